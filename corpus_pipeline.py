"""The corpus pipeline: stages over documents, each written as Parquet before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bpe import encode_documents
from sparkloom.llm.common import materialize, read_table
from sparkloom.llm.mixing import mixed_rows
from sparkloom.llm.quality_rules import keep_good
from sparkloom.llm.simhash import keep_one
from sparkloom.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go.

    Null, empty and short texts fail the rules; repeated rows are judged alike and all stay or go; null languages and
    sources are groups of their own. An empty table stays empty; other columns, whatever their names, are kept.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays.

    Rows are told apart by themselves, not by ids: null and repeated ids are rows like any others, of equal texts one
    row stays. Texts without a word have one fingerprint and are one group. Other columns are kept.
    """
    return keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 200 that occur again anywhere leave the texts.

    All rows stay, also those of which nothing is left; a null text stays null; texts of any length are read whole, and
    repeated ids do not mix rows up. ``n_chars`` is counted anew, other columns are kept.
    """
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix to the sources' target weights takes it.

    A null source is a source of its own; a text without a word is never taken. Reruns agree, ties are broken by a
    seeded digest of the id, then the id, the size and a digest of the text and the other columns. Columns are those of the input.
    """
    return mixed_rows(docs, F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests, a row per row of the mix.

    A null text has no token and the digests of nothing; repeated rows give repeated results.
    """
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("mixing sources", mix),
    ("byte-level BPE", encode),
]

#: The outlier, component and mixing stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
