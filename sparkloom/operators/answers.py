"""Parsing of models' answers over tables, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import combined_tags, sanitize_summary


def _mapped(rows: DataFrame, key: str, columns: list[str], parse, schema: str) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    names = [key, *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *parse(*rest)) for k, *rest in b.itertuples(index=False)], columns=names)

    return rows.select(key, *columns).mapInPandas(run, f"{key} {kind}, {schema}")


def parse_arrays(rows: DataFrame, key: str, raw: str = "raw", expected: str = "expected") -> DataFrame:
    """(key, items): the tag lists of an answer of ``expected`` lists, null where it has not as many."""
    return _mapped(rows, key, [raw, expected], lambda t, n: (A.json_array(t, int(n)),), "items array<array<string>>")


def parse_structured(rows: DataFrame, key: str, raw: str = "raw", most: int = 600) -> DataFrame:
    """(key, summary, key_topics, notable_terms, child_overview); all null where the answer is no such object or its
    summary is refused."""

    def parse(text):
        found = A.structured(text)
        return tuple(found.values()) if found else (None,) * 4

    d = _mapped(rows, key, [raw], parse, "summary string, key_topics array<string>, notable_terms array<string>, child_overview array<string>")
    d = d.withColumn("summary", sanitize_summary(F.col("summary"), most))
    good = F.col("summary").isNotNull()
    return d.select(key, "summary", *[F.when(good, F.col(c)).alias(c) for c in ("key_topics", "notable_terms", "child_overview")])


def parse_combined(rows: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """(key, context, tags) of a combined answer, its tags in normal form."""

    def parse(text):
        found = A.combined(text)
        return (found["context"], found["tags"]) if found else (None, None)

    d = _mapped(rows, key, [raw], parse, "context string, tags array<string>")
    return d.select(key, "context", combined_tags(F.col("tags")).alias("tags"))
