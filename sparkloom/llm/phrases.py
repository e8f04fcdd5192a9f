"""Phrase collocations by hierarchical pair naming.

Texts are gathered into blocks of one language, in which a word is an index into the block's own list of distinct items.
Level by level, the items of all blocks are counted together, the frequent ones get an id (their name), and the block
replaces its items by these names, anything else by a break. Two adjacent names of k-word phrases are a phrase of k + 1
words, an item of the next level, so a level costs a row for each distinct pair of a block, not for each occurrence, and
only pairs of frequent phrases are ever counted. The table of names keeps both halves of each pair: these parent pointers
give the counts of every cut's parts and the phrases that a longer one contains.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, remove, written

LEAST = 30
LONGEST = 4
TOP = 2000
#: Words at which a block is closed, and bytes of texts that are split into words at once.
BLOCK, SLICE = 1 << 20, 4 << 20
#: Candidates of a language that one task ranks.
RANKED = 200_000
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0x0A if c in _BREAKS else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def split_words(texts: pa.Array) -> pa.Array:
    """The words of all texts in order, with "\\n" before each text and where a piece ends, and some empty strings."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    lowered = (data.to_pybytes() if data else b"").translate(_TABLE)
    texts = pa.LargeStringArray.from_buffers(len(filled), pa.py_buffer(offsets.tobytes()), pa.py_buffer(lowered))
    spaced = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(texts, "\n", " \n "), pa.scalar(" ", pa.large_string()))
    return pc.split_pattern(spaced, " ").flatten()


def squeeze(seq: np.ndarray) -> np.ndarray:
    """One break in place of each run of them."""
    if not len(seq):
        return seq
    stay = seq >= 0
    stay[1:] |= seq[:-1] >= 0
    return seq[stay]


def word_block(words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(sequence of indices with -1 for breaks, distinct words, their counts) of split words."""
    coded = words.dictionary_encode()
    entries = coded.dictionary
    real = pc.and_(pc.not_equal(entries, ""), pc.not_equal(entries, "\n")).to_numpy(zero_copy_only=False)
    index = np.where(real, np.cumsum(real) - 1, -1).astype(np.int32)
    index[~real & (pc.equal(entries, "").to_numpy(zero_copy_only=False))] = -2
    seq = index[coded.indices.to_numpy()]
    seq = squeeze(seq[seq > -2])
    return seq, entries.filter(pa.array(real)), np.bincount(seq[seq >= 0], minlength=int(real.sum()))


def pair_block(seq: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence of pairs, lefts, rights, counts) of the adjacent items of a sequence of indices into ``names``."""
    m = max(1, len(names))
    a, b = seq[:-1].astype(np.int64), seq[1:]
    ok = (a >= 0) & (b >= 0)
    pairs, inverse, counts = np.unique(a[ok] * m + b[ok], return_inverse=True, return_counts=True)
    following = np.full(len(ok), -1, dtype=np.int32)
    following[ok] = inverse
    return following, names[pairs // m], names[pairs % m], counts


def named_block(seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sequence in which item ``at[i]`` is i, and every other one a break."""
    known = np.full(int(seq.max(initial=-1)) + 2, -1, dtype=np.int32)  # the last one is for breaks
    known[at] = np.arange(len(at))
    return squeeze(known[seq])


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=kind)


def _word_blocks(docs: DataFrame, lang: str, text: str, block: int) -> DataFrame:
    """(block, lang, seq, words, counts), each block of whole texts of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}
        made = 0

        def close(of: str) -> pa.RecordBatch:
            nonlocal made
            seq, words, counts = word_block(pa.concat_arrays(held.pop(of)))
            del size[of]
            made += 1
            columns = [[(TaskContext.get().partitionId() << 32) + made], [of], [_packed(seq)], pa.array([words.cast(pa.string())], pa.list_(pa.string())), [_packed(counts)]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "lang", "seq", "words", "counts"])

        for b in batches:
            for of in pc.unique(b.column(0)).to_pylist():
                texts = b.column(1).filter(pc.equal(b.column(0), of))
                ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                at = 0
                while at < len(texts):  # whole texts, so no phrase is cut
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
                    words = split_words(texts[at:to])
                    held.setdefault(of, []).append(words)
                    size[of] = size.get(of, 0) + len(words)
                    at = to
                    if size[of] >= block:
                        yield close(of)
                if sum(size.values()) >= 2 * block:
                    yield close(max(size, key=size.get))
        for of in list(held):
            yield close(of)

    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text)).mapInArrow(run, "block bigint, lang string, seq binary, words array<string>, counts binary")


def _word_items(blocks: DataFrame) -> DataFrame:
    """(block, pos, lang, phrase, c): a row for each distinct word of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, lang, words, raw in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                n = len(words.values)
                columns = [pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), pa.array([lang.as_py()]).take(pa.array(np.zeros(n, dtype=np.int64))), words.values, pa.array(_unpacked(raw, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "pos", "lang", "phrase", "c"])

    return blocks.select("block", "lang", "words", "counts").mapInArrow(run, "block bigint, pos int, lang string, phrase string, c bigint")


def _pair_items(blocks: DataFrame) -> DataFrame:
    """(block, pos, left, right, c): a row for each distinct pair of a block (block, seq, names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, seq, names in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                _, *sides, counts = pair_block(_unpacked(seq.as_py(), np.int32), _unpacked(names.as_py(), np.int64))
                columns = [np.full(len(counts), number), np.arange(len(counts), dtype=np.int32), *sides, counts]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "pos", "left", "right", "c"])

    return blocks.mapInArrow(run, "block bigint, pos int, left bigint, right bigint, c bigint")


def _named(items: DataFrame, by: list[str], least: int, level: int) -> DataFrame:
    """(block, pos, *by, f, id, first): the items that occur ``least`` times in all blocks, and their names, written;
    ``first`` is set in one row of each. Items are dealt once, and a common one has a row for each of its blocks only."""
    each = Window.partitionBy(*by)
    often = items.withColumn("f", F.sum("c").over(each)).filter(F.col("f") >= least)
    marked = often.withColumn("n", F.monotonically_increasing_id()).withColumn("id", F.min("n").over(each))
    return materialize(marked.select("block", "pos", *by, "f", "id", (F.col("n") == F.col("id")).alias("first")), f"phrase-names-{level}")


def _named_blocks(blocks: DataFrame, names: DataFrame, pairs: bool) -> tuple[DataFrame, str]:
    """(block, seq, names) of the next level, written, and where: the items of ``blocks``, which are its words or the
    pairs of its names, under the names that ``names`` has for them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        seq = _unpacked(left["seq"][0].as_py(), np.int32)
        if pairs:
            seq = pair_block(seq, _unpacked(left["names"][0].as_py(), np.int64))[0]
        made = [_packed(named_block(seq, right["pos"].to_numpy())), _packed(right["id"].to_numpy().astype(np.int64))]
        return pa.Table.from_arrays([left["block"].combine_chunks(), *(pa.array([m]) for m in made)], names=["block", "seq", "names"])

    known = names.select(F.col("block").alias("of"), "pos", "id").groupBy("of")
    made = blocks.select("block", "seq", *["names"] * pairs).groupBy("block").cogroup(known)
    return written(made.applyInArrow(run, "block bigint, seq binary, names binary"), "phrase-blocks")


def phrase_names(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, block: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n): words of each language; for each length from 1, the phrases with ``least`` occurrences: (id, lang,
    phrase, last, f, left, right, heads, tails)), where left and right are the ids of the phrase without its last and its
    first word, ``last`` is its last word, and heads and tails hold the counts of its first and last 1, 2, ... words."""
    spark = docs.sparkSession
    blocks, path = written(_word_blocks(docs, lang, text, block), "phrase-blocks")
    totals = materialize(_word_items(blocks).groupBy("lang").agg(F.sum("c").alias("n")), "phrase-totals")
    named = _named(_word_items(blocks), ["lang", "phrase"], least, 1)
    null = F.lit(None).cast("bigint")
    found = [named.filter("first").select("id", "lang", "phrase", F.col("phrase").alias("last"), "f", null.alias("left"), null.alias("right"), F.array("f").alias("heads"), F.array("f").alias("tails"))]
    for level in range(2, longest + 1):
        blocks, next_path = _named_blocks(blocks, named, level > 2)
        remove(spark, path)
        path = next_path
        named = _named(_pair_items(blocks), ["left", "right"], least, level)
        first = found[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.col("heads").alias("h"))
        rest = found[-1].select(F.col("id").alias("right"), "last", F.col("tails").alias("t"))
        whole = named.filter("first").select("id", "left", "right", "f").join(first, "left").join(rest, "right")
        whole = whole.select("id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", "left", "right", F.concat("h", F.array("f")).alias("heads"), F.concat("t", F.array("f")).alias("tails"))
        found.append(materialize(whole, f"phrase-table-{level}"))
    return totals, found


def scored(phrases: DataFrame, words: int) -> DataFrame:
    """Phrases of ``words`` words with the score of their lowest cut, ties to the earliest, and its parts' counts l, r."""
    cuts = [
        f"struct((2000000 * cast(f as decimal(20,0))) div (cast(heads[{k - 1}] as decimal(20,0)) + tails[{words - k - 1}]) as score, {k} as k, heads[{k - 1}] as l, tails[{words - k - 1}] as r)"
        for k in range(1, words)
    ]
    return phrases.select("id", "lang", "phrase", F.col("f").alias("a"), F.expr(f"array_min(array({', '.join(cuts)}))").alias("cut")).select("id", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language.

    A phrase goes where a longer candidate that contains it has 80 of 100 of its occurrences at least. It is enough to
    look at phrases one word longer: those inside a longer one are as frequent as that at least. A null language is
    ``und``; null and empty texts have no words; ids play no part, repeated rows count as often as they occur; a table
    without rows, or without frequent phrases, gives none. Texts of any length are read whole.
    """
    totals, names = phrase_names(docs, lang, text, least, longest, block)
    kept = None
    for words in range(2, longest + 1):
        found = scored(names[words - 1], words)
        if words < longest:
            longer = names[words].select(F.col("left").alias("id"), "f").unionByName(names[words].select(F.col("right").alias("id"), "f"))
            most = longer.groupBy("id").agg(F.max("f").alias("most"))
            found = found.join(most, "id", "left").filter("most is null or 100 * cast(most as decimal(20,0)) < 80 * cast(a as decimal(20,0))").drop("most")
        found = found.drop("id")
        kept = found if kept is None else kept.unionByName(found)
    kept = materialize(kept, "phrase-candidates")
    # a language's candidates are ranked in parts, then the best of the parts together
    parts = 1 + kept.count() // RANKED
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rank = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*best))
    first = kept.withColumn("i", rank).filter(F.col("i") <= top).drop("i")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
