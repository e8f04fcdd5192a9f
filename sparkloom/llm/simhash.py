"""SimHash near-duplicates: exact links at a Hamming radius, by tiled comparison.

Distinct fingerprints are packed into tiles by the population counts of their four 16-bit blocks, a
tile holding a bounded number of them. The blocks' counts of two fingerprints differ in sum by no more than
the fingerprints do in bits, so a pair of tiles whose counts differ by more than the radius is skipped; every other
pair is compared in full, by exclusive-or and bit counts over numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, numbered
from .components import connected_components

RADIUS = 2
WORDS = 3
SEED = 42
BLOCKS = 4
TILE = 2048
#: Tiles of a key that are compared with as many of another in one place.
GROUP = 8
_AT_ONCE = 1 << 16


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text; 0 without a word."""
    # bytes.lower() and bytes.split() know ASCII only, as the word rule does
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        ones += np.unpackbits(hashes[i : i + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((simhash(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, T.StructType([d.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _nearby(radius: int) -> list[int]:
    """Differences of packed block counts that a pair within the radius can have, the second tile not
    before the first."""
    reach = range(-radius, radius + 1)
    steps = [d for d in product(reach, repeat=BLOCKS) if sum(map(abs, d)) <= radius]
    packed = [sum(x << (8 * (BLOCKS - 1 - i)) for i, x in enumerate(d)) for d in steps]
    return sorted(p for p in packed if p >= 0)


def _stars(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles: each linked value with another of its group.

    Rows are compared in strips, and a strip's matches are merged into running labels at once, so that a
    tile full of near copies makes no list of all its pairs."""
    values = a if same else np.concatenate((a, b))
    off = 0 if same else len(a)
    label = np.arange(len(values))
    strip = max(1, (1 << 20) // max(1, len(b)))
    for i in range(0, len(a), strip):
        near = np.bitwise_count(a[i : i + strip, None] ^ b[None, :]) <= radius
        u, v = np.nonzero(near)
        u, v = u + i, v + off
        keep = u != v
        u, v = u[keep], v[keep]
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    while (label[label] != label).any():
        label = label[label]
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """(u, v) edges over the distinct bigint column ``fp`` whose components are those of all pairs at
    ``radius`` or fewer bits: each pair of tiles yields a spanning forest of its links."""
    key = sum((F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("bigint") * (1 << (8 * i)) for i in range(1, BLOCKS)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFF))).cast("bigint"))
    keyed = prints.select("fp", key.alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("parts"))
    sizes = materialize(sizes, "simhash-keys")
    tiles = (
        keyed.join(sizes, "key")
        .groupBy("key", F.pmod(F.xxhash64("fp"), "parts").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = materialize(tiles, "simhash-tiles")
    steps = F.array(*[F.lit(x).cast("bigint") for x in _nearby(radius)])
    pairs = sizes.select("key", "parts", F.explode(F.transform(steps, lambda x: F.col("key") + x)).alias("key2"))
    pairs = materialize(pairs.join(sizes.select(F.col("key").alias("key2"), F.col("parts").alias("parts2")), "key2"), "simhash-pairs")
    # the tiles of a key are dealt in groups, and a place compares one group of each key: the most common
    # key's pairs, whose number is the square of its tiles, are spread over many places
    groups = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(parts) - 1) / group)))
    left = tiles.select("key", "part", F.col("fps").alias("a"), F.floor(F.col("part") / group).alias("group"))
    left = left.join(pairs.select("key", "key2", "parts2"), "key").withColumn("group2", groups("parts2")).filter("key != key2 or group <= group2")
    right = tiles.select(F.col("key").alias("key2"), F.col("part").alias("part2"), F.col("fps").alias("b"), F.floor(F.col("part") / group).alias("group2"))
    right = right.join(pairs.select("key", "key2", "parts"), "key2").withColumn("group", groups("parts")).filter("key != key2 or group <= group2")
    both = left.drop("parts2").join(right.drop("parts"), ["key", "group", "key2", "group2"]).filter("key != key2 or part <= part2")
    both = both.select("a", "b", ((F.col("key") == F.col("key2")) & (F.col("part") == F.col("part2"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                u, v = _stars(np.asarray(a.values).view(np.uint64), np.asarray(b.values).view(np.uint64), same.as_py(), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return both.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: ``component_id`` is the smallest id reachable over links of
    ``radius`` or fewer differing bits, itself included.

    Null, empty and blank texts have fingerprint 0 and link like any other; equal fingerprints are one node,
    so copies cost nothing more. Ids are of any one ordered type. A null id keeps its row and gets the component
    of its fingerprint (null if no id reaches it); rows that repeat an id each have their own fingerprint, and
    the id stands for all of them. Texts are read whole, of any length. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    prints = materialize(fingerprints(docs, doc_id, text), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = connected_components(links(distinct, radius, tile))
    roots = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    roots = materialize(roots, "simhash-roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(roots.join(least, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates, by row and not by id: repeated and
    null ids are rows like any others."""
    rows = numbered(docs, "simhash-rows")
    found = near_duplicates(rows, "__row", text, radius, tile)
    first = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*docs.columns)
