"""Exact removal of repeated byte strings by a collection suffix order.

Candidates. Every window of ``window`` bytes is keyed by the hash of one k-byte piece of it, chosen by its
content alone (the leftmost least hash), and consecutive windows with the same piece form a segment.
Equal windows have equal keys, so a segment whose key occurs once holds no repeat, and where all segments
of a key are equal all their windows repeat. Only the distinct segments of the other keys are sorted. A key
with very many of them (a common line, say, in ever other surroundings) is split by keying its segments anew
with a longer piece, at last by the whole window.

Sorting. A collection of segments is indexed column by column: each round inserts one more symbol of
every segment, from its end, into the collection's Burrows-Wheeler transform and renews the common
prefixes at the places of insertion: two neighbours of one symbol share one symbol more than the least common
prefix between the places of what follows them. The transform is held as the sorted occurrences (symbol, place), in which the
index of an entry is the order of the suffix it begins. A symbol is ``PACK`` bytes: each segment is taken
at PACK shifts, so that a window of any start is a whole number of symbols, and rounds are PACK times fewer.
A collection is bounded and its tables are arrays read and written in sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import materialize, numbered

WINDOW = 200
PIECE = 64
PACK = 8
#: Suffixes of a collection at which the next key starts a new one.
BATCH = 400_000
#: A key with more distinct segments than this is split by a longer piece.
HOT = 4000
_CHUNK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.int64((1 << 32) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Segmenter:
    """Splits texts into keyed segments, with tables made once in each process."""

    _made: dict[tuple[int, int], Segmenter] = {}

    def __init__(self, window: int, piece: int) -> None:
        self.window, self.piece, self.width = window, piece, window - piece + 1
        n = _CHUNK + 2 * window
        self.value = np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    @classmethod
    def get(cls, window: int, piece: int) -> Segmenter:
        if (window, piece) not in cls._made:
            cls._made[window, piece] = cls(window, piece)
        return cls._made[window, piece]

    def _chunk(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k, w = len(b), self.piece, self.width
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.value[b] * self.up[:n], out=total[1:])
        h = (total[k:] - total[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        m = len(h)
        # least of each w neighbours, from running minima within blocks of w
        padded = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:m] = (h & ~_PLACE) | np.arange(m, dtype=np.uint64)
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - w + 1
        at = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        last = np.concatenate((first[1:], [windows]))
        return h[at[first]].view(np.int64), first, last + self.window - 1

    def split(self, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, starts, ends) of the segments of ``raw``, by chunks that share no window."""
        b = np.frombuffer(raw, dtype=np.uint8)
        for i in range(0, max(0, len(b) - self.window + 1), _CHUNK):
            keys, starts, ends = self._chunk(b[i : i + _CHUNK + self.window - 1])
            yield keys, starts + i, ends + i


class RangeLeast:
    """Least values of ranges of an array, from the least of every run of 1, 2, 4, ... entries."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.runs = [values]
        step = 1
        while 2 * step <= longest:
            last = self.runs[-1]
            self.runs.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values[first..last], ends included, for each pair."""
        out = np.empty(len(first), dtype=self.runs[0].dtype)
        level = np.frexp(last - first + 1)[1] - 1
        for k in np.unique(level):
            these = level == k
            run = self.runs[k]
            out[these] = np.minimum(run[first[these]], run[last[these] - (1 << int(k)) + 1])
        return out


def collection_tables(words: np.ndarray, ends: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of a collection and its common prefixes, column by column.

    ``words`` holds the symbols of all strings (dense ids, concatenated), ``ends`` the end and
    ``lengths`` the length of each. Returns (order, common): the start in ``words`` of each suffix in
    order, and how many symbols, up to ``most``, it shares with the one before it.
    """
    m = len(ends)
    kind = np.uint8 if most < 256 else np.int32
    occ = np.empty(0, dtype=np.int64)  # symbol << 32 | place of what follows it, sorted
    order = np.empty(0, dtype=np.int64)
    common = np.zeros(m, dtype=kind)  # the empty suffixes, one of each string, come first
    place = np.arange(m, dtype=np.int64)  # of each string's suffix so far
    longest_first = np.argsort(-lengths, kind="stable")
    sorted_lengths = -lengths[longest_first]
    for column in range(1, int(lengths.max(initial=0)) + 1):
        active = longest_first[: np.searchsorted(sorted_lengths, -column, side="right")]
        start = ends[active] - column
        key = (words[start] << 32) | place[active]
        by = np.argsort(key)
        key, active, start = key[by], active[by], start[by]
        into = np.searchsorted(occ, key)
        at = into + np.arange(len(key))
        n = len(occ)
        old = np.ones(n + len(key), dtype=bool)
        old[at] = False
        merged = np.empty(n + len(key), dtype=np.int64)
        merged[old], merged[at] = occ, key
        # common prefixes change only at what came in and at what now follows it
        touched = np.concatenate((at, at[at + 1 < len(merged)] + 1))
        touched = touched[touched > 0]
        touched = touched[(merged[touched] >> 32) == (merged[touched - 1] >> 32)]
        first, last = (merged[touched - 1] & _LOW) + 1, merged[touched] & _LOW
        renewed = np.zeros(m + len(merged), dtype=kind)
        renewed[m:][old] = common[m:]
        renewed[m + at] = 0
        renewed[m + at[at + 1 < len(merged)] + 1] = 0
        if len(touched):
            least = RangeLeast(common, int((last - first).max()) + 1)(first, last)
            renewed[m + touched] = np.minimum(least, most - 1) + 1
        common = renewed
        moved = np.zeros(m + n, dtype=np.int64)
        np.cumsum(np.bincount(into, minlength=n + 1)[:n], out=moved[m:])
        merged += moved[merged & _LOW]
        occ = merged
        suffix = np.empty_like(occ)
        suffix[old], suffix[at] = order, start
        order = suffix
        place[active] = m + at
    return order, common[m:]


def collection_order(words: np.ndarray, ends: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of a collection, and whether each suffix shares ``depth`` symbols with the one before it."""
    order, common = collection_tables(words, ends, lengths, depth)
    return order, common >= depth


def repeated_windows(strings: list[bytes], window: int = WINDOW, pack: int = PACK) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every window of the strings that occurs in them more than once, in order."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(strings) + b"\0" * pack, dtype=np.uint8)
    of, shift = np.divmod(np.arange(len(strings) * pack), pack)
    lengths = (sizes[of] - shift) // pack
    keep = sizes[of] - shift >= window
    of, shift, lengths = of[keep], shift[keep], lengths[keep]
    if not len(of):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    within = np.arange(int(ends[-1])) - np.repeat(ends - lengths, lengths)
    address = np.repeat(starts[of] + shift, lengths) + pack * within
    piece = np.ndarray((len(raw) - pack + 1,), dtype=f"<u{pack}", buffer=raw.data, strides=(1,))
    _, words = np.unique(piece[address], return_inverse=True)
    order, common = collection_order(words.astype(np.int64), ends, lengths, window // pack)
    found = common.copy()
    found[:-1] |= common[1:]
    byte = np.sort(address[order[found]])
    which = np.searchsorted(starts, byte, side="right") - 1
    return which, byte - starts[which]


def spans(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by windows at the sorted ``starts``."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(starts[1:] > starts[:-1] + window) + 1
    return starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))] + window


def _segments(docs: DataFrame, window: int, piece: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Segmenter.get(window, piece).split
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for keys, starts, ends in split(raw):
                    digests = np.array([digest(raw[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), key)), pa.array(keys), pa.array(digests), pa.array(starts), pa.array((ends - starts).astype(np.int32))],
                        names=["k", "anchor", "digest", "start", "size"],
                    )

    return docs.mapInArrow(run, "k bigint, anchor bigint, digest bigint, start bigint, size int")


def _sorted_windows(strings: DataFrame, window: int, batch: int) -> DataFrame:
    """(anchor, digest, from, to): covered spans of the distinct strings (anchor, digest, raw) of each key."""

    def settle(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        which, at = repeated_windows([x[2] for x in held], window)
        edges = np.searchsorted(which, np.arange(len(held) + 1))
        rows: list[list] = [[], [], [], []]
        for i in np.unique(which).tolist():
            a, b = spans(at[edges[i] : edges[i + 1]], window)
            for col, values in zip(rows, ([held[i][0]] * len(a), [held[i][1]] * len(a), a.tolist(), b.tolist()), strict=True):
                col += values
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["anchor", "digest", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if row[:2] == last:
                    continue  # the same row of the input twice
                if held and row[0] != last[0] and size >= batch:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
                last = row[:2]
        if held:
            yield settle(held)

    dealt = strings.select("anchor", "digest", "raw").repartition("anchor").sortWithinPartitions("anchor", "digest")
    return dealt.mapInArrow(run, "anchor bigint, digest bigint, from bigint, to bigint")


def _keyed(docs: DataFrame, doc_id: str) -> DataFrame:
    """``docs`` with k, which tells rows apart: the id where ids are integers, all there and distinct, which saves a copy
    of the texts, else a number of each row of a written copy."""
    ids = docs.select(F.col(doc_id).alias("i"))
    n, there, least = ids.groupBy("i").count().agg(F.sum("count"), F.count("i"), F.max(F.col("i").isNull())).first()
    unique = (n or 0) == there and not least and docs.schema[doc_id].dataType.typeName() in ("long", "integer", "short", "byte")
    return docs.withColumn("__row", F.col(doc_id).cast("bigint")) if unique else numbered(docs, "suffix-docs")


def longer_piece(piece: int, window: int) -> int:
    """The piece by which a key is split that a piece of ``piece`` bytes leaves too common: half-way to the
    window, then the window itself."""
    half = (window - piece) // 2
    return piece + half if half >= 32 else window


def repeated_spans(keyed: DataFrame, window: int = WINDOW, piece: int = PIECE, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """(k, spans): for each document of (k, text) with a repeat, its covered spans [from, to), unmerged."""
    segments = materialize(_segments(keyed.select("k", "text"), window, piece), "suffix-segments")
    # tables of their own, so that joins have plain exchanges on both sides and a common key's rows are split
    keys = segments.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("mixed")).filter("n > 1")
    keys = materialize(keys.select("anchor", "mixed"), "suffix-keys")
    hits = materialize(segments.join(keys, "anchor"), "suffix-hits")
    distinct = hits.filter("mixed").groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("k", "start", "size")).alias("one"))
    distinct = materialize(distinct.select("anchor", "digest", "n", "one.*"), "suffix-distinct")
    many = distinct.groupBy("anchor").count().filter(F.col("count") > (hot if piece < window else 1 << 62))
    many = materialize(many.select("anchor", F.lit(True).alias("hot")), "suffix-many")
    wanted = distinct.join(many, "anchor", "left").select("k", F.struct("anchor", "digest", "start", "size", F.coalesce("hot", F.lit(False)).alias("hot")).alias("s"))
    wanted = wanted.groupBy("k").agg(F.collect_list("s").alias("s"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, wants in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                cols = list(zip(*((w["anchor"], w["digest"], w["hot"], raw[w["start"] : w["start"] + w["size"]]) for w in wants), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["anchor", "digest", "hot", "raw"])

    strings = keyed.join(wanted, "k").select("text", "s").mapInArrow(cut, "anchor bigint, digest bigint, hot boolean, raw binary")
    strings = materialize(strings.withColumn("k", F.monotonically_increasing_id()), "suffix-strings")
    parts = _sorted_windows(strings.filter("not hot"), window, batch)
    if many.take(1):
        # equal windows lie in segments of one key: keyed anew, those of hot keys are documents of their own
        split = repeated_spans(strings.filter("hot").select("k", F.col("raw").alias("text")), window, longer_piece(piece, window), batch, hot)
        split = strings.filter("hot").select("k", "anchor", "digest").join(split.select("k", F.explode("spans").alias("s")), "k")
        parts = parts.unionByName(split.select("anchor", "digest", "s.from", "s.to"))
    # a segment that occurs twice as a whole repeats as a whole
    whole = distinct.filter("n > 1").select("anchor", "digest", F.lit(0).cast("bigint").alias("from"), F.col("size").cast("bigint").alias("to"))
    parts = materialize(parts.unionByName(whole), "suffix-parts")
    mixed = hits.filter("mixed").join(parts, ["anchor", "digest"]).select("k", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"))
    same = hits.filter("not mixed").select("k", F.col("start").alias("from"), (F.col("start") + F.col("size")).alias("to"))
    found = mixed.unionByName(same).distinct()
    return found.groupBy("k").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, piece: int = PIECE, batch: int = BATCH, hot: int = HOT, kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, row]) per row of ``docs``: every byte that is
    covered by a ``window``-byte string which also starts anywhere else in the collection is removed.

    Texts are their UTF-8 bytes, a null text has none; matches never cross rows, overlaps count, and strings
    are judged on the input. Segments are told apart by 128 bits of hashes (key and digest), not byte by byte. A text shorter than ``window`` stays as it is; rows that repeat
    each other are copies like any others. ``kept``: the remaining bytes as a text, where a character that
    lost some of its bytes goes (null stays null), and all other columns of ``docs`` in a struct.
    """
    names = [F.col("__row").alias("k"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")]
    told = _keyed(docs, doc_id)
    found = materialize(repeated_spans(told.select(*names), window, piece, batch, hot), "suffix-spans")
    keyed = told.select(*names, *([F.struct(*[c for c in docs.columns if c != text]).alias("row")] if kept else []))
    rows = keyed.join(found, "k", "left").select("doc_id", "text", "spans", *["row"] * kept)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * kept]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), *[T.StringType()] * kept]
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, t) for n, t in zip(names[1:], kinds, strict=True)], *([rows.schema["row"]] if kept else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for text, got in zip(b.column(1), b.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                removed = n = 0
                rest = raw
                if got.is_valid and len(got):
                    pairs = got.values
                    a = pairs.field("from").to_numpy(zero_copy_only=False)
                    z = pairs.field("to").to_numpy(zero_copy_only=False)
                    by = np.argsort(a, kind="stable")
                    a, z = a[by], np.maximum.accumulate(z[by])
                    cut = np.flatnonzero(a[1:] > z[:-1]) + 1
                    froms, tos = a[np.concatenate(([0], cut))].tolist(), z[np.concatenate((cut - 1, [len(z) - 1]))].tolist()
                    n, removed = len(froms), sum(tos) - sum(froms)
                    rest = b"".join(raw[i:j] for i, j in zip([0, *tos], [*froms, len(raw)], strict=True))
                values = (len(raw), removed, n, hashlib.sha256(rest).hexdigest(), (rest.decode("utf-8", "ignore") if text.is_valid else None))
                for col, v in zip(cols, values, strict=False):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, *([b.column(3)] if kept else [])], names=[*names, *["row"] * kept])

    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated bytes taken out of its texts, and ``n_chars`` (where it is a column)
    counted anew. Rows stay, also where no text is left."""
    d = remove_repeats(docs, doc_id, text, window, kept=True)
    new = {text: F.col("kept"), n_chars: F.length("kept").cast("bigint")}
    return d.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
