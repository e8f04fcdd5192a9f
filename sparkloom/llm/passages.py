"""Removal of passages of words that an earlier document has, by suffix automata of reference shards.

Candidates. Every window of consecutive words is keyed by one short piece of it, chosen by its content alone (the leftmost
least hash); consecutive windows with the same piece form a segment. Equal windows have equal keys, so segments whose key
occurs once are settled, and of each key only the distinct segments go on, with the least id that holds each.

Reference shards. Keys are dealt to shards of a bounded number of words. The distinct segments of a shard are its
reference: they make one suffix automaton over words, in which a state knows the least id that holds its strings, and
stream through it: matching statistics cut at the window's length tell for each window where the earliest equal one
starts. Only segments of the shard's keys can match there, so a shard's automaton goes to these, not to every task: the
reference is all documents, and no part of it that every task would hold has a bounded size. A key with too many words
for a shard is split beforehand, by keying its segments anew with a longer piece, at last by the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, numbered, remove, written

WINDOW = 13
PIECE = 4
#: Words of an automaton's reference on average, and words of distinct segments from which a key is split.
SHARD, HOT = 100_000, 50_000
_PLACE = np.uint64((1 << 26) - 1)
_STEP = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once, a random odd number for each byte, and which bytes part words.
_RUN = 1 << 20
_VALUE = np.random.default_rng(21).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, number of words of each text). A hash is the polynomial of the word's
    bytes, each by a random odd number, mixed with its length."""
    filled = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    b = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    inside = np.zeros(len(b) + 1, dtype=bool)
    inside[:-1] = ~_WHITE[b]
    start, end = inside[:-1].copy(), inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    end &= ~inside[1:]
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(b))]  # words of two texts may touch
    start[border] = inside[border]
    end[border - 1] = inside[border - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = Powers.upto(_RUN)
    hashes = np.empty(len(first), dtype=np.uint64)
    at = 0
    while at < len(first):  # by runs of about as many bytes as there are powers
        to = max(at + 1, int(np.searchsorted(last, first[at] + _RUN, side="right")))
        n = int(last[to - 1] - first[at])
        if n > len(up):
            up, down = Powers.upto(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[b[first[at] : last[to - 1]]] * up[:n], out=total[1:])
        i, j = first[at:to] - first[at], last[at:to] - first[at]
        hashes[at:to] = mixed((total[j] - total[i]) * down[i] + (j - i).astype(np.uint64))
        at = to
    return hashes, np.diff(np.searchsorted(first, offsets))


class Powers:
    """Powers of a step and of its inverse, as many as were ever asked for."""

    up = np.empty(0, dtype=np.uint64)
    down = np.empty(0, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, step in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
                steps = np.full(n, step, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def segments(words: np.ndarray, counts: np.ndarray, window: int, piece: int) -> tuple[np.ndarray, ...]:
    """(text, start, size, key, digest) of the segments of texts whose word hashes are ``words``, end to end."""
    n, width = len(words), window - piece + 1
    none = np.empty(0, dtype=np.int64)
    if n < window:
        return none, none, none, none, none
    up, down = Powers.upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    pieces = mixed((total[piece:] - total[:-piece]) * down[: n - piece + 1])
    least = (pieces & ~_PLACE) | np.arange(len(pieces), dtype=np.uint64)
    have = 1
    while have < width:  # least of runs of 1, 2, 4, ... pieces, at last of ``width``
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & _PLACE).astype(np.int64)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts)[: len(at)] - np.arange(len(at))  # words from here to the text's end
    good = np.flatnonzero(left >= window)
    if not len(good):
        return none, none, none, none, none
    cut = np.flatnonzero((np.diff(good) > 1) | (np.diff(at[good]) != 0)) + 1
    first = good[np.concatenate(([0], cut))]
    to = good[np.concatenate((cut - 1, [len(good) - 1]))] + window
    text = np.searchsorted(ends, first, side="right")
    digest = mixed((total[to] - total[first]) * down[first] + (to - first).astype(np.uint64))
    return text, first - (ends - counts)[text], to - first, pieces[at[first]].view(np.int64), digest.view(np.int64)


class Automaton:
    """A suffix automaton of several strings of symbols, as arrays: transitions sorted by (state, symbol), and for each
    state its longest length, its suffix link and the rank of the first holder of its strings."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, length: np.ndarray, link: np.ndarray, holder: np.ndarray, symbols: int) -> None:
        self.keys, self.targets, self.length, self.link, self.holder, self.symbols = keys, targets, length, link, holder, symbols

    @classmethod
    def of(cls, strings: list[list[int]], ranks: list[int], symbols: int) -> Automaton:
        """Of strings over 0..symbols - 1, each with its holder's rank, which never falls from one string to the next."""
        step, link, length, holder = [{}], [-1], [0], [1 << 62]

        def copied(to: int, n: int, p: int, c: int) -> int:
            """A copy of state ``to`` for its strings of up to ``n`` symbols, to which p and its suffixes lead by c."""
            copy = len(step)
            step.append(step[to].copy())
            length.append(n)
            link.append(link[to])
            holder.append(holder[to])
            link[to] = copy
            while p >= 0 and step[p].get(c) == to:
                step[p][c] = copy
                p = link[p]
            return copy

        for string, rank in zip(strings, ranks, strict=True):
            last = n = 0
            for c in string:
                out = step[last]
                to = out.get(c)
                n = length[last] + 1
                if to is not None:
                    last = to if length[to] == n else copied(to, n, last, c)
                    continue
                new = len(step)
                step.append({})
                length.append(n)
                holder.append(rank)
                link.append(0)
                p = last
                while to is None:
                    out[c] = new
                    p = link[p]
                    if p < 0:
                        break
                    out = step[p]
                    to = out.get(c)
                else:
                    n = length[p] + 1
                    link[new] = to if length[to] == n else copied(to, n, p, c)
                last = new
        lengths, links, held = np.array(length, dtype=np.int32), np.array(link, dtype=np.int32), np.array(holder, dtype=np.int64)
        longest_first = np.argsort(-lengths, kind="stable")[:-1]
        for these in np.split(longest_first, np.flatnonzero(np.diff(lengths[longest_first])) + 1):
            np.minimum.at(held, links[these], held[these])  # a suffix is held wherever the longer string is
        sizes = np.fromiter(map(len, step), dtype=np.int64, count=len(step))
        m = int(sizes.sum())
        keys = np.repeat(np.arange(len(step)), sizes) * symbols + np.fromiter(chain.from_iterable(step), dtype=np.int64, count=m)
        targets = np.fromiter(chain.from_iterable(d.values() for d in step), dtype=np.int32, count=m)
        by = np.argsort(keys)
        return cls(keys[by], targets[by], lengths, links, held, symbols)

    def first_holders(self, strings: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
        """For rows of symbols (-1: unknown, or beyond the row's length), longest first: the rank of the first holder of
        the window that ends at each place, or -1."""
        rows, width = strings.shape
        out = np.full((rows, width), -1, dtype=np.int64)
        state, have = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
        for t in range(width):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # rows longer than t
            symbol, open_ = strings[:n, t], np.arange(n)
            while len(open_):
                key = state[open_] * self.symbols + symbol[open_]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                met = (self.keys[at] == key) & (symbol[open_] >= 0)
                done = open_[met]
                state[done] = self.targets[at[met]]
                have[done] += 1
                open_ = open_[~met]
                have[open_[state[open_] == 0]] = 0
                open_ = open_[state[open_] != 0]
                state[open_] = self.link[state[open_]]
                have[open_] = self.length[state[open_]]
            far = np.flatnonzero(have[:n] >= window)
            while len(far):  # no more than the window's words
                far = far[self.length[self.link[state[far]]] >= window]
                state[far] = self.link[state[far]]
                have[far] = window
            full = np.flatnonzero(have[:n] >= window)
            out[full, t] = self.holder[state[full]]
        return out


def _segments(docs: DataFrame, window: int, piece: int) -> DataFrame:
    """(k, id, anchor, digest, start, size) of ``docs`` (k, id, text)."""
    schema = T.StructType([T.StructField("k", T.LongType()), docs.schema["id"], *[T.StructField(n, T.LongType()) for n in ("anchor", "digest")], *[T.StructField(n, T.IntegerType()) for n in ("start", "size")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, start, size, key, digest = segments(*word_hashes(b.column(2)), window, piece)
            at = pa.array(text)
            ints = (pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(key), pa.array(digest), *ints], names=schema.names)

    return docs.select("k", "id", "text").mapInArrow(run, schema)


def _strings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, digest, hot, shared, least, raw) of segments ``wanted`` (k, s: list of the rest with start and size)."""
    rows = docs.join(wanted, "k").select("text", "s")
    schema = T.StructType([f for f in rows.schema["s"].dataType.elementType if f.name not in ("start", "size")]).add("raw", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wants = b.column(1)
            sizes, inner = np.diff(wants.offsets.to_numpy()).tolist(), wants.flatten()
            starts, lengths = inner.field("start").to_pylist(), inner.field("size").to_pylist()
            raw, at = [], 0
            for text, n in zip(b.column(0), sizes, strict=True):
                words = text.as_buffer().to_pybytes().split()
                raw += [b" ".join(words[i : i + k]) for i, k in zip(starts[at : at + n], lengths[at : at + n], strict=True)]
                at += n
            yield pa.RecordBatch.from_arrays([*(inner.field(n) for n in schema.names[:-1]), pa.array(raw, pa.binary()).cast(pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def first_holders(strings: list[str], holders: np.ndarray, window: int) -> np.ndarray:
    """For each string and place: the rank of the first holder of the window that ends there, or -1. The strings are the
    reference and stream through its automaton."""
    symbols: dict[str, int] = {}
    add = symbols.setdefault
    rows = [[add(w, len(symbols)) for w in s.split(" ")] for s in strings]
    order = np.argsort(holders, kind="stable").tolist()
    automaton = Automaton.of([rows[i] for i in order], holders[order].tolist(), len(symbols))
    sizes = np.array(list(map(len, rows)))
    by = np.argsort(-sizes, kind="stable")
    grid = np.full((len(rows), int(sizes.max())), -1, dtype=np.int64)
    grid[np.arange(grid.shape[1]) < sizes[by][:, None]] = np.fromiter(chain.from_iterable(rows[i] for i in by), dtype=np.int64)
    found = np.empty_like(grid)
    found[by] = automaton.first_holders(grid, sizes[by], window)
    return found


def _matched(strings: DataFrame, window: int) -> DataFrame:
    """(anchor, digest, from, to, first): runs of windows of the segments of which the first equal one is of ``first``.
    Runs of a segment that one id alone holds, and no earlier one, are left out."""
    least = strings.schema["least"].dataType
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()), T.StructField("first", least)])

    def match(table: pa.Table) -> pa.Table:
        values = table["least"].to_pylist()
        ids = sorted({i for i in values if i is not None})
        rank = {i: r for r, i in enumerate(ids)} | {None: len(ids)}
        own = np.array([rank[i] for i in values])
        first = first_holders(table["raw"].to_pylist(), own, window)
        first[(first >= own[:, None]) & ~table["shared"].to_numpy()[:, None]] = -1
        first[first == len(ids)] = -1  # nobody comes after those without ids
        # runs of one first holder, along each row
        padded = np.full((first.shape[0], first.shape[1] + 2), -1, dtype=np.int64)
        padded[:, 1:-1] = first
        row, at = np.nonzero(np.diff(padded, axis=1) != 0)
        value = padded[row, at + 1]
        begin = np.flatnonzero(value >= 0)  # the row's next edge ends the run
        pick = pa.array(row[begin])
        holder = pa.array(ids, table.schema.field("least").type).take(pa.array(value[begin]))
        spans = (pa.array((at[begin] - window + 1).astype(np.int32)), pa.array(at[begin + 1].astype(np.int32)))
        return pa.Table.from_arrays([table["anchor"].take(pick), table["digest"].take(pick), *spans, holder], names=schema.names)

    return strings.select("shard", "anchor", "digest", "shared", "least", "raw").groupBy("shard").applyInArrow(match, schema)


def longer_piece(piece: int, window: int) -> int:
    """The piece by which a key is split that a piece of ``piece`` words leaves too common."""
    return min(window, piece + max(2, (window - piece) // 2))


def earlier_spans(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(k, from, to, first): runs of words of ``docs`` (k, id, text) that lie in windows of which an equal one starts in a
    row with a smaller id; ``first`` is the smallest. k tells rows apart."""
    found, path = written(_segments(docs, window, piece), "passage-segments")
    ids = found.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("lacks"))
    keys, keys_path = written(ids.filter("least <> most or lacks and least is not null").select("anchor"), "passage-keys")
    hits = materialize(found.join(keys, "anchor"), "passage-hits")
    for done in (path, keys_path):
        remove(docs.sparkSession, done)
    distinct = hits.groupBy("anchor", "digest", "size").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("lacks"), F.min(F.struct("k", "start")).alias("one"))
    shared = F.coalesce(F.col("least") != F.col("most"), F.lit(False)) | (F.col("lacks") & F.col("least").isNotNull())
    distinct, distinct_path = written(distinct.select("anchor", "digest", "size", "least", shared.alias("shared"), "one.*"), "passage-distinct")
    sums = distinct.groupBy("anchor").agg(F.sum("size").alias("words"))
    many = materialize(sums.filter(F.col("words") > (hot if piece < window else 1 << 62)).select("anchor", F.lit(True).alias("hot")), "passage-many")
    wanted = distinct.join(many, "anchor", "left").select("k", F.struct("anchor", "digest", "least", "shared", F.coalesce("hot", F.lit(False)).alias("hot"), "start", "size").alias("s"))
    strings = _strings(docs, wanted.groupBy("k").agg(F.collect_list("s").alias("s")))
    strings, strings_path = written(strings.withColumn("n", F.monotonically_increasing_id()), "passage-strings")
    words = distinct.agg(F.sum("size")).first()[0] or 0
    plain = strings.filter("not hot").withColumn("shard", F.pmod("anchor", F.lit(1 + words // shard)))
    parts = _matched(plain, window)
    if many.take(1):
        # equal windows lie in segments of one key: keyed anew, those of hot keys are texts of their own
        split = strings.filter("hot")
        again = earlier_spans(split.select(F.col("n").alias("k"), F.col("least").alias("id"), F.col("raw").alias("text")), window, longer_piece(piece, window), shard, hot)
        own = split.filter("shared").select(F.col("n").alias("k"), "anchor", "digest", F.lit(0).alias("from"), F.size(F.split("raw", " ")).alias("to"), F.col("least").alias("first"))
        again = split.select(F.col("n").alias("k"), "anchor", "digest").join(again, "k").select("anchor", "digest", "from", "to", "first")
        parts = parts.unionByName(again).unionByName(own.select("anchor", "digest", "from", "to", "first"))
    parts = materialize(parts, "passage-parts")
    for done in (distinct_path, strings_path):
        remove(docs.sparkSession, done)
    spans = hits.join(parts, ["anchor", "digest"]).filter("first is not null and (id is null or first < id)")
    return spans.select("k", (F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to")).alias("to"), "first")


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, piece: int = PIECE, shard: int = SHARD, hot: int = HOT, kept: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) per row of ``docs``: every word that is covered by a window of
    ``window`` words which also starts in a row with a smaller id is removed.

    Words are runs of bytes other than space and U+0009 to U+000D, unchanged; a null text has none; windows are judged on
    the input. Ids may be of any ordered type. A row without an id comes after all that have one; rows of one id, or
    without, are not smaller than each other, so copies among them stay. A text shorter than the window stays. Texts of
    any length are read whole; a table without rows gives none. ``kept``: the words that stay, joined by one space.
    """
    numbers = numbered(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "passage-docs").withColumnRenamed("__row", "k")
    spans = earlier_spans(numbers, window, piece, shard, hot)
    spans = spans.groupBy("k").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    rows = numbers.join(spans, "k", "left").select(F.col("id").alias("doc_id"), "text", "spans")
    schema = T.StructType([rows.schema["doc_id"]]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if kept:
        schema = schema.add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in schema.names[1:]]
            for value, got in zip(b.column(1), b.column(2), strict=True):
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                rest = words
                if got.is_valid:
                    marks = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(marks, got.values.field("from").to_numpy(), 1)
                    np.add.at(marks, got.values.field("to").to_numpy(), -1)
                    rest = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]
                joined = b" ".join(rest)
                for col, v in zip(cols, (len(words), len(words) - len(rest), hashlib.sha256(joined).hexdigest(), joined.decode()), strict=False):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=schema.names)

    return rows.mapInArrow(run, schema)
