"""Byte-level BPE encoding and decoding from a rank file.

Two tiers: whole pre-tokens that are vocabulary entries are found by a minimal perfect hash (one
displacement per bucket, one slot per entry, the entry's bytes compared); other pre-tokens are merged
by rank with a heap over a linked list of their bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: Pre-tokens whose encoding a worker remembers, and their characters; when it holds as many of either, it starts anew.
MEMO, MEMO_CHARS = 700_000, 8_000_000


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file in order of their ids, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    entries = [b""] * len(pairs)
    for token, rank in pairs:
        entries[int(rank)] = base64.b64decode(token)
    return entries


def _digests(tokens: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], dtype=np.uint64)


class PerfectHash:
    """Each of n distinct byte strings to its own slot of n.

    Buckets of a first hash are placed largest first: a bucket tries displacements until its keys
    fall on free slots; a bucket of one key is given a free slot outright (stored as -1 - slot).
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = max(1, len(keys))
        self.n = np.uint64(n)
        self.buckets = np.uint64(n // 4 + 1)
        h = _digests(keys)
        bucket = (h % self.buckets).astype(np.int64)
        self.shift = np.zeros(int(self.buckets), dtype=np.int64)
        self.key_at = np.full(n, -1, dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(int(self.buckets) + 1))
        sizes = np.diff(edges)
        singles = []
        tries = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[edges[b] : edges[b + 1]]
            if len(members) == 0:
                break
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            d = np.uint64(0)
            while True:
                slots = self._slot(h[members][None, :], (tries + d)[:, None])
                free = (self.key_at[slots] < 0).all(axis=1)
                ordered = np.sort(slots, axis=1)
                fits = np.flatnonzero(free & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                if len(fits):
                    self.shift[b] = int(d) + int(fits[0])
                    self.key_at[slots[fits[0]]] = members
                    break
                d += np.uint64(len(tries))
        left = np.flatnonzero(self.key_at < 0)
        for (b, key), slot in zip(singles, left, strict=False):
            self.shift[b] = -1 - slot
            self.key_at[slot] = key

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * _STEP)) * _MIX
        return ((x ^ (x >> np.uint64(32))) % self.n).astype(np.int64)

    def find(self, tokens: list[bytes]) -> np.ndarray:
        """The index of the key in each token's slot, to be compared with the token (-1: none)."""
        h = _digests(tokens)
        d = self.shift[(h % self.buckets).astype(np.int64)]
        with np.errstate(over="ignore"):
            slot = np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0).astype(np.uint64)))
        return self.key_at[slot]


class Tokenizer:
    def __init__(self, entries: list[bytes], pattern: str) -> None:
        self.entries = entries
        self.pattern = pattern
        self.hash = PerfectHash(entries)
        self._ready()

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.rank = {t: i for i, t in enumerate(self.entries)}
        self.text = [str(i) for i in range(len(self.entries))]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def __getstate__(self) -> dict:
        return {"entries": self.entries, "pattern": self.pattern, "hash": self.hash}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def merge(self, token: bytes) -> tuple[int, ...]:
        """The ids of a pre-token that is no entry: lowest rank first, leftmost among equals."""
        n = len(token)
        end = list(range(1, n + 1))  # of the part that starts here; 0: swallowed
        before = list(range(-1, n - 1))
        rank = self.rank.get
        # heap entries are rank, start and stop in one integer: they compare in that order
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = [((r << bits | i) << bits) | i + 2 for i in range(n - 1) if (r := rank(token[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            stop = entry & mask
            i = entry >> bits & mask
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(token[i : end[stop]])) is not None:
                    heappush(heap, ((r << bits | i) << bits) | end[stop])
            if (p := before[i]) >= 0 and (r := rank(token[p:stop])) is not None:
                heappush(heap, ((r << bits | p) << bits) | stop)
        out, i = [], 0
        while i < n:
            out.append(self.rank[token[i : end[i]]])
            i = end[i]
        return tuple(out)

    def learn(self, parts: Iterable[str]) -> None:
        """Put the encodings of pre-tokens into the memo, tier by tier."""
        new = [p for p in parts if p not in self.memo]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        if not new:
            return
        for part, token, at in zip(new, raw, self.hash.find(raw).tolist(), strict=True):
            self.held += len(part)
            self.memo[part] = (at,) if at >= 0 and self.entries[at] == token else self.merge(token)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; null counts as empty."""
        parts = self.find(text or "")
        if len(self.memo) > MEMO or self.held > MEMO_CHARS:
            self.memo.clear()
            self.held = 0
        try:
            return list(chain.from_iterable(map(self.memo.__getitem__, parts)))
        except KeyError:
            self.learn(set(parts))
            return list(chain.from_iterable(map(self.memo.__getitem__, parts)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))

    def joined(self, ids: Iterable[int]) -> str:
        """Decimal ids with a space between."""
        return " ".join(map(self.text.__getitem__, ids))


_loaded: dict[tuple[str, str], Tokenizer] = {}


def load(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a rank file, built once in each process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokenizer(read_ranks(path), pattern)
    return _loaded[path, pattern]


def _shipped(key: tuple[str, str], tokenizer: Tokenizer) -> Tokenizer:
    """A worker keeps the first copy it gets, with what it has remembered."""
    return _loaded.setdefault(key, tokenizer)


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) per row of ``docs``, with no shuffle.

    Null texts count as empty: no id, and the digests of nothing. Pre-tokens never cross rows.
    Repeated rows give repeated results; other columns of ``docs`` are not read. The rank file is read by
    the driver and shipped, so executors need no copy of it.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(load(path, pattern))
    key = (path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _loaded.get(key) or _shipped(key, shipped.value)
        for b in batches:
            rows = []
            for i, text_ in zip(b["doc_id"], b["text"], strict=True):
                found = t.encode(text_)
                row = (i, len(found), hashlib.sha256(t.joined(found).encode()).hexdigest(), hashlib.sha256(t.decode(found)).hexdigest())
                rows.append((*row, np.array(found, dtype=np.int32)) if ids else row)
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    )


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids array<int>); null ids decode to no bytes."""
    shipped = encoded.sparkSession.sparkContext.broadcast(load(path, pattern))
    key = (path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _loaded.get(key) or _shipped(key, shipped.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "decoded": [t.decode(x) if x is not None else b"" for x in b["ids"]]})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInPandas(run, f"doc_id {kind}, decoded binary")
