"""Removal of earlier passages against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import passages

SCHEMA = "doc_id long, text string, k string, id string, first string, raw string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows: (id, text). Null ids come last."""
    order = lambda i: (i is None, i or 0)
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - window + 1):
            s = tuple(w[j : j + window])
            least[s] = min(least.get(s, order(i)), order(i))
    out = []
    for i, w in split:
        gone = {j + k for j in range(len(w) - window + 1) if least[tuple(w[j : j + window])] < order(i) for k in range(window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def rows_of(seed, count=40, vocabulary=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abé漢") for _ in range(r.randint(1, 4))) for _ in range(vocabulary)] + ["\xa0", " x"]
    prose = lambda n: r.choice([" ", "  ", "\n", "\t "]).join(r.choice(words) for _ in range(n))
    passage = [prose(n) for n in (13, 14, 30, 200)]
    out = []
    for i in range(count):
        parts = [prose(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passage), prose(r.randint(0, 9))]
        out.append((r.choice([i, i, i, 100 + i, 5, None]), " ".join(parts)))
    out += [(200, "same " * 60), (201, "same " * 59), (7, "same " * 20), (202, "ab cd " * 50), (203, "cd ab " * 30)]
    return out + [(300, None), (None, None), (301, ""), (302, " \n"), (303, "one"), out[0], (500, out[0][1])]


@pytest.mark.parametrize("hot,shard", [(50_000, 100_000), (60, 40), (0, 10)])
def test_remove_passages(spark, hot, shard):
    rows = rows_of(2)
    docs = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3)
    got = passages.remove_passages(docs, hot=hot, shard=shard, kept=True).collect()
    want = brute(rows, 13)
    assert collections.Counter(tuple(r)[:4] for r in got) == want and sum(n * c for (_, _, n, _), c in want.items()) > 1000
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_text_ids_and_small_windows(spark):
    rows = rows_of(3, 25, 6)
    docs = spark.createDataFrame([(None if i is None else f"{i:04d}", t) for i, t in rows], "doc_id string, text string")
    got = passages.remove_passages(docs, window=5, piece=2, hot=30, shard=50).collect()
    assert collections.Counter((None if r[0] is None else int(r[0]), *r[1:]) for r in got) == brute(rows, 5)


def test_no_rows_and_long_texts(spark):
    assert passages.remove_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    r = random.Random(4)
    long = " ".join(str(r.randrange(10**6)) for _ in range(300_000))
    tail = " ".join(long.split(" ")[-50:])
    got = {x[0]: tuple(x)[1:3] for x in passages.remove_passages(spark.createDataFrame([(1, long), (2, "a " + tail), (3, "b" * 2_000_000)], "doc_id long, text string")).collect()}
    assert got == {1: (300_000, 0), 2: (51, 50), 3: (1, 0)}


def test_equal_windows_have_equal_keys():
    texts = [" ".join(random.Random(i).choice("abc") for _ in range(90)) for i in range(12)]
    words, counts = passages.word_hashes(pa.array([*texts, None, "x  y", texts[0]]))
    assert counts.tolist() == [90] * 12 + [0, 2, 90]
    text, start, size, key, digest = passages.segments(words, counts, 13, 4)
    seen, covered = {}, set()
    of = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    for t, s, n, k, d in zip(text, start, size, key, digest, strict=True):
        whole = tuple(words[first[t] + s : first[t] + s + n])
        assert len(whole) == n >= 13 and seen.setdefault((k, d), whole) == whole
        for i in range(n - 12):
            assert (t, s + i) not in covered
            covered.add((t, s + i))
            assert seen.setdefault(whole[i : i + 13], k) == k
    assert len(covered) == sum(max(0, c - 12) for c in counts) and len(of) == len(words)


def test_word_hashes(monkeypatch):
    texts = ["ab c", "d\x0be  ", None, "", "d", " \n", "ab漢 \xa0 漢ab", "e" * 90, "e" * 90 + " e"]
    for run in (1 << 20, 7):
        monkeypatch.setattr(passages, "_RUN", run)
        hashes, counts = passages.word_hashes(pa.array(["x", *texts]).slice(1))
        words = [w for t in texts for w in WORD.findall(t or "")]
        assert counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
        assert len(hashes) == len(words) and len({(h, w) for h, w in zip(hashes.tolist(), words, strict=True)}) == len(set(words)) == len(set(hashes.tolist()))


def test_automaton_knows_first_holders():
    r = random.Random(9)
    strings = [[r.randrange(3) for _ in range(r.randint(1, 25))] for _ in range(40)]
    ranks = sorted(r.randrange(10) for _ in strings)
    automaton = passages.Automaton.of(strings, ranks, 3)
    rows = sorted([[r.randrange(4) - (r.random() < 0.02) for _ in range(r.randint(1, 30))] for _ in range(50)] + strings, key=len, reverse=True)
    grid = np.full((len(rows), 30), -1)
    for i, row in enumerate(rows):
        grid[i, : len(row)] = [c if c < 3 else -1 for c in row]
    for window in (1, 3, 6):
        got = automaton.first_holders(grid, np.array([len(x) for x in rows]), window)
        for i, row in enumerate(rows):
            for t in range(30):
                piece = row[t - window + 1 : t + 1] if window - 1 <= t < len(row) else None
                holders = [k for s, k in zip(strings, ranks, strict=True) if piece and any(s[j : j + window] == piece for j in range(len(s) - window + 1))]
                assert got[i, t] == min(holders, default=-1)
