"""Phrase collocations against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, n string, rank string"


def brute(rows, least, top, longest=4):
    counts, totals = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {p: c for p, c in counts.items() if c >= least}
    out = []
    for lang in totals:
        mine = []
        for (of, w), a in often.items():
            if of != lang or len(w) < 2:
                continue
            longer = (c for (o, v), c in often.items() if o == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))))
            if any(100 * c >= 80 * a for c in longer):
                continue
            score, k = min((2000000 * a // (often[lang, w[:k]] + often[lang, w[k:]]), k) for k in range(1, len(w)))
            mine.append((-score, -a, " ".join(w).encode(), often[lang, w[:k]], often[lang, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, totals[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(mine)[:top])]
    return sorted(out)


def rows_of(seed):
    r = random.Random(seed)
    words = ["a", "B", "the", "The", "é", "漢", "of", "x|y", "new", "york", "\xa0"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"] + [" "] * 9) for _ in range(n))
    fixed = "In New York City the sun\nin new york city the moon. "
    out = [(i, text(r.randint(1, 90)) + (fixed if i % 3 else "") + text(5), r.choice(["en", "fr", None, "und"]), "s", "x", "y") for i in range(60)]
    return out + [(None, None, "en", None, None, None), (7, "", "de", "", "", ""), (8, " \n . ", "xx", "", "", ""), out[3], out[3]]


@pytest.mark.parametrize("block,ranked", [(1 << 21, 200_000), (50, 20)])
def test_collocations(spark, block, ranked, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED", ranked)
    monkeypatch.setattr(phrases, "SLICE", 300 if block == 50 else 4 << 20)
    rows = rows_of(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = phrases.collocations(docs, least=4, top=25, block=block).collect()
    want = brute(rows, 4, 25)
    assert sorted(map(tuple, got)) == want and len(want) > 60
    assert max(len(x[2].split(" ")) for x in want) == 4


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "one two", "en", "", "", "")], SCHEMA)).collect() == []


def test_a_long_text_is_one_block(spark):
    text = "alpha beta " * 400_000
    got = phrases.collocations(spark.createDataFrame([(1, text, "en", "", "", "")], SCHEMA), block=1000).collect()
    assert [(r["phrase"], r["a"], r["n"]) for r in got] == [("alpha beta alpha beta", 399_999, 800_000), ("beta alpha beta alpha", 399_998, 800_000)]


def test_blocks():
    seq, items, counts = phrases.word_block(phrases.split_words(pa.array(["A b. b", None, "\tb  c;;c "])))
    named = [None if i < 0 else items[int(i)].as_py() for i in seq]
    assert named == ["a", "b", None, "b", None, "b", "c", None, "c"]
    assert dict(zip(items.to_pylist(), counts.tolist(), strict=True)) == {"a": 1, "b": 3, "c": 2}
    seq = phrases.named_block(np.array([-1, 0, 1, 0, 1, 3, -1, 2, 0], dtype=np.int32), np.array([1, 0]))
    assert seq.tolist() == [1, 0, 1, 0, -1, 1]
    following, lefts, rights, counts = phrases.pair_block(seq, np.array([70, 50]))
    assert sorted(zip(lefts.tolist(), rights.tolist(), counts.tolist(), strict=True)) == [(50, 70, 2), (70, 50, 1)]
    assert [(int(lefts[i]) if i >= 0 else None) for i in following] == [50, 70, 50, None, None]
