"""The ten operators and the pipeline on small fixtures, against brute force."""

import base64
import collections
import gzip
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import bpe, components, fingerprints, mixing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity, url_filters, warc
from sparkloom.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(5)
VOCABULARY = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(120, i) for i in range(12)]
    passage = prose(70, 99)
    out = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    out += [(20, base[0], "en", "s0", 1), (21, base[0], None, None, None), (22, base[1][:300] + " " + passage + base[2][:50], "fr", "s1", 1), (23, passage + base[3], "fr", "s1", 1)]
    out += [(30, None, "en", "s1", None), (31, "", "en", "s2", 0), (32, "one", "en", "s2", 3), (33, "aé漢😀 \t\x0b b\nb\nb", "de", None, 5), (34, "ab " * 400, "de", "s0", 9), (35, "ab " * 400, "de", "s0", 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Also a column that clashes with results of operators."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("size", "kept", "fp", "score", "count", "grp", "key")})


def test_suffix_dedup(docs, rows):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = collections.Counter(b[i : i + 200] for _, b in raw for i in range(len(b) - 199))
    for hot in (suffix_dedup.HOT, 0):
        got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, batch=500, hot=hot).collect()}
        assert len(got) == len(raw)
        for i, b in raw:
            m = np.zeros(len(b) + 2, dtype=bool)
            for j in range(len(b) - 199):
                if seen[b[j : j + 200]] > 1:
                    m[j + 1 : j + 201] = True
            rest = bytes(c for c, x in zip(b, m[1:], strict=False) if not x)
            want = (len(b), int(m.sum()), int((m[1:] > m[:-1]).sum()), hashlib.sha256(rest).hexdigest())
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want


def test_collection_order_is_the_suffix_order():
    r = np.random.default_rng(0)
    lengths = r.integers(1, 30, 20)
    words = r.integers(0, 3, int(lengths.sum()))
    ends = np.cumsum(lengths)
    order, common = suffix_dedup.collection_order(words, ends, lengths, 4)
    stop = np.repeat(ends, lengths)
    suffixes = [tuple(words[i : stop[i]]) for i in order]
    assert suffixes == sorted(suffixes)
    assert list(common[1:]) == [a[:4] == b[:4] and len(a) >= 4 and len(b) >= 4 for a, b in zip(suffixes, suffixes[1:], strict=False)]


def test_collection_tables_hold_common_prefixes():
    r = np.random.default_rng(1)
    for letters, most in ((2, 50), (3, 6), (1, 300)):
        lengths = r.integers(0, 25, 30)
        words = r.integers(0, letters, int(lengths.sum()))
        ends = np.cumsum(lengths)
        order, common = suffix_dedup.collection_tables(words, ends, lengths, most)
        stop = np.repeat(ends, lengths)
        suffixes = [tuple(words[i : stop[i]]) for i in order]
        shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert suffixes == sorted(suffixes)
        assert list(common[1:]) == [min(most, shared(a, b)) for a, b in zip(suffixes, suffixes[1:], strict=False)]


def test_least_of_ranges():
    r = np.random.default_rng(2)
    v = r.integers(0, 200, 100).astype(np.uint8)
    a = r.integers(0, 100, 50)
    b = np.minimum(99, a + r.integers(0, 60, 50))
    assert suffix_dedup.RangeLeast(v, 60)(a, b).tolist() == [v[i : j + 1].min() for i, j in zip(a, b, strict=True)]


def test_suffix_dedup_across_the_border_of_chunks(spark, monkeypatch):
    # texts of several chunks, whose repeats cross the chunks' borders
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 2000)
    monkeypatch.setattr(suffix_dedup.Segmenter, "_made", {})
    shared = prose(300, 50)
    texts = [prose(1500, 51) + shared + prose(900, 52), prose(400, 53) + " " + shared, prose(2000, 54)]
    assert len(texts[0]) > 5000
    split = suffix_dedup.Segmenter.get(200, 64).split
    for t in texts:
        found = [(a, b) for _, starts, ends in split(t.encode()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        assert sorted(w for a, b in found for w in range(a, b - 199)) == list(range(len(t.encode()) - 199))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[2] == 0 and got[0] == got[1] >= len(shared)


def test_suffix_dedup_of_rows_without_ids(spark):
    t = prose(80, 1)
    d = spark.createDataFrame([(None, t), (None, t), (1, t), (1, prose(80, 2)), (1, None)], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(d).collect())
    assert got == sorted([(len(t), len(t))] * 3 + [(len(prose(80, 2)), 0), (0, 0)])
    assert suffix_dedup.remove_repeats(d.limit(0)).count() == 0


def test_mixing(spark, docs, rows):
    got = mixing.mix_sources(docs, F.array("source")).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        e = by[tuple(r["sources"])]
        e[0], e[1], e[2] = e[0] + r["size"], e[1] + r["taken"], r["target"]
    whole = sum(len(WORD.findall(t or "")) for _, t, *_ in rows)
    assert sum(e[0] for e in by.values()) == whole == pytest.approx(sum(e[2] for e in by.values()))
    assert all(abs(e[1] - e[2]) <= 400 for e in by.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs, F.array("source")).collect()))
    assert mixing.mix_sources(docs.limit(0), F.array("source")).count() == 0


def test_mixing_fills_until_nothing_fits(spark):
    # many long documents, and short ones that fill what is left at the cut one by one
    for seed in range(3):
        sizes = [400 + 7 * i for i in range(12)] + [30 + 11 * (i % 4) for i in range(9)]
        data = [(i, "w " * n, "en", f"s{i % 2}", 1) for i, n in enumerate(sizes)]
        got = mixing.mix_sources(spark.createDataFrame(data, SCHEMA), F.array("source"), seed=seed).collect()
        for s in ("s0", "s1"):
            own = [r for r in got if r["sources"] == [s]]
            left = int(own[0]["target"] + 0.5) - sum(r["taken"] for r in own)
            least = min(r["times"] for r in own)
            assert left >= 0 and {r["times"] for r in own} <= {least, least + 1}
            assert not left or all(r["size"] > left for r in own if r["times"] == least)


def test_mixing_overlapping_sources():
    take = mixing.route([(("a",), 100), (("a", "b"), 50), (("b",), 10)], {"a": 100, "b": 60}, 3)
    assert take == [100, 50, 10]
    take = mixing.route([(("a",), 10), (("a", "b"), 50)], {"a": 30, "b": 50}, 3)
    assert sum(take) == 80 and take[0] <= 30 and take[1] <= 150
    assert mixing.targets([10, 1000], [5, 1], 3) == [30.0, 980.0]


def test_mixing_routes_overlaps_at_the_least_cost():
    r = random.Random(2)
    for _ in range(25):
        names = ["a", "b"]
        patterns = [(("a",), r.randint(0, 2)), (("a", "b"), r.randint(0, 2)), (("b",), r.randint(0, 2))]
        quotas = {x: r.randint(0, 5) for x in names}
        cost = lambda took: sum(j // n for (_, n), t in zip(patterns, took, strict=True) for j in range(t) if n)
        best = None
        for took in itertools.product(*(range(3 * n + 1) for _, n in patterns)):
            # what both sources share goes to either
            fits = any(took[0] + to_a <= quotas["a"] and took[2] + took[1] - to_a <= quotas["b"] for to_a in range(took[1] + 1))
            if fits and (best is None or (-sum(took), cost(took)) < best):
                best = (-sum(took), cost(took))
        got = mixing.route(patterns, quotas, 3)
        assert (-sum(got), cost(got)) == best


def test_mixing_of_overlapping_sources_by_rows(spark):
    data = [(i, "w " * (3 + i % 5), ["a", "b"][: 1 + i % 2] if i % 3 else ["b"]) for i in range(60)]
    data += [(7, "w w", ["a"]), (None, "w", ["b", "a"]), (None, None, None), (8, "", [])]
    d = spark.createDataFrame(data, "doc_id long, text string, of array<string>").withColumns({c: F.lit("x") for c in ("size", "taken", "draw", "part")})
    got = mixing.mix_sources(d, F.col("of"), weights=(3, 1)).collect()
    assert len(got) == len(data) and all(x["taken"] == x["times"] * x["size"] <= 3 * x["size"] for x in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(d.repartition(7), F.col("of"), weights=(3, 1)).collect()))
    by = collections.Counter()
    for x in got:
        by[tuple(x["sources"])] += x["size"]
    patterns = sorted(by.items(), key=lambda p: tuple((y is None, y or "") for y in p[0]))
    of = collections.Counter()
    for m, n in patterns:
        for y in m:
            of[y] += n
    names = sorted(of, key=lambda y: (y is None, y or ""))
    share = mixing.targets([of[y] for y in names], [(3, 1)[i % 2] for i in range(len(names))], 3)
    whole = sum(n for _, n in patterns)
    quotas = {y: int(t * whole / sum(of.values()) + 0.5) for y, t in zip(names, share, strict=True)}
    for (m, _), due in zip(patterns, mixing.route(patterns, quotas, 3), strict=True):
        own = [x for x in got if tuple(x["sources"]) == m]
        left, least = due - sum(x["taken"] for x in own), min(x["times"] for x in own)
        assert left == 0 or left > 0 and not any(0 < x["size"] <= left for x in own if x["times"] == least)


def brute_simhash(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, rows):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, tile=4).collect()}
    prints = {i: brute_simhash(t) for i, t, *_ in rows}
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == prints
    least = {i: i for i in prints}
    for _ in prints:
        least = {i: min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
    assert {i: r["component_id"] for i, r in got.items()} == least
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_tiles_lose_no_link(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    prints = set(base)
    for b in base:
        prints |= {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(8)}
    prints = sorted(prints)
    d = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = components.connected_components(simhash.links(d, tile=5, group=2))
    root = {r["node"] % 2**64: r["root"] for r in found.collect()}
    label = list(range(len(prints)))
    near = [[j for j, q in enumerate(prints) if (p ^ q).bit_count() <= 2] for p in prints]
    for _ in prints:
        label = [min(label[j] for j in n) for n in near]
    groups = collections.defaultdict(set)
    for p, k in zip(prints, label, strict=True):
        groups[k].add(root.get(p, ("alone", p)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_keep_one_by_row(spark):
    t = prose(60, 4)
    d = spark.createDataFrame([(1, t), (1, t), (None, t), (2, prose(60, 5)), (1, prose(60, 6))], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one(d).collect()) == sorted([t, prose(60, 5), prose(60, 6)])


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 180)] + [(7, 7), (1, 0)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 180)}}


def test_fingerprints(spark, docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    order = sorted(rows)
    shingles = lambda t: {tuple(WORD.findall(t)[i : i + 5]) for i in range(max(1, len(WORD.findall(t)) - 4))} if WORD.findall(t) else set()
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        exact = len(shingles(t) | shingles(edited)) <= fingerprints.K
        assert r["near_edited"] == pytest.approx(like(shingles(t), shingles(edited)), abs=1e-9 if exact else 0.2)
    assert got[0]["fingerprint"] == got[20]["fingerprint"] and got[20]["near_next"] == 1.0
    assert fingerprints.fingerprint_edits(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e g"), (None, "z")], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(same).count() == 3


def test_simhash_of_text_ids_and_null_ids(spark):
    t = prose(60, 4)
    d = spark.createDataFrame([("b", t), ("a", t), (None, t), (None, prose(60, 5)), ("c", prose(60, 6)), ("c", None)], "doc_id string, text string").withColumn("fp", F.lit("clash"))
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(d).collect())
    assert got == [("None", "None"), ("None", "a"), ("a", "a"), ("b", "a"), ("c", "c"), ("c", "c")]


def test_simhash_of_a_very_long_text():
    t = prose(200_000, 1)
    assert len(t) > 800_000 and simhash.simhash(t) == brute_simhash(t)


def test_fingerprints_of_neighbours_in_many_buckets(spark):
    data = [(7 * i, prose(12 + i % 9, i // 2)) for i in range(60)]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    rows = fingerprints.with_next(d, "doc_id", "text", buckets=9).collect()
    assert len({r["bucket"] for r in rows}) == 9
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(d).collect()}
    shingles = lambda t: {tuple(WORD.findall(t)[i : i + 5]) for i in range(max(1, len(WORD.findall(t)) - 4))}
    for (i, t), (_, nxt) in zip(data, data[1:] + data[:1], strict=True):
        a, b = shingles(t), shingles(nxt)
        assert got[i]["near_next"] == pytest.approx(len(a & b) / len(a | b), abs=1e-9)
    with pytest.raises(TypeError):
        fingerprints.fingerprint_edits(d.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_sketches_merge(spark):
    a, b = prose(700, 8), prose(500, 9)
    row = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string").select(*[fingerprints.sketch(F.col(c), 64).alias(c) for c in "abc"])
    m, c, n = row.select(fingerprints.merge(F.col("a"), F.col("b"), 64), "c", fingerprints.distinct_shingles(F.col("c"), 64)).first()
    assert len(set(m) & set(c)) >= 60
    assert n == pytest.approx(1190, rel=0.4)
    parts = spark.createDataFrame([(1, a), (1, b)], "k long, t string").select("k", fingerprints.sketch(F.col("t"), 64).alias("s"))
    assert fingerprints.merge_sketches(parts, "k", "s", 64).first()["s"] == m


def test_quality_statistics(docs, rows):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, keep=["doc_id"]).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j + d for j in range(len(w) - 2) if n[tuple(w[j : j + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 2 * len(cover) > len(w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_quality_outliers(spark):
    good = [(i, prose(100 + i, i), "en", "a", 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "$$$&&&" for w in prose(120, 700 + i).split()), "en", "a", 1) for i in range(15)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(good + bad, SCHEMA)).collect()}
    assert all(got[r[0]] for r in good) and not any(got[r[0]] for r in bad)


def test_quality_outliers_of_one_part(spark):
    # two words in five end in a symbol, and nothing else is odd
    good = [(i, prose(100 + i, i), "en", "a", 1) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "$" * (k % 5 < 2) for k, w in enumerate(prose(120, 700 + i).split())), "en", "a", 1) for i in range(15)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(good + bad, SCHEMA)).collect()}
    assert all(got[r[0]] for r in good) and not any(got[r[0]] for r in bad)


def numpy_mcd(x, floors, coverage, steps):
    """(centre, covariance, rows within the cut) of one group, of the better of two starts."""
    n = x.shape[1]
    q = quality_rules.chi2_quantile(coverage, n)
    correction = coverage / quality_rules._gamma_p(n / 2 + 1, q / 2)
    at = lambda v, p: np.sort(v, axis=0)[int(np.ceil(p * len(v))) - 1]
    middle, found = at(x, 0.5), []
    for scale in (np.maximum(1.4826 * at(np.abs(x - middle), 0.5), floors), floors):
        centre, cov = middle, np.diag(scale**2)
        for _ in range(steps):
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = x[d2 <= at(d2, coverage) + 1e-12]
            centre, cov = near.mean(axis=0), np.atleast_2d(np.cov(near.T, bias=True)) * correction + np.diag(floors**2)
        found.append((np.linalg.slogdet(cov)[1], centre, cov, len(near)))
    return min(found, key=lambda f: f[0])[1:]


def test_robust_estimate_of_each_group(spark):
    r = np.random.default_rng(4)
    names = list(quality_rules.FLOORS)
    floors = np.array(list(quality_rules.FLOORS.values()))
    groups = {}
    for k, n in enumerate((1, 2, 7, 60, 400)):
        x = r.normal(k, 0.3 + 0.1 * k, (n, 5))
        x[: n // 5] += 6
        groups[f"g{k}"] = x
    groups[quality_rules.POOLED] = np.concatenate(list(groups.values()))
    data = [(g, *map(float, row)) for g, x in groups.items() for row in x]
    d = spark.createDataFrame(data, ["grp", *names])
    found, n_groups = quality_rules.robust_parameters(d, quality_rules.FLOORS, 0.75, 3)
    got = {row["grp"]: row for row in found.collect()}
    assert n_groups == len(got) == 6
    pooled = numpy_mcd(groups[quality_rules.POOLED], floors, 0.75, 3)
    for g, x in groups.items():
        centre, cov, h = numpy_mcd(x, floors, 0.75, 3)
        w = 1.0 if g == quality_rules.POOLED else h / (h + quality_rules.PRIOR)
        centre, cov = w * centre + (1 - w) * pooled[0], w * cov + (1 - w) * pooled[1]
        factor = np.array([[got[g][f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert np.allclose([got[g][f"m_{i}"] for i in range(5)], centre, atol=1e-6)
        assert np.allclose(factor @ factor.T, cov, atol=1e-6)


def test_quality_parameters_by_salted_join(spark, docs, monkeypatch):
    judged = lambda: sorted((r["doc_id"], r["kept"], round(r["d2"] or -1.0, 6)) for r in quality_rules.quality_rules(docs, keep=["doc_id"]).collect())
    want = judged()
    monkeypatch.setattr(quality_rules, "MOST_BROADCAST", 0)
    assert judged() == want


def test_chi_square():
    assert quality_rules.chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)


def test_toxicity(spark):
    r = random.Random(1)
    data, labels = [], []
    for i in range(400):
        words, toxic = prose(80, i).split(), int(i % 3 == 0)
        for _ in range(2 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["zzylq", "wwuxv", "qqyzk"]))
        data.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, toxic))
    data += [(900, None, None, None, None), (901, "", None, None, None)]
    d, y = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(d, y).collect()}
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i, *_ in labels)
    assert sum(got[i]["predicted"] == t for i, _, t in labels if i in held) >= 0.95 * len(held)
    assert 0 <= got[900]["score"] == got[901]["score"] <= 1
    assert toxicity.toxicity(d, y.limit(0)).count() == len(data)
    assert toxicity.toxicity(d.limit(0), y).count() == 0


def test_quality_classifier(spark):
    data = [(i, prose(90, i) if i % 4 else " ".join(w + "%%%" for w in prose(90, i).split()), "en", "s", 1) for i in range(400)]
    y = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([*data, (900, None, None, None, None)], SCHEMA)
    got = {x["doc_id"]: x for x in quality_classifier.quality(d, y).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == int(i % 4 > 0) for i in held) >= 0.97 * len(held)
    assert quality_classifier.quality(d, y.limit(0)).count() == 401


def numeric_gradient(f, w):
    step = 1e-6 * np.eye(len(w))
    return np.array([(f(w + e) - f(w - e)) / 2e-6 for e in step])


def test_toxicity_loss_and_ratios():
    r = np.random.default_rng(3)
    has = r.random((40, 6)) < 0.4
    labels = (r.random(40) < 0.3).astype(float)
    with_0, with_1 = has[labels == 0].sum(axis=0), has[labels == 1].sum(axis=0)
    n0, n1 = int((labels == 0).sum()), int(labels.sum())
    ratio = toxicity.log_count_ratio(with_0, with_1, n0, n1)
    assert ratio == pytest.approx([np.log((b + 1) / (n1 + 2) / ((a + 1) / (n0 + 2))) for a, b in zip(with_0, with_1, strict=True)])
    row, col = np.nonzero(has)
    w = r.normal(size=7)
    share = (n1 + 0.5) / 41
    weight = np.array([(0.5 / share if y else 0.5 / (1 - share)) ** 0.5 for y in labels])

    def brute(w):
        z = (has * ratio) @ w[:-1] + w[-1]
        p = 1 / (1 + np.exp(-z))
        return -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weight.sum() + 0.05 * (w[:-1] ** 2).sum()

    value, gradient = toxicity.loss(w, row, col, ratio, labels, ridge=0.1)
    assert value == pytest.approx(brute(w)) and gradient == pytest.approx(numeric_gradient(brute, w), abs=1e-6)


def test_toxicity_features(monkeypatch):
    def brute(t):
        s = " " + " ".join(t.lower().split()) + " "
        out = set()
        for n in toxicity.SIZES:
            for i in range(len(s) - n + 1):
                key = 0
                for c in s[i : i + n]:
                    key = (key * 0x100000001B3 + ord(c)) % 2**64
                out.add(((key + n) * 0x9E3779B97F4A7C15) % 2**64 >> (64 - toxicity.BITS))
        return out

    for t in ("", "a", "Ünï  cödé 漢字😀\n x", prose(60, 3)):
        want = brute(t)
        assert set(toxicity.distinct(t).tolist()) == want
        with monkeypatch.context() as m:
            m.setattr(toxicity, "_CHUNK", 7)
            assert set(toxicity.distinct(t).tolist()) == want
    assert len(toxicity.distinct(None)) == 0
    # one character is one character, whatever its bytes
    assert len(toxicity.distinct("漢字漢字")) == len(toxicity.distinct("xyxy"))


def test_non_negative_risk():
    r = np.random.default_rng(5)
    p, u, prior = r.normal(1, 1, 9), r.normal(-1, 1, 12), 0.4
    soft = lambda z: np.log1p(np.exp(z))
    negative = lambda p, u: soft(u).mean() - prior * soft(p).mean()
    for shift in (0.0, -9.0):  # the second has a negative estimate, which is undone
        q = u + shift
        value, g_p, g_u = quality_classifier.non_negative_risk(p, q, prior)
        assert value == pytest.approx(prior * soft(-p).mean() + max(0.0, negative(p, q)))
        if negative(p, q) >= 0:
            risk = lambda p, u: prior * soft(-p).mean() + negative(p, u)
        else:
            risk = lambda p, u: -negative(p, u)
        assert g_p == pytest.approx(numeric_gradient(lambda p: risk(p, q), p), abs=1e-6)
        assert g_u == pytest.approx(numeric_gradient(lambda u: risk(p, u), q), abs=1e-6)


def test_classifiers_of_odd_tables(spark):
    long = prose(60_000, 9)
    data = [(i, prose(60, i) + (" zzylq wwuxv" if i % 3 == 0 else " plain"), "x", "x") for i in range(120)]
    data += [(5, data[5][1], "y", "y"), (5, None, "y", "y"), (None, "a b", None, None), (900, long, "z", "z"), (901, "", "z", "z")]
    d = spark.createDataFrame(data, "doc_id long, text string, score string, held_out string").withColumns({c: F.lit("x") for c in ("y", "predicted", "features")})
    y = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 120)] + [(7, 1, 0), (5000, 1, 1), (None, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    for f in (toxicity.toxicity, quality_classifier.quality):
        got = f(d, y).collect()
        assert len(got) == len(data) and all(0 <= r["score"] <= 1 for r in got)
        assert sorted(map(str, got)) == sorted(map(str, f(d, y).collect()))
        assert len({r["score"] for r in got if r["doc_id"] == 5}) <= 2
        assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
        assert f(d.limit(0), y).count() == 0 and f(d, y.limit(0)).count() == len(data)


def test_counts_above_cuts_are_of_all_documents(spark):
    texts = [prose(40 + i, i) for i in range(70)] + [None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    x = quality_classifier.vectors(texts)
    model = quality_classifier.first_model(x[:30], x[30:])
    out = model.outputs(texts)
    cuts = np.sort(quality_classifier.prior_cuts(out[:30]))
    n, above = quality_classifier._counts_above(d, "text", model, cuts)
    assert n == 72 and np.abs(above - [(out >= c).sum() for c in cuts]).max() <= 1


def test_class_prior():
    r = np.random.default_rng(2)
    p, u = r.normal(2, 1, 4000), np.concatenate([r.normal(2, 1, 2800), r.normal(-4, 1, 1200)])
    assert quality_classifier.estimate_prior(p, u) == pytest.approx(0.7, abs=0.05)


def test_url_filters(spark):
    page = lambda i, u, h="": (i, u, h)
    data = [
        page(1, "http://www.Example.COM/en/1?a#b"),
        page(2, "http://example.com/en/77"),
        page(3, "http://other.fr/x", '<link rel="canonical" href="http://a.com/en/9">'),
        page(4, "http://third.fr/y/z", "<META http-equiv=refresh content='0; url=../../x'>"),
        page(5, "http://other.fr/far", "<link href='http://other.fr/x#frag' rel=canonical>"),
        page(6, "http://both.fr/q", '<link rel="canonical" href="http://a.com/en/10">'),
        page(7, "http://both.fr/r", '<link rel="canonical" href="/q"><meta http-equiv="refresh" content="5;URL=http://example.com/en/7x">'),
        page(8, None, None),
        page(9, "no scheme"),
        page(10, "http://notexample.net/de/8"),
        page(11, "http://x.example.net/de/88"),
        page(12, "http://other.fr/x"),
        page(12, "http://other.fr/x"),
    ]
    d = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("root", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(d, URL_RULES).collect()}
    assert got[1] == ("www.example.com", "/en/1", "com/en/", "block")
    assert got[2] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[3][2:] == (None, "block") and got[5][3] == "block" and got[12][3] == "block"
    assert got[4][3] == "allow"  # its target is another page of its own host
    assert got[6][3] == got[7][3] == "allow"  # an explicit allow among the aliases comes first
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow")
    assert got[10][2:] == ("net/de/", "allow") and got[11][2:] == ("example.net/de/8", "block")
    more = spark.createDataFrame([("http://third.fr/y/z", "http://b.com/en/1")], "source string, target string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(d, URL_RULES, more).collect()}
    assert got[4] == "block"
    assert url_filters.filter_urls(d.limit(0), URL_RULES).count() == 0


@pytest.fixture(scope="module")
def tokens():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    entries = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(entries)}, special_tokens={})
    return path, enc


def test_bpe(docs, rows, tokens):
    path, enc = tokens
    encoded = bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in encoded.collect()}
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        r = got[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode_documents(encoded, path, public_tokenizers.PATTERN).collect()}
    assert decoded == {i: (t or "").encode() for i, t, *_ in rows}


def test_bpe_like_the_library(tokens):
    path, enc = tokens
    t = bpe.load(path, public_tokenizers.PATTERN)
    r = random.Random(1)
    for _ in range(400):
        s = "".join(r.choice("aaab  \n\t'sé漢😀1234!?ABCthe\u00a0<|>") for _ in range(r.randint(0, 90)))
        assert t.encode(s) == enc.encode_ordinary(s)
    assert t.encode("a" * 9000) == enc.encode_ordinary("a" * 9000)


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert h.find(keys).tolist() == list(range(5000))
    assert sorted(h.key_at.tolist()) == list(range(5000))


@pytest.fixture(scope="module")
def pages(spark):
    r = [(i, f"http://h{i % 4}.Example.com/p/{i // 2}", f"<p>{prose(20, i % 5)}</p>") for i in range(40)]
    r += [(50, None, None), (51, "http://x.com", ""), (52, "http://é.com/a b\r\nX: y", "é"), (53, "http://x.com", "z" * 200000)]
    return spark.createDataFrame(r, "page_id long, url string, html string").withColumn("key", F.lit("clash"))


@pytest.mark.parametrize("least", [0, 100])
def test_warc(pages, least):
    rows = pages.collect()
    first = {}
    for r in rows:
        first.setdefault(r["html"] or "", r["page_id"])
    got = {r["page_id"]: r for r in warc.round_trip(pages, least).collect()}
    assert len(got) == len(rows)
    for r in rows:
        raw = (r["html"] or "").encode()
        f = first[r["html"] or ""] if len(raw) >= least else r["page_id"]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == r["page_id"] else "revisit", None if f == r["page_id"] else f)
        g = got[r["page_id"]]
        assert (g["payload_bytes"], g["payload_digest"], g["record_type"], g["refers_to"]) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_index(pages, tmp_path):
    at, index = f"file://{tmp_path}/a", f"file://{tmp_path}/i"
    captures = warc.write_archives(pages.select("page_id", "url", "html"), at)
    directory = warc.build_index(captures, index, block_lines=3)
    look = warc.Index(directory, index, at)
    for r in pages.collect():
        hits = look.read(r["url"])
        assert r["page_id"] in {h["page_id"] for h in hits}
        assert {warc.surt(h["url"]) for h in hits} == {warc.surt(r["url"])}
    assert look.read("http://absent.org/") == []
    one = next(p for p in (tmp_path / "a").iterdir() if p.name.endswith(".gz"))
    assert gzip.decompress(one.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_warc_of_repeated_and_missing_ids(spark):
    data = [(1, "A"), (2, "B"), (5, "A"), (5, "B"), (5, "C"), (None, "A"), (None, "D"), (None, "D"), (7, "E"), (7, "E"), (8, "E"), (9, None), (10, "")]
    d = spark.createDataFrame([(i, f"http://h{k % 3}.com/", t) for k, (i, t) in enumerate(data)], "page_id long, url string, html string")
    least = {}
    for i, t in data:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    want = []
    for i, t in data:
        first = least.get(t or "")
        again = i is not None and i > first
        want.append((i, base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode(), "revisit" if again else "response", first if again else None))
    got = warc.round_trip(d).collect()
    assert sorted(map(str, [(r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got])) == sorted(map(str, want))


def test_warc_archives_share_a_folder(spark, pages, tmp_path):
    at, rows = f"file://{tmp_path}/a", pages.select("page_id", "url", "html")
    one, two = warc.write_archives(rows, at), warc.write_archives(rows.filter("page_id < 7"), at)
    assert warc.read_archives(one, at).count() == rows.count() and warc.read_archives(two, at).count() == 7
    # every payload lies in the first run's archives, and a revisit names its response's record, url and date
    heads, payloads = [], set()
    for f in {r["file"] for r in one.collect()}:
        assert gzip.decompress((tmp_path / "a" / f).read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    for r in warc.read_archives(one, at, payload=True).collect():
        payloads |= {bytes(r["payload"])} if r["payload"] is not None else set()
    assert payloads == {(r["html"] or "").encode() for r in rows.collect()}
    raw = warc.record(3, "http://b.com/", b"x", 1, "D", (1, "http://a.com/"))
    assert f"WARC-Refers-To: {warc.record_id(1, 'http://a.com/', 'D')}\r\n".encode() in raw
    assert b"WARC-Refers-To-Target-URI: http://a.com/\r\nWARC-Refers-To-Date: " in raw


def test_warc_looks_up_many_keys_in_blocks(spark, tmp_path):
    # one url with captures in many blocks and parts, beside others
    data = [(i, "http://hot.com/" if i % 3 else f"http://h{i}.com/", f"{i}") for i in range(120)]
    d = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    at, index = f"file://{tmp_path}/a", f"file://{tmp_path}/i"
    built = warc.Index(warc.build_index(warc.write_archives(d, at), index, block_lines=4), index, at)
    asked = spark.createDataFrame([("http://hot.com/",), ("http://h6.com/",), ("http://absent.com/",), (None,), ("http://hot.com/#x",)], "url string")
    found = warc.look_up(asked, built).collect()
    assert sorted(r["page_id"] for r in found) == sorted([6, *(i for i in range(120) if i % 3)])
    assert len(list(built.blocks(warc.surt("http://hot.com/")))) > 10 > len(list(built.blocks(warc.surt("http://h6.com/"))))


def test_bpe_of_repeated_rows_and_a_small_memo(spark, tokens, monkeypatch):
    path, enc = tokens
    monkeypatch.setattr(bpe, "MEMO_CHARS", 20)
    t = bpe.Tokenizer(bpe.read_ranks(path), public_tokenizers.PATTERN)
    for text in ("some words", "x" * 500, "other words 漢字", "some words"):
        assert t.encode(text) == enc.encode_ordinary(text) and t.held <= 20 + len(text)
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None), (None, "c")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("ids", "n_tokens")})
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in bpe.encode_documents(d, path, public_tokenizers.PATTERN).collect())
    assert got == sorted((str(i), len(enc.encode_ordinary(t or ""))) for i, t in [(1, "a b"), (1, "a b"), (1, None), (None, "c")])


def test_url_filters_of_nulls(spark):
    data = [(None, None, "<link rel=canonical href='http://a.com/en/1'>"), (1, "http://q.fr/", None), (1, "http://q.fr/", None), (2, "", ""), (3, "http://q.fr/a", "<link rel=canonical href=''>")]
    d = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("node", "rule", "verdict")})
    got = sorted((str(r["page_id"]), r["host"], r["verdict"]) for r in url_filters.filter_urls(d, URL_RULES).collect())
    assert got == [("1", "q.fr", "allow"), ("1", "q.fr", "allow"), ("2", "", "allow"), ("3", "q.fr", "allow"), ("None", "", "allow")]


def test_long_texts(spark):
    long = prose(60_000, 77)  # a quarter of a million characters
    d = spark.createDataFrame([(1, long, "en", "a", 1), (2, long + " end", "en", "a", 1), (3, prose(200, 78), "en", "a", 1)], SCHEMA)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(d, keep=["doc_id"]).collect()}
    assert got[1]["n_words"] == 60_000 and got[1]["word_chars"] == len(long.replace(" ", ""))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(d).collect()}
    assert got[1]["n_chars"] == len(long) and got[1]["near_next"] > 0.9
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(d).collect()}
    assert got[1]["n_removed"] == len(long) and got[2]["n_removed"] >= len(long) and got[3]["n_removed"] == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as P

    none = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    good = prose(90, 900)
    odd = spark.createDataFrame([(None, good, "en", "s", 1), (5, prose(90, 901), None, None, None), (5, prose(90, 902), "en", "s", 1), (6, None, "en", "s", 0), (7, "", "en", "s", 0), (8, good, "en", "s", 1)], SCHEMA).withColumns({c: F.lit("x") for c in ("__row", "kept", "spans", "grp")})
    docs = odd
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 1:
            assert sorted(r["text"] for r in docs.collect()) == sorted([good, prose(90, 901), prose(90, 902)])
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count() > 0


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline as P

    more = [(100 + i, prose(90, 300 + i), "en", f"s{i % 2}", 1) for i in range(40)]
    d = spark.createDataFrame([*rows, *more], SCHEMA)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs, before = spark.read.parquet(f"{tmp_path}/{k}"), docs
        texts = [r["text"] for r in docs.collect()]
        if k == 0:
            assert all(len(WORD.findall(t)) >= 50 for t in texts) and {r[0] for r in more} <= {r["doc_id"] for r in docs.collect()}
        if k == 1:
            assert len(texts) == len(set(texts)) < before.count()
        if k == 2:
            assert before.count() == len(texts)
            windows = collections.Counter(t.encode()[i : i + 200] for t in texts for i in range(len(t.encode()) - 199))
            assert not [w for w, n in windows.items() if n > 1]
        if k == 3:
            sizes = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before.collect()}
            taken = sum(sizes[r["doc_id"]] for r in docs.collect())
            assert abs(taken - sum(sizes.values())) <= 0.1 * sum(sizes.values())
    last = P.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count() and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert P.run(spark, str(tmp_path)).count() == last.count()


def test_warc_gives_urls_back(spark, tmp_path):
    urls = ["http://x.com/a%20b", "http://x.com/a%2Fb?q=%26", "http://x.com/é ü", "http://x.com/%zz%", "http://x.com/a\tb\r\nc", "", None, "%25", "plain"]
    rows = [(i, u, f"page {i}") for i, u in enumerate(urls)]
    for i, u, html in rows:
        raw = html.encode()
        assert warc.parse(warc.record(i, u, raw, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), None))["url"] == u
    folder = f"file://{tmp_path}/archives"
    captures = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    assert {r["page_id"]: r["url"] for r in warc.read_archives(captures, folder, payload=True).collect()} == dict(enumerate(urls))


def test_mixing_does_not_follow_row_order(spark):
    """Seven rows of one id and one size, of which the mix takes some: the same ones however the rows are dealt."""
    texts = [" ".join(f"w{i}{j}" for j in range(10)) for i in range(7)]
    rows = [(1, t, "en", "a", n) for n, t in enumerate(texts)] + [(2, "x " * 400, "en", "b", 5), (2, "x " * 400, "en", "b", 5)]
    mixes = set()
    for seed in range(4):
        shuffled = random.Random(seed).sample(rows, len(rows))
        docs = spark.createDataFrame(shuffled, SCHEMA).repartition(1 + seed)
        mixed = mixing.mixed_rows(docs, F.array("source"), weights=(1, 60))
        mixes.add(tuple(sorted(map(tuple, mixed.collect()), key=str)))
    assert len(mixes) == 1
    times = collections.Counter(r[1] for r in mixes.pop() if r[3] == "a")
    assert 0 < sum(times.values()) and len({times[t] for t in texts}) > 1


def test_suffix_dedup_tells_text_ids_apart(spark):
    rows = [(None, "p" * 10 + "q" * 250), ("a", "x"), ("a", "q" * 230), (None, None), ("b", "y" * 199)]
    got = [tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()]
    assert sorted((r[0] or "", *r[1:4]) for r in got) == [("", 0, 0, 0), ("", 260, 250, 1), ("a", 1, 0, 0), ("a", 230, 230, 1), ("b", 199, 0, 0)]


def test_urls_outside_the_graph_keep_their_own_verdict(spark):
    page = lambda i, u, to=None: (i, u, f'<link rel="canonical" href="{to}">' if to else "x")
    rows = [page(1, "http://a.org/es/1", "http://b.io/z"), page(2, "http://b.io/z"), page(3, "http://c.io/"), page(4, "http://q.org/es/"), page(5, "http://q.org/es/"), page(6, "nothing"), page(7, "http://b.io/z")]
    rules = [("block", "org", "/es/")]
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: ("block", "org/es/"), 2: ("block", None), 3: ("allow", None), 4: ("block", "org/es/"), 5: ("block", "org/es/"), 6: ("allow", None), 7: ("block", None)}


def test_scratch_is_never_on_a_machines_own_disk():
    from types import SimpleNamespace

    from sparkloom.llm.common import shared_dir

    def session(master, **conf):
        get = {k.replace("_", "."): v for k, v in conf.items()}.get
        return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(master=master))

    warehouse = {"spark_sql_warehouse_dir": "file:/w"}
    assert shared_dir(session("local[4]", **warehouse)) == "file:/w/_scratch"
    assert shared_dir(session("yarn", spark_sql_warehouse_dir="s3a://b/w")) == "s3a://b/w/_scratch"
    assert shared_dir(session("yarn", spark_checkpoint_dir="hdfs:///c/", **warehouse)) == "hdfs:///c"
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_dir(session(master, **warehouse))
