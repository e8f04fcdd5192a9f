"""Evaluation of ranked runs: gains, recalls, aggregates, guards and paired bootstrap."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import numbered_by


def _gain(rel: Column, kind: str) -> Column:
    return F.pow(F.lit(2.0), rel) - 1 if kind == "exp" else rel.cast("double")


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, depth: int = 100, gain: str = "linear") -> DataFrame:
    """(qid, ndcg, recall, precision, mrr, ap) for the queries of ``run`` (qid, id, rank from 1); ``qrels``
    (qid, id, rel). Recall and ap are null without a relevant document; ndcg is 0 then (null for the
    exponential gain)."""
    good = qrels.filter("rel > 0")
    judged = run.join(good, ["qid", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    hits = F.sum((F.col("rel") > 0).cast("int")).over(Window.partitionBy("qid").orderBy("rank"))
    judged = judged.withColumn("hits", hits)
    dcg = F.sum(F.when(F.col("rank") <= k, _gain(F.col("rel"), gain) / F.log2(F.col("rank") + 1)).otherwise(0.0))
    found = judged.groupBy("qid").agg(
        dcg.alias("dcg"),
        F.sum(((F.col("rel") > 0) & (F.col("rank") <= k)).cast("int")).alias("hit_k"),
        F.max(F.when((F.col("rel") > 0) & (F.col("rank") <= k), 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"),
        F.sum(F.when((F.col("rel") > 0) & (F.col("rank") <= depth), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
    )
    best = good.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "id")))
    best = best.groupBy("qid").agg(F.sum(F.when(F.col("i") <= k, _gain(F.col("rel"), gain) / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("idcg"), F.count("*").alias("total"))
    d = found.join(best, "qid", "left")
    none = F.lit(None).cast("double") if gain == "exp" else F.lit(0.0)
    return d.select(
        "qid",
        F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(none), 9).alias("ndcg"),
        F.round(F.col("hit_k") / F.col("total"), 9).alias("recall"),
        F.round(F.col("hit_k") / k, 9).alias("precision"),
        F.round("mrr", 9).alias("mrr"),
        F.round(F.col("ap_sum") / F.col("total"), 9).alias("ap"),
    )


def aggregate_metrics(scores: DataFrame) -> DataFrame:
    """Means over the run's queries; recall and ap over those where they are defined, and how many are not."""
    return scores.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "recall", "precision", "mrr", "ap")], F.count_if(F.col("recall").isNull()).alias("skipped"))


def lane_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(qid, shared): how many of the first k both lanes have."""
    top = lambda d: d.filter(F.col("rank") <= k).select("qid", "id")
    both = top(a).join(top(b), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("shared"))
    return a.select("qid").distinct().join(both, "qid", "left").select("qid", F.coalesce("shared", F.lit(0).cast("bigint")).alias("shared"))


def window_recall(run: DataFrame, wanted: DataFrame, k: int, width: int) -> DataFrame:
    """(qid, recall): the share of wanted chunks (qid, source_file, chunk_index) with a hit of the first k at a
    distance of ``width`` or less."""
    near = wanted.withColumn("__o", F.explode(F.array(*[F.lit(i) for i in range(-width, width + 1)])))
    near = near.withColumn("at", F.col("chunk_index") + F.col("__o"))
    top = run.filter(F.col("rank") <= k).select("qid", "source_file", F.col("chunk_index").alias("at")).distinct()
    hit = near.join(top, ["qid", "source_file", "at"], "left_semi").select("qid", "source_file", "chunk_index").distinct().withColumn("hit", F.lit(1))
    d = wanted.join(hit, ["qid", "source_file", "chunk_index"], "left")
    return d.groupBy("qid").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 9).alias("recall"))


def regression_flags(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, flag) from best relevant ranks (qid, best) of two modes: regression if the first had it in three
    and the second has not, improvement if the second has it first and the first had not."""
    d = a.select("qid", F.col("best").alias("a")).join(b.select("qid", F.col("best").alias("b")), "qid", "full")
    flag = F.when((F.col("a") <= 3) & (F.col("b").isNull() | (F.col("b") > 3)), "regression").when((F.col("b") == 1) & (F.col("a").isNull() | (F.col("a") > 1)), "improvement").otherwise("same")
    return d.select("qid", flag.alias("flag"))


def bootstrap_word(seed: str, word: int) -> int:
    """The word-th 32-bit number of the SHA-256 counter stream."""
    block = hashlib.sha256(f"{seed}:{word // 8}".encode()).digest()
    return int.from_bytes(block[4 * (word % 8) : 4 * (word % 8) + 4], "big")


#: Draws of a resample that are made at once.
DRAWS = 1 << 16


def paired_bootstrap(pairs: DataFrame, seed: str = "seed", rounds: int = 2000) -> DataFrame:
    """One row of (n, mean, low, high, wins, losses, ties, verdict) from per-query (qid, a, b), with ends of the middle 95 % of
    ``rounds`` resampled means.

    Queries are numbered by id over ranges. A resample's draws are made in parts, each from its own place in the stream,
    as how often they name each number, and joined to the differences; what comes to the driver is a mean for each round.
    """
    schema = "n bigint, mean double, low double, high double, wins bigint, losses bigint, ties bigint, verdict string"
    spark = pairs.sparkSession
    d = numbered_by(pairs.filter("a is not null and b is not null").select("qid", (F.col("b") - F.col("a")).alias("delta")), [], [F.col("qid")], "at")
    d = d.select((F.col("at") - 1).alias("at"), "delta")
    told = d.agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses")).first()
    n, wins, losses = told["n"], told["wins"], told["losses"]
    if not n:
        return spark.createDataFrame([(0, None, None, None, 0, 0, 0, "INCONCLUSIVE")], schema)
    parts = -(-n // DRAWS)

    def run(batches):
        for b in batches:
            for i in b["id"].to_numpy():
                of, part = divmod(int(i), parts)
                first = of * n + part * DRAWS
                size = min(DRAWS, n - part * DRAWS)
                blocks = range(first // 8, (first + size - 1) // 8 + 1)
                stream = np.frombuffer(b"".join(hashlib.sha256(f"{seed}:{x}".encode()).digest() for x in blocks), dtype=">u4")
                drawn, times = np.unique(stream[first - 8 * (first // 8) :][:size].astype(np.int64) % n, return_counts=True)
                yield pd.DataFrame({"round": np.full(len(drawn), of), "at": drawn, "times": times})

    draws = spark.range(rounds * parts).mapInPandas(run, "round bigint, at bigint, times bigint")
    sums = draws.join(d, "at").groupBy("round").agg((F.sum(F.col("delta") * F.col("times")) / n).alias("mean"))
    means = sorted(round(r["mean"], 12) for r in sums.collect())
    low, high = means[int(0.025 * rounds)], means[int(np.ceil(0.975 * rounds)) - 1]
    verdict = "B_BETTER" if low > 0 else "A_BETTER" if high < 0 else "MIXED" if wins and losses else "INCONCLUSIVE"
    return spark.createDataFrame([(n, float(told["mean"]), float(low), float(high), wins, losses, n - wins - losses, verdict)], schema)


def graded(run: DataFrame, qrels: DataFrame, k: int, least: int = 3) -> DataFrame:
    """(qid, hit, recall, mrr) at ``k`` for every query of ``run`` or ``qrels``, where a grade of ``least`` or more is
    relevant; all three are null for a query without a relevant document."""
    good = qrels.filter(F.col("rel") >= least).select("qid", "id").distinct()
    total = good.groupBy("qid").agg(F.count("*").alias("total"))
    found = run.filter(F.col("rank") <= k).join(good, ["qid", "id"], "left_semi").groupBy("qid").agg(F.countDistinct("id").alias("n"), F.min("rank").alias("best"))
    every = run.select("qid").unionByName(qrels.select("qid")).distinct()
    d = every.join(total, "qid", "left").join(found, "qid", "left")
    known = F.col("total").isNotNull()
    return d.select(
        "qid",
        F.when(known, F.col("n").isNotNull()).alias("hit"),
        F.when(known, F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 9)).alias("recall"),
        F.when(known, F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 9)).alias("mrr"),
    )


def required_evidence(run: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(qid, covered): whether each group (qid, grp, id) of a query has one of its documents among the first k."""
    top = run.filter(F.col("rank") <= k).select("qid", "id").distinct().withColumn("in", F.lit(True))
    has = groups.join(top, ["qid", "id"], "left").groupBy("qid", "grp").agg(F.bool_or(F.coalesce("in", F.lit(False))).alias("has"))
    return has.groupBy("qid").agg(F.bool_and("has").alias("covered"))


def negative_absence(first: DataFrame, tokens: DataFrame) -> DataFrame:
    """(qid, absent): none of a query's tokens (qid, token) stands in the text or section of its first hit ``first``
    (qid, text, section); true where there is no hit."""
    hay = F.lower(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("section", F.lit(""))))
    d = tokens.join(first.select("qid", hay.alias("hay")), "qid", "left")
    return d.groupBy("qid").agg((~F.bool_or(F.coalesce(F.contains(F.col("hay"), F.lower("token")), F.lit(False)))).alias("absent"))


def ndcg_binary(run: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(qid, ndcg) of ranked files (qid, rank, file), where every place with an expected file counts, also one that
    repeats it; 0 for a query without an expected file."""
    good = expected.select("qid", "file").distinct()
    ideal = good.groupBy("qid").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    ideal = ideal.select("qid", F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1)).alias("idcg"))
    gain = run.filter(F.col("rank") <= k).join(good, ["qid", "file"], "left_semi").groupBy("qid").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    d = run.select("qid").distinct().join(ideal, "qid", "left").join(gain, "qid", "left")
    return d.select("qid", F.round(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)), 9).alias("ndcg"))


def relevant_overlap(a: DataFrame, b: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row: how many relevant documents the first k of only one lane, of both, and of neither have."""
    top = lambda d, name: d.filter(F.col("rank") <= k).select("qid", "id", F.lit(True).alias(name))
    d = qrels.filter("rel > 0").select("qid", "id").distinct().join(top(a, "x"), ["qid", "id"], "left").join(top(b, "y"), ["qid", "id"], "left")
    x, y = F.col("x").isNotNull(), F.col("y").isNotNull()
    return d.agg(F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither"))


TOLERANCE = 1e-9


def rescue_harm(base: DataFrame, other: DataFrame) -> DataFrame:
    """(qid, delta, kind) of per-query nDCG (qid, ndcg): rescue where the second is better by more than the
    tolerance, harm where it is worse, else tie; a query that one lacks counts 0 there."""
    d = base.select("qid", F.col("ndcg").alias("a")).join(other.select("qid", F.col("ndcg").alias("b")), "qid", "full")
    delta = F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 9)
    return d.select("qid", delta.alias("delta")).withColumn("kind", F.when(F.col("delta") > TOLERANCE, "rescue").when(F.col("delta") < -TOLERANCE, "harm").otherwise("tie"))


def representative_cases(cases: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` largest rescues and harms, ranked; ties by qid."""
    w = Window.partitionBy("kind").orderBy(F.desc(F.abs("delta")), "qid")
    return cases.filter("kind != 'tie'").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def metric_parity(recomputed: DataFrame, reported: DataFrame, metrics: list[str], key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, metric, ok) of two tables of metrics by ``key``: both null, or both there and within the tolerance."""
    values = lambda d, name: d.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("e")).select(key, "e.*")
    d = values(recomputed, "a").join(values(reported, "b"), [key, "metric"], "full")
    ok = (F.col("a").isNull() & F.col("b").isNull()) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False))
    return d.select(key, "metric", ok.alias("ok"))


def overall_verdict(comparisons: DataFrame) -> DataFrame:
    """One row from comparisons (n, mean, low, high): which way those point whose interval excludes zero."""
    sure = (F.col("n") > 0) & ((F.col("low") > 0) | (F.col("high") < 0))
    d = comparisons.agg(F.count_if(sure & (F.col("mean") > 0)).alias("better"), F.count_if(sure & (F.col("mean") <= 0)).alias("worse"))
    up, down = F.col("better") > 0, F.col("worse") > 0
    verdict = F.when(up & down, "FUSION_DATASET_DEPENDENT").when(up, "FUSION_COMPLEMENTARY").when(down, "FUSION_SPARSE_DEGRADES").otherwise("FUSION_ANALYSIS_INCONCLUSIVE")
    return d.select(verdict.alias("verdict"))


def exact_ranks(runs: DataFrame, qrels: DataFrame, least: int = 3) -> DataFrame:
    """(mode, qid, best): the first rank of a document graded ``least`` or more, for the queries that have one; null
    where a mode does not find it."""
    good = qrels.filter(F.col("rel") >= least).select("qid", "id").distinct()
    every = good.select("qid").distinct().join(F.broadcast(runs.select("mode").distinct()))  # a few modes
    best = runs.join(good, ["qid", "id"], "left_semi").groupBy("mode", "qid").agg(F.min("rank").cast("bigint").alias("best"))
    return every.join(best, ["mode", "qid"], "left")


def routing_metrics(runs: DataFrame, qrels: DataFrame, k: int = 10, by: list[str] = ()) -> DataFrame:
    """A row per mode (and the ``by`` columns of ``qrels``) of runs (mode, qid, id, rank): rank1, recalls at 3, 5 and k,
    support recall (grade 2 or more), mrr10 and nDCG with exponential gain, over queries that have the grades asked for."""
    by = list(by)
    grades = qrels.groupBy("qid", *by).agg(F.max("rel").alias("top"))
    every = grades.join(F.broadcast(runs.select("mode").distinct()))  # a few modes
    hits = runs.join(qrels.select("qid", "id", "rel"), ["qid", "id"]).groupBy("mode", "qid").agg(
        F.min(F.when(F.col("rel") >= 3, F.col("rank"))).alias("best"),
        F.min(F.when(F.col("rel") >= 2, F.col("rank"))).alias("support"),
        F.sum(F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "id"))
    ideal = qrels.select("qid", "id", "rel", place.alias("i")).filter(F.col("i") <= k).groupBy("qid").agg(F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("i") + 1)).alias("idcg"))
    d = every.join(hits, ["mode", "qid"], "left").join(ideal, "qid", "left")
    exact = F.col("top") >= 3
    share = lambda c, of: F.round(F.avg(F.when(of, F.coalesce(c.cast("int"), F.lit(0)))), 6)
    return d.groupBy("mode", *by).agg(
        F.count_if(exact & (F.col("best") == 1)).alias("rank1"),
        *[share(F.col("best") <= n, exact).alias(f"recall_{name}") for n, name in ((3, "3"), (5, "5"), (k, "k"))],
        share(F.col("support") <= k, F.lit(True)).alias("support_k"),
        F.round(F.avg(F.when(exact, F.coalesce(F.when(F.col("best") <= 10, 1.0 / F.col("best")), F.lit(0.0)))), 6).alias("mrr10"),
        F.round(F.avg(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0)), 6).alias("ndcg"),
        F.count("*").alias("n"),
    )


def ordering_loss(ranks: DataFrame, base: str, guarded: str, raw: str) -> DataFrame:
    """(qid, base_rank, guarded_rank, raw_rank, cause, mrr_loss) of queries whose document the base mode has first or
    second and the guarded mode lower, but still among three; the cause is the raw second stage's order (CE),
    the guard, or both (mixed). ``ranks``: (mode, qid, best)."""
    at = lambda m: F.max(F.when(F.col("mode") == m, F.col("best")))
    d = ranks.groupBy("qid").agg(at(base).alias("base_rank"), at(guarded).alias("guarded_rank"), at(raw).alias("raw_rank"))
    d = d.filter("base_rank <= 2 and guarded_rank > base_rank and guarded_rank <= 3")
    ce, guard = F.coalesce(F.col("raw_rank") > F.col("base_rank"), F.lit(False)), F.coalesce(F.col("guarded_rank") > F.col("raw_rank"), F.lit(False))
    cause = F.when(ce & guard, "mixed").when(ce, "CE").otherwise("guard")
    return d.withColumns({"cause": cause, "mrr_loss": F.round(1 / F.col("base_rank") - 1 / F.col("guarded_rank"), 9)})


def trigger_eval(signals: DataFrame, thresholds: list[float]) -> DataFrame:
    """A row per threshold over queries (signal, miss, recovers): a trigger fires below the threshold. Its rate, the
    share of misses that it catches, its precision and false positive rate, and how many caught misses recover."""
    d = signals.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    fired = F.coalesce(F.col("signal") < F.col("threshold"), F.lit(False))
    caught = fired & F.col("miss")
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return d.groupBy("threshold").agg(
        ratio(F.count_if(fired), F.count("*")).alias("trigger_rate"),
        ratio(F.count_if(caught), F.count_if("miss")).alias("miss_recall"),
        ratio(F.count_if(caught), F.count_if(fired)).alias("precision"),
        ratio(F.count_if(fired & ~F.col("miss")), F.count_if(~F.col("miss"))).alias("false_positive_rate"),
        ratio(F.count_if(caught & F.col("recovers")), F.count_if(caught)).alias("recovery"),
    )


def agent_policies(ranks: DataFrame) -> DataFrame:
    """A row per policy over queries (best, reranked, neighbour, window): ranks in one search, after reranking a deep
    one, whether a neighbour of the document is among five, and whether its window has it. Five results; ten; five,
    then ten; five, then reranked; five, then the neighbours' windows."""
    five, ten = F.coalesce(F.col("best") <= 5, F.lit(False)), F.coalesce(F.col("best") <= 10, F.lit(False))
    deep = F.coalesce(F.col("reranked") <= 10, F.lit(False))
    look = ~five & F.coalesce(F.col("neighbour"), F.lit(False))
    once = F.lit(1)
    more = F.when(five, 1).otherwise(2)
    policies = {
        "p1": (five, five, once),
        "p2": (ten, ten, once),
        "p3": (five, five | ten, more),
        "p4": (five, five | deep, more),
        "p5": (five, five | (look & F.coalesce(F.col("window"), F.lit(False))), F.when(look, 2).otherwise(1)),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), a.alias("one"), b.alias("two"), c.alias("calls")) for n, (a, b, c) in policies.items()])
    d = ranks.select(F.explode(rows).alias("p")).select("p.*")
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return d.groupBy("policy").agg(share("one").alias("success_1"), share("two").alias("success_2"), F.round(F.avg("calls"), 6).alias("calls"))


def retrieval_report(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row over queries (qid, negative, files, sections, all_tokens, any_tokens, latency) and their hits (qid, rank,
    file, section, text): recall at 1 and k, mrr, nDCG, section and token hits among the expected files' hits,
    passed negatives, duplicate files, diversity, latencies."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)
    d = hits.filter(F.col("rank") <= k).withColumn("__w", F.concat(words(F.col("text")), words(F.col("section")))).join(queries, "qid")
    good = F.array_contains("files", F.col("file"))
    none = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0
    tokens_ok = (none("all_tokens") | (F.size(F.array_except("all_tokens", "__w")) == 0)) & (none("any_tokens") | F.arrays_overlap("any_tokens", "__w"))
    per = d.groupBy("qid").agg(
        F.min(F.when(good, F.col("rank"))).alias("best"),
        F.sum(F.when(good, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.bool_or(good & F.array_contains("sections", F.col("section"))).alias("section_hit"),
        F.bool_or(good & tokens_ok).alias("token_hit"),
        F.bool_or((F.col("rank") == 1) & F.arrays_overlap(F.coalesce("all_tokens", F.array().cast("array<string>")), "__w")).alias("strong"),
        F.countDistinct("file").alias("files_found"),
        F.count("file").alias("n"),
    )
    every = queries.join(per, "qid", "left")
    positive = ~F.col("negative")
    idcg = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("files"), F.lit(k)))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    mean = lambda c, of=positive: F.round(F.avg(F.when(of, c)), 6)
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    rank = lambda p: F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY latency) AS DOUBLE)")
    return every.agg(
        mean(yes(F.col("best") <= 1)).alias("recall_1"),
        mean(yes(F.col("best") <= k)).alias("recall_k"),
        mean(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"),
        mean(F.when(F.size("files") > 0, F.coalesce("dcg", F.lit(0.0)) / idcg).otherwise(0.0)).alias("ndcg"),
        mean(yes(F.col("section_hit")), positive & ~none("sections")).alias("section_hit"),
        mean(yes(F.col("token_hit")), positive & ~(none("all_tokens") & none("any_tokens"))).alias("token_hit"),
        mean(yes(~F.coalesce("strong", F.lit(False))), F.col("negative")).alias("negative_pass"),
        mean(F.when(F.col("n") > 0, 1 - F.col("files_found") / F.col("n")).otherwise(0.0)).alias("duplicate_rate"),
        mean(F.coalesce("files_found", F.lit(0))).alias("diversity"),
        F.round(F.avg("latency"), 6).alias("latency"),
        rank(0.5).alias("p50"),
        rank(0.95).alias("p95"),
        F.count_if(positive).alias("n_positive"),
        F.count_if("negative").alias("n_negative"),
    )


def tag_fill(chunks: DataFrame, latency: str) -> DataFrame:
    """One row: the share of chunks with a tag, tags a chunk, and the mean, median and 95th percentile of a latency."""
    n = F.size(F.coalesce("tags", F.array().cast("array<string>")))
    rank = lambda p: F.expr(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY {latency}) AS DOUBLE)")
    return chunks.agg(
        F.round(F.avg((n > 0).cast("int")), 6).alias("filled"),
        F.round(F.avg(n), 6).alias("mean_tags"),
        F.round(F.avg(latency), 6).alias("mean"),
        rank(0.5).alias("p50"),
        rank(0.95).alias("p95"),
    )


def safe_candidates(grid: DataFrame, groups: list[str], tolerance: float = 0.0) -> DataFrame:
    """(k, ratio, gain, safe): a fusion setting's mean gain over the base, and whether in no group of ``grid`` (k, ratio,
    *groups, base, fused) the fused mean falls below the base mean by more than the tolerance; best safe first."""
    g = grid.groupBy("k", "ratio", *groups).agg(F.avg("base").alias("b"), F.avg("fused").alias("f"), F.count("*").alias("n"))
    out = g.groupBy("k", "ratio").agg(F.round(F.sum((F.col("f") - F.col("b")) * F.col("n")) / F.sum("n"), 6).alias("gain"), F.bool_and(F.col("f") >= F.col("b") - tolerance).alias("safe"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("safe"), F.desc("gain"), "k", "ratio")))  # a row per setting
