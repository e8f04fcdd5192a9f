"""Text forms of ranked runs and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_lines(run: DataFrame, tag: str) -> DataFrame:
    """(value): six fields a hit of (qid, id, rank, score), tab-separated."""
    return run.select(F.concat_ws("\t", "qid", F.lit("Q0"), "id", "rank", "score", F.lit(tag)).alias("value"))


def parse_run(lines: DataFrame) -> DataFrame:
    """(qid, id, rank, score, tag) of a run's lines; blank lines go. Any other that has not six fields, a whole rank and
    a finite score fails the read."""
    value = F.trim("value")
    f = F.split(value, r"\s+")
    rank, score = F.get(f, F.lit(3)).try_cast("int"), F.get(f, F.lit(4)).try_cast("double")
    good = (F.size(f) == 6) & (F.get(f, F.lit(1)) == "Q0") & rank.isNotNull() & score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    checked = F.when(F.coalesce(good, F.lit(False)), f).otherwise(F.raise_error(F.concat(F.lit("not a run line: "), "value")))
    d = lines.filter(value != "").select(checked.alias("f"))
    return d.select(F.get("f", F.lit(0)).alias("qid"), F.get("f", F.lit(2)).alias("id"), F.get("f", F.lit(3)).cast("int").alias("rank"), F.get("f", F.lit(4)).cast("double").alias("score"), F.get("f", F.lit(5)).alias("tag"))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """(qid, id, score) of tab-separated lines, without a header and scores that are no finite numbers."""
    f = F.split("value", "\t")
    score = f[2].try_cast("double")
    good = (F.size(f) >= 3) & (f[0] != "query-id") & score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    return lines.filter(good).select(f[0].alias("qid"), f[1].alias("id"), score.alias("score"))
