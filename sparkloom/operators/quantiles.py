"""Exact quantiles of large groups by counted ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.collections import scratch_folder

#: Parts that a range is cut into in a round.
PARTS = 256


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], parts: int = PARTS) -> DataFrame:
    """(by, share, value): for each group the least value that ``share`` of its values do not exceed (nearest rank).

    The range of a group's values is cut in equal parts, values are counted by part (in the task first, so a group sends a
    row for each part at most, however many values it has), and the part with the wanted rank is the next range, from
    its least value to its greatest, until these are one. Values outside are left behind each round. Nulls and NaN do not
    count; a group without other values gives no row; null groups are groups.
    """
    spark = rows.sparkSession
    folder = scratch_folder(spark, "quantiles")
    names = [f"__k{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    d = rows.filter(v.isNotNull() & ~F.isnan(v)).select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], v.alias("v"))
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    open_ = d.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("share", wanted)
    open_ = open_.select(*names, "share", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n"))).cast("bigint").alias("rank"), "low", "high")
    open_.write.parquet(f"{folder}/ranges-0")
    values, done, at = d, None, 0
    while True:
        ranges = spark.read.parquet(f"{folder}/ranges-{at}")
        found = ranges.filter("low = high").select(*names, "share", F.col("low").alias("v"))
        done = found if done is None else done.unionByName(found)
        left = ranges.filter("low < high")
        if left.isEmpty():
            break
        # halves, so that the width of a range is a number
        same = F.lit(True)
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"r{n}"))
        asked = left.select(*[F.col(n).alias(f"r{n}") for n in names], "share", "rank", "low", "high")
        place = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        inside = values.join(asked, same & F.col("v").between(F.col("low"), F.col("high"))).withColumn("part", F.least(F.floor(place * parts), F.lit(parts - 1)))
        counts = inside.groupBy(*names, "share", "rank", "part").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        through = F.sum("n").over(Window.partitionBy(*names, "share").orderBy("part"))
        hit = counts.withColumn("through", through).filter((F.col("through") - F.col("n") < F.col("rank")) & (F.col("rank") <= F.col("through")))
        at += 1
        hit.select(*names, "share", (F.col("rank") - F.col("through") + F.col("n")).alias("rank"), "low", "high").write.parquet(f"{folder}/ranges-{at}")
    return done.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], "share", F.col("v").alias("value"))
