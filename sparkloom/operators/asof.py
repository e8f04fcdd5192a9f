"""Joins of each row with the latest one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, tie: list[str] | None = None, bucket: str = "1 day", prefix: str = "last_") -> DataFrame:
    """``left`` with the latest row of ``right`` of the same ``by`` whose ``at`` (a timestamp) is not after its own, of equal
    times the last by ``tie`` (by default by all columns): its other columns under ``prefix``, null where there is none.

    Both tables are one sorted sequence, cut into time buckets, so that a common key is spread: inside a bucket the last
    right row so far is carried along, and a bucket without one yet takes what the key's buckets before left, of which
    there is one row each. Null keys match null keys; a row without a time has no match and is none.
    """
    payload = [c for c in right.columns if c not in by]
    tie = tie if tie is not None else [c for c in payload if c != at]
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    names = [f"__k{i}" for i in range(len(by))]
    row = F.struct(*left.columns)
    hit = F.struct(*payload)
    # of equal times right rows come first, in order of the tie
    mine = left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*tie).alias("t")).schema["t"].dataType).alias("__tie"), row.alias("__row"), F.lit(None).cast(right.select(hit.alias("h")).schema["h"].dataType).alias("__hit"))
    other = right.filter(F.col(at).isNotNull()).select(*keys, F.col(at).alias("__t"), F.lit(0).alias("__side"), F.struct(*tie).alias("__tie"), F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), hit.alias("__hit"))
    both = mine.unionByName(other).withColumn("__b", F.window("__t", bucket)["start"])
    # a window column drops rows without a time
    untimed = mine.filter(F.col("__t").isNull()).select(*[F.col("__row")[c].alias(c) for c in left.columns], *[F.lit(None).cast(right.schema[c].dataType).alias(prefix + c) for c in payload])
    so_far = Window.partitionBy(*names, "__b").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__hit", F.last("__hit", ignorenulls=True).over(so_far))
    ends = other.withColumn("__b", F.window("__t", bucket)["start"]).groupBy(*names, "__b").agg(F.max_by("__hit", F.struct("__t", "__tie")).alias("__end"))
    # the buckets of a key with a row of either side, and what was left before each
    places = mine.withColumn("__b", F.window("__t", bucket)["start"]).select(*names, "__b").distinct().withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType))
    marks = ends.withColumn("__r", F.lit(True)).unionByName(places.withColumn("__r", F.lit(False))).groupBy(*names, "__b").agg(F.max_by("__end", "__r").alias("__end"))
    earlier = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = marks.withColumn("__before", F.last("__end", ignorenulls=True).over(earlier)).select(*[F.col(n).alias(f"{n}x") for n in names], F.col("__b").alias("__bx"), "__before")
    same = F.col("__b") == F.col("__bx")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}x"))
    found = carried.filter("__side = 1").join(before, same, "left").withColumn("__hit", F.coalesce("__hit", "__before"))
    out = found.select(*[F.col("__row")[c].alias(c) for c in left.columns], *[F.col("__hit")[c].alias(prefix + c) for c in payload])
    return out.unionByName(untimed)


def refilled(tokens: Column, elapsed_ms: Column, capacity: float, per_ms: float) -> Column:
    """What a bucket of so many tokens holds after a time without use; full where it was never used."""
    return F.coalesce(F.least(F.lit(float(capacity)), tokens + elapsed_ms * per_ms), F.lit(float(capacity)))
