"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch_path


def _written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of the edges (u, v), of any one ordered type, that has another one linked, and
    ``root`` the smallest node of its component.

    Alternates large-star and small-star rounds until the edges no longer change: O(log^2) rounds, and the
    number of edges never grows. Each round takes the smallest neighbour by partial
    aggregation and joins it to the edges, so a hub's edges are spread by the skew join. Every round is
    written to the shared folder. Loops and repeated edges do no harm, null ends are dropped.
    """
    e = edges.select("u", "v").filter("u != v").distinct()
    e, path = _written(e, "cc-edges")
    last = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        down, mid = _written(down, "cc-large")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new, new_path = _written(small.filter("u != v").distinct(), "cc-small")
        remove(e.sparkSession, path)
        remove(e.sparkSession, mid)
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        e, path = new, new_path
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


