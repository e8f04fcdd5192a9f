"""As-of joins against a scan of all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.asof import asof_join


@pytest.mark.parametrize("bucket", ["1 hour", "3 days"])
def test_asof_join(spark, bucket):
    r = random.Random(1)
    when = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * r.randrange(300))
    key = lambda: r.choice([1, 1, 1, 1, 2, 3, None])
    left = [(i, key(), when() if r.random() > 0.05 else None, "x") for i in range(300)]
    right = [(i, key(), when() if r.random() > 0.05 else None, float(i % 7)) for i in range(120)]
    a = spark.createDataFrame(left, "id long, k long, ts timestamp, size string").repartition(3)
    b = spark.createDataFrame(right, "id long, k long, ts timestamp, size double")
    got = {x["id"]: (x["last_id"], x["last_ts"], x["last_size"]) for x in asof_join(a, b, ["k"], "ts", ["id"], bucket).collect()}
    assert len(got) == 300
    for i, k, t, _ in left:
        best = max(((u, j, s) for j, q, u, s in right if q == k and u is not None and t is not None and u <= t), default=None)
        assert got[i] == ((best[1], best[0], best[2]) if best else (None, None, None))
    assert sum(v[0] is not None for v in got.values()) > 100


def test_asof_join_of_empty_tables(spark):
    a = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "k long, ts timestamp")
    assert [tuple(x) for x in asof_join(a, a.filter("k > 1").withColumn("v", F.lit(1)), ["k"], "ts").collect()] == [(1, dt.datetime(2024, 1, 1), None, None)]
    assert asof_join(a.filter("k > 1"), a, ["k"], "ts").collect() == []
