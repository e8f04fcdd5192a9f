"""Exact quantiles against sorting."""

import math
import random

from sparkloom.operators.quantiles import exact_quantiles


def test_exact_quantiles(spark):
    r = random.Random(2)
    groups = {"a": [r.gauss(0, 1) for _ in range(501)], "b": [1e-300, -1e308, 1e308, 5.0, 5.0, 5.0], "c": [7.0] * 40, None: [2.0**i for i in range(-40, 60)], "d": [float(i % 3) for i in range(100)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None)]
    d = spark.createDataFrame(r.sample(rows, len(rows)), "share string, v double").withColumnRenamed("share", "low").repartition(3)
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = {(x["low"], x["share"]): x["value"] for x in exact_quantiles(d, ["low"], "v", shares, parts=8).collect()}
    assert got == {(k, s): sorted(vs)[max(1, math.ceil(s * len(vs))) - 1] for k, vs in groups.items() for s in shares}


def test_no_rows(spark):
    assert exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [0.5]).collect() == []
