"""Bounded training samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def crc_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(crc_remainder(doc_id, modulus) == remainder, F.lit(False))


def sample_ids(rows: DataFrame, doc_id: str, most: int, seed: int = 0) -> list[int]:
    """At most ``most`` distinct ids, the first in the order of a seeded hash: all of them in a small
    table, an even sample of a large one, the same at every run."""
    ids = rows.select(F.col(doc_id).alias("i")).filter("i is not null").distinct()
    return [r["i"] for r in ids.orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(most).collect()]


def sample_rows(docs: DataFrame, ids: dict[int, int], doc_id: str, text: str, tag: str) -> DataFrame:
    """(doc_id, text, y) of a bounded list of ids and their marks, written: one row for each id (of rows that
    repeat it the first by text), wherever the executors read it. The texts do not come to the driver."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    few = spark.createDataFrame(sorted(ids.items()), f"doc_id {kind}, y int")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(few), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return materialize(rows.select("doc_id", "text", "y"), tag)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Adam:
    """Steps for full-batch gradients."""

    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
