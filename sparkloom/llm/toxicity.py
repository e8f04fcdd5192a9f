"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes
log-count ratios, trained here on labelled text. Features are made and counted on executors; the driver sees
counts of hashed features, and of each labelled row those that the model keeps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import Adam, held_out, sample_ids, sample_rows, sigmoid

BITS = 20
SIZES = (4, 5, 6)
#: Labelled rows that training takes at most, of either label.
MOST_POSITIVE, MOST_NEGATIVE = 3000, 6000
#: Features of fewer texts are left out, and those whose log-count ratio times the root of that number is
#: nearer to 0 than CLEAR, whichever label they speak for.
LEAST, CLEAR = 3, 8.0
RIDGE = 1e-3
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def ngrams(text: str | None) -> Iterator[np.ndarray]:
    """Hashed features of a text, part by part and with repeats: its n-grams of code points, lower-cased, white
    space as one space, over the whole text."""
    whole = " " + " ".join((text or "").lower().split()) + " "
    for at in range(0, len(whole), _CHUNK):
        part = whole[at : at + _CHUNK + max(SIZES) - 1]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        key = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, min(max(SIZES), len(c)) + 1):
            key = key[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
            if n in SIZES:
                yield (((key + np.uint64(n)) * _ODD) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(text: str | None, kept: np.ndarray | None = None) -> np.ndarray:
    """The distinct features of a text, or those of them that ``kept`` has a non-zero entry for."""
    parts = [x if kept is None else x[kept[x] != 0] for x in ngrams(text)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.int64)


class Model:
    """``weight`` per hashed feature (the ratio included) and ``bias``."""

    def __init__(self, weight: np.ndarray, bias: float) -> None:
        self.weight, self.bias = weight, bias

    def score(self, texts) -> np.ndarray:
        z = np.fromiter((self.weight[distinct(t, self.weight)].sum(dtype=np.float64) for t in texts), np.float64, len(texts))
        return sigmoid(z + self.bias)


def log_count_ratio(with_0: np.ndarray, with_1: np.ndarray, n0: int, n1: int, smooth: float = 1.0) -> np.ndarray:
    """How much more often texts labelled 1 have a feature than those labelled 0, as a logarithm."""
    return np.log((with_1 + smooth) / (n1 + 2 * smooth)) - np.log((with_0 + smooth) / (n0 + 2 * smooth))


def loss(w: np.ndarray, row: np.ndarray, col: np.ndarray, ratio: np.ndarray, labels: np.ndarray, ridge: float = RIDGE) -> tuple[float, np.ndarray]:
    """Logistic loss of the weights and, last, the bias, and its gradient. ``row`` and ``col`` say which row has
    which feature, and a feature enters by its ratio; the rarer label weighs more, by the root of its rarity."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    balance /= balance.sum()
    scale = ratio[col]
    z = np.bincount(row, weights=w[col] * scale, minlength=len(labels)) + w[-1]
    error = balance * (sigmoid(z) - labels)
    grad = np.append(np.bincount(col, weights=error[row] * scale, minlength=len(w) - 1) + ridge * w[:-1], error.sum())
    value = (balance * (np.logaddexp(0, z) - labels * z)).sum() + ridge / 2 * (w[:-1] ** 2).sum()
    return float(value), grad


def train(features: list[np.ndarray], labels: np.ndarray, kept: np.ndarray, ratio: np.ndarray, steps: int = 200) -> Model:
    """From the kept features of each row (as indices into ``kept``, their hashes). Without both labels, the share
    of ones is the score."""
    labels = np.asarray(labels, dtype=np.float64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    w = np.append(np.zeros(len(kept)), np.log(share / (1 - share)))
    weight = np.zeros(1 << BITS, dtype=np.float32)
    if len(labels) and labels.min() != labels.max() and len(kept):
        row = np.repeat(np.arange(len(features)), [len(f) for f in features])
        col = np.concatenate(features).astype(np.int64)
        adam = Adam(len(w), 0.03)
        for _ in range(steps):
            w = w + adam.step(loss(w, row, col, ratio, labels)[1])
        weight[kept] = w[:-1] * ratio
    return Model(weight, float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_positive: int = MOST_POSITIVE, most_negative: int = MOST_NEGATIVE) -> Model:
    """Train on a bounded sample of the labelled rows: at most ``most_positive`` with label 1 and
    ``most_negative`` with label 0. Null labels, and labels without a document, are left out; of repeated
    labels of an id the largest counts, and of rows that repeat an id the first by text."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    marks = {i: 1 for i in sample_ids(known.filter("y = 1"), "doc_id", most_positive)}
    marks |= {i: 0 for i in sample_ids(known.filter("y = 0"), "doc_id", most_negative)}
    sample = sample_rows(docs, marks, doc_id, text, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BITS), dtype=np.int64)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[y, distinct(t)] += 1
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[0, at]), pa.array(found[1, at])], names=["feature", "c0", "c1"])

    by = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = by.get(0, 0), by.get(1, 0)
    counts = sample.select("text", "y").mapInArrow(count, "feature bigint, c0 bigint, c1 bigint")
    counts = counts.groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).filter(F.col("c0") + F.col("c1") >= LEAST)
    # only features that tell the labels apart come to the driver: those whose ratio is clear, with room for rounding
    told = F.log((F.col("c1") + 1) / (n1 + 2)) - F.log((F.col("c0") + 1) / (n0 + 2))
    counts = counts.filter(F.abs(told) * F.sqrt(F.col("c0") + F.col("c1")) >= CLEAR - 1e-6)
    counts = counts.toPandas().sort_values("feature")
    c0, c1 = counts["c0"].to_numpy(), counts["c1"].to_numpy()
    ratio = log_count_ratio(c0, c1, n0, n1)
    clear = np.abs(ratio) * np.sqrt(c0 + c1) >= CLEAR
    kept, ratio = counts["feature"].to_numpy()[clear], ratio[clear]
    place = np.zeros(1 << BITS, dtype=np.int32)
    place[kept] = np.arange(1, len(kept) + 1)
    shipped = docs.sparkSession.sparkContext.broadcast(place)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shipped.value
        for b in batches:
            found = [(place[distinct(t, place)] - 1).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "y", "f"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = sample.select("doc_id", "text", "y").mapInArrow(features, f"doc_id {kind}, y int, f array<int>").toPandas().sort_values("doc_id")
    return train(list(rows["f"]), rows["y"].to_numpy(), kept, ratio)


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs``, from its whole text alone. A null text scores as
    an empty one, rows that repeat an id or a text are scored like any others, an empty table gives an empty
    result. Other columns are not read. No shuffle; the model has a fixed size."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = shipped.value.score(b["text"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score, "predicted": (score >= threshold).astype(np.int32)})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted): trained on labels whose crc32(doc_id) mod ``modulus`` is not
    ``remainder``, applied to every document. Without labels, or with one label only, every score is the
    (smoothed) share of ones; a null id is never held out; other columns of either table are not read."""
    model = fit(docs, labels.filter(~held_out("doc_id", modulus, remainder)))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", "predicted")
