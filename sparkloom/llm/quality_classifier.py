"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text; the class prior is estimated from the scores of a first,
non-traditional classifier over all documents, and a linear model then minimises the non-negative unbiased risk.
Its inputs are hashed words and character 3-grams, and the shape of the text. They are made on executors; the
driver holds vectors of a fixed length of a bounded number of rows, never texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import Adam, held_out, sample_ids, sample_rows, sigmoid

#: Trusted positives and unlabelled rows that training takes at most.
MOST_POSITIVE, MOST_UNLABELLED = 2000, 4000
SHAPES = 14
#: Hashed inputs: as many of words as of character 3-grams.
HASHED = 512
WIDTH = SHAPES + 2 * HASHED
#: What a hashed weight costs; that of a shape costs RIDGE_SHAPE.
RIDGE_HASHED, RIDGE_SHAPE = 1e-2, 1e-3
CUTS = 100
_CHUNK = 1 << 20
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>~^{}[]\\@=+_")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!?")] = True


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text: 14 numbers, each bounded or logarithmic. All zero without a word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(14)
    b = np.frombuffer(raw, dtype=np.uint8)
    n, size = len(words), len(b) - int(_WHITE[b].sum())
    upper, lower = int(((b >= 65) & (b <= 90)).sum()), int(((b >= 97) & (b <= 122)).sum())
    pairs = set(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(a == c for a, c in zip(words, words[1:], strict=False))
    return np.array(
        [
            np.sqrt(_SYMBOL[b].sum() / n),
            np.sqrt(_MARK[b].sum() / n),
            np.sqrt(raw.count(b"|") / n),
            upper / max(1, upper + lower),
            np.sqrt(same / n),
            len(set(words)) / n**0.8,
            len(pairs) / max(1, n - 1),
            1 - len(set(lines)) / len(lines),
            np.log1p(n) / 10,
            np.log(size / n),
            np.sqrt(((b >= 48) & (b <= 57)).sum() / size),
            np.log1p(n / len(lines)) / 6,
            np.sqrt((b == 46).sum() / n),
            np.sqrt((b == 44).sum() / n),
        ]
    )


def _signed(h: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` the numbers ``n`` at the places of the hashes ``h``, with a sign of each hash's own."""
    at = ((h >> np.uint64(8)) % np.uint64(HASHED)).astype(np.int64)
    out += np.bincount(at, weights=np.where(h & np.uint64(1), n, -n), minlength=HASHED)


def hashed(text: str | None) -> np.ndarray:
    """Words and character 3-grams of a whole text, lower-cased, hashed with signs; each half of root counts has
    length one (zero without a word)."""
    out = np.zeros((2, HASHED))
    words = (text or "").lower().split()
    if not words:
        return out.ravel()
    counts = Counter(words)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in counts), np.uint64, len(counts))
    _signed(h, np.sqrt(np.fromiter(counts.values(), np.float64, len(counts))), out[0])
    whole = " " + " ".join(words) + " "
    for i in range(0, len(whole) - 2, _CHUNK):
        c = np.frombuffer(whole[i : i + _CHUNK + 2].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        key = (((c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        _signed(key, np.ones(len(key)), out[1])
    out[1] = np.sign(out[1]) * np.sqrt(np.abs(out[1]))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).ravel()


def vectors(texts) -> np.ndarray:
    """The inputs of each text before scaling: its shape and its hashed features."""
    if not len(texts):
        return np.zeros((0, WIDTH), dtype=np.float32)
    return np.vstack([np.concatenate((features(t), hashed(t))) for t in texts]).astype(np.float32)


class Model:
    def __init__(self, centre: np.ndarray, spread: np.ndarray, w: np.ndarray, b: float, prior: float) -> None:
        self.centre, self.spread, self.w, self.b, self.prior = centre, spread, w, b, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x[:, :SHAPES] - self.centre) / self.spread, -8, 8).astype(np.float32)
        return np.hstack([z, z * z, x[:, SHAPES:]])

    def outputs(self, texts) -> np.ndarray:
        return self.inputs(vectors(texts)) @ self.w.astype(np.float32) + self.b

    def score(self, texts) -> np.ndarray:
        return sigmoid(self.outputs(texts).astype(np.float64))


def _blank(w: float = 0.5) -> Model:
    return Model(np.zeros(SHAPES), np.ones(SHAPES), np.zeros(SHAPES + WIDTH), 0.0, w)


RIDGE = np.repeat([RIDGE_SHAPE, RIDGE_HASHED], [2 * SHAPES, 2 * HASHED])


def prior_cuts(positive: np.ndarray, least: float = 0.8) -> np.ndarray:
    """The cuts at which shares are compared: quantiles of the positives' scores that at least ``least`` pass."""
    return np.quantile(positive, np.linspace(0.002, 1 - least, CUTS))


def prior_from_counts(positive: np.ndarray, cuts: np.ndarray, above: np.ndarray, n: int) -> float:
    """The share of positives among ``n`` unlabelled rows of which ``above`` reach each cut: the smallest
    ratio of the shares above a cut."""
    ratio = [a / max(1, n) / max((positive >= c).mean(), 1e-9) for a, c in zip(above, cuts, strict=True)]
    return float(np.clip(min(ratio), 0.05, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.8) -> float:
    """The same of scores that are at hand."""
    cuts = prior_cuts(positive, least)
    return prior_from_counts(positive, cuts, np.array([(unlabelled >= c).sum() for c in cuts]), len(unlabelled))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
    w = np.zeros(x.shape[1] + 1)
    adam = Adam(len(w), 0.05)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(steps):
        error = weight * (sigmoid((x @ w[:-1].astype(np.float32)).astype(np.float64) + w[-1]) - y)
        w += adam.step(np.append(x.T @ error.astype(np.float32) + RIDGE * w[:-1], error.sum()))
    return w


def non_negative_risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative unbiased risk of logistic loss, and the gradients by the outputs that reduce
    it. Where the estimated negative part is below zero, the step undoes it instead."""
    soft = lambda z: np.logaddexp(0, z)
    part_p, part_n = prior * soft(-z_p).mean(), soft(z_u).mean() - prior * soft(z_p).mean()
    g_p, g_u = sigmoid(z_p) / len(z_p), sigmoid(z_u) / len(z_u)
    if part_n >= 0:
        return part_p + part_n, prior * (g_p - 1 / len(z_p)) - prior * g_p, g_u
    return part_p, prior * g_p, -g_u


def first_model(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Positives against unlabelled rows: its scores rank rows by how likely they are positive."""
    model = _blank()
    shapes = positive[:, :SHAPES]
    model.centre = np.median(shapes, axis=0)
    model.spread = np.maximum(1.4826 * np.median(np.abs(shapes - model.centre), axis=0), 0.03)
    w = _logistic(np.vstack([model.inputs(positive), model.inputs(unlabelled)]), np.repeat([1.0, 0.0], [len(positive), len(unlabelled)]))
    model.w, model.b = w[:-1], float(w[-1])
    return model


def train(positive: np.ndarray, unlabelled: np.ndarray, first: Model, prior: float, steps: int = 600) -> Model:
    """Minimises the non-negative risk under ``prior``, with the scales of ``first``."""
    model = Model(first.centre, first.spread, first.w, first.b, prior)
    xp, xu = model.inputs(positive), model.inputs(unlabelled)
    w = np.zeros(xp.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    adam = Adam(len(w), 0.03)
    for _ in range(steps):
        v = w[:-1].astype(np.float32)
        _, g_p, g_u = non_negative_risk((xp @ v).astype(np.float64) + w[-1], (xu @ v).astype(np.float64) + w[-1], prior)
        w += adam.step(np.append(xp.T @ g_p.astype(np.float32) + xu.T @ g_u.astype(np.float32) + RIDGE * w[:-1], g_p.sum() + g_u.sum()))
    model.w, model.b = w[:-1], float(w[-1])
    return model


def _counts_above(docs: DataFrame, text: str, model: Model, cuts: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents, and how many of them score each cut or more: sums over all of them."""
    shipped = docs.sparkSession.sparkContext.broadcast((model, np.sort(cuts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cuts = shipped.value
        found, n = np.zeros(len(cuts), dtype=np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            reached = np.searchsorted(cuts, model.outputs(texts), side="right")
            found += np.bincount(reached, minlength=len(cuts) + 1)[::-1].cumsum()[::-1][1:]
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts) + 1)), pa.array(np.append(found, n))], names=["i", "n"])

    rows = docs.select(F.col(text)).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    at = {r["i"]: r["n"] for r in rows}
    return at.get(len(cuts), 0), np.array([at.get(i, 0) for i in range(len(cuts))])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Train on a bounded sample: rows labelled 1 are the trusted positives (no other label is read), and
    any documents, whatever their labels, are the unlabelled text. The class prior is taken over all
    documents: half of the positives train the first classifier, and the shares of the other half and of
    all documents above the cuts are compared. Without positives or documents every score is one half."""
    trusted = sample_ids(labels.filter(F.col(label) == 1), doc_id, most_positive)
    some = sample_ids(docs, doc_id, most_unlabelled, seed=1)
    marks = {i: 1 for i in trusted}
    for i in some:
        marks[i] = marks.get(i, 0) + 2  # 1: positive, 2: unlabelled, 3: both
    sample = sample_rows(docs, marks, doc_id, text, "quality-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors(b.column(1).to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([row.tobytes() for row in x], pa.binary())], names=["doc_id", "y", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    # some 2 kB a row of a bounded number of rows, in half precision
    rows = sample.mapInArrow(run, f"doc_id {kind}, y int, x binary").toPandas().sort_values("doc_id")
    mark = rows["y"].to_numpy()
    x = np.frombuffer(b"".join(rows.pop("x")), dtype=np.float16).reshape(-1, WIDTH).astype(np.float32)
    positive, unlabelled = x[mark & 1 == 1], x[mark & 2 == 2]
    del x, rows
    if len(positive) < 2 or not len(unlabelled):
        return _blank()
    half = np.arange(len(positive)) % 2 == 1
    first = first_model(positive[half], unlabelled)
    held = first.inputs(positive[~half]) @ first.w.astype(np.float32) + first.b
    cuts = np.sort(prior_cuts(held))
    n, above = _counts_above(docs, text, first, cuts)
    return train(positive, unlabelled, first, prior_from_counts(held, cuts, above, n))


def score_quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) per row of ``docs``, from its whole text alone; a null text scores as
    an empty one, rows that repeat an id or a text are scored like any others, an empty table gives an empty
    result. Other columns are not read."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = shipped.value.score(b["text"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score, "predicted": (score >= threshold).astype(np.int32)})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {kind}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted): trained on labels whose crc32(doc_id) mod ``modulus`` is not
    ``remainder``, applied to every document. A null id is never held out; other columns of either table
    are not read."""
    model = fit(docs, labels.filter(~held_out("doc_id", modulus, remainder)))
    return score_quality(docs, model).select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", "predicted")
