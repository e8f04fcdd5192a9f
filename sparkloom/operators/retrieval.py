"""Retrieval: sparse encoding, top-k lanes, fusion, reranking and window expansion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import SPARSE_BUCKETS, SPARSE_STOP_WORDS, hash_bucket, query_tokens, sparse_words
from ..sources.collections import written

# BM25 saturation, fusion and rerank weights.
K1, B = 1.5, 0.75
RRF_K = 60
SOURCE_BOOST, SECTION_BOOST, TAG_BOOST, TEXT_BOOST, TEXT_MOST = 0.08, 0.06, 0.05, 0.01, 0.05
INTRO_PENALTY, PROTECT, FILE_PENALTY = 0.02, 0.05, (0.0, 0.05, 0.10, 0.15)
SPECIAL_IDS = (0, 1, 2, 3, 250001)


def sparse_terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term): a row for each of a text's sparse tokens. Words are exploded first and filtered as rows, by a hash set
    in compiled code, not as elements of an array."""
    words = docs.select(key, F.explode(sparse_words(F.col(text))).alias("term"))
    return words.filter((F.length("term") > 1) & ~F.col("term").isin(*SPARSE_STOP_WORDS))


#: Bytes of texts, and rows of their encodings, that one task counts on average, whatever the settings of the session are.
TASK_TEXT, TASK_TERMS = 4 << 20, 500_000


def dealt(rows: DataFrame, by: str, size: Column, most: int) -> DataFrame:
    """``rows`` dealt by a key to as many tasks as keep the sum of ``size`` in a task at ``most`` on average. The number is
    stated, so tasks are not put together again, and what a task holds does not grow with the input."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    return rows.repartition(max(1, -(-int(total) // most)), by)


def sparse_encode(docs: DataFrame, key: str, text: str = "text", avg_length: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """(key, bucket, weight): saturated term frequencies, colliding buckets added up. With ``avg_length``
    lengths are normalised by the corpus mean; without it the norm is 1. ``wanted`` (bucket): only these
    buckets are encoded. Texts are dealt by key before they are split, so that all counts and sums of a text are made where
    it is: what moves is each text once, not its terms. A task counts ``TASK_TEXT`` bytes of texts on average."""
    terms = sparse_terms(dealt(docs.select(key, text), key, F.octet_length(text), TASK_TEXT), key, text).groupBy(key, "term").agg(F.count("*").alias("f"))
    norm: Column = F.lit(1.0)
    if avg_length:
        n = terms.groupBy(key).agg(F.sum("f").alias("n"))
        mean = n.agg(F.avg("n")).first()[0]
        terms = terms.join(n, key)
        norm = 1 - B + B * F.col("n") / F.lit(mean)
    weight = F.col("f") * (K1 + 1) / (F.col("f") + K1 * norm)
    hashed = terms.select(key, hash_bucket(F.col("term")).alias("bucket"), weight.alias("w"))
    if wanted is not None:
        hashed = hashed.join(wanted.select("bucket").distinct(), "bucket", "left_semi")
    return hashed.groupBy(key, "bucket").agg(F.sum("w").alias("weight"))


def _buckets(terms: pa.Array) -> np.ndarray:
    """``hash_bucket`` of an array of terms: a step for each place of a code unit, over the terms that reach it."""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(terms).to_numpy())]).astype(np.int64)
    whole = "".join(terms.to_pylist())
    byte, code = np.frombuffer(whole.encode(), np.uint8), np.frombuffer(whole.encode("utf-16-le"), "<u2")
    # a character's first byte stands for its units: one, or two beyond U+FFFF
    ends = np.concatenate([[0], np.cumsum((byte & 0xC0 != 0x80).astype(np.int64) + (byte >= 0xF0))])[ends]
    length = np.diff(ends)
    order = np.argsort(-length, kind="stable")
    start = ends[:-1][order]
    h = np.full(len(length), 5381, np.int32)
    for i, n in enumerate(np.searchsorted(-length[order], -np.arange(length.max(initial=0)))):
        h[:n] = (h[:n] * np.int32(33)) ^ code[start[:n] + i]
    out = np.empty(len(length), np.int64)
    out[order] = np.abs(h.astype(np.int64)) % SPARSE_BUCKETS
    return out


def encoded_vectors(docs: DataFrame, key: str, wanted: DataFrame, text: str = "text", size: int = 64) -> DataFrame:
    """(key, vec, buckets, weights), a row for each text with a term: its sparse encoding as ``sparse_encode`` gives it, folded to
    a unit vector of ``size`` dimensions, and its weights in the ``wanted`` buckets (bucket), which are ``SPARSE_BUCKETS`` at most.
    Texts are dealt by key and cleaned by Spark, with one space between words; the words are counted, hashed and added up a batch of
    texts at a time, in arrays. Rows of one key are one text."""
    kind = docs.schema[key].dataType
    schema = f"__key {kind.simpleString()}, vec array<double>, buckets array<bigint>, weights array<double>"
    asked = np.zeros(SPARSE_BUCKETS, dtype=bool)
    asked[wanted.select("bucket").distinct().toArrow()["bucket"].to_numpy()] = True
    asked = np.packbits(asked)

    def encode(rows: pa.Table, inside: np.ndarray) -> pa.RecordBatch:
        keys, words = rows["__key"].combine_chunks().dictionary_encode("encode"), pc.split_pattern(rows["words"].combine_chunks(), " ")
        found, n = words.flatten().dictionary_encode(), len(keys.dictionary)
        terms, at = found.dictionary, found.indices.to_numpy()
        of = np.repeat(keys.indices.to_numpy().astype(np.int64), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        good = (pc.utf8_length(terms).to_numpy() > 1) & ~pc.is_in(terms, pa.array(SPARSE_STOP_WORDS, terms.type)).to_numpy(zero_copy_only=False)
        pair, f = np.unique((of * len(terms) + at)[good[at]], return_counts=True)
        of, term = np.divmod(pair, max(1, len(terms)))
        bucket, w = _buckets(terms)[term], f * (K1 + 1) / (f + K1)
        vec = np.bincount(of * size + bucket % size, w, n * size).reshape(n, size)
        norm = np.sqrt((vec * vec).sum(axis=1, keepdims=True))
        some = inside[bucket]
        cell, place = np.unique((of * SPARSE_BUCKETS + bucket)[some], return_inverse=True)
        ends = pa.array(np.searchsorted(cell, np.arange(n + 1) * SPARSE_BUCKETS), pa.int32())
        there = norm[:, 0] > 0
        unit = (vec[there] / norm[there]).ravel()
        out = [
            keys.dictionary.filter(pa.array(there)),
            pa.ListArray.from_arrays(pa.array(np.arange(there.sum() + 1) * size, pa.int32()), pa.array(unit, pa.float64())),
            pa.ListArray.from_arrays(ends, pa.array(cell % SPARSE_BUCKETS, pa.int64())).filter(pa.array(there)),
            pa.ListArray.from_arrays(ends, pa.array(np.bincount(place, w[some], len(cell)), pa.float64())).filter(pa.array(there)),
        ]
        return pa.RecordBatch.from_arrays(out, ["__key", "vec", "buckets", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, held = np.unpackbits(asked).astype(bool), None
        for b in chain(batches, [None]):
            rows = held
            if b is not None:  # the last key's rows wait, as more of them may follow
                rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                code = rows["__key"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
                last = int(np.argmax(code == code[-1])) if len(code) else 0
                rows, held = rows.slice(0, last), rows.slice(last)
            if rows is not None and len(rows):
                yield encode(rows, inside)

    texts = dealt(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__key", F.octet_length("__text"), TASK_TEXT)
    words = texts.sortWithinPartitions("__key").select("__key", F.regexp_replace(F.lower("__text"), r"[^\p{L}\p{N}]+", " ").alias("words"))  # the words of ``sparse_words``
    return words.mapInArrow(run, schema).withColumnRenamed("__key", key)


def bm25_idf(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, df, idf)."""
    n = docs.agg(F.count("*").alias("n"))
    df = sparse_terms(docs.withColumn("__row", F.monotonically_increasing_id()), "__row", text).distinct().groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def max_by_token(weights: DataFrame, key: str) -> DataFrame:
    """(key, id, weight): the largest positive weight of each id that is not special."""
    return weights.filter(~F.col("id").isin(*SPECIAL_IDS) & (F.col("weight") > 0)).groupBy(key, "id").agg(F.max("weight").alias("weight"))


def ranked(scores: DataFrame, order: list[Column], by: str = "qid", limit: int | None = None, base: int = 1) -> DataFrame:
    """Adds ``rank`` within each query, keeping the first ``limit``."""
    d = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)) + (base - 1))
    return d.filter(F.col("rank") < limit + base) if limit else d


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


#: Queries of a tile, and rows of a slice of the corpus, that meet in one task; rows that are scored at once.
TILE, SLICE, STEP = 8192, 65_536, 4096


def tiled(queries: DataFrame, corpus: DataFrame, work: Callable[[pa.Table, pa.Table], dict], schema: str, tile: int = TILE, part: int = SLICE) -> DataFrame:
    """``work(queries, rows)`` for each tile of the queries and slice of the corpus, of bounded sizes on average. Both are dealt
    by hashes and copied to the pairs they belong to by a list of numbers, so nothing passes through the driver but two
    counts, and the plan is the same for any number of queries."""
    tiles, slices = (max(1, -(-d.count() // n)) for d, n in ((queries, tile), (corpus, part)))
    spread = lambda d, n: F.pmod(F.xxhash64(*[c for c in d.columns if d.schema[c].dataType.typeName() != "map"]), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(spread(queries, tiles).alias("__tile"), numbers(slices).alias("__slice"), *queries.columns)
    c = corpus.select(numbers(tiles).alias("__t"), spread(corpus, slices).alias("__s"), *[F.col(n).alias(f"__c_{n}") for n in corpus.columns])  # columns of one name would be mixed up
    names = [x.split()[0] for x in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
        found = work(left, right.rename_columns([n.removeprefix("__c_") for n in right.column_names]))
        return pa.table({n: pa.array(found[n], t) for n, t in zip(names, kinds, strict=True)})

    kinds = [f.type for f in to_arrow_schema(corpus.sparkSession.createDataFrame([], schema).schema)]
    return q.groupBy("__tile", "__slice").cogroup(c.groupBy("__t", "__s")).applyInArrow(run, schema)


def _matrix(table: pa.Table, column: str = "vec") -> np.ndarray:
    return np.vstack(table[column].to_numpy()).astype(np.float64)


def _units(table: pa.Table) -> np.ndarray:
    m = _matrix(table)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def best_of(scores: Callable[[int, int], np.ndarray], rows: int, queries: int, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of what may be among a query's first ``k`` rows, ties included, of scores(from, to) of rows by
    queries; of all pairs without ``k``. What lies below a query's k-th best so far is dropped as soon as it is scored."""
    found: list[tuple] = []
    floor = np.full(queries, -np.inf)
    for at in range(0, rows, STEP):
        s = scores(at, min(rows, at + STEP))
        if k is not None and len(s) >= k:
            floor = np.maximum(floor, np.partition(s, len(s) - k, axis=0)[len(s) - k])
        row, col = np.nonzero(s >= floor)
        found.append((row + at, col, s[row, col]))
    row, col, score = (np.concatenate(x) for x in zip(*found, strict=True))
    last = score >= floor[col]
    return row[last], col[last], score[last]


def dense_scores(queries: DataFrame, corpus: DataFrame, digits: int = 6, k: int | None = None, tile: int = TILE, part: int = SLICE) -> DataFrame:
    """(qid, id, score): exact cosines of a stated query set against every row, by tiles of queries and slices of the corpus.
    With ``k`` a slice hands on only what may be among a query's first k (ties included)."""

    def work(left: pa.Table, right: pa.Table) -> dict:
        q, m = _units(left), _units(right)
        row, col, score = best_of(lambda i, j: np.round(m[i:j] @ q.T, digits), len(m), len(q), k)
        return {"qid": left["qid"].to_numpy()[col], "id": right["id"].to_numpy()[row], "score": score}

    return tiled(queries.select("qid", "vec"), corpus.select("id", "vec"), work, "qid bigint, id bigint, score double", tile, part)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Cosine nearest, ties by id; filters are applied to ``corpus`` before it comes here."""
    return ranked(dense_scores(queries, corpus, k=k), [F.desc("score"), F.asc("id")], limit=k)


def _late(q: np.ndarray, m: np.ndarray, width: int, digits: int) -> np.ndarray:
    """Late interaction of rows by queries: a vector is a list of parts of ``width`` entries; each part of the query counts with
    its best dot product among a row's parts, and the score is the mean."""
    parts = [slice(i, i + width) for i in range(0, q.shape[1], width)]
    return np.round(sum(np.maximum.reduce([m[:, b] @ q[:, a].T for b in parts]) for a in parts) / len(parts), digits)


def maxsim_scores(queries: DataFrame, corpus: DataFrame, width: int = 16, digits: int = 6, tile: int = 512, part: int = 4096) -> DataFrame:
    """(qid, id, score) by late interaction of every query with every row. What a task gives is its tile times its slice."""

    def work(left: pa.Table, right: pa.Table) -> dict:
        score = _late(_matrix(left), _matrix(right), width, digits)
        return {"qid": np.tile(left["qid"].to_numpy(), len(right)), "id": np.repeat(right["id"].to_numpy(), len(left)), "score": score.ravel()}

    return tiled(queries.select("qid", "vec"), corpus.select("id", "vec"), work, "qid bigint, id bigint, score double", tile, part)


def maxsim_topk(queries: DataFrame, corpus: DataFrame, k: int, width: int = 16, digits: int = 6, tile: int = TILE // 4, part: int = SLICE) -> DataFrame:
    """(qid, id, score, rank): the first ``k`` rows of each query by late interaction, ties by id."""

    def work(left: pa.Table, right: pa.Table) -> dict:
        q, m = _matrix(left), _matrix(right)
        row, col, score = best_of(lambda i, j: _late(q, m[i:j], width, digits), len(m), len(q), k)
        return {"qid": left["qid"].to_numpy()[col], "id": right["id"].to_numpy()[row], "score": score}

    found = tiled(queries.select("qid", "vec"), corpus.select("id", "vec"), work, "qid bigint, id bigint, score double", tile, part)
    return ranked(found, [F.desc("score"), F.asc("id")], limit=k)


def dense_best_ranks(queries: DataFrame, corpus: DataFrame, digits: int = 6, tile: int = TILE, part: int = SLICE) -> DataFrame:
    """(qid, best): the rank of the first row that has its query's label, for queries (qid, vec, q_label) and a corpus
    (id, vec, label); a query without such a row is left out. Ranks are counted, not sorted: a pass finds
    each query's best such row, another counts the rows before it."""

    def first(left: pa.Table, right: pa.Table) -> dict:
        q, m, ids = _units(left), _units(right), right["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        score, at = np.full(len(q), -np.inf), np.zeros(len(q), dtype=np.int64)
        for i in range(0, len(order), STEP):  # of equal scores the least id
            some = order[i : i + STEP]
            s = np.round(m[some] @ q.T, digits)
            s[right["label"].to_numpy()[some][:, None] != left["q_label"].to_numpy()[None, :]] = -np.inf
            top = np.argmax(s, axis=0)
            better = s[top, np.arange(len(q))] > score
            score[better], at[better] = s[top, np.arange(len(q))][better], ids[some[top]][better]
        there = np.isfinite(score)
        return {"qid": left["qid"].to_numpy()[there], "score": score[there], "id": at[there]}

    def before(left: pa.Table, right: pa.Table) -> dict:
        q, m, ids = _units(left), _units(right), right["id"].to_numpy()
        score, mark, total = left["score"].to_numpy(), left["mark"].to_numpy(), np.zeros(len(q), dtype=np.int64)
        for i in range(0, len(m), STEP):
            s = np.round(m[i : i + STEP] @ q.T, digits)
            total += ((s > score) | ((s == score) & (ids[i : i + STEP, None] < mark))).sum(axis=0)
        return {"qid": left["qid"].to_numpy(), "n": total}

    asked, rows = queries.select("qid", "vec", "q_label"), corpus.select("id", "vec", "label")
    found = tiled(asked, rows, first, "qid bigint, score double, id bigint", tile, part)
    best = found.groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b")).select("qid", (-F.col("b.s")).alias("score"), F.col("b.id").alias("mark"))
    marked = asked.select("qid", "vec").join(best, "qid")
    counts = tiled(marked, rows.select("id", "vec"), before, "qid bigint, n bigint", tile, part)
    return counts.groupBy("qid").agg((F.sum("n") + 1).alias("best"))


def sparse_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, id, score) over shared buckets: an equi-join, so only documents that share one are read."""
    hits = corpus.join(queries.select("qid", "bucket", F.col("weight").alias("qw")), "bucket")
    return hits.groupBy("qid", "id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))


def sparse_search(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, text: str = "text") -> DataFrame:
    """(qid, id, score) of text queries against texts. Documents are encoded in the queries' buckets only."""
    q = sparse_encode(queries, query_key, text).withColumnRenamed(query_key, "qid")
    return sparse_scores(q, sparse_encode(docs, doc_key, text, wanted=q).withColumnRenamed(doc_key, "id"))


def fuse_rrf(lanes: list[DataFrame], k: int = RRF_K, rank_base: int = 0) -> DataFrame:
    """(qid, id, score) of 1/(k + rank) added over lanes of 1-based ranks. ``rank_base`` is what a lane's first
    rank counts as: 0 by default, as the server that is modelled does; 1 as its manual says."""
    parts = [lane.select("qid", "id", (1.0 / (k + F.col("rank") - 1 + rank_base)).alias("s")) for lane in lanes]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("qid", "id").agg(F.round(F.sum("s"), 9).alias("score"))


def weighted_rrf(dense: DataFrame, sparse: DataFrame, k: int, ratio: float) -> DataFrame:
    """(qid, id, score, d_rank, s_rank); the sparse lane's weight is set so that its first rank is worth
    ``ratio`` of the dense lane's."""
    w = 1.0 / (k * (1.0 / ratio - 1) + 1)
    both = dense.select("qid", "id", F.col("rank").alias("d_rank")).join(sparse.select("qid", "id", F.col("rank").alias("s_rank")), ["qid", "id"], "full")
    one = F.coalesce(1.0 / (k + F.col("d_rank") - 1), F.lit(0.0))
    two = F.coalesce(1.0 / (k + F.col("s_rank") / w - 1), F.lit(0.0))
    return both.withColumn("score", F.round(one + two, 9))


def rank_weighted(fused: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of a weighted fusion; ties by dense rank, sparse rank, id, a missing rank last."""
    order = [F.desc("score"), F.asc_nulls_last("d_rank"), F.asc_nulls_last("s_rank"), F.asc("id")]
    return ranked(fused, order, limit=limit)


def mmr(candidates: DataFrame, diversity: float, limit: int) -> DataFrame:
    """(qid, id, rank) by greedy marginal relevance; ``candidates`` (qid, id, score, vec) are a bounded
    list per query."""

    def pick(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        v = np.vstack(p["vec"].to_numpy())
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        near, left, out = np.full(len(p), -np.inf), np.ones(len(p), dtype=bool), []
        for _ in range(min(limit, len(p))):
            gain = (1 - diversity) * p["score"].to_numpy() - diversity * np.where(np.isinf(near), 0, near)
            i = int(np.argmax(np.where(left, gain, -np.inf)))
            out.append(i)
            left[i] = False
            near = np.maximum(near, v @ v[i])
        return pd.DataFrame({"qid": p["qid"].iloc[0], "id": p["id"].iloc[out].to_numpy(), "rank": range(1, len(out) + 1)})

    return candidates.groupBy("qid").applyInPandas(pick, "qid bigint, id bigint, rank bigint")


def rerank_scores(hits: DataFrame) -> DataFrame:
    """Adds ``det_score`` to hits (qid, query, id, rank, source_file, section, tags, text, chunk_index)."""
    tokens = query_tokens(F.col("query"))

    def hit_sum(where: Column) -> Column:
        """Each word of the field that is a query token adds 1, or 3 where the token is technical."""
        words = F.regexp_extract_all(F.lower(F.coalesce(where, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)
        return F.aggregate(words, F.lit(0.0), lambda s, w: s + F.when(F.col("__q")[w].isNull(), 0.0).when(F.col("__q")[w], 3.0).otherwise(1.0))

    boost = lambda n, b: F.least(n * b, F.lit(b * 3))
    technical = F.size(F.filter(F.map_values(F.col("__q")), lambda t: t))
    intro = F.when((F.col("chunk_index") == 0) & (technical >= 2), INTRO_PENALTY).otherwise(0.0)
    score = (
        1.0 / F.col("rank")
        + boost(hit_sum(F.col("source_file")), SOURCE_BOOST)
        + boost(hit_sum(F.col("section")), SECTION_BOOST)
        + boost(hit_sum(F.array_join("tags", " ")), TAG_BOOST)
        + F.least(hit_sum(F.col("text")) * TEXT_BOOST, F.lit(TEXT_MOST))
        - intro
    )
    return hits.withColumn("__q", tokens).withColumn("det_score", F.round(score, 9)).drop("__q")


def rerank_diverse(scored: DataFrame, limit: int) -> DataFrame:
    """(qid, id, new_rank, score): greedy choice with a penalty for files already chosen; the first hit stays
    first unless another leads it by the protection margin."""

    def pick(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rank").reset_index(drop=True)
        left, seen, out = list(range(len(p))), {}, []
        while left and len(out) < limit:
            value = [(p["det_score"][i] - FILE_PENALTY[min(seen.get(p["source_file"][i], 0), 3)], -p["rank"][i], i) for i in left]
            best = max(value)
            if not out and best[2] != 0:
                first = next(v for v in value if v[2] == 0)
                best = first if best[0] - first[0] < PROTECT else best
            out.append((p["id"][best[2]], best[0]))
            left.remove(best[2])
            seen[p["source_file"][best[2]]] = seen.get(p["source_file"][best[2]], 0) + 1
        return pd.DataFrame({"qid": p["qid"].iloc[0], "id": [o[0] for o in out], "new_rank": range(1, len(out) + 1), "score": [float(o[1]) for o in out]})

    kind = scored.schema["id"].dataType.simpleString()
    return scored.select("qid", "id", "rank", "source_file", "det_score").groupBy("qid").applyInPandas(pick, f"qid bigint, id {kind}, new_rank bigint, score double")


def rerank_by(hits: DataFrame, scorer: Column, top_n: int, limit: int) -> DataFrame:
    """The first ``top_n`` hits by a pluggable scorer; where it gives null the input order stands."""
    head = hits.filter(F.col("rank") <= top_n).withColumn("ce_score", scorer)
    failed = F.max(F.col("ce_score").isNull()).over(Window.partitionBy("qid"))
    key = F.when(failed, -F.col("rank").cast("double")).otherwise(F.col("ce_score"))
    w = Window.partitionBy("qid").orderBy(F.desc("__key"), "rank")
    return head.withColumn("__key", key).withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= limit).drop("__key")


def maxsim(query_vectors: Column, doc_vectors: Column) -> Column:
    """Mean over query vectors of the largest dot product with a document vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    best = F.transform(query_vectors, lambda q: F.array_max(F.transform(doc_vectors, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.size(query_vectors)


def blend_guard(hits: DataFrame, protect: float = 0.05) -> DataFrame:
    """Blends a min-max normalised second score (0.5 where flat) with the reciprocal rank, and keeps the first
    hit first unless another leads it by ``protect``."""
    w = Window.partitionBy("qid")
    low, high = F.min("second").over(w), F.max("second").over(w)
    norm = F.when(high == low, F.lit(0.5)).otherwise((F.col("second") - low) / (high - low))
    d = hits.withColumn("blend", F.round(0.7 * norm + 0.3 / F.col("rank"), 9))
    d = d.withColumn("first", F.max(F.when(F.col("rank") == 1, F.col("blend"))).over(w)).withColumn("top", F.max("blend").over(w))
    keep = (F.col("rank") == 1) & (F.col("top") - F.col("first") < protect)
    order = Window.partitionBy("qid").orderBy(F.desc(keep), F.desc("blend"), "rank")
    return d.withColumn("new_rank", F.row_number().over(order)).drop("first", "top")


def gap_trigger(hits: DataFrame, least: float = 0.10) -> DataFrame:
    """(qid, fires): whether the first score leads the second by less than ``least`` of itself, which asks for a
    second opinion; a query of one hit does not fire."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    g = hits.groupBy("qid").agg(at(1).alias("s1"), at(2).alias("s2"))
    return g.select("qid", F.coalesce((F.col("s1") - F.col("s2")) / F.col("s1") < least, F.lit(False)).alias("fires"))


def collapse_to_docs(hits: DataFrame, chunk_docs: DataFrame) -> DataFrame:
    """(qid, doc_id, score, chunk_count): the best chunk of each document; hits of no known document are one row
    with a null doc_id per query."""
    return hits.join(chunk_docs, "id", "left").groupBy("qid", "doc_id").agg(F.max("score").alias("score"), F.count("*").alias("chunk_count"))


def expand_window(hits: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Hits (qid, rank, source_file, chunk_index) with neighbours at ``width``: offsets are exploded, so it is an
    equi-join. A match is always kept, a neighbour at its first appearance in hit order."""
    near = hits.withColumn("__o", F.explode(F.array(*[F.lit(i) for i in range(-width, width + 1)])))
    near = near.select("qid", "rank", "source_file", (F.col("chunk_index") + F.col("__o")).alias("chunk_index"), (F.col("__o") == 0).alias("is_match"))
    found = near.join(chunks.select("source_file", "chunk_index", "text"), ["source_file", "chunk_index"])
    order = Window.partitionBy("qid", "source_file", "chunk_index").orderBy("rank", F.desc("is_match"))
    return found.withColumn("__n", F.row_number().over(order)).filter(F.col("is_match") | (F.col("__n") == 1)).drop("__n")


def hashed_embedding(docs: DataFrame, key: str, text: str = "text", size: int = 64) -> DataFrame:
    """(key, dim, value): a deterministic unit vector, the sparse weights folded to ``size`` dimensions; the default
    where no embedding model is given."""
    v = sparse_encode(docs, key, text).groupBy(key, (F.col("bucket") % size).alias("dim")).agg(F.sum("weight").alias("v"))
    # a vector's entries are held together, so that texts are encoded once; a null key has no vector
    by = v.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct("dim", "v")).alias("e"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return by.select(key, F.explode("e").alias("e"), "n").select(key, F.col("e.dim").alias("dim"), (F.col("e.v") / F.col("n")).alias("value"))


def folded_vectors(encoded: DataFrame, key: str, size: int = 64) -> DataFrame:
    """(key, vec): sparse encodings (key, bucket, weight) folded to unit vectors of ``size`` dimensions."""
    folded = dealt(encoded, key, F.lit(1), TASK_TERMS).groupBy(key, (F.col("bucket") % size).cast("int").alias("dim")).agg(F.sum("weight").alias("v"))
    by = folded.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return by.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) / F.col("n")).alias("vec"))


def both_lanes(queries: DataFrame, docs: DataFrame, query_key: str, doc_key: str, k: int | None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The dense and the sparse scores (qid, id, score) of text queries, both from one encoding of the documents, which is
    written once. ``k``: the depth to which dense scores are wanted. Only the queries' buckets go on to the sparse lane, dealt by
    document, so that its sums are made where they are."""
    q = written(sparse_encode(queries, query_key, text).withColumnRenamed(query_key, "qid"), "query-terms")
    d = written(encoded_vectors(docs, doc_key, q, text).withColumnRenamed(doc_key, "id"), "encoded")
    shared = dealt(d.select("id", "buckets", "weights"), "id", F.size("buckets"), TASK_TERMS)
    shared = shared.select("id", F.inline(F.arrays_zip("buckets", "weights"))).toDF("id", "bucket", "weight")
    return dense_scores(folded_vectors(q, "qid"), d.select("id", "vec"), k=k), sparse_scores(q, shared)


def dense_vectors(long: DataFrame, key: str, size: int = 64) -> DataFrame:
    """(key, vec) of the long form (key, dim, value); missing dimensions are 0. A vector of other than ``size``
    dimensions is an error."""
    by = F.map_from_entries(F.collect_list(F.struct(F.col("dim").cast("int"), "value")))
    wide = long.groupBy(key).agg(by.alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    beyond = F.exists(F.map_keys("m"), lambda i: (i < 0) | (i >= size))
    return wide.select(key, F.when(beyond, F.raise_error(F.lit(f"a vector has a dimension beyond {size}"))).otherwise(whole).alias("vec"))


def check_dimensions(vectors: DataFrame, size: int, column: str = "vec") -> DataFrame:
    """``vectors`` as they are; reading one of another length fails."""
    wrong = F.raise_error(F.format_string(f"a vector has %d dimensions, not {size}", F.size(column)))
    return vectors.withColumn(column, F.when(F.size(column) == size, F.col(column)).otherwise(wrong))


# The least bounds of the length buckets; what is longer than all is in the last.
BATCH_BOUNDS = (16, 32, 64, 128, 256)


def numbered_by(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``, their number from 1 within ``by`` in ``order``, which is total. Rows are dealt by ranges of both, so
    a large group is spread over tasks; each ranks its own, and counts of the ranges before (a row for each range and
    group) are added."""
    keys = [F.col(c) for c in by]
    dealt = rows.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id())
    dealt = written(dealt, "ranges")  # numbers of partitions hold for what is written
    counts = dealt.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__p")) - F.col("__n")).drop("__n")
    same = F.col("__p") == F.col("__q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    before = before.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__p").alias("__q"), "__before")
    ranked_rows = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*order)))
    return ranked_rows.join(before, same).withColumn(name, (F.col(name) + F.col("__before")).cast("bigint")).select(*rows.columns, name)


def bucketed_batches(texts: DataFrame, by: list[str], order: str, tokens: Column, most: int = 8) -> DataFrame:
    """``texts`` with ``bucket`` (0 to 5 by length), ``batch`` (from 0 in each bucket, at most ``most`` rows) and ``place``: the
    number in the original order, by which results are put back."""
    bucket = F.lit(len(BATCH_BOUNDS))
    for i in reversed(range(len(BATCH_BOUNDS))):
        bucket = F.when(tokens <= BATCH_BOUNDS[i], i).otherwise(bucket)
    d = texts.withColumn("bucket", bucket.cast("bigint"))
    d = numbered_by(d, [*by, "bucket"], [F.col(order)], "__at")
    d = numbered_by(d, by, [F.col(order)], "__place")
    return d.select(*texts.columns, "bucket", F.floor((F.col("__at") - 1) / most).alias("batch"), (F.col("__place") - 1).alias("place"))
