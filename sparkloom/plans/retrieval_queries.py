"""Encoding, retrieval, fusion and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import guards as G
from ..operators import retrieval as R
from ..operators import search as H
from ..operators import store as S
from ..sources.collections import written
from .fixtures import CHUNKS, DENSE, chunks, dense, table
from .registry import query
from .text_queries import BUCKET_SQL, SPARSE_SQL, TECH_SQL, quoted

TERMS = f"WITH toks AS (SELECT doc_id, unnest({SPARSE_SQL}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS f FROM toks GROUP BY doc_id, term)"
B_TERM = f"CAST(abs({BUCKET_SQL.format('term')}) % 1048576 AS BIGINT)"
SPARSE = f"""{TERMS}, terms AS (SELECT term, {B_TERM} AS bucket FROM (SELECT DISTINCT term FROM tf)),
sc AS (SELECT doc_id AS id, bucket, sum(f * 2.5e0 / (f + 1.5e0)) AS weight FROM tf JOIN terms USING (term) GROUP BY doc_id, bucket),
qtf AS (SELECT item_id, term, count(*) AS f FROM (SELECT item_id, unnest({SPARSE_SQL}) AS term FROM benchmark) GROUP BY item_id, term),
sq AS (SELECT item_id AS qid, {B_TERM} AS bucket, sum(f * 2.5e0 / (f + 1.5e0)) AS weight FROM qtf GROUP BY 1, 2),
ss AS (SELECT qid, id, round(sum(sq.weight * sc.weight), 6) AS score FROM sq JOIN sc USING (bucket) GROUP BY qid, id),
sparse_run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ss)"""
QRELS = "qrels AS (SELECT item_id AS qid, doc_id AS id, 1 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
#: Both lanes over one corpus: the sparse encodings, and the same folded to 64 dimensions as unit vectors.
LANES = f"""{SPARSE}, dv AS (SELECT id, bucket % 64 AS dim, sum(weight) AS v FROM sc GROUP BY 1, 2), dl AS (SELECT id, sqrt(sum(v * v)) AS n FROM dv GROUP BY id),
qv AS (SELECT qid, bucket % 64 AS dim, sum(weight) AS v FROM sq GROUP BY 1, 2), ql AS (SELECT qid, sqrt(sum(v * v)) AS n FROM qv GROUP BY qid),
dots AS (SELECT qid, id, sum(qv.v * dv.v) AS dot FROM qv JOIN dv USING (dim) GROUP BY qid, id),
ds AS (SELECT ql.qid, dl.id, round(coalesce(dot, 0) / (ql.n * dl.n), 6) AS score FROM ql CROSS JOIN dl LEFT JOIN dots ON dots.qid = ql.qid AND dots.id = dl.id),
lane_d AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ds)"""


def corpus(spark, sf_dir):
    """Documents as a search collection's rows."""
    d = table(spark, sf_dir, "documents")
    source = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), "doc_id", F.lit(".md"))
    return d.select(F.col("doc_id").alias("id"), "text", source.alias("source_file"), F.array("lang", "source").alias("tags"), F.lit(None).cast("string").alias("point_kind"))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def sparse_lane(spark, sf_dir, k=None):
    scores = R.sparse_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")
    return R.ranked(scores, [F.desc("score"), F.asc("id")], limit=k)


def text_lanes(spark, sf_dir, k):
    """The dense and the sparse lane of the benchmark's passages over the documents, from one encoding of these. What is left of
    them, ``k`` rows a passage, is written, as most plans read it more than once."""
    lanes = zip(R.both_lanes(asked(spark, sf_dir), corpus(spark, sf_dir), "qid", "id", k), ("dense-lane", "sparse-lane"), strict=True)
    return tuple(written(R.ranked(lane, [F.desc("score"), F.asc("id")], limit=k), name) for lane, name in lanes)


def dense_lane(spark, sf_dir, k):
    queries, vectors = dense(spark, sf_dir)
    return R.dense_topk(queries, vectors, k)


@query("sparse_encode", f"{SPARSE} SELECT id AS doc_id, bucket, round(weight, 6) AS weight FROM sc")
def sparse_encode(spark, sf_dir):
    return R.sparse_encode(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("sparse_encode_avgdl", f"""{TERMS}, n AS (SELECT doc_id, sum(f) AS n FROM tf GROUP BY doc_id), m AS (SELECT avg(n) AS mean FROM n), terms AS (SELECT term, {B_TERM} AS bucket FROM (SELECT DISTINCT term FROM tf))
  SELECT doc_id, bucket, round(sum(f * 2.5e0 / (f + 1.5e0 * (0.25e0 + 0.75e0 * n / mean))), 6) AS weight FROM tf JOIN n USING (doc_id) CROSS JOIN m JOIN terms USING (term) GROUP BY doc_id, bucket""")
def sparse_encode_avgdl(spark, sf_dir):
    return R.sparse_encode(table(spark, sf_dir, "documents"), "doc_id", avg_length=True).select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query("bm25_idf", f"{TERMS} SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5e0) / (count(*) + 0.5e0)), 6) AS idf FROM tf GROUP BY term")
def bm25_idf(spark, sf_dir):
    return R.bm25_idf(table(spark, sf_dir, "documents"), "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


@query("sparse_max_by_token", "SELECT l_orderkey AS k, l_linenumber AS id, max(l_discount) AS weight FROM lineitem WHERE l_linenumber NOT IN (0, 1, 2, 3, 250001) AND l_discount > 0 GROUP BY 1, 2")
def sparse_max_by_token(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), F.col("l_discount").alias("weight"))
    return R.max_by_token(d, "k")


@query("context_fit", f"{CHUNKS} SELECT source_file, chunk_index, CASE WHEN length(text) >= 400 THEN '' ELSE right(source_file || ' › ' || section, 400 - length(text)) END AS context FROM chunks")
def context_fit(spark, sf_dir):
    context = X.deterministic_context(F.col("source_file"), F.col("section"))
    room = F.lit(400) - F.length("text")
    return chunks(spark, sf_dir).select("source_file", "chunk_index", F.when(room <= 0, "").otherwise(F.right(context, room)).alias("context"))


@query("dense_topk", f"{DENSE} SELECT qid, id, score, rank FROM dense_run WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return dense_lane(spark, sf_dir, 10).select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("dense_topk_filtered", f"{DENSE}, f AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cos WHERE label % 2 = 0) SELECT * FROM f WHERE rank <= 10")
def dense_topk_filtered(spark, sf_dir):
    queries, vectors = dense(spark, sf_dir)
    return R.dense_topk(queries, vectors.filter("label % 2 = 0"), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("sparse_topk", f"{SPARSE} SELECT qid, id, score, rank FROM sparse_run WHERE rank <= 10")
def sparse_topk(spark, sf_dir):
    return sparse_lane(spark, sf_dir, 10).select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("hybrid_rrf", f"""{LANES}, u AS (SELECT qid, id, 1e0 / (60 + rank - 1) AS s FROM lane_d WHERE rank <= 20 UNION ALL SELECT qid, id, 1e0 / (60 + rank - 1) FROM sparse_run WHERE rank <= 20),
  f AS (SELECT qid, id, round(sum(s), 9) AS score FROM u GROUP BY qid, id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) SELECT * FROM r WHERE rank <= 10""")
def hybrid_rrf(spark, sf_dir):
    """Dense and sparse lanes over the documents, each to twice the depth, fused by reciprocal ranks from 0."""
    return H.hybrid_search(*H.lanes_of(H.Collection(corpus(spark, sf_dir)), asked(spark, sf_dir), F.lit(True), 10), 10)


IN_FILTER = "SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3'"


@query("hybrid_filtered", f"""{LANES}, a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM ds WHERE id IN ({IN_FILTER})), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM ss WHERE id IN ({IN_FILTER})),
  u AS (SELECT qid, id, 1e0 / (60 + r - 1) AS s FROM a WHERE r <= 20 UNION ALL SELECT qid, id, 1e0 / (60 + r - 1) FROM b WHERE r <= 20),
  f AS (SELECT qid, id, round(sum(s), 9) AS score FROM u GROUP BY qid, id), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) SELECT * FROM r WHERE rank <= 10""")
def hybrid_filtered(spark, sf_dir):
    """The filter holds in both lanes, before either is ranked."""
    request = H.validate_search_request({"collection": "main", "query": "passages", "top": 10, "tags": ["fr", "src3"]})
    return H.run_search({"main": H.Collection(corpus(spark, sf_dir))}, request, asked(spark, sf_dir))


@query("dense_only_fallback", f"{LANES} SELECT qid, id, score, rank FROM lane_d WHERE rank <= 10")
def dense_only_fallback(spark, sf_dir):
    """A collection whose profile has no sparse lane."""
    found = H.Collection(corpus(spark, sf_dir), profile={"dense": "hashed", "sparse": None})
    return H.run_search({"main": found}, H.validate_search_request({"collection": "main", "query": "passages", "top": 10}), asked(spark, sf_dir))


@query("run_search", """SELECT item_id AS qid, ['main', 'absent', 'blank', 'other'][1 + item_id % 4] AS collection, [NULL, 'collection_not_found', 'embedding_unresolved', 'embedding_unsupported'][1 + item_id % 4] AS error,
  CASE WHEN item_id % 4 = 0 THEN least(3, (SELECT count(*) FROM documents)) ELSE 0 END AS hits FROM benchmark""")
def run_search(spark, sf_dir):
    """Each passage asks one of four collections: it gets hits, or what stands in the way."""
    docs, out = corpus(spark, sf_dir), None
    known = {"main": H.Collection(docs), "blank": H.Collection(docs, profile=None), "other": H.Collection(docs, profile={"dense": "model-x", "sparse": None})}
    for i, name in enumerate(("main", "absent", "blank", "other")):
        mine = asked(spark, sf_dir).filter(F.col("qid") % 4 == i)
        found = H.run_search(known, H.SearchRequest(name, "q"), mine)
        error = F.lit(found.error if isinstance(found, H.SearchError) else None).cast("string")
        hits = mine.select("qid", F.lit(0).alias("n")) if isinstance(found, H.SearchError) else found.groupBy("qid").agg(F.count("*").alias("n"))
        one = mine.join(hits, "qid", "left").select("qid", F.lit(name).alias("collection"), error.alias("error"), F.coalesce("n", F.lit(0)).cast("bigint").alias("hits"))
        out = one if out is None else out.unionByName(one)
    return out


@query("rrf_rank_base", f"""{LANES}, u AS (SELECT qid, id, 1e0 / (2 + rank) AS s FROM lane_d WHERE rank <= 20 UNION ALL SELECT qid, id, 1e0 / (2 + rank) FROM sparse_run WHERE rank <= 20) SELECT qid, id, round(sum(s), 9) AS score FROM u GROUP BY qid, id""")
def rrf_rank_base(spark, sf_dir):
    return R.fuse_rrf([*text_lanes(spark, sf_dir, 20)], k=2, rank_base=1)


@query("weighted_rrf", f"""{LANES}, d AS (SELECT * FROM lane_d WHERE rank <= 50), t AS (SELECT * FROM sparse_run WHERE rank <= 50),
  f AS (SELECT coalesce(d.qid, t.qid) AS qid, coalesce(d.id, t.id) AS id, d.rank AS d_rank, t.rank AS s_rank, round(coalesce(1e0 / (60 + d.rank - 1), 0) + coalesce(1e0 / (60 + t.rank / (1e0 / (60 * 3e0 + 1)) - 1), 0), 9) AS score
  FROM d FULL JOIN t ON d.qid = t.qid AND d.id = t.id), r AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, d_rank NULLS LAST, s_rank NULLS LAST, id) AS rank FROM f) SELECT * FROM r WHERE rank <= 20""")
def weighted_rrf(spark, sf_dir):
    fused = R.weighted_rrf(*text_lanes(spark, sf_dir, 50), 60, 0.25)
    return R.rank_weighted(fused, 20).select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("mmr")
def mmr(spark, sf_dir):
    _, vectors = dense(spark, sf_dir)
    return R.mmr(dense_lane(spark, sf_dir, 100).join(vectors.select("id", "vec"), "id"), 0.5, 10)


def chunk_hits(spark, sf_dir, top=10):
    """Benchmark queries against chunks: of all chunks of each document hit, the first that holds the most
    query terms. Documents are fetched to the depth that reranking to ``top`` asks for."""
    lane = sparse_lane(spark, sf_dir, max(4 * top, top + 5)).select("qid", F.col("id").alias("doc_id"), "rank", "score")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    wanted = lane.join(b.withColumn("__terms", F.map_keys(X.query_tokens(F.col("query")))), "qid")
    every = wanted.join(chunks(spark, sf_dir), "doc_id")
    shared = F.size(F.filter("__terms", lambda t: F.lower("text").contains(t)))
    best = every.groupBy("qid", "doc_id").agg(
        F.first("query").alias("query"),
        F.first("rank").alias("rank"),
        F.first("score").alias("score"),
        F.min(F.struct((-shared).alias("order"), "chunk_index", "total_chunks", "source_file", "lang", "source", "section", "text", "tags", "point_kind")).alias("c"),
    )
    return best.select("qid", F.col("doc_id").alias("id"), "rank", "score", "query", "c.*").drop("order")


@query("rerank_det")
def rerank_det(spark, sf_dir):
    return R.rerank_diverse(R.rerank_scores(chunk_hits(spark, sf_dir)), 10)


TOKENS = """q_raw AS (SELECT item_id AS qid, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS raw, generate_subscripts(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), 1) AS pos FROM benchmark),
q_tok AS (SELECT qid, lower(raw) AS w, CASE WHEN TECH THEN 3e0 ELSE 1e0 END AS weight FROM (SELECT *, row_number() OVER (PARTITION BY qid, lower(raw) ORDER BY pos DESC) AS n FROM q_raw WHERE NOT list_contains(STOP, lower(raw))) WHERE n = 1)"""
TOKENS = TOKENS.replace("TECH", TECH_SQL.format("raw")).replace("STOP", quoted(X.QUERY_STOP_WORDS))


def field_sql(name: str, column: str) -> str:
    """Weights of the words of a hit's field that are query tokens, every occurrence counted."""
    return f"""{name} AS (SELECT f.qid, f.id, sum(q.weight) AS s FROM (SELECT qid, id, unnest(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM hit) f JOIN q_tok q ON q.qid = f.qid AND q.w = f.w GROUP BY 1, 2)"""


@query("rerank_scores", f"""{SPARSE}, {TOKENS}, hit AS (SELECT qid, id, rank, source || '/' || lang || '/doc-' || doc_id || '.md' AS source_file, lang AS section, lang || ' ' || source AS tags, text, id % 2 AS chunk_index FROM sparse_run JOIN documents ON id = doc_id WHERE rank <= 40),
  {field_sql('f_source', 'source_file')}, {field_sql('f_section', 'section')}, {field_sql('f_tags', 'tags')}, {field_sql('f_text', 'text')}, tech AS (SELECT qid, count(*) FILTER (WHERE weight = 3) AS n FROM q_tok GROUP BY qid)
  SELECT hit.qid, hit.id, round(1e0 / rank + least(coalesce(a.s, 0) * 0.08, 0.24) + least(coalesce(b.s, 0) * 0.06, 0.18) + least(coalesce(c.s, 0) * 0.05, 0.15) + least(coalesce(d.s, 0) * 0.01, 0.05)
    - CASE WHEN chunk_index = 0 AND coalesce(tech.n, 0) >= 2 THEN 0.02 ELSE 0 END, 6) AS det_score
  FROM hit LEFT JOIN f_source a USING (qid, id) LEFT JOIN f_section b USING (qid, id) LEFT JOIN f_tags c USING (qid, id) LEFT JOIN f_text d USING (qid, id) LEFT JOIN tech USING (qid)""")
def rerank_scores(spark, sf_dir):
    """Scores of the first stage's documents as whole texts."""
    d = corpus(spark, sf_dir).withColumns({"section": F.get("tags", F.lit(0)), "chunk_index": F.col("id") % 2})
    hits = sparse_lane(spark, sf_dir, 40).select("qid", "id", "rank").join(d, "id").join(asked(spark, sf_dir).withColumnRenamed("text", "query"), "qid")
    return R.rerank_scores(hits).select("qid", "id", F.round("det_score", 6).alias("det_score"))


@query("rerank_ce", f"{SPARSE} , h AS (SELECT qid, id, rank FROM sparse_run WHERE rank <= 40), r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY length(text) DESC, rank) AS new_rank FROM h JOIN documents ON id = doc_id) SELECT * FROM r WHERE new_rank <= 10")
def rerank_ce(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("double").alias("n"))
    out = R.rerank_by(sparse_lane(spark, sf_dir, 40).join(docs, "id"), F.col("n"), 40, 10)
    return out.select("qid", "id", F.col("new_rank").cast("bigint").alias("new_rank"))


PARTS = "[q.vec[1:16], q.vec[17:32], q.vec[33:48], q.vec[49:64]]"
MAXSIM = f"""{DENSE} SELECT qid, id, round(list_sum(list_transform({PARTS}, lambda a: list_max(list_transform({PARTS.replace('q.', 'c.')}, lambda b: list_dot_product(a, b))))) / 4, 6) AS score FROM dense_q q, dense_c c"""


@query("colbert_maxsim", MAXSIM)
def colbert_maxsim(spark, sf_dir):
    """Every pair, which is what this query reports: whole vectors, as four parts each."""
    return R.maxsim_scores(*dense(spark, sf_dir))


@query("colbert_guard", f"""{DENSE}, h AS (SELECT qid, id, rank, CAST(id % 17 AS DOUBLE) AS second FROM dense_run WHERE rank <= 20),
  n AS (SELECT *, round(0.7 * CASE WHEN max(second) OVER w = min(second) OVER w THEN 0.5 ELSE (second - min(second) OVER w) / (max(second) OVER w - min(second) OVER w) END + 0.3 / rank, 9) AS blend FROM h WINDOW w AS (PARTITION BY qid)),
  g AS (SELECT *, rank = 1 AND max(blend) OVER (PARTITION BY qid) - max(CASE WHEN rank = 1 THEN blend END) OVER (PARTITION BY qid) < 0.05 AS keep FROM n)
  SELECT qid, id, blend, row_number() OVER (PARTITION BY qid ORDER BY keep DESC, blend DESC, rank) AS new_rank FROM g""")
def colbert_guard(spark, sf_dir):
    hits = dense_lane(spark, sf_dir, 20).withColumn("second", (F.col("id") % 17).cast("double"))
    return R.blend_guard(hits).select("qid", "id", "blend", F.col("new_rank").cast("bigint").alias("new_rank"))


def guard_hits(spark, sf_dir):
    """The sparse lane's first ten, and a second order of them by id; documents of a source are a named file's."""
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("source") == "src1", "providers.md").when(F.col("source") == "src2", "config-env.md").when(F.col("source") == "src3", "project-structure.md").otherwise(F.concat("source", F.lit(".md")))
    docs = d.select(F.col("doc_id").alias("id"), name.alias("source_file"), F.col("lang").alias("section"), "text")
    h = sparse_lane(spark, sf_dir, 10).select("qid", "id", "rank").join(docs, "id")
    h = h.withColumn("ce_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.xxhash64("id"), "id")))
    kinds = F.array(F.lit("enable the provider"), F.lit("where is"), F.lit("config.json"), F.lit("getValue"), F.lit(""))
    q = asked(spark, sf_dir).select("qid", F.concat_ws(" ", F.element_at(kinds, (F.col("qid") % 5 + 1).cast("int")), "text").alias("query"), F.lit(None).cast("string").alias("label"))
    return h.join(q, "qid")


def guard_query(variant):
    @query(f"ce_guard_{variant.replace('-', '_')}")
    def run(spark, sf_dir):
        return G.ce_guard(guard_hits(spark, sf_dir), variant)


for _variant in G.VARIANTS:
    guard_query(_variant)


@query("ce_guard_oracle", f"""{SPARSE}, {QRELS}, h AS (SELECT qid, id, rank FROM sparse_run WHERE rank <= 10), c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY id) AS ce FROM h), p AS (SELECT c.*, rank <= 3 AND ce > 3 AND EXISTS (SELECT 1 FROM qrels q WHERE q.qid = c.qid AND q.id = c.id) AS far FROM c)
  SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN far THEN 1 WHEN n <= 2 THEN 0 ELSE 2 END, CASE WHEN far THEN -ce ELSE ce END) AS new_rank, bool_or(far) OVER (PARTITION BY qid) AS fired
  FROM (SELECT *, CASE WHEN far THEN NULL ELSE row_number() OVER (PARTITION BY qid, far ORDER BY ce) END AS n FROM p)""")
def ce_guard_oracle(spark, sf_dir):
    h = sparse_lane(spark, sf_dir, 10).select("qid", "id", "rank")
    h = h.withColumn("ce_rank", F.row_number().over(Window.partitionBy("qid").orderBy("id")))
    return G.oracle_guard(h, judged(spark, sf_dir).withColumn("rel", F.lit(3))).select("qid", "id", "new_rank", "fired")


@query("stable_sort", f"{CHUNKS} SELECT source_file, chunk_index, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, source_file, chunk_index) AS rank FROM chunks")
def stable_sort(spark, sf_dir):
    d = chunks(spark, sf_dir).select("source_file", "chunk_index", "lang", F.length("text").alias("n"))
    return R.numbered_by(d, ["lang"], [F.desc("n"), F.col("source_file"), F.col("chunk_index")], "rank").select("source_file", "chunk_index", "rank")


@query("collapse_to_docs", f"{DENSE} SELECT qid, nullif(label, 0) AS doc_id, max(score) AS score, count(*) AS chunk_count FROM dense_run WHERE rank <= 50 GROUP BY 1, 2")
def collapse_to_docs(spark, sf_dir):
    """Vectors with label 0 belong to no document: their hits are told as unmapped."""
    _, vectors = dense(spark, sf_dir)
    return R.collapse_to_docs(dense_lane(spark, sf_dir, 50).select("qid", "id", "score"), vectors.filter("label != 0").select("id", F.col("label").alias("doc_id")))


@query("gap_trigger", f"{DENSE} SELECT qid, coalesce((max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END)) / max(CASE WHEN rank = 1 THEN score END) < 0.1, false) AS fires FROM dense_run GROUP BY qid")
def gap_trigger(spark, sf_dir):
    return R.gap_trigger(dense_lane(spark, sf_dir, 2))


HITS = f"{CHUNKS}, hits AS (SELECT doc_id % 50 AS qid, source_file, chunk_index, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY length(text) DESC, source_file, chunk_index) AS rank FROM chunks), top AS (SELECT * FROM hits WHERE rank <= 20)"


def window_hits(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("qid", F.col("doc_id") % 50).withColumn("n", F.length("text"))
    return R.ranked(c.select("qid", "source_file", "chunk_index", "n"), [F.desc("n"), F.asc("source_file"), F.asc("chunk_index")], limit=20)


@query("expand_window", f"""{HITS}, near AS (SELECT t.qid, t.rank, c.source_file, c.chunk_index, c.chunk_index = t.chunk_index AS is_match FROM top t JOIN chunks c ON c.source_file = t.source_file AND abs(c.chunk_index - t.chunk_index) <= 2),
  n AS (SELECT *, row_number() OVER (PARTITION BY qid, source_file, chunk_index ORDER BY rank, is_match DESC) AS i FROM near) SELECT qid, rank, source_file, chunk_index, is_match FROM n WHERE is_match OR i = 1""")
def expand_window(spark, sf_dir):
    out = R.expand_window(window_hits(spark, sf_dir), chunks(spark, sf_dir), 2)
    return out.select("qid", F.col("rank").cast("bigint").alias("rank"), "source_file", "chunk_index", "is_match")


CONTENT_CHUNKS = f"{CHUNKS}, content AS (SELECT * FROM chunks WHERE coalesce(point_kind, '') NOT IN ('skeleton_nav', 'entity_raw'))"


@query("fetch_window", f"""{CONTENT_CHUNKS}, r AS (SELECT DISTINCT doc_id AS request, source_file, total_chunks // 2 AS center FROM chunks)
  SELECT request, c.chunk_index, c.chunk_index = center AS is_center, text FROM r JOIN content c ON c.source_file = r.source_file AND c.chunk_index BETWEEN center - 3 AND center + 3""")
def fetch_window(spark, sf_dir):
    """The window around the middle of each file."""
    c = chunks(spark, sf_dir)
    asked_for = c.groupBy(F.col("doc_id").alias("request"), "source_file").agg(F.expr("max(total_chunks) div 2").alias("chunk_index"))
    return S.fetch_window(c, asked_for, 3).select("request", "chunk_index", "is_center", "text")


@query("file_chunks", f"{CONTENT_CHUNKS} SELECT doc_id AS request, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS place FROM content WHERE lang = 'fr'")
def file_chunks(spark, sf_dir):
    c = chunks(spark, sf_dir)
    asked_for = c.filter("lang = 'fr'").select(F.col("doc_id").alias("request"), "source_file").distinct()
    return S.file_chunks(c, asked_for).select("request", "chunk_index", "place")


@query("section_chunks", f"""{CONTENT_CHUNKS}, p AS (SELECT *, source_file || '#' || section AS parent_id FROM content), r AS (SELECT DISTINCT source_file || '#' || section AS parent_id FROM chunks WHERE chunk_index % 8 = 5)
  SELECT parent_id AS request, chunk_index, row_number() OVER (PARTITION BY parent_id ORDER BY chunk_index) AS place FROM p JOIN r USING (parent_id)""")
def section_chunks(spark, sf_dir):
    """The sections in which every eighth chunk stands."""
    c = chunks(spark, sf_dir).withColumn("parent_id", F.concat("source_file", F.lit("#"), "section"))
    asked_for = c.filter("chunk_index % 8 = 5").select(F.col("parent_id").alias("request"), "parent_id").distinct()
    return S.section_chunks(c, asked_for).select("request", "chunk_index", "place")


@query("first_in_section", f"{CONTENT_CHUNKS} SELECT source_file, section, arg_min(text, chunk_index) AS text FROM content GROUP BY source_file, section")
def first_in_section(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("parent_id", F.struct("source_file", "section"))
    return S.first_in_section(c).select("source_file", "section", "text")


def metric_sql(run: str, gain: str, none: str) -> str:
    return f"""j AS (SELECT r.qid, r.id, r.rank, coalesce(q.rel, 0) AS rel FROM {run} r LEFT JOIN qrels q ON q.qid = r.qid AND q.id = r.id),
  jj AS (SELECT *, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM j),
  f AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN ({gain}) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rel > 0 AND rank <= 10 THEN 1 ELSE 0 END) AS hit_k,
        max(CASE WHEN rel > 0 AND rank <= 10 THEN 1e0 / rank ELSE 0 END) AS mrr, sum(CASE WHEN rel > 0 AND rank <= 100 THEN CAST(hits AS DOUBLE) / rank ELSE 0 END) AS ap_sum FROM jj GROUP BY qid),
  i AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, id) AS i FROM qrels),
  ib AS (SELECT qid, sum(CASE WHEN i <= 10 THEN ({gain}) / log2(i + 1) ELSE 0 END) AS idcg, count(*) AS total FROM i GROUP BY qid),
  m AS (SELECT f.qid, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE {none} END, 9) AS ndcg, round(CAST(hit_k AS DOUBLE) / total, 9) AS recall, round(hit_k / 10e0, 9) AS precision, round(mrr, 9) AS mrr, round(ap_sum / total, 9) AS ap FROM f LEFT JOIN ib ON ib.qid = f.qid)"""


RUN100 = "run AS (SELECT * FROM sparse_run WHERE rank <= 100)"


SHINGLE = 3


def all_runs(d):
    """(id, run): every run of ``SHINGLE`` words of a text, as often as it occurs. Words are zipped with those after them and joined as
    rows, in compiled code, not as elements of an array."""
    words = d.select("id", F.array_remove(F.split("text", r"\s+"), "").alias("w"))
    after = [F.slice("w", F.lit(i + 1), F.size("w")) for i in range(1, SHINGLE)]
    parts = [f"__{i}" for i in range(SHINGLE)]
    rows = words.select("id", F.inline(F.arrays_zip("w", *after))).toDF("id", *parts)
    return rows.filter(F.col(parts[-1]).isNotNull()).select("id", F.concat_ws(" ", *parts).alias("run"))


def judged(spark, sf_dir):
    """(qid, id, rel): the documents that hold a passage word for word.

    A passage's inner words stand in such a document as they are. Its rarest run of three of them narrows the pairs by
    an equi-join, the text is searched only in those. Passages of fewer inner words are searched in every
    document; that side is broadcast only if it is small. The pairs are written: measures read them for runs and ideals.
    """
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage")).withColumn("runs", X.word_runs(F.col("passage"), SHINGLE, inner=True))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    long = F.size("runs") > 0
    inner = b.select("qid", "passage", F.explode("runs").alias("run"))
    in_docs = all_runs(d).join(inner.select("run").distinct(), "run", "left_semi").distinct()
    in_docs = written(in_docs, "runs")  # read twice
    often = in_docs.groupBy("run").agg(F.count("*").alias("n"))
    rarest = inner.join(often, "run", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r"))
    pairs = rarest.filter("r.n > 0").select("qid", "r.run").join(in_docs, "run").select("qid", "id")
    found = pairs.join(b.select("qid", "passage"), "qid").join(d, "id").filter(F.contains("text", "passage")).select("qid", "id")
    short = d.join(b.filter(~long).select("qid", "passage"), F.contains("text", "passage")).select("qid", "id")
    return written(found.unionByName(short).select("qid", "id", F.lit(1).alias("rel")), "judged")


@query("retrieval_metrics", f"{SPARSE}, {QRELS}, {RUN100}, {metric_sql('run', 'CAST(rel AS DOUBLE)', '0e0')} SELECT * FROM m")
def retrieval_metrics(spark, sf_dir):
    return E.per_query(sparse_lane(spark, sf_dir, 100), judged(spark, sf_dir))


@query("ndcg_exp", f"{SPARSE}, {QRELS}, {RUN100}, {metric_sql('run', 'pow(2e0, rel) - 1', 'NULL')} SELECT qid, ndcg FROM m")
def ndcg_exp(spark, sf_dir):
    return E.per_query(sparse_lane(spark, sf_dir, 100), judged(spark, sf_dir), gain="exp").select("qid", "ndcg")


@query("aggregate_metrics", f"{SPARSE}, {QRELS}, {RUN100}, {metric_sql('run', 'CAST(rel AS DOUBLE)', '0e0')} SELECT round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS ap, count(*) FILTER (WHERE recall IS NULL) AS skipped FROM m")
def aggregate_metrics(spark, sf_dir):
    return E.aggregate_metrics(E.per_query(sparse_lane(spark, sf_dir, 100), judged(spark, sf_dir)))


@query("lane_overlap", f"{LANES}, b AS (SELECT d.qid, count(*) AS shared FROM lane_d d JOIN sparse_run t ON d.qid = t.qid AND d.id = t.id WHERE d.rank <= 10 AND t.rank <= 10 GROUP BY d.qid) SELECT q.qid, coalesce(shared, 0) AS shared FROM ql q LEFT JOIN b ON b.qid = q.qid")
def lane_overlap(spark, sf_dir):
    return E.lane_overlap(*text_lanes(spark, sf_dir, 10), 10)


@query("relevant_overlap", f"""{LANES}, {QRELS}, m AS (SELECT q.qid, d.id IS NOT NULL AS x, t.id IS NOT NULL AS y FROM qrels q LEFT JOIN (SELECT * FROM lane_d WHERE rank <= 10) d ON d.qid = q.qid AND d.id = q.id LEFT JOIN (SELECT * FROM sparse_run WHERE rank <= 10) t ON t.qid = q.qid AND t.id = q.id)
  SELECT count(*) FILTER (WHERE x AND NOT y) AS first_only, count(*) FILTER (WHERE y AND NOT x) AS second_only, count(*) FILTER (WHERE x AND y) AS both, count(*) FILTER (WHERE NOT x AND NOT y) AS neither FROM m""")
def relevant_overlap(spark, sf_dir):
    return E.relevant_overlap(*text_lanes(spark, sf_dir, 10), judged(spark, sf_dir), 10)


@query("window_recall", f"""{HITS}, want AS (SELECT doc_id % 50 AS qid, source_file, chunk_index FROM chunks WHERE chunk_index = 1)
  SELECT w.qid, round(CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM top t WHERE t.qid = w.qid AND t.source_file = w.source_file AND abs(t.chunk_index - w.chunk_index) <= 1) THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS recall FROM want w GROUP BY w.qid""")
def window_recall(spark, sf_dir):
    wanted = chunks(spark, sf_dir).filter("chunk_index = 1").select((F.col("doc_id") % 50).alias("qid"), "source_file", "chunk_index")
    return E.window_recall(window_hits(spark, sf_dir), wanted, 20, 1)


def runs_sql(depth: int) -> str:
    """Both lanes and their fusion as modes, and per-query nDCG at 10 of each."""
    return f"""{LANES}, {QRELS}, fused AS (SELECT qid, id, round(sum(s), 9) AS score FROM (SELECT qid, id, 1e0 / (60 + rank - 1) AS s FROM lane_d WHERE rank <= 20 UNION ALL SELECT qid, id, 1e0 / (60 + rank - 1) FROM sparse_run WHERE rank <= 20) GROUP BY qid, id),
hybrid_run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused),
runs AS (SELECT 'dense' AS mode, qid, id, rank FROM lane_d WHERE rank <= {depth} UNION ALL SELECT 'sparse', qid, id, rank FROM sparse_run WHERE rank <= {depth} UNION ALL SELECT 'hybrid', qid, id, rank FROM hybrid_run WHERE rank <= {min(depth, 10)}),
grades AS (SELECT qid, id, CASE WHEN id % 3 = 0 THEN 2 ELSE 3 END AS rel FROM qrels),
hit AS (SELECT runs.*, coalesce(grades.rel, 0) AS rel FROM runs LEFT JOIN grades ON grades.qid = runs.qid AND grades.id = runs.id),
one AS (SELECT mode, qid, sum(CASE WHEN rel > 0 AND rank <= 10 THEN 1e0 / log2(rank + 1) ELSE 0 END) AS dcg, min(CASE WHEN rel >= 3 THEN rank END) AS best, min(CASE WHEN rel >= 2 THEN rank END) AS support,
  sum(CASE WHEN rank <= 10 THEN (pow(2e0, rel) - 1) / log2(rank + 1) ELSE 0 END) AS xdcg FROM hit GROUP BY mode, qid),
ideal AS (SELECT qid, sum(CASE WHEN i <= 10 THEN 1e0 / log2(i + 1) ELSE 0 END) AS idcg, sum(CASE WHEN i <= 10 THEN (pow(2e0, rel) - 1) / log2(i + 1) ELSE 0 END) AS xidcg, max(rel) AS top FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, id) AS i FROM grades) GROUP BY qid),
scored AS (SELECT one.mode, one.qid, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 9) AS ndcg, best FROM one LEFT JOIN ideal ON ideal.qid = one.qid)"""


def modes(spark, sf_dir, depth=10):
    """(mode, qid, id, rank) of the dense lane, the sparse lane and their fusion."""
    d, t = text_lanes(spark, sf_dir, max(20, depth))
    fused = R.ranked(R.fuse_rrf([d.filter("rank <= 20"), t.filter("rank <= 20")]), [F.desc("score"), F.asc("id")], limit=10)
    of = lambda run, mode, n: run.filter(F.col("rank") <= n).select(F.lit(mode).alias("mode"), "qid", "id", F.col("rank").cast("bigint").alias("rank"))
    return of(d, "dense", depth).unionByName(of(t, "sparse", depth)).unionByName(of(fused, "hybrid", 10))


def grades(spark, sf_dir):
    return graded_of(judged(spark, sf_dir))


def graded_of(good):
    return good.select("qid", "id", F.when(F.col("id") % 3 == 0, 2).otherwise(3).alias("rel"))


def scored(spark, sf_dir, *wanted):
    """(qid, ndcg) of each mode that is wanted. All are scored at once and written, so that lanes and judgements are made once."""
    run = modes(spark, sf_dir).filter(F.col("mode").isin(*wanted))
    kinds = F.explode(F.array(*[F.lit(m) for m in wanted])).alias("mode")
    good = judged(spark, sf_dir).select("*", kinds)
    both = F.struct("mode", "qid").alias("qid")
    found = E.per_query(run.select(both, "id", "rank"), good.select(both, "id", "rel"))
    found = written(found.select("qid.mode", "qid.qid", "ndcg"), "scored")
    return tuple(found.filter(F.col("mode") == m).select("qid", "ndcg") for m in wanted)


@query("rescue_harm", f"""{runs_sql(10)}, c AS (SELECT coalesce(a.qid, b.qid) AS qid, round(coalesce(b.ndcg, 0) - coalesce(a.ndcg, 0), 9) AS delta FROM (SELECT * FROM scored WHERE mode = 'dense') a FULL JOIN (SELECT * FROM scored WHERE mode = 'hybrid') b ON a.qid = b.qid)
  SELECT qid, delta, CASE WHEN delta > 1e-9 THEN 'rescue' WHEN delta < -1e-9 THEN 'harm' ELSE 'tie' END AS kind FROM c""")
def rescue_harm(spark, sf_dir):
    return E.rescue_harm(*scored(spark, sf_dir, "dense", "hybrid"))


@query("representative_cases", f"""{runs_sql(10)}, c AS (SELECT a.qid, round(b.ndcg - a.ndcg, 9) AS delta FROM (SELECT * FROM scored WHERE mode = 'dense') a JOIN (SELECT * FROM scored WHERE mode = 'sparse') b ON a.qid = b.qid),
  k AS (SELECT *, CASE WHEN delta > 0 THEN 'rescue' ELSE 'harm' END AS kind, row_number() OVER (PARTITION BY delta > 0 ORDER BY abs(delta) DESC, qid) AS place FROM c WHERE abs(delta) > 1e-9) SELECT * FROM k WHERE place <= 3""")
def representative_cases(spark, sf_dir):
    cases = E.rescue_harm(*scored(spark, sf_dir, "dense", "sparse"))
    return E.representative_cases(cases).withColumn("place", F.col("place").cast("bigint"))


@query("metric_parity", f"{runs_sql(10)}, m AS (SELECT mode, avg(ndcg) AS ndcg, avg(1e0 / best) AS mrr FROM scored GROUP BY mode) SELECT mode, unnest(['ndcg', 'mrr']) AS metric, unnest([mode <> 'sparse', mode <> 'dense' OR mrr IS NULL]) AS ok FROM m")
def metric_parity(spark, sf_dir):
    """Means against a report that is wrong in two places."""
    m, good = modes(spark, sf_dir), judged(spark, sf_dir)
    ndcg = E.per_query(m.withColumn("qid", F.struct("mode", "qid")), good.join(m.select("mode").distinct()).withColumn("qid", F.struct("mode", "qid")))
    first = E.exact_ranks(m, graded_of(good)).groupBy("mode").agg(F.avg(1.0 / F.col("best")).alias("mrr"))
    found = ndcg.groupBy("qid.mode").agg(F.avg("ndcg").alias("ndcg")).join(first, "mode", "left")
    told = found.select("mode", (F.col("ndcg") + F.when(F.col("mode") == "sparse", 1e-3).otherwise(1e-12)).alias("ndcg"), F.when(F.col("mode") == "dense", None).otherwise(F.col("mrr")).alias("mrr"))
    return E.metric_parity(found, told, ["ndcg", "mrr"], "mode")


@query("overall_verdict", f"""{runs_sql(10)}, d AS (SELECT b.mode, b.ndcg - a.ndcg AS x FROM (SELECT * FROM scored WHERE mode = 'dense') a JOIN scored b ON a.qid = b.qid WHERE b.mode <> 'dense'),
  s AS (SELECT mode, avg(x) AS mean, min(x) AS low, max(x) AS high FROM d GROUP BY mode), v AS (SELECT count(*) FILTER (WHERE (low > 0 OR high < 0) AND mean > 0) AS up, count(*) FILTER (WHERE (low > 0 OR high < 0) AND mean <= 0) AS down FROM s)
  SELECT CASE WHEN up > 0 AND down > 0 THEN 'FUSION_DATASET_DEPENDENT' WHEN up > 0 THEN 'FUSION_COMPLEMENTARY' WHEN down > 0 THEN 'FUSION_SPARSE_DEGRADES' ELSE 'FUSION_ANALYSIS_INCONCLUSIVE' END AS verdict FROM v""")
def overall_verdict(spark, sf_dir):
    """Each mode against the dense lane, with the range of the differences as its interval."""
    base, *others = scored(spark, sf_dir, "dense", "sparse", "hybrid")
    base = base.withColumnRenamed("ndcg", "a")
    rows = [base.join(other, "qid").select((F.col("ndcg") - F.col("a")).alias("x")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("low"), F.max("x").alias("high")) for other in others]
    return E.overall_verdict(rows[0].unionByName(rows[1]))


GRADED = "grades_k AS (SELECT qid, id, CASE WHEN id % 3 = 0 THEN 2 ELSE 3 END AS rel FROM qrels)"


@query("graded_recall", f"""{SPARSE}, {QRELS}, {GRADED}, t AS (SELECT qid, count(*) AS total FROM grades_k WHERE rel >= 3 GROUP BY qid), f AS (SELECT r.qid, count(*) AS n, min(rank) AS best FROM sparse_run r JOIN grades_k g ON g.qid = r.qid AND g.id = r.id AND g.rel >= 3 WHERE rank <= 10 GROUP BY r.qid),
  q AS (SELECT DISTINCT qid FROM sparse_run UNION SELECT qid FROM grades_k) SELECT q.qid, CASE WHEN total IS NOT NULL THEN n IS NOT NULL END AS hit, CASE WHEN total IS NOT NULL THEN round(coalesce(n, 0) / CAST(total AS DOUBLE), 9) END AS recall, CASE WHEN total IS NOT NULL THEN round(coalesce(1e0 / best, 0), 9) END AS mrr
  FROM q LEFT JOIN t ON t.qid = q.qid LEFT JOIN f ON f.qid = q.qid""")
def graded_recall(spark, sf_dir):
    return E.graded(sparse_lane(spark, sf_dir, 10), grades(spark, sf_dir), 10)


@query("required_evidence", f"""{SPARSE}, {QRELS}, g AS (SELECT qid, id % 2 AS grp, max(CASE WHEN EXISTS (SELECT 1 FROM sparse_run r WHERE r.qid = qrels.qid AND r.id = qrels.id AND r.rank <= 5) THEN 1 ELSE 0 END) AS has FROM qrels GROUP BY 1, 2) SELECT qid, min(has) = 1 AS covered FROM g GROUP BY qid""")
def required_evidence(spark, sf_dir):
    groups = judged(spark, sf_dir).select("qid", (F.col("id") % 2).alias("grp"), "id")
    return E.required_evidence(sparse_lane(spark, sf_dir, 5), groups, 5)


@query("negative_absence", f"""{SPARSE}, w AS (SELECT item_id AS qid, unnest(string_split(text, ' ')[1:3]) AS token FROM benchmark), f AS (SELECT r.qid, lower(d.text || ' ' || d.lang) AS hay FROM sparse_run r JOIN documents d ON d.doc_id = r.id WHERE rank = 1)
  SELECT w.qid, NOT bool_or(coalesce(contains(hay, lower(token)), false)) AS absent FROM w LEFT JOIN f ON f.qid = w.qid GROUP BY w.qid""")
def negative_absence(spark, sf_dir):
    first = sparse_lane(spark, sf_dir, 1).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("section")), "id")
    tokens = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.slice(F.split("text", " "), 1, 3)).alias("token"))
    return E.negative_absence(first, tokens)


@query("ndcg_binary", f"""{SPARSE}, {QRELS}, r AS (SELECT qid, rank, source AS file FROM sparse_run JOIN documents ON doc_id = id WHERE rank <= 10), e AS (SELECT DISTINCT qid, source AS file FROM qrels JOIN documents ON doc_id = id),
  n AS (SELECT qid, least(count(*), 10) AS n FROM e GROUP BY qid), i AS (SELECT qid, list_sum(list_transform(range(1, n + 1), lambda x: 1e0 / log2(x + 1))) AS idcg FROM n), d AS (SELECT r.qid, sum(1e0 / log2(rank + 1)) AS dcg FROM r JOIN e ON e.qid = r.qid AND e.file = r.file GROUP BY r.qid)
  SELECT q.qid, round(coalesce(dcg / idcg, 0), 9) AS ndcg FROM (SELECT DISTINCT qid FROM r) q LEFT JOIN i ON i.qid = q.qid LEFT JOIN d ON d.qid = q.qid""")
def ndcg_binary(spark, sf_dir):
    of = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"))
    return E.ndcg_binary(sparse_lane(spark, sf_dir, 10).join(of, "id"), judged(spark, sf_dir).join(of, "id"), 10)


ROUTING = """SELECT {by}mode, count(*) FILTER (WHERE top >= 3 AND best = 1) AS rank1, round(avg(CASE WHEN top >= 3 THEN CASE WHEN best <= 3 THEN 1 ELSE 0 END END), 6) AS recall_3, round(avg(CASE WHEN top >= 3 THEN CASE WHEN best <= 5 THEN 1 ELSE 0 END END), 6) AS recall_5,
  round(avg(CASE WHEN top >= 3 THEN CASE WHEN best <= 10 THEN 1 ELSE 0 END END), 6) AS recall_k, round(avg(CASE WHEN support <= 10 THEN 1 ELSE 0 END), 6) AS support_k, round(avg(CASE WHEN top >= 3 THEN CASE WHEN best <= 10 THEN 1e0 / best ELSE 0 END END), 6) AS mrr10,
  round(avg(CASE WHEN xidcg > 0 THEN coalesce(xdcg, 0) / xidcg ELSE 0 END), 6) AS ndcg, count(*) AS n
  FROM (SELECT i.*, m.mode FROM ideal i CROSS JOIN (SELECT DISTINCT mode FROM runs) m) e LEFT JOIN one USING (mode, qid) GROUP BY {by}mode"""


@query("routing_metrics", f"{runs_sql(10)} {ROUTING.format(by='')}")
def routing_metrics(spark, sf_dir):
    return E.routing_metrics(modes(spark, sf_dir), grades(spark, sf_dir))


@query("per_class", f"{runs_sql(10)}, typed AS (SELECT *, 'class' || (qid % 3) AS type FROM ideal), ideal2 AS (SELECT * FROM typed) {ROUTING.format(by='type, ').replace('FROM ideal i', 'FROM ideal2 i')}")
def per_class(spark, sf_dir):
    return E.routing_metrics(modes(spark, sf_dir), grades(spark, sf_dir).withColumn("type", F.concat(F.lit("class"), (F.col("qid") % 3).cast("string"))), by=["type"])


@query("ordering_loss", f"""{runs_sql(20)}, p AS (SELECT qid, max(CASE WHEN mode = 'hybrid' THEN best END) AS base_rank, max(CASE WHEN mode = 'dense' THEN best END) AS guarded_rank, max(CASE WHEN mode = 'sparse' THEN best END) AS raw_rank FROM one GROUP BY qid)
  SELECT *, CASE WHEN coalesce(raw_rank > base_rank, false) AND coalesce(guarded_rank > raw_rank, false) THEN 'mixed' WHEN coalesce(raw_rank > base_rank, false) THEN 'CE' ELSE 'guard' END AS cause, round(1e0 / base_rank - 1e0 / guarded_rank, 9) AS mrr_loss FROM p WHERE base_rank <= 2 AND guarded_rank > base_rank AND guarded_rank <= 3""")
def ordering_loss(spark, sf_dir):
    return E.ordering_loss(E.exact_ranks(modes(spark, sf_dir, 20), grades(spark, sf_dir)), "hybrid", "dense", "sparse")


@query("regression_flags", f"""{runs_sql(10)}, b AS (SELECT mode, qid, min(rank) AS best FROM hit WHERE rel > 0 GROUP BY mode, qid)
  SELECT coalesce(a.qid, b.qid) AS qid, CASE WHEN a.best <= 3 AND (b.best IS NULL OR b.best > 3) THEN 'regression' WHEN b.best = 1 AND (a.best IS NULL OR a.best > 1) THEN 'improvement' ELSE 'same' END AS flag
  FROM (SELECT * FROM b WHERE mode = 'hybrid') a FULL JOIN (SELECT * FROM b WHERE mode = 'dense') b ON a.qid = b.qid""")
def regression_flags(spark, sf_dir):
    best = modes(spark, sf_dir).join(judged(spark, sf_dir), ["qid", "id"], "left_semi").groupBy("mode", "qid").agg(F.min("rank").alias("best"))
    return E.regression_flags(best.filter("mode = 'hybrid'"), best.filter("mode = 'dense'"))


@query("best_exact_rank", f"{DENSE} SELECT qid, min(rank) AS best FROM dense_run WHERE label = q_label GROUP BY qid")
def best_exact_rank(spark, sf_dir):
    return R.dense_best_ranks(*dense(spark, sf_dir))


REPORT = f"""{SPARSE}, {QRELS}, q AS (SELECT item_id AS qid, item_id % 4 = 0 AS negative, lower(regexp_extract(text, '[\\p{{L}}\\p{{N}}_]+')) AS token, CAST(length(text) AS DOUBLE) AS latency FROM benchmark),
  h AS (SELECT r.qid, rank, source AS file, lang AS section, list_concat(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), [lower(lang)]) AS w FROM sparse_run r JOIN documents ON doc_id = id WHERE rank <= 10),
  x AS (SELECT q.qid, list_distinct(list(source) FILTER (WHERE source IS NOT NULL)) AS files FROM q LEFT JOIN qrels ON qrels.qid = q.qid LEFT JOIN documents ON doc_id = qrels.id GROUP BY q.qid),
  j AS (SELECT h.*, list_contains(files, file) AS good, list_contains(w, token) AS has, token FROM h JOIN x USING (qid) JOIN q USING (qid)),
  p AS (SELECT qid, min(CASE WHEN good THEN rank END) AS best, sum(CASE WHEN good THEN 1e0 / log2(rank + 1) ELSE 0 END) AS dcg, bool_or(good AND section = 'en') AS section_hit, bool_or(good AND has) AS token_hit, bool_or(rank = 1 AND has) AS strong, count(DISTINCT file) AS found, count(*) AS n FROM j GROUP BY qid),
  e AS (SELECT q.*, p.best, p.dcg, p.section_hit, p.token_hit, p.strong, p.found, p.n, len(coalesce(files, [])) AS nf FROM q LEFT JOIN p USING (qid) LEFT JOIN x USING (qid))"""


@query("retrieval_report", f"""{REPORT} SELECT round(avg(CASE WHEN best <= 1 THEN 1 ELSE 0 END) FILTER (WHERE NOT negative), 6) AS recall_1, round(avg(CASE WHEN best <= 10 THEN 1 ELSE 0 END) FILTER (WHERE NOT negative), 6) AS recall_k, round(avg(coalesce(1e0 / best, 0)) FILTER (WHERE NOT negative), 6) AS mrr,
  round(avg(CASE WHEN nf > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(nf, 10) + 1), lambda i: 1e0 / log2(i + 1))) ELSE 0 END) FILTER (WHERE NOT negative), 6) AS ndcg,
  round(avg(CASE WHEN section_hit THEN 1 ELSE 0 END) FILTER (WHERE NOT negative), 6) AS section_hit, round(avg(CASE WHEN token_hit THEN 1 ELSE 0 END) FILTER (WHERE NOT negative), 6) AS token_hit, round(avg(CASE WHEN coalesce(strong, false) THEN 0 ELSE 1 END) FILTER (WHERE negative), 6) AS negative_pass,
  round(avg(CASE WHEN n > 0 THEN 1 - found / CAST(n AS DOUBLE) ELSE 0 END) FILTER (WHERE NOT negative), 6) AS duplicate_rate, round(avg(coalesce(found, 0)) FILTER (WHERE NOT negative), 6) AS diversity, round(avg(latency), 6) AS latency,
  quantile_disc(latency, 0.5) AS p50, quantile_disc(latency, 0.95) AS p95, count(*) FILTER (WHERE NOT negative) AS n_positive, count(*) FILTER (WHERE negative) AS n_negative FROM e""")
def retrieval_report(spark, sf_dir):
    """Every fourth passage counts as a negative, its first word as the token that must not be hit."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("lang").alias("section"), "text")
    token = F.lower(F.regexp_extract("text", r"[\p{L}\p{N}_]+", 0))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") % 4 == 0).alias("negative"), F.array(token).alias("all_tokens"), F.length("text").cast("double").alias("latency"))
    files = judged(spark, sf_dir).join(d.select("id", "file"), "id").groupBy("qid").agg(F.collect_set("file").alias("files"))
    q = q.join(files, "qid", "left").withColumns({"files": F.coalesce("files", F.array().cast("array<string>")), "sections": F.array(F.lit("en")), "any_tokens": F.array().cast("array<string>")})
    return E.retrieval_report(sparse_lane(spark, sf_dir, 10).select("qid", "id", "rank").join(d, "id"), q, 10)


@query("trigger_eval", f"""{DENSE}, b AS (SELECT qid, min(CASE WHEN label = q_label AND id <> qid THEN rank END) AS best, max(CASE WHEN rank = 2 THEN score END) AS s2, max(CASE WHEN rank = 6 THEN score END) AS s6 FROM dense_run GROUP BY qid),
  s AS (SELECT s2 - s6 AS signal, best IS NULL OR best > 6 AS miss, coalesce(best <= 11, false) AS recovers FROM b), g AS (SELECT unnest([0.02, 0.05, 0.1, 0.2]) AS threshold), x AS (SELECT CAST(threshold AS DOUBLE) AS threshold, signal < threshold AS fired, miss, recovers FROM s, g)
  SELECT threshold, round(count(*) FILTER (WHERE fired) / CAST(count(*) AS DOUBLE), 6) AS trigger_rate, round(count(*) FILTER (WHERE fired AND miss) / CAST(nullif(count(*) FILTER (WHERE miss), 0) AS DOUBLE), 6) AS miss_recall, round(count(*) FILTER (WHERE fired AND miss) / CAST(nullif(count(*) FILTER (WHERE fired), 0) AS DOUBLE), 6) AS precision,
  round(count(*) FILTER (WHERE fired AND NOT miss) / CAST(nullif(count(*) FILTER (WHERE NOT miss), 0) AS DOUBLE), 6) AS false_positive_rate, round(count(*) FILTER (WHERE fired AND miss AND recovers) / CAST(nullif(count(*) FILTER (WHERE fired AND miss), 0) AS DOUBLE), 6) AS recovery FROM x GROUP BY threshold""")
def trigger_eval(spark, sf_dir):
    """The score spread of the five nearest others as the signal; a miss has none of the query's label among them."""
    queries, vectors = dense(spark, sf_dir)
    lane = dense_lane(spark, sf_dir, 11).join(vectors.select("id", "label"), "id").join(queries.select("qid", "q_label"), "qid")
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    best = F.min(F.when((F.col("label") == F.col("q_label")) & (F.col("id") != F.col("qid")), F.col("rank")))
    s = lane.groupBy("qid").agg((at(2) - at(6)).alias("signal"), best.alias("best"))
    s = s.select("signal", (F.col("best").isNull() | (F.col("best") > 6)).alias("miss"), F.coalesce(F.col("best") <= 11, F.lit(False)).alias("recovers"))
    return E.trigger_eval(s, [0.02, 0.05, 0.1, 0.2])


@query("agent_policies", f"""{DENSE}, r AS (SELECT qid, min(CASE WHEN label = q_label AND id <> qid THEN rank END) AS best, max(CASE WHEN rank <= 5 AND abs(id - qid) <= 25 AND id <> qid THEN 1 ELSE 0 END) = 1 AS neighbour FROM dense_run WHERE rank <= 40 GROUP BY qid),
  s AS (SELECT coalesce(best <= 5, false) AS five, coalesce(best <= 10, false) AS ten, coalesce((best + 1) // 2 <= 10, false) AS deep, neighbour AND NOT coalesce(best <= 5, false) AS look FROM r),
  p AS (SELECT unnest(['p1', 'p2', 'p3', 'p4', 'p5']) AS policy, unnest([five, ten, five, five, five]) AS one, unnest([five, ten, five OR ten, five OR deep, five OR (look AND ten)]) AS two, unnest([1, 1, CASE WHEN five THEN 1 ELSE 2 END, CASE WHEN five THEN 1 ELSE 2 END, CASE WHEN look THEN 2 ELSE 1 END]) AS calls FROM s)
  SELECT policy, round(avg(CAST(one AS INTEGER)), 6) AS success_1, round(avg(CAST(two AS INTEGER)), 6) AS success_2, round(avg(calls), 6) AS calls FROM p GROUP BY policy""")
def agent_policies(spark, sf_dir):
    """Reranking stands for halving a rank, a window for the next ten; a neighbour is an id within 25."""
    queries, vectors = dense(spark, sf_dir)
    lane = dense_lane(spark, sf_dir, 40).join(vectors.select("id", "label"), "id").join(queries.select("qid", "q_label"), "qid")
    other = F.col("id") != F.col("qid")
    r = lane.groupBy("qid").agg(
        F.min(F.when((F.col("label") == F.col("q_label")) & other, F.col("rank"))).alias("best"),
        F.bool_or((F.col("rank") <= 5) & (F.abs(F.col("id") - F.col("qid")) <= 25) & other).alias("neighbour"),
    )
    return E.agent_policies(r.withColumns({"reranked": F.floor((F.col("best") + 1) / 2), "window": F.col("best") <= 10}))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    a, b = (d.withColumnRenamed("ndcg", c) for d, c in zip(scored(spark, sf_dir, "dense", "hybrid"), "ab", strict=True))
    return E.paired_bootstrap(a.join(b, "qid"))


@query("oracle_max", f"{runs_sql(10)} SELECT round(avg(greatest(coalesce(a.ndcg, 0), coalesce(b.ndcg, 0))), 6) AS oracle FROM (SELECT * FROM scored WHERE mode = 'dense') a FULL JOIN (SELECT * FROM scored WHERE mode = 'sparse') b ON a.qid = b.qid")
def oracle_max(spark, sf_dir):
    """Mean of the better lane's nDCG."""
    a, b = (d.withColumnRenamed("ndcg", c) for d, c in zip(scored(spark, sf_dir, "dense", "sparse"), "ab", strict=True))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.join(b, "qid", "full").agg(F.round(F.avg(F.greatest(zero("a"), zero("b"))), 6).alias("oracle"))


@query("tag_fill", "SELECT round(avg(CASE WHEN len(tags) > 0 THEN 1 ELSE 0 END), 6) AS filled, round(avg(len(tags)), 6) AS mean_tags, round(avg(n), 6) AS mean, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95 FROM (SELECT list_filter([lang, source], lambda t: t NOT IN ('en', 'src1')) AS tags, CAST(length(text) AS DOUBLE) AS n FROM documents)")
def tag_fill(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.filter(F.array("lang", "source"), lambda t: ~t.isin("en", "src1")).alias("tags"), F.length("text").cast("double").alias("n"))
    return E.tag_fill(d, "n")


@query("macro_summary", "SELECT lang, source, round(avg(length(text)), 6) AS mean, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def macro_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", F.length("text").alias("n_text"))
    return d.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.round(F.avg("n_text"), 6).alias("mean"), F.count("*").alias("n"))


@query("sparse_diagnostics", f"{SPARSE}, k AS (SELECT id, count(*) AS nnz FROM sc GROUP BY id) SELECT round(avg(nnz), 6) AS mean_nnz, count(*) AS covered FROM k")
def sparse_diagnostics(spark, sf_dir):
    k = R.sparse_encode(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("nnz"))
    return k.agg(F.round(F.avg("nnz"), 6).alias("mean_nnz"), F.count("*").alias("covered"))


GRID = [(k, r) for k in (2, 60) for r in (0.1, 0.25, 0.5, 0.75, 1.0)]


@query("fusion_grid", f"""{LANES}, {QRELS}, g AS (SELECT * FROM (SELECT unnest([2, 60]) AS k), (SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0]) AS ratio)), d AS (SELECT * FROM lane_d WHERE rank <= 20), t AS (SELECT * FROM sparse_run WHERE rank <= 20),
  p AS (SELECT coalesce(d.qid, t.qid) AS qid, coalesce(d.id, t.id) AS id, d.rank AS dr, t.rank AS tr FROM d FULL JOIN t ON d.qid = t.qid AND d.id = t.id),
  f AS (SELECT k, ratio, qid, id, dr, tr, round(coalesce(1e0 / (k + dr - 1), 0) + coalesce(1e0 / (k + tr / (1e0 / (k * (1e0 / ratio - 1) + 1)) - 1), 0), 9) AS score FROM p, g),
  o AS (SELECT *, row_number() OVER (PARTITION BY k, ratio, qid ORDER BY score DESC, dr NULLS LAST, tr NULLS LAST, id) AS rank FROM f),
  b AS (SELECT k, ratio, o.qid, coalesce(max(CASE WHEN q.id IS NOT NULL AND rank <= 10 THEN 1e0 / rank END), 0) AS fused, coalesce(max(CASE WHEN q.id IS NOT NULL AND dr <= 10 THEN 1e0 / dr END), 0) AS base FROM o LEFT JOIN qrels q ON q.qid = o.qid AND q.id = o.id GROUP BY 1, 2, 3),
  s AS (SELECT k, ratio, qid % 2 AS grp, avg(base) AS bm, avg(fused) AS fm, count(*) AS n FROM b GROUP BY 1, 2, 3), r AS (SELECT k, CAST(ratio AS DOUBLE) AS ratio, round(sum((fm - bm) * n) / sum(n), 6) AS gain, bool_and(fm >= bm) AS safe FROM s GROUP BY 1, 2)
  SELECT *, row_number() OVER (ORDER BY safe DESC, gain DESC, k, ratio) AS place FROM r""")
def fusion_grid(spark, sf_dir):
    """Reciprocal first ranks of the weighted fusion against the dense lane, per setting; the best safe one first."""
    d, t = text_lanes(spark, sf_dir, 20)
    good = judged(spark, sf_dir).select("qid", "id", F.lit(True).alias("good"))
    settings = F.broadcast(spark.createDataFrame([(k, r, 1 / (k * (1 / r - 1) + 1)) for k, r in GRID], "k int, ratio double, w double"))  # ten rows
    both = written(R.weighted_rrf(d, t, 60, 0.5).drop("score").join(good, ["qid", "id"], "left"), "fusion")  # ranked once, for all settings
    worth = lambda rank, w: F.coalesce(1.0 / (F.col("k") + F.col(rank) / w - 1), F.lit(0.0))
    run = both.crossJoin(settings).withColumn("score", F.round(worth("d_rank", F.lit(1.0)) + worth("s_rank", F.col("w")), 9))
    place = F.row_number().over(Window.partitionBy("k", "ratio", "qid").orderBy(F.desc("score"), F.asc_nulls_last("d_rank"), F.asc_nulls_last("s_rank"), F.asc("id")))
    best = lambda c: F.coalesce(F.max(F.when(F.col("good") & (F.col(c) <= 10), 1.0 / F.col(c))), F.lit(0.0))
    out = run.withColumn("rank", place).groupBy("k", "ratio", "qid").agg(best("rank").alias("fused"), best("d_rank").alias("base"))
    out = out.select("k", "ratio", (F.col("qid") % 2).alias("grp"), "base", "fused")
    return E.safe_candidates(out, ["grp"]).withColumn("place", F.col("place").cast("bigint"))


@query("trec_run", f"{SPARSE} SELECT qid || chr(9) || 'Q0' || chr(9) || id || chr(9) || rank || chr(9) || 'sparse' AS line FROM sparse_run WHERE rank <= 10")
def trec_run(spark, sf_dir):
    return sparse_lane(spark, sf_dir, 10).select(F.concat_ws("\t", "qid", F.lit("Q0"), "id", "rank", F.lit("sparse")).alias("line"))


@query("qrels_tsv", f"WITH {QRELS} SELECT qid, id, CAST(1 AS DOUBLE) AS score FROM qrels")
def qrels_tsv(spark, sf_dir):
    from ..sources.runs import parse_qrels

    lines = judged(spark, sf_dir).select(F.concat_ws("\t", "qid", "id", "rel").alias("value"))
    extra = spark.createDataFrame([("query-id\tcorpus-id\tscore",), ("1\t2\tnan",), ("1\t2\tmany",)], "value string")
    out = parse_qrels(lines.unionByName(extra))
    return out.select(F.col("qid").cast("bigint").alias("qid"), F.col("id").cast("bigint").alias("id"), "score")


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY sha256('seed' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(F.sha2(F.concat(F.lit("seed"), "doc_id"), 256), "doc_id").select("doc_id").limit(100)


@query("round_robin_pool", f"""{DENSE}, t AS (SELECT qid, id, rank FROM dense_run WHERE rank <= 30 AND label <> q_label), f AS (SELECT id, rank, qid, row_number() OVER (PARTITION BY id ORDER BY rank, qid) AS i FROM t),
  r AS (SELECT qid, id, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS round FROM f WHERE i = 1) SELECT id, qid FROM r ORDER BY round, qid, rank, id LIMIT 100""")
def round_robin_pool(spark, sf_dir):
    """Near misses in turn: each query's next one a round, queries in order, each row at its first appearance."""
    queries, vectors = dense(spark, sf_dir)
    t = dense_lane(spark, sf_dir, 30).join(vectors.select("id", "label"), "id").join(queries.select("qid", "q_label"), "qid").filter("label != q_label")
    first = t.groupBy("id").agg(F.min(F.struct("rank", "qid")).alias("f")).select("id", "f.*")
    turns = first.withColumn("round", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return turns.orderBy("round", "qid", "rank", "id").limit(100).select("id", "qid")


@query("task_synthesis", "SELECT md5(text) AS passage, count(*) AS n, count(DISTINCT lang) > 1 AS inconsistent FROM documents GROUP BY 1")
def task_synthesis(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("passage")).agg(F.count("*").alias("n"), (F.countDistinct("lang") > 1).alias("inconsistent"))


@query("dense_embed", f"{SPARSE}, v AS (SELECT id AS doc_id, bucket % 64 AS dim, sum(weight) AS v FROM sc GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM v GROUP BY doc_id) SELECT doc_id, dim, round(v / n, 6) AS value FROM v JOIN n USING (doc_id)")
def dense_embed(spark, sf_dir):
    return R.hashed_embedding(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "dim", F.round("value", 6).alias("value"))
