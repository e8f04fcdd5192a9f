"""Store, navigation and repair queries over the chunk tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as X
from ..operators import control as K
from ..operators import navigation as N
from ..operators import profiles as P
from ..operators import store as S
from ..sources import collection_source as CS
from ..sources import collections as Q
from .fixtures import CHUNKS, chunks, table
from .registry import query
from .text_queries import quoted, uuid_sql

CONTENT = "coalesce(point_kind, '') NOT IN ('skeleton_nav', 'entity_raw')"


@query("nav_exclude", f"{CHUNKS} SELECT source_file, chunk_index, point_kind FROM chunks WHERE {CONTENT}")
def nav_exclude(spark, sf_dir):
    return chunks(spark, sf_dir).filter(S.content_only()).select("source_file", "chunk_index", "point_kind")


@query("filter_translate", f"{CHUNKS} SELECT source_file, chunk_index FROM chunks WHERE (list_contains(tags, 'fr') OR list_contains(tags, 'src3')) AND {CONTENT}")
def filter_translate(spark, sf_dir):
    return chunks(spark, sf_dir).filter(S.search_filter(tags=["fr", "src3"])).select("source_file", "chunk_index")


@query("filter_algebra", f"{CHUNKS} SELECT source_file, chunk_index FROM chunks WHERE lang = 'en' AND (chunk_index BETWEEN 2 AND 5 OR section = 's0') AND NOT source IN ('src1', 'src2')")
def filter_algebra(spark, sf_dir):
    c = chunks(spark, sf_dir)
    must = F.col("lang") == "en"
    should = F.col("chunk_index").between(2, 5) | (F.col("section") == "s0")
    return c.filter(must & should & ~F.col("source").isin("src1", "src2")).select("source_file", "chunk_index")


@query("count_content", f"{CHUNKS} SELECT count(*) AS n FROM chunks WHERE {CONTENT}")
def count_content(spark, sf_dir):
    return chunks(spark, sf_dir).filter(S.content_only()).agg(F.count("*").alias("n"))


@query("scroll", f"{CHUNKS} SELECT source_file, chunk_index, text FROM chunks WHERE lang = 'de' ORDER BY source_file, chunk_index LIMIT 50")
def scroll(spark, sf_dir):
    return chunks(spark, sf_dir).filter("lang = 'de'").orderBy("source_file", "chunk_index").select("source_file", "chunk_index", "text").limit(50)


@query("scroll_all", f"{CHUNKS} SELECT source_file, chunk_index, section FROM chunks WHERE lang = 'de'")
def scroll_all(spark, sf_dir):
    return chunks(spark, sf_dir).filter("lang = 'de'").select("source_file", "chunk_index", "section")


@query("list_collections", "SELECT source AS collection, count(*) AS documents, count(DISTINCT lang) AS languages, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def list_collections(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages"), F.sum(F.length("text")).alias("chars"))


@query("upsert", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN upper(source) ELSE source END AS source FROM documents UNION ALL SELECT doc_id + 1000000000, source FROM documents WHERE doc_id % 25 = 0")
def upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    changed = d.filter("doc_id % 10 = 0").withColumn("source", F.upper("source"))
    added = d.filter("doc_id % 25 = 0").withColumn("doc_id", F.col("doc_id") + 1000000000)
    return S.upsert(d, changed.unionByName(added), "doc_id")


@query("upsert_latest", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'v3' ELSE source END AS source FROM documents UNION ALL SELECT NULL, 'w2'")
def upsert_latest(spark, sf_dir):
    """Each changed key comes three times, and a null key twice: the latest version counts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(0).alias("version"))
    again = d.filter("doc_id % 10 = 0").withColumn("version", F.explode(F.array(F.lit(2), F.lit(3), F.lit(1)))).withColumn("source", F.concat(F.lit("v"), "version"))
    nameless = spark.createDataFrame([(None, "w1", 1), (None, "w2", 2)], "doc_id bigint, source string, version int")
    return S.upsert(d, again.unionByName(nameless), "doc_id", F.col("version")).select("doc_id", "source")


@query("set_payload", f"{CHUNKS} SELECT source_file, chunk_index, CASE WHEN lang = 'en' THEN 'reviewed' ELSE section END AS section FROM chunks")
def set_payload(spark, sf_dir):
    return S.set_payload(chunks(spark, sf_dir), F.col("lang") == "en", {"section": F.lit("reviewed")}).select("source_file", "chunk_index", "section")


@query("delete_payload_keys", f"{CHUNKS} SELECT source_file, chunk_index, CASE WHEN lang = 'en' THEN NULL ELSE section END AS section FROM chunks")
def delete_payload_keys(spark, sf_dir):
    return S.delete_payload_keys(chunks(spark, sf_dir), F.col("lang") == "en", ["section"]).select("source_file", "chunk_index", "section")


@query("delete_by_source", "SELECT doc_id FROM documents WHERE source NOT IN ('src3', 'src7')")
def delete_by_source(spark, sf_dir):
    gone = spark.createDataFrame([("src3",), ("src7",)], "source string")
    return S.delete_by_source(table(spark, sf_dir, "documents"), gone, "source").select("doc_id")


@query("delete_by_filter", f"{CHUNKS} SELECT source_file, chunk_index FROM chunks WHERE NOT (lang = 'fr' AND chunk_index > 3)")
def delete_by_filter(spark, sf_dir):
    return S.delete_where(chunks(spark, sf_dir), (F.col("lang") == "fr") & (F.col("chunk_index") > 3)).select("source_file", "chunk_index")


@query("delete_trailing", f"{CHUNKS} SELECT source_file, chunk_index FROM chunks WHERE NOT (doc_id % 3 = 0 AND chunk_index >= total_chunks // 2)")
def delete_trailing(spark, sf_dir):
    c = chunks(spark, sf_dir)
    kept = c.filter("doc_id % 3 = 0").groupBy("source_file").agg(F.floor(F.max("total_chunks") / 2).alias("n"))
    return S.delete_trailing(c.select("source_file", "chunk_index"), kept)


@query("is_managed", "SELECT p_partkey AS id, p_brand IS NOT NULL AND nullif(p_size % 5, 0) IS NOT NULL AS managed FROM part")
def is_managed(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("odd", F.nullif(F.col("p_size") % 5, F.lit(0)))
    return p.select(F.col("p_partkey").alias("id"), S.is_managed(("p_brand", "odd")).alias("managed"))


@query("search_result_projection", f"{CHUNKS} SELECT source_file || '#' || chunk_index AS id, section, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS snippet FROM chunks WHERE {CONTENT}")
def search_result_projection(spark, sf_dir):
    return chunks(spark, sf_dir).filter(S.content_only()).select(F.concat("source_file", F.lit("#"), "chunk_index").alias("id"), "section", X.compact_snippet(F.col("text")).alias("snippet"))


@query("is_managed_fields", "SELECT doc_id, doc_id % 11 = 10 AS managed FROM documents")
def is_managed_fields(spark, sf_dir):
    """A point lacks the field whose number is its id modulo 11; ten is none of the ten."""
    d = table(spark, sf_dir, "documents")
    fields = {f: F.when(F.col("doc_id") % 11 != i, "x") for i, f in enumerate(S.IDENTITY)}
    return d.withColumns(fields).select("doc_id", S.is_managed().alias("managed"))


@query("provider_combo", "SELECT event_id, event_id % 9 IN (0, 4, 8) AS legal FROM events")
def provider_combo(spark, sf_dir):
    """All nine pairs of three dense and three sparse providers."""
    of = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    n = F.col("event_id") % 9
    pair = P.legal_pair(of(P.DENSE, F.floor(n / 3)), of(P.SPARSE, n % 3))
    return table(spark, sf_dir, "events").select("event_id", pair.alias("legal"))


@query("path_contained", f"{CHUNKS} SELECT source_file, chunk_index, chunk_index % 3 <> 0 AS contained FROM chunks")
def path_contained(spark, sf_dir):
    made = F.when(F.col("chunk_index") % 3 == 0, F.concat(F.lit("a/../../"), "source_file")).when(F.col("chunk_index") % 3 == 1, F.concat(F.lit("./b/../"), "source_file")).otherwise(F.col("source_file"))
    return chunks(spark, sf_dir).select("source_file", "chunk_index", S.path_contained(made).alias("contained"))


@query("source_prefix", f"{CHUNKS} SELECT source_file, count(*) AS n FROM chunks WHERE starts_with(source_file, 'src1/en') GROUP BY source_file")
def source_prefix(spark, sf_dir):
    return chunks(spark, sf_dir).filter(F.col("source_file").startswith("src1/en")).groupBy("source_file").agg(F.count("*").alias("n"))


@query("list_files", f"{CHUNKS} SELECT source_file, count(*) AS chunk_count, arg_min(section, chunk_index) AS first_section, CAST(sum(CASE WHEN lang = 'en' OR source = 'src2' THEN 1 ELSE 0 END) AS BIGINT) AS tag_hits FROM chunks WHERE lang = 'en' OR source = 'src2' GROUP BY source_file")
def list_files(spark, sf_dir):
    return N.list_files(chunks(spark, sf_dir), ["en", "src2"])


@query("list_documents", f"{CHUNKS} SELECT source_file, count(*) AS chunk_count, lang || ',' || source AS tags FROM chunks GROUP BY source_file, lang, source")
def list_documents(spark, sf_dir):
    return N.list_documents(chunks(spark, sf_dir))


@query("list_directories", f"{CHUNKS} SELECT source || '/' || lang || '/' AS directory, count(DISTINCT source_file) AS file_count, count(*) AS chunk_count FROM chunks GROUP BY 1")
def list_directories(spark, sf_dir):
    return N.list_directories(chunks(spark, sf_dir), 2)


@query("list_tags", f"{CHUNKS} SELECT tag, count(*) AS chunk_count, count(DISTINCT source_file) AS file_count FROM (SELECT source_file, unnest(tags) AS tag FROM chunks) GROUP BY tag HAVING count(*) >= 100")
def list_tags(spark, sf_dir):
    return N.list_tags(chunks(spark, sf_dir), least=100)


@query("find_by_tag", f"""{CHUNKS}, s AS (SELECT source_file, section, min(chunk_index) AS first, count(*) AS n FROM chunks WHERE lang = 'en' AND source = 'src4' GROUP BY source_file, section) SELECT source_file, string_agg(section, ',' ORDER BY first) AS sections, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY source_file""")
def find_by_tag(spark, sf_dir):
    return N.find_by_tag(chunks(spark, sf_dir), ["en", "src4"], "all")


@query("find_by_tag_limited", f"""{CHUNKS}, h AS (SELECT *, row_number() OVER (ORDER BY source_file, chunk_index) AS i, count(*) OVER () AS total FROM chunks WHERE lang = 'fr'), s AS (SELECT source_file, section, min(chunk_index) AS first, count(*) AS n, any_value(total) AS total FROM h WHERE i <= 40 GROUP BY 1, 2)
  SELECT source_file, string_agg(section, ',' ORDER BY first) AS sections, CAST(sum(n) AS BIGINT) AS n, any_value(total) > 40 AS truncated FROM s GROUP BY source_file""")
def find_by_tag_limited(spark, sf_dir):
    """The first forty chunks, and whether there are more."""
    return N.find_by_tag(chunks(spark, sf_dir), ["fr"], "any", limit=40)


@query("inventory", f"{CHUNKS}, k AS (SELECT source, lang, count(*) AS n FROM chunks GROUP BY source, lang) SELECT source, string_agg(n || ' ' || lang || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY lang) AS inventory FROM k GROUP BY source")
def inventory(spark, sf_dir):
    return N.inventory(chunks(spark, sf_dir), "source", "lang")


@query("file_skeleton", f'{CHUNKS}, s AS (SELECT source_file, section, count(*) AS n_chunks, min(chunk_index) AS first_chunk, max(chunk_index) AS last_chunk FROM chunks GROUP BY source_file, section) SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY first_chunk) AS "order" FROM s')
def file_skeleton(spark, sf_dir):
    return N.file_skeleton(chunks(spark, sf_dir))


@query(
    "dir_rollup",
    """WITH f AS (SELECT source, source || '/' || lang AS sub, doc_id FROM documents)
    SELECT '' AS directory, count(*) AS n_files, count(DISTINCT source) + count(DISTINCT sub) AS n_dirs FROM f
    UNION ALL SELECT source, count(*), count(DISTINCT sub) FROM f GROUP BY source
    UNION ALL SELECT sub, count(*), 0 FROM f GROUP BY sub""",
)
def dir_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return N.dir_rollup(d.select(F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), "doc_id", F.lit(".md")).alias("source_file")))


@query("children_ordered", f"{CHUNKS} SELECT source_file AS parent, source_file || '#' || chunk_index AS node, CAST(total_chunks - 1 - chunk_index AS INTEGER) AS position FROM chunks WHERE total_chunks - 1 - chunk_index < 3")
def children_ordered(spark, sf_dir):
    c = chunks(spark, sf_dir).select("source_file", F.concat("source_file", F.lit("#"), "chunk_index").alias("node"), "chunk_index")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "node")), asc=False), lambda x: x["node"])
    parents = c.groupBy(F.col("source_file").alias("parent")).agg(listed.alias("children"))
    return N.children_ordered(parents, c.select("node"), 3)


@query("get_node", f"""{CHUNKS}, r AS (SELECT source_file || '#' || chunk_index AS node_id, CASE WHEN chunk_index % 4 = 3 THEN source_file || '#' || (chunk_index - 1) END AS target, point_kind, text FROM chunks)
  SELECT r.node_id, CASE WHEN coalesce(e.point_kind, r.point_kind, '') = 'skeleton_nav' THEN 'nav_node_not_content' ELSE 'found' END AS outcome, CASE WHEN coalesce(e.point_kind, r.point_kind, '') <> 'skeleton_nav' THEN left(coalesce(e.text, r.text), 300) END AS preview,
  CASE WHEN coalesce(e.point_kind, r.point_kind, '') <> 'skeleton_nav' THEN length(coalesce(e.text, r.text)) > 300 END AS truncated FROM r LEFT JOIN r e ON e.node_id = r.target AND coalesce(e.point_kind, '') <> 'skeleton_nav'""")
def get_node(spark, sf_dir):
    """Every point asked for by its id; fragments point to the point before them."""
    return N.get_nodes(addressed(spark, sf_dir), addressed(spark, sf_dir).select("node_id"), 300)


def addressed(spark, sf_dir):
    c = chunks(spark, sf_dir)
    name = lambda i: F.concat("source_file", F.lit("#"), i)
    return c.select(name(F.col("chunk_index")).alias("node_id"), F.when(F.col("chunk_index") % 4 == 3, name(F.col("chunk_index") - 1)).alias("entity_id"), "point_kind", "text")


@query("get_node_absent", "SELECT 'node-' || doc_id AS node_id, 'not_found' AS outcome FROM documents")
def get_node_absent(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(F.concat(F.lit("node-"), "doc_id").alias("node_id"))
    return N.get_nodes(addressed(spark, sf_dir), wanted, 300).select("node_id", "outcome")


@query("resolve_canonical", f"""{CHUNKS}, r AS (SELECT source_file || '#' || chunk_index AS node_id, CASE WHEN chunk_index % 4 = 3 THEN source_file || '#' || (chunk_index - 1) END AS target, point_kind, text FROM chunks)
  SELECT r.node_id, coalesce(e.node_id, r.node_id) AS canonical_id, coalesce(e.text, r.text) AS text FROM r LEFT JOIN r e ON e.node_id = r.target AND coalesce(e.point_kind, '') <> 'skeleton_nav'""")
def resolve_canonical(spark, sf_dir):
    return N.resolve_canonical(addressed(spark, sf_dir)).select("node_id", "canonical_id", "text")


@query("get_children", f"""{CHUNKS}, k AS (SELECT source_file AS parent, source_file || '#' || chunk_index AS node, row_number() OVER (PARTITION BY source_file ORDER BY chunk_index DESC) AS place, count(*) OVER (PARTITION BY source_file) AS total FROM chunks)
  SELECT parent, string_agg(node, ',' ORDER BY place) FILTER (WHERE place <= 3) AS children, max(total) AS total_children, count(*) FILTER (WHERE place <= 3) AS returned_children, max(total) > count(*) FILTER (WHERE place <= 3) AS truncated FROM k GROUP BY parent""")
def get_children(spark, sf_dir):
    c = chunks(spark, sf_dir).select("source_file", F.concat("source_file", F.lit("#"), "chunk_index").alias("node"), "chunk_index")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "node")), asc=False), lambda x: x["node"])
    parents = c.groupBy(F.col("source_file").alias("parent")).agg(listed.alias("children"))
    return N.get_children(parents, c.select("node"), 3)


def points(spark, sf_dir):
    """Points of documents where copies of a text stand in one place; every third has the id that its place asks for."""
    d = table(spark, sf_dir, "documents")
    place = F.md5("text")
    n = F.col("doc_id")
    return d.select(
        place.alias("source_file"),
        F.lit(0).cast("bigint").alias("chunk_index"),
        F.when(n % 3 == 0, I.chunk_id(F.lit("main"), place, F.lit(0))).otherwise(n.cast("string")).alias("point_id"),
        F.when(n % 11 == 0, "old").otherwise(F.sha2("text", 256)).alias("file_hash"),
        F.when(n % 2 == 0, F.array("lang")).alias("tags"),
        F.when(n % 5 == 0, F.lit(None).cast("string")).otherwise("ctx").alias("context"),
        F.when(n % 13 == 0, "ollama").otherwise("bge-m3-onnx").alias("dense_provider"),
        F.lit("m").alias("dense_model"),
        F.lit("bge-m3-onnx").alias("sparse_provider"),
        F.lit(2).alias("embedding_schema_version"),
        (n % 7).alias("vector_size"),
    )


POINTS = f"""WITH points AS (SELECT md5(text) AS source_file, CAST(0 AS BIGINT) AS chunk_index, CASE WHEN doc_id % 3 = 0 THEN {uuid_sql("'main' || chr(0) || md5(text) || chr(0) || '0' || chr(0) || '2'")} ELSE CAST(doc_id AS VARCHAR) END AS point_id,
  CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(text) END AS file_hash, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS tag, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'ctx' END AS context, doc_id % 13 = 0 AS provider, doc_id % 7 AS size, doc_id % 3 = 0 AS expected FROM documents)"""


@query("duplicate_groups", f"{POINTS} SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, count(*) AS n, count(*) - 1 AS extra FROM points GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return S.duplicate_groups(points(spark, sf_dir))


@query("duplicate_classify", f"""{POINTS}, d AS (SELECT source_file, chunk_index, count(*) AS n, count(DISTINCT file_hash) AS h, count(DISTINCT provider) AS p, count(DISTINCT tag) AS t, count(DISTINCT context) AS c, count(DISTINCT size) AS z FROM points GROUP BY 1, 2 HAVING count(*) > 1)
  SELECT source_file, chunk_index, n, CASE WHEN h = 1 AND p = 1 AND t = 1 AND c = 1 AND z = 1 THEN 'exact-duplicate' WHEN h > 1 THEN 'different-file-hash' WHEN p > 1 THEN 'different-provider-or-schema' WHEN t > 1 AND c > 1 THEN 'different-tags-and-context'
  WHEN t > 1 THEN 'different-tags' WHEN c > 1 THEN 'different-context' ELSE 'partial-difference' END AS kind FROM d""")
def duplicate_classify(spark, sf_dir):
    return S.duplicate_classify(points(spark, sf_dir))


@query("cleanup_plan", f"""{POINTS}, p AS (SELECT *, count(*) OVER w AS n, bool_or(expected) OVER w AS has FROM points WINDOW w AS (PARTITION BY source_file, chunk_index))
  SELECT source_file, chunk_index, point_id, CASE WHEN n = 1 THEN 'keep' WHEN NOT has THEN 'reindex' WHEN expected THEN 'keep' ELSE 'orphan' END AS action FROM p""")
def cleanup_plan(spark, sf_dir):
    return S.cleanup_plan(points(spark, sf_dir), I.chunk_id(F.lit("main"), F.col("source_file"), F.col("chunk_index")))


@query("payload_consistency", "WITH f AS (SELECT lang || source AS one, min(doc_id) AS k FROM documents GROUP BY 1) SELECT (SELECT count(*) FROM documents) AS n, count(*) AS identities, count(*) <= 1 AS consistent, (SELECT k FROM f ORDER BY k LIMIT 1 OFFSET 1) AS first_other FROM f")
def payload_consistency(spark, sf_dir):
    return S.payload_consistency(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id")


@query("infer_legacy_profile", """SELECT p_partkey AS collection, CASE p_partkey % 8 WHEN 0 THEN 'no_payload' WHEN 1 THEN 'no_payload' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'ambiguous' WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'ambiguous' ELSE 'inferred' END AS status FROM part""")
def infer_legacy_profile(spark, sf_dir):
    """Collections of eight kinds: no content, no provider, points that disagree, an unknown pair, no dense schema, other
    dimensions, no sparse schema where one is named, and one that fits."""
    n = F.col("p_partkey") % 8
    when = lambda i, v, other: F.when(n == i, v).otherwise(other)
    c = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("collection"),
        when(0, 0, 5).alias("n"),
        when(2, False, True).alias("consistent"),
        when(1, F.lit(None).cast("string"), when(3, "ollama", "bge-m3-onnx")).alias("dense_provider"),
        F.lit("bge-m3-onnx").alias("sparse_provider"),
        F.lit(1024).alias("vector_size"),
        when(4, F.lit(None).cast("int"), when(5, 768, 1024)).alias("dense_dimensions"),
        when(6, False, True).alias("has_sparse"),
    )
    return c.select("collection", P.infer_legacy_profile().alias("status"))


AVAILABILITY = {
    ("available", "available"): "available", ("available", "none"): "available", ("not_cached", "none"): "download_required",
    ("model_cached", "none"): "runtime_unverified", ("missing_model", "none"): "missing_model", ("not_cached", "available"): "download_required",
    ("available", "model_cached"): "runtime_unverified", ("inference_unverified", "available"): "runtime_unverified", ("missing_model", "available"): "missing_model",
    ("available", "cloud_unreachable"): "missing_credentials", ("unsupported_backend", "missing_model"): "unsupported_backend", ("available", "unsupported_backend"): "unsupported_backend",
}


@query("availability", f"""SELECT p_partkey AS collection, {quoted(list(AVAILABILITY.values()))}[1 + p_partkey % {len(AVAILABILITY)}] AS status, p_partkey % {len(AVAILABILITY)} = 0 AS hybrid, p_partkey % {len(AVAILABILITY)} IN (0, 5, 6, 7) AS attemptable FROM part""")
def availability(spark, sf_dir):
    """Collections whose lanes have each of twelve pairs of states; what follows from each is stated."""
    at = (F.col("p_partkey") % len(AVAILABILITY) + 1).cast("int")
    lane = lambda i: F.element_at(F.array(*[F.lit(pair[i]) for pair in AVAILABILITY]), at)
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("collection"), lane(0).alias("dense"), F.nullif(lane(1), F.lit("none")).alias("sparse"))
    a = P.availability(F.col("dense"), F.col("sparse"))
    return c.select("collection", a.alias("a")).select("collection", "a.*")


@query("lane_status", f"""SELECT p_partkey AS lane, ['unsupported_backend', 'missing_model', 'cloud_unreachable', 'missing_credentials', 'inference_unverified', 'unsupported_backend', 'available', 'missing_model', 'model_cached', 'not_cached', 'available', 'unsupported_backend'][1 + p_partkey % 12] AS status FROM part""")
def lane_status(spark, sf_dir):
    """Lanes of twelve kinds by execution, provider, model and what a probe of it says."""
    kinds = [
        ("qdrant-cloud", "other", "m", "ok"), ("qdrant-cloud", "qdrant-cloud", "unknown", "ok"), ("qdrant-cloud", "qdrant-cloud", "m", "unreachable"), ("qdrant-cloud", "qdrant-cloud", "m", "auth_failed"),
        ("qdrant-cloud", "qdrant-cloud", "m", "ok"), ("edge", "ollama", "m", "available"), ("client", "ollama", "m", "available"), ("client", "ollama", "m", "unreachable"),
        ("client", "bge-m3-onnx", "m", "model_cached"), ("client", "bge-m3-onnx", "m", "not_cached"), ("client", "hashed-tf", None, None), ("client", "other", "m", "available"),
    ]
    at = (F.col("p_partkey") % 12 + 1).cast("int")
    of = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in kinds]), at)
    d = table(spark, sf_dir, "part")
    return d.select(F.col("p_partkey").alias("lane"), P.lane_status(of(0), of(1), of(2).isin("m"), of(3)).alias("status"))


OLD = "CASE WHEN doc_id % 10 = 1 THEN md5('old' || text) ELSE md5(text) END"


@query("manifest_diff", f"""WITH new AS (SELECT doc_id, md5(text) AS file_hash, 4 AS version FROM documents), old AS (SELECT doc_id, {OLD} AS file_hash, CASE WHEN doc_id % 15 = 0 THEN 3 ELSE 4 END AS version FROM documents WHERE doc_id % 20 <> 7)
  SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.file_hash IS DISTINCT FROM o.file_hash OR n.version IS DISTINCT FROM o.version THEN 'reindex' ELSE 'skip' END AS action,
  CASE WHEN o.doc_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN n.file_hash IS DISTINCT FROM o.file_hash THEN 'file_hash' END, CASE WHEN n.version IS DISTINCT FROM o.version THEN 'version' END) END AS reasons
  FROM new n LEFT JOIN old o ON n.doc_id = o.doc_id""")
def manifest_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    new = d.select("doc_id", F.md5("text").alias("file_hash"), F.lit(4).alias("version"))
    old = d.filter("doc_id % 20 != 7").select("doc_id", F.when(F.col("doc_id") % 10 == 1, F.md5(F.concat(F.lit("old"), "text"))).otherwise(F.md5("text")).alias("file_hash"), F.when(F.col("doc_id") % 15 == 0, 3).otherwise(4).alias("version"))
    return S.manifest_diff(new, old, ["file_hash", "version"], "doc_id")


@query("stale_files", "SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def stale_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return S.stale_files(d, d.filter("doc_id % 4 != 1"), "doc_id")


@query("backfill_tags_select", f"{CHUNKS} SELECT source_file, chunk_index FROM chunks WHERE trim(text) <> '' AND len(list_filter(tags, lambda t: t NOT IN ('en', 'src1'))) = 0")
def backfill_tags_select(spark, sf_dir):
    left = F.filter("tags", lambda t: ~t.isin("en", "src1"))
    return chunks(spark, sf_dir).filter((F.trim("text") != "") & (F.size(left) == 0)).select("source_file", "chunk_index")


@query("telemetry_summary", "SELECT event_type AS lane, CASE WHEN user_id % 2 = 0 THEN 'index' ELSE 'query' END AS phase, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY CUBE (1, 2)")
def telemetry_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("lane"), F.when(F.col("user_id") % 2 == 0, "index").otherwise("query").alias("phase"), F.length("props").alias("c"))
    return e.cube("lane", "phase").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


@query("profiler_phases", "SELECT user_id, event_id, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS us FROM events")
def profiler_phases(spark, sf_dir):
    return K.phase_times(table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), "user_id", "at", "event_id").select("user_id", "event_id", F.col("took").alias("us"))


@query("profiler_rate", "WITH r AS (SELECT user_id, max(epoch_us(ts)) - min(epoch_us(ts)) AS us, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n AS chunks, CASE WHEN us > 0 THEN round(n / (us / 1e6), 6) END AS per_second FROM r")
def profiler_rate(spark, sf_dir):
    return K.throughput(table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), "user_id", "at")


@query("reindex_chunks", f"{CHUNKS} SELECT source_file, section, chunk_index, row_number() OVER (PARTITION BY source_file, section ORDER BY chunk_index) - 1 AS new_index, count(*) OVER (PARTITION BY source_file, section) AS total FROM chunks")
def reindex_chunks(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("source_file", "section")
    return chunks(spark, sf_dir).select("source_file", "section", "chunk_index", (F.row_number().over(w.orderBy("chunk_index")) - 1).cast("bigint").alias("new_index"), F.count("*").over(w).alias("total"))


@query("empty_section", f"{CHUNKS} SELECT source_file, count(*) FILTER (WHERE chunk_index % 9 = 0) AS empty, count(*) FILTER (WHERE chunk_index % 9 <> 0) AS filled FROM chunks GROUP BY source_file")
def empty_section(spark, sf_dir):
    made = F.when(F.col("chunk_index") % 9 == 0, F.concat(F.lit("(empty section: "), "section", F.lit(")"))).otherwise(F.col("text"))
    is_empty = X.empty_section(made)
    return chunks(spark, sf_dir).groupBy("source_file").agg(F.count_if(is_empty).alias("empty"), F.count_if(~is_empty).alias("filled"))




STORED = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN upper(source) ELSE source END AS source, lang, CAST(length(text) AS BIGINT) AS size FROM documents
  UNION ALL SELECT doc_id + 1000000000, source, 'new', 0 FROM documents WHERE doc_id % 25 = 0)
SELECT doc_id, source, CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS lang, CASE WHEN lang = 'de' THEN -1 ELSE size END AS size FROM d WHERE NOT (lang = 'es' AND size > 2000)"""


def stored_documents(spark, sf_dir, tag):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").cast("bigint").alias("size"))
    return d, Q.Collection.create(d, Q.scratch_folder(spark, tag), "doc_id", bucket_rows=20_000)


@query("stored_changes", STORED)
def stored_changes(spark, sf_dir):
    """A stored collection after an upsert of changed and added rows, a payload set, a key taken out and a delete."""
    d, c = stored_documents(spark, sf_dir, "stored")
    changed = d.filter("doc_id % 100 = 7").withColumn("source", F.upper("source"))
    added = d.filter("doc_id % 25 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "source", F.lit("new").alias("lang"), F.lit(0).cast("bigint").alias("size"))
    c.upsert(changed.unionByName(added))
    c.delete((F.col("lang") == "es") & (F.col("size") > 2000))
    c.set_payload(F.col("lang") == "de", {"size": F.lit(-1).cast("bigint")})
    c.delete_payload_keys(F.col("lang") == "fr", ["lang"])
    return c.read()


@query("stored_version", "SELECT doc_id, source FROM documents")
def stored_version(spark, sf_dir):
    """Readers of an old version see none of what came after it."""
    d, c = stored_documents(spark, sf_dir, "version")
    c.delete(F.col("doc_id") % 3 == 0)
    return c.read(version=1).select("doc_id", "source")


@query("scroll_pages", "WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 250 AS page FROM documents WHERE lang = 'en') SELECT page, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM p GROUP BY page")
def scroll_pages(spark, sf_dir):
    """The pages of a filtered scan, and the key from which each is read on."""
    _, c = stored_documents(spark, sf_dir, "pages")
    p = c.page_numbers(250, F.col("lang") == "en")
    return p.groupBy("page").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("collection_source", "SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN 'again' ELSE source END AS source FROM documents WHERE doc_id >= 100 AND lang = 'en'")
def collection_source(spark, sf_dir):
    """Written and read as a data source; what is written again counts."""
    CS.register(spark)
    path = Q.scratch_folder(spark, "source")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    write = lambda rows: rows.write.format("collection").option("path", path).option("key", "doc_id").mode("append").save()
    write(d)
    Q.Collection(spark, path, bucket_rows=20_000).compact()
    write(d.filter("doc_id % 40 = 0").withColumn("source", F.lit("again")))
    return spark.read.format("collection").option("path", path).load().filter("doc_id >= 100 and lang = 'en'").select("doc_id", "source")
