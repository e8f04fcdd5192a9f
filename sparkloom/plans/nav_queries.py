"""Navigation nodes, summaries, answers, settings and projections."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as J
from ..operators import languages as L
from ..operators import retrieval as R
from ..operators import store as S
from ..operators import summaries as N
from ..plugins import SETTINGS, FirstSentence
from .chunk_queries import plain_markdown
from .fixtures import CHUNKS, chunks, table
from .registry import query


def counted(label: Column, lines: Column) -> Column:
    """A generator that tells what it was given."""
    return F.concat(label, F.lit(": "), F.size(lines).cast("string"), F.lit(" lines, "), F.element_at(lines, -1))


PAGES = """WITH f AS (SELECT doc_id, lang || '/doc-' || doc_id || '.md' AS source_file, 'document-' || doc_id AS d, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents),
nav AS (SELECT source_file, source_file || '#file' AS node_path, 'file' AS node_type, '' AS heading_path, 'Document ' || doc_id || ' — 3 sections' || CASE WHEN n > 0 THEN ', ' || n || ' paragraph' || CASE WHEN n = 1 THEN '' ELSE 's' END ELSE '' END || ', 1 table, 1 unknown, 1 code_block, 1 checklist' AS summary, 3 AS children FROM f
  UNION ALL SELECT source_file, source_file || '#' || d, 'section', 'Document ' || doc_id, 'Document ' || doc_id || ' — empty', 0 FROM f
  UNION ALL SELECT source_file, source_file || '#' || d || '/overview', 'section', 'Document ' || doc_id || ' › Overview', 'Overview — ' || CASE WHEN n > 0 THEN n || ' paragraph' || CASE WHEN n = 1 THEN '' ELSE 's' END || ', ' ELSE '' END || '1 table, 1 unknown, 1 code_block', n + 3 FROM f
  UNION ALL SELECT source_file, source_file || '#' || d || '/tasks', 'section', 'Document ' || doc_id || ' › Tasks', 'Tasks — 1 checklist', 1 FROM f)"""


@query("nav_points", f"{PAGES} SELECT source_file, node_path, node_type, heading_path, summary, CAST(children AS INTEGER) AS children FROM nav")
def nav_points(spark, sf_dir):
    n = N.nav_points(N.outline_nodes(plain_markdown(spark, sf_dir)))
    return n.withColumn("children", F.size("children"))


@query("nav_summaries", f"""{PAGES} SELECT source_file, node_path, summary AS inventory, CASE WHEN node_type = 'file' THEN 'the document "' || source_file || '": 3 lines, - Tasks: section "Tasks": 1 lines, tasks' WHEN node_path LIKE '%/tasks' THEN 'section "Tasks": 1 lines, tasks' ELSE summary END AS summary,
  CASE WHEN node_type = 'file' OR node_path LIKE '%/tasks' THEN 'generated' ELSE 'inventory' END AS summary_kind FROM nav""")
def nav_summaries(spark, sf_dir):
    """Only the last section of each page has a text."""
    nav = N.nav_points(N.outline_nodes(plain_markdown(spark, sf_dir)))
    texts = nav.filter("node_type = 'section'").select("source_file", "node_path", F.when(F.col("node_path").endswith("/tasks"), "tasks").otherwise(" ").alias("text"))
    return N.nav_summaries(nav, texts, counted).select("source_file", "node_path", "inventory", "summary", "summary_kind")


FOLDERS = """WITH f AS (SELECT source AS a, source || '/' || lang AS b, source || '/' || lang || '/doc-' || doc_id || '.md' AS file, doc_id FROM documents),
low AS (SELECT b AS path, a AS parent, count(*) AS n FROM f GROUP BY 1, 2), top AS (SELECT a AS path, count(DISTINCT b) AS n FROM f GROUP BY 1)"""


def doc_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), "doc_id", F.lit(".md")).alias("source_file"))


@query("directory_points", f"""{FOLDERS} SELECT path, 'main#dir/' || path AS node_path, parent, split_part(path, '/', 2) || ' — ' || n || CASE WHEN n = 1 THEN ' file' ELSE ' files' END || ', 0 directories' AS summary, n AS n_children FROM low
  UNION ALL SELECT path, 'main#dir/' || path, '', path || ' — 0 files, ' || n || CASE WHEN n = 1 THEN ' directory' ELSE ' directories' END, n FROM top""")
def directory_points(spark, sf_dir):
    d = N.directory_points(doc_files(spark, sf_dir), "main")
    return d.select("path", "node_path", "parent", "summary", F.size("children").cast("bigint").alias("n_children"))


@query("summary_rollup", f"""{FOLDERS}, l AS (SELECT low.path, parent, n, max(doc_id) AS only_id FROM low JOIN f ON f.b = low.path GROUP BY ALL),
  ll AS (SELECT path, parent, CASE WHEN n = 1 AND only_id % 2 = 0 THEN 'propagated' WHEN n >= 2 THEN 'rollup' ELSE 'inventory' END AS summary_kind FROM l), t AS (SELECT parent AS path, count(*) AS n, any_value(summary_kind) AS k FROM ll GROUP BY parent)
  SELECT path, summary_kind FROM ll UNION ALL SELECT path, CASE WHEN n >= 2 THEN 'rollup' WHEN k <> 'inventory' THEN 'propagated' ELSE 'inventory' END FROM t""")
def summary_rollup(spark, sf_dir):
    """Files of even documents have a summary of their own."""
    files = doc_files(spark, sf_dir)
    known = files.select(F.concat("source_file", F.lit("#file")).alias("node_path"), F.concat(F.lit("summary of "), "doc_id").alias("summary"), F.when(F.col("doc_id") % 2 == 0, "generated").otherwise("inventory").alias("summary_kind"))
    return N.summary_rollup(N.directory_points(files, "main"), known, counted).select("path", "summary_kind")


@query("collection_summary", "SELECT 'main' AS collection, 'collection main: ' || (4 + count(DISTINCT source) + count(*)) || ' lines, ' || max('- ' || source || '/' || lang || '/doc-' || doc_id || '.md: ' || lang) AS summary, 'collection_overview' AS summary_kind, count(*) AS n_files FROM documents")
def collection_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = doc_files(spark, sf_dir).join(d.select("doc_id", F.col("lang").alias("summary")), "doc_id").select("source_file", "summary")
    top = d.select(F.col("source").alias("name"), F.lit("top").alias("summary")).distinct()
    return N.collection_summary("main", files, top, counted)


@query("collection_inventory", "SELECT 'main' AS collection, 'main — ' || count(*) || ' files' AS summary, 'inventory' AS summary_kind, count(*) AS n_files FROM documents")
def collection_inventory(spark, sf_dir):
    return N.collection_summary("main", doc_files(spark, sf_dir).withColumn("summary", F.lit("x")))


@query("generated_first_sentence", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'About ' || lang || '.' END AS answer FROM documents")
def generated_first_sentence(spark, sf_dir):
    prompt = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Say it.\n\nAbout "), "lang", F.lit(". And more."))).otherwise("Say it.\n\n")
    return table(spark, sf_dir, "documents").select("doc_id", FirstSentence().generate(prompt).alias("answer"))


ARRAYS = [
    ('[["a", "b"], ["c"]]', 2, [["a", "b"], ["c"]]), ('```json\n[["a"], []]\n```', 2, [["a"], []]), ('{"x": ["a"], "y": ["b", "c"]}', 2, [["a"], ["b", "c"]]), ('Sure: ["a"] and then ["b]", "c"].', 2, [["a"], ["b]", "c"]]),
    ('{"x": [["a"], ["b"]], "n": 3}', 2, [["a"], ["b"]]), ('text [["a"], ["b"]] text [broken', 2, [["a"], ["b"]]), ('[["a"]]', 2, None), ("no array", 1, None), ('["a", "b"]', 1, [["a", "b"]]),
]


def cases(spark, sf_dir, rows, columns):
    """Every document has one of the stated answers, by its id."""
    at = (F.col("doc_id") % len(rows) + 1).cast("int")
    of = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in rows]), at)
    return table(spark, sf_dir, "documents").select("doc_id", *[of(i).alias(c) for i, c in enumerate(columns)])


def stated(values: list) -> str:
    return "SELECT doc_id, [" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][1 + doc_id % {len(values)}] AS value FROM documents"


@query("parse_arrays", stated([None if r[2] is None else "|".join(",".join(x) for x in r[2]) for r in ARRAYS]))
def parse_arrays(spark, sf_dir):
    d = J.parse_arrays(cases(spark, sf_dir, ARRAYS, ["raw", "expected"]), "doc_id")
    return d.select("doc_id", F.array_join(F.transform("items", lambda x: F.array_join(x, ",")), "|").alias("value"))


STRUCTURED = [
    ('```json\n{"summary": "A plain sentence that says enough.", "key_topics": [" one ", 2, "", "two"]}\n```', "A plain sentence that says enough.|one,two|"),
    ('json: {"summary": "Another plain sentence of this kind.", "notable_terms": ["t"]}', "Another plain sentence of this kind.||t"),
    ('{"summary": "Sure, here is the summary of it"}', None), ('{"summary": "short"}', None), ("{broken", None), ("[1]", None), ('{"key_topics": []}', None),
]


@query("parse_structured", stated([r[1] for r in STRUCTURED]))
def parse_structured(spark, sf_dir):
    d = J.parse_structured(cases(spark, sf_dir, STRUCTURED, ["raw"]), "doc_id")
    return d.select("doc_id", F.concat(F.col("summary"), F.lit("|"), F.array_join("key_topics", ","), F.lit("|"), F.array_join("notable_terms", ",")).alias("value"))


COMBINED = [
    ('{"context": " where it is ", "tags": ["One Two", "x", "one two"]}', "where it is|one-two"), ('[{"context": "c", "tags": []}, 3]', "c|"), ('{"context": "", "tags": []}', None), ('{"context": "c", "tags": "t"}', None), ("nothing", None),
]


@query("parse_combined", stated([r[1] for r in COMBINED]))
def parse_combined(spark, sf_dir):
    d = J.parse_combined(cases(spark, sf_dir, COMBINED, ["raw"]), "doc_id")
    return d.select("doc_id", F.concat("context", F.lit("|"), F.array_join("tags", ",")).alias("value"))


SETTING_CASES = [("RRF_K", "70", "70"), ("RRF_K", "0", "60"), ("RRF_K", "12abc", "12"), ("RRF_K", None, "60"), ("RERANK_BOOST_TEXT", "0.5x", "0.5"), ("RERANK_BOOST_TEXT", "-1", "0.01"), ("TAG_GEN", "true", "true"), ("TAG_GEN", "yes", "false"), ("SKELETON_SUMMARY", "llm", "llm"), ("SKELETON_SUMMARY", "x", "deterministic"), ("SUMMARY_LANG", "", "auto")]


@query("settings", stated([c[2] for c in SETTING_CASES]))
def settings(spark, sf_dir):
    d = cases(spark, sf_dir, SETTING_CASES, ["name", "raw"])
    out = F.lit(None).cast("string")
    for name in {c[0] for c in SETTING_CASES}:
        out = F.when(F.col("name") == name, SETTINGS[name].column(F.col("raw"))).otherwise(out)
    return d.select("doc_id", out.alias("value"))


@query("language_of")
def language_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", X.language_of(F.col("text")).alias("found"))


@query("language_forced", "SELECT doc_id, lang AS found FROM documents")
def language_forced(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.language_of(F.col("text"), F.upper("lang")).alias("found"))


@query("bucketed_batches", """WITH b AS (SELECT doc_id, lang, CASE WHEN t <= 16 THEN 0 WHEN t <= 32 THEN 1 WHEN t <= 64 THEN 2 WHEN t <= 128 THEN 3 WHEN t <= 256 THEN 4 ELSE 5 END AS bucket FROM (SELECT *, ceil(length(text) / 4.0) AS t FROM documents))
  SELECT doc_id, lang, CAST(bucket AS BIGINT) AS bucket, (row_number() OVER (PARTITION BY lang, bucket ORDER BY doc_id) - 1) // 8 AS batch, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM b""")
def bucketed_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", X.heuristic_tokens(F.col("text")).alias("t"))
    return R.bucketed_batches(d, ["lang"], "doc_id", F.col("t")).drop("t")


@query("to_chunk", f"""{CHUNKS} SELECT source_file, CASE WHEN chunk_index % 3 = 0 THEN NULL ELSE chunk_index END AS chunk_index, total_chunks, section, CASE WHEN chunk_index % 2 = 0 THEN '' ELSE lang || ',' || source END AS tags, CAST(NULL AS VARCHAR) AS node_id FROM chunks""")
def to_chunk(spark, sf_dir):
    """Points whose index is no whole number in a third, and without tags in half."""
    c = chunks(spark, sf_dir)
    p = c.select("source_file", F.when(F.col("chunk_index") % 3 == 0, F.concat("chunk_index", F.lit(".5"))).otherwise(F.col("chunk_index").cast("string")).alias("chunk_index"), "total_chunks", "section", F.when(F.col("chunk_index") % 2 == 1, F.col("tags")).alias("tags"))
    return S.to_chunk(p).select("source_file", "chunk_index", "total_chunks", "section", F.array_join("tags", ",").alias("tags"), "node_id")


@query("search_result_window", f"""{CHUNKS}, h AS (SELECT source_file, chunk_index, text FROM chunks WHERE chunk_index % 6 = 2), w AS (SELECT h.source_file, h.chunk_index AS hit, string_agg(c.chunk_index || CASE WHEN c.chunk_index = h.chunk_index THEN '*' ELSE '' END || CASE WHEN length(c.text) > 150 THEN left(c.text, 150) || '...' ELSE c.text END, '|' ORDER BY c.chunk_index) AS shown
  FROM h JOIN chunks c ON c.source_file = h.source_file AND abs(c.chunk_index - h.chunk_index) <= 1 GROUP BY 1, 2) SELECT source_file, hit, shown FROM w""")
def search_result_window(spark, sf_dir):
    """Every sixth chunk as a hit, with its neighbours."""
    c = chunks(spark, sf_dir)
    hits = c.filter("chunk_index % 6 = 2").withColumns({"qid": F.col("source_file"), "rank": F.col("chunk_index"), "score": F.lit(1.0), "node_id": F.lit(None).cast("string")})
    around = R.expand_window(hits.select("qid", "rank", "source_file", "chunk_index"), c, 1).join(c.select("source_file", "chunk_index", "section"), ["source_file", "chunk_index"])
    out = S.search_results(hits, around, "compact", X.compact_snippet(F.col("text")))
    shown = F.transform("window_chunks", lambda x: F.concat(x["chunk_index"].cast("string"), F.when(x["is_match"], "*").otherwise(""), x["text_snippet"]))
    return out.select(F.col("result.source_file").alias("source_file"), F.col("result.chunk_index").alias("hit"), F.array_join(shown, "|").alias("shown"))


@query("list_profiles", """SELECT coalesce(d.source, p.c) AS collection, coalesce(n, 0) AS points, CASE WHEN v THEN 'bge-m3-onnx' END AS dense_provider, CASE WHEN v THEN 'bge-m3-onnx' END AS sparse_provider, CASE WHEN v THEN 'valid' WHEN v IS NULL THEN 'missing' ELSE 'invalid' END AS profile_state
  FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) d FULL JOIN (SELECT * FROM (VALUES ('src1', true), ('src2', false), ('empty', true)) AS t(c, v)) p ON p.c = d.source""")
def list_profiles(spark, sf_dir):
    profiles = spark.createDataFrame([("src1", "bge-m3-onnx", "bge-m3-onnx", True), ("src2", "x", None, False), ("empty", "bge-m3-onnx", "bge-m3-onnx", True)], "collection string, dense_provider string, sparse_provider string, valid boolean")
    return S.list_collections(table(spark, sf_dir, "documents").select(F.col("source").alias("collection")), profiles)


@query("backfill_refs_plan", f"""{CHUNKS} SELECT source_file || '#' || chunk_index AS point_id, CASE WHEN chunk_index % 5 = 0 AND chunk_index % 2 = 0 THEN 'unchanged' WHEN chunk_index % 5 = 0 THEN 'set' WHEN chunk_index % 4 = 0 THEN 'clear' ELSE 'unchanged' END AS action FROM chunks""")
def backfill_refs_plan(spark, sf_dir):
    """Placeholders of every fifth chunk are resolved anew; half of those have it stored, and others have what is gone."""
    from ..operators import chunking as C

    c = chunks(spark, sf_dir).withColumn("point_id", F.concat("source_file", F.lit("#"), "chunk_index"))
    has = F.col("chunk_index") % 5 == 0
    marked = c.withColumn("text", F.when(has, F.concat(F.lit("prose\n[table node: "), "section", F.lit("]"))).otherwise("prose"))
    entities = c.select("source_file", "section", F.col("section").alias("node_path"), F.concat("section", F.lit("#id")).alias("node_id")).distinct()
    refs = C.attach_entity_refs(marked, entities).filter("node_id is not null").groupBy("source_file", "chunk_index").agg(F.array_sort(F.collect_list("node_id")).alias("refs"))
    now = refs.select(F.concat("source_file", F.lit("#"), "chunk_index").alias("point_id"), "refs")
    stored = F.when(has & (F.col("chunk_index") % 2 == 0), F.array(F.concat("section", F.lit("#id")))).when(~has & (F.col("chunk_index") % 4 == 0), F.array(F.lit("gone")))
    return S.backfill_refs_plan(c.select("point_id", stored.alias("refs")), now)


@query("collated_order", "WITH n AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS name FROM documents) SELECT name, row_number() OVER (ORDER BY lower(name), name DESC) AS place FROM n")
def collated_order(spark, sf_dir):
    """The names of sources in both cases, as people sort them; a row a name."""
    d = table(spark, sf_dir, "documents")
    names = d.select(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(*S.collated("name"))).cast("bigint").alias("place"))


@query("sorted_tags", f"""{CHUNKS}, t AS (SELECT unnest(tags) AS tag FROM chunks) SELECT tag, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tag) AS place FROM t GROUP BY tag""")
def sorted_tags(spark, sf_dir):
    """Tags by number, then in collated order; a row per tag."""
    t = chunks(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), *S.collated("tag"))).cast("bigint"))


GRAMS = r"""WITH d AS (SELECT doc_id, lang, length(text) AS size, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) || ' ' AS t FROM documents),
  c AS (SELECT doc_id, lang, size, string_split(t, '') AS c FROM d WHERE t <> '  '),
  u AS (SELECT doc_id, lang, size, unnest(c) AS a, unnest(list_append(c[2:], '')) AS b, unnest(list_concat(c[3:], ['', ''])) AS e FROM c),
  g AS MATERIALIZED (SELECT doc_id, any_value(lang) AS lang, any_value(size) AS size, gram, count(*) AS n FROM (
      SELECT doc_id, lang, size, a AS gram FROM u UNION ALL SELECT doc_id, lang, size, a || b FROM u WHERE b <> '' UNION ALL SELECT doc_id, lang, size, a || b || e FROM u WHERE e <> '') WHERE gram <> ' ' GROUP BY doc_id, gram),
  p AS (SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) AS rank FROM g WHERE lang IS NOT NULL GROUP BY lang, gram QUALIFY rank <= 300)"""


@query("language_profiles", f"{GRAMS} SELECT lang, rank, gram, n FROM p")
def language_profiles(spark, sf_dir):
    return L.language_profiles(table(spark, sf_dir, "documents"))


@query(
    "language_by_profile",
    f"""{GRAMS}, m AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS r FROM g WHERE size >= 100 QUALIFY r <= 300),
  far AS (SELECT doc_id, l.lang, CAST(sum(CASE WHEN p.rank IS NULL THEN 300 ELSE abs(p.rank - m.r) END) AS BIGINT) AS distance
    FROM m CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.gram = m.gram GROUP BY doc_id, l.lang),
  b AS (SELECT doc_id, lang AS found, distance FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1)
  SELECT documents.doc_id, found, distance FROM documents LEFT JOIN b ON b.doc_id = documents.doc_id""",
)
def language_by_profile(spark, sf_dir):
    """Every document under the profiles of all of them."""
    d = table(spark, sf_dir, "documents")
    return L.language_by_profile(d, L.language_profiles(d), "doc_id")
