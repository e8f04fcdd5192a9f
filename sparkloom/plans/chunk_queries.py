"""Structure, chunking, assembly and history queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assembly as A
from ..operators import chunking as C
from ..operators import documents as D
from ..operators import skeleton_chunks as K
from ..sources.files import strip_html
from .fixtures import CHUNKS, MARKDOWN, chunks, markdown, table
from .registry import query


def plain_markdown(spark, sf_dir, without=""):
    """Pages whose lines of text are paragraphs, whatever they hold: each begins with a word and stands alone."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.translate("text", without, ""))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("w "), F.trim(F.regexp_replace(x, r"\s+", " "))))
    head = F.array(F.concat(F.lit("# Document "), "doc_id"), F.lit("## Overview"))
    tail = F.array(
        F.concat(F.lit("| lang | source |\n| --- | --- |\n| "), "lang", F.lit(" | "), "source", F.lit(" |")),
        F.lit("<aside>note</aside>"),
        F.concat(F.lit("```py\n# no heading\nprint("), "doc_id", F.lit(")\n```")),
        F.lit("## Tasks"),
        F.lit("- [x] read\n- [ ] check"),
    )
    return d.select(F.concat("lang", F.lit("/doc-"), "doc_id", F.lit(".md")).alias("source_file"), F.array_join(F.concat(head, lines, tail), "\n\n").alias("markdown"))


PLAIN = """WITH l AS (SELECT doc_id, lang, source, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: 'w ' || trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS ls FROM documents),
f AS (SELECT *, lang || '/doc-' || doc_id || '.md' AS source_file, 'document-' || doc_id || '/overview' AS o, len(ls) AS n FROM l),
nodes AS (SELECT source_file, 'paragraph' AS node_type, o AS structural_path, i AS ordinal, 3 + 2 * i AS start_line, i - 1 AS node_order, ls[i] AS text FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f)
  UNION ALL SELECT source_file, 'table', o, 1, 5 + 2 * n, n, '| lang | source |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | ' || source || ' |' FROM f
  UNION ALL SELECT source_file, 'unknown', o, 1, 9 + 2 * n, n + 1, '<aside>note</aside>' FROM f
  UNION ALL SELECT source_file, 'code_block', o, 1, 11 + 2 * n, n + 2, '```py' || chr(10) || '# no heading' || chr(10) || 'print(' || doc_id || ')' || chr(10) || '```' FROM f
  UNION ALL SELECT source_file, 'checklist', 'document-' || doc_id || '/tasks', 1, 18 + 2 * n, n + 3, '- [x] read' || chr(10) || '- [ ] check' FROM f)"""


@query("md_skeleton", f"{PLAIN} SELECT source_file, node_type, structural_path, CAST(ordinal AS INTEGER) AS ordinal, CAST(start_line AS INTEGER) AS start_line, CAST(node_order AS INTEGER) AS node_order, text FROM nodes")
def md_skeleton(spark, sf_dir):
    """Every node of every page."""
    return C.md_skeleton(plain_markdown(spark, sf_dir)).select("source_file", "node_type", "structural_path", "ordinal", "start_line", "node_order", "text")


@query("read_markdown")
def read_markdown(spark, sf_dir):
    return C.md_skeleton(markdown(spark, sf_dir))


@query("skeleton_warnings", "SELECT lang || '/doc-' || doc_id || '.md' AS source_file, 'html' AS source_type, 'unknown' AS node_type, CAST(9 + 2 * len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INTEGER) AS start_line, '<aside>note</aside>' AS excerpt FROM documents")
def skeleton_warnings(spark, sf_dir):
    return C.skeleton_warnings(plain_markdown(spark, sf_dir)).select("source_file", "source_type", "node_type", "start_line", "excerpt")


#: Prose and entities of plain pages: what says less than four words goes, all else is in a chunk.
WORDS = "len(regexp_split_to_array(trim({0}), '\\s+'))"


@query("skeleton_chunk", "SELECT lang || '/doc-' || doc_id || '.md' AS source_file, 0 AS above_budget, 0 AS orphans, 1 AS tables, 1 AS checklists, 0 AS lost_prose, 0 AS gaps FROM documents")
def skeleton_chunk(spark, sf_dir):
    """What must hold of every page's chunks: nothing above the budget, a placeholder for each entity, one table and one
    checklist, no prose lost but pieces of under four words, and indexes without gaps."""
    # a piece that begins with ### reads as a heading, which says nothing by the rule
    pages = plain_markdown(spark, sf_dir, without="#")
    c = K.skeleton_chunks(pages, 128)
    marks = r"\[(?:table|checklist) node: [^\n]*\]"
    said = lambda x: F.regexp_count(x, F.lit(r"\S*[\p{L}\p{N}]\S*"))
    prose = F.when(F.col("node_type") == "paragraph", F.regexp_replace(F.regexp_replace("text", marks, ""), r"`# no heading print\(\d+\)`|<aside>note</aside>", "")).otherwise("")
    whole = c.groupBy("source_file").agg(
        F.count_if((F.col("point_kind") == "retrieval_content") & (F.col("node_type") != "paragraph") & (X.heuristic_tokens(F.col("text")) > 128)).alias("above_budget"),
        F.sum(F.size(F.regexp_extract_all("text", F.lit(marks), 0)) * (F.col("node_type") == "paragraph").cast("int")).alias("marks"),
        F.count_if((F.col("node_type") == "table") & (F.coalesce("fragment_index", F.lit(0)) == 0) & F.col("chunk_index").isNotNull()).alias("tables"),
        F.count_if((F.col("node_type") == "checklist") & F.col("chunk_index").isNotNull()).alias("checklists"),
        F.sum(said(prose)).alias("kept"),
        (F.max("total_chunks") - F.countDistinct("chunk_index")).alias("gaps"),
    )
    lines = F.filter(F.split("markdown", "\n\n"), lambda x: x.startswith("w "))
    # of a page's pieces, two for every 128 tokens at most, one that says under four words goes
    may_go = 3 * (F.floor(X.heuristic_tokens(F.col("markdown")) / 64) + 2)
    before = pages.select("source_file", said(F.array_join(lines, " ")).alias("prose"), may_go.alias("may_go"))
    d = whole.join(before, "source_file")
    return d.select("source_file", "above_budget", F.when(F.col("marks") >= 1, 0).otherwise(1).alias("orphans"), "tables", "checklists", F.when(F.col("prose") - F.col("kept") <= F.col("may_go"), 0).otherwise(1).alias("lost_prose"), "gaps")


@query("node_policy", f"""{PLAIN} SELECT node_type, CASE node_type WHEN 'paragraph' THEN 'chunk_text' WHEN 'unknown' THEN 'chunk_text' WHEN 'code_block' THEN 'merge_with_parent' ELSE 'payload_raw_embed_context' END AS policy, CASE WHEN node_type <> 'code_block' THEN 'retrieval_content' END AS point_kind, count(*) AS n FROM nodes GROUP BY node_type""")
def node_policy(spark, sf_dir):
    """Code blocks are tiny here."""
    return C.node_policy(C.md_skeleton(plain_markdown(spark, sf_dir))).groupBy("node_type", "policy", "point_kind").agg(F.count("*").alias("n"))


@query("tiny_code", "SELECT doc_id, NOT ((len(list_filter(string_split(code, chr(10)), lambda x: trim(x) <> '')) >= 2 AND len(list_filter(regexp_split_to_array(trim(code), '\\s+'), lambda x: x <> '')) >= 12) OR len(list_filter(regexp_split_to_array(trim(code), '\\s+'), lambda x: x <> '')) >= 16) AS tiny FROM (SELECT doc_id, text AS code FROM documents)")
def tiny_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.tiny_code(F.lit("code_block"), F.col("text")).alias("tiny"))


@query("tiny_code_whole", "SELECT doc_id, NOT ((len(list_filter(string_split(code, chr(10)), lambda x: trim(x) <> '')) >= 2 AND len(list_filter(regexp_split_to_array(trim(code), '\\s+'), lambda x: x <> '')) >= 12) OR len(list_filter(regexp_split_to_array(trim(code), '\\s+'), lambda x: x <> '')) >= 16) AS tiny FROM (SELECT doc_id, text AS code FROM documents)")
def tiny_code_whole(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.tiny_code(F.lit("code_block"), F.col("text")).alias("tiny"))


@query("content_bearing", f"{CHUNKS} SELECT source_file, chunk_index, coalesce(point_kind, '') = 'retrieval_content' AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) >= 4 AS content FROM chunks")
def content_bearing(spark, sf_dir):
    c = C.content_bearing(F.coalesce("point_kind", F.lit("")), F.lit("paragraph"), F.col("text"))
    return chunks(spark, sf_dir).select("source_file", "chunk_index", c.alias("content"))


#: Pages with headings of both kinds around the text's own lines, neutral ones.
SECTION_LINES = """WITH l AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: 'w ' || trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS ls FROM documents)
SELECT doc_id AS source_file, unnest(['', 'First part', 'Second']) AS section, unnest([CAST(2 AS BIGINT), len(ls) + 3, 1]) AS n_lines FROM l"""


@query("legacy_sections", SECTION_LINES)
def legacy_sections(spark, sf_dir):
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("w "), F.trim(F.regexp_replace(x, r"\s+", " "))))
    page = F.concat(F.array(F.lit("intro"), F.lit("# Ends like a sentence."), F.lit("**First part**"), F.lit("=====")), lines, F.array(F.lit("# Also one!"), F.lit("Nor this."), F.lit("---"), F.lit("## Second"), F.lit("end")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), F.array_join(page, "\n").alias("markdown"))
    return C.legacy_sections(d)


def split_query(name, splitter):
    @query(name)
    def run(spark, sf_dir):
        return C.chunk_texts(table(spark, sf_dir, "documents"), "doc_id", "text", splitter)


split_query("recursive_split", C.recursive_split)
split_query("budget_variants", lambda t: C.recursive_split(t, 128, strict=True))
split_query("sentence_pack", lambda t: C.sentence_pack(t, 128))
split_query("merge_short", lambda t: C.merge_short(C.recursive_split(t, 64), 48))


def whole(pieces, squeeze=True):
    """(doc_id, text, above, gaps): the pieces of each document put together again, how many are above 128 heuristic
    tokens, and whether their numbers have gaps."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "")
    g = pieces.groupBy("doc_id").agg(parts.alias("all"), F.count_if(X.heuristic_tokens(F.col("text")) > 128).alias("above"), (F.max("total_chunks") - F.countDistinct("chunk_index")).alias("gaps"))
    return g.select("doc_id", F.md5(F.regexp_replace("all", r"\s+", "") if squeeze else F.col("all")).alias("text"), "above", "gaps")


#: No character but white space is lost, nothing is above the budget, the numbering has no gap.
KEPT = "SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS text, 0 AS above, 0 AS gaps FROM documents WHERE trim(text) <> ''"


@query("budget_kept", KEPT)
def budget_kept(spark, sf_dir):
    return whole(C.chunk_texts(table(spark, sf_dir, "documents"), "doc_id", "text", lambda t: C.recursive_split(t, 128, strict=True)))


@query("recursive_kept", KEPT.replace("0 AS above, ", ""))
def recursive_kept(spark, sf_dir):
    return whole(C.chunk_texts(table(spark, sf_dir, "documents"), "doc_id", "text", lambda t: C.recursive_split(t, 128))).drop("above")


@query("merge_short_kept", "SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS text, 0 AS gaps FROM documents WHERE trim(text) <> ''")
def merge_short_kept(spark, sf_dir):
    return whole(C.chunk_texts(table(spark, sf_dir, "documents"), "doc_id", "text", lambda t: C.merge_short(C.recursive_split(t, 64), 48))).drop("above")


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents"


@query("greedy_group", f"""WITH RECURSIVE l AS ({LINES}), g AS (SELECT doc_id, i, 0 AS chunk_index, length(line) AS used FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, g.chunk_index + CASE WHEN ceil((g.used + 1 + length(l.line)) / 4.0) > 256 THEN 1 ELSE 0 END, CASE WHEN ceil((g.used + 1 + length(l.line)) / 4.0) > 256 THEN length(l.line) ELSE g.used + 1 + length(l.line) END FROM g JOIN l ON l.doc_id = g.doc_id AND l.i = g.i + 1)
  SELECT g.doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, string_agg(line, chr(10) ORDER BY g.i) AS text FROM g JOIN l ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY 1, 2""")
def greedy_group(spark, sf_dir):
    out = C.chunk_texts(table(spark, sf_dir, "documents"), "doc_id", "text", lambda t: ["\n".join(g) for g in C.greedy_group(t.split("\n"), 256)])
    return out.select("doc_id", "chunk_index", "text")


@query("char_split", "SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 512.0) AS BIGINT))) AS chunk_index, CAST(ceil(length(text) / 512.0) AS BIGINT) AS total_chunks, substr(text, 1 + 512 * unnest(range(0, CAST(ceil(length(text) / 512.0) AS BIGINT))), 512) AS text FROM documents")
def char_split(spark, sf_dir):
    return C.chunk_texts(table(spark, sf_dir, "documents"), "doc_id", "text", lambda t: C.char_split(t, 128))


def as_table(spark, sf_dir):
    rows = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("| "), F.replace(x, F.lit("|"), F.lit("/")), F.lit(" |"))), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("| text |\n| --- |\n"), rows).alias("t"))


@query("table_split")
def table_split(spark, sf_dir):
    return C.chunk_texts(as_table(spark, sf_dir), "doc_id", "t", lambda t: C.split_table(t, 256))


@query("table_kept", "SELECT doc_id, md5(regexp_replace(replace(text, '|', '/'), '\\s+', '', 'g')) AS text, 0 AS above FROM documents")
def table_kept(spark, sf_dir):
    """Fragments without header, bars and labels are the cells again, and none is above the budget."""
    pieces = C.chunk_texts(as_table(spark, sf_dir), "doc_id", "t", lambda t: C.split_table(t, 256))
    cells = F.regexp_replace(F.regexp_replace("text", r"^\| text \|\n\| --- \|\n", ""), r"(?m)^\| | \(text continued\) \|$| \|$|^\|$", "")
    above = pieces.groupBy("doc_id").agg(F.count_if(X.heuristic_tokens(F.col("text")) > 256).alias("above"))
    return whole(pieces.withColumn("text", cells)).drop("above", "gaps").join(above, "doc_id")


@query("checklist_split")
def checklist_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("- [ ] "), x)), "\n").alias("t"))
    return C.chunk_texts(d, "doc_id", "t", lambda t: C.split_checklist(t, 256))


def as_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("```py\n"), "text", F.lit("\n```")).alias("t"))


@query("code_split")
def code_split(spark, sf_dir):
    return C.chunk_texts(as_code(spark, sf_dir), "doc_id", "t", lambda t: C.split_code(t, 256))


@query("code_kept", "SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS text, 0 AS above FROM documents")
def code_kept(spark, sf_dir):
    pieces = C.chunk_texts(as_code(spark, sf_dir), "doc_id", "t", lambda t: C.split_code(t, 256))
    above = pieces.groupBy("doc_id").agg(F.count_if(X.heuristic_tokens(F.col("text")) > 256).alias("above"))
    return whole(pieces.withColumn("text", F.regexp_replace("text", r"^```py\n|\n```$", ""))).drop("above", "gaps").join(above, "doc_id")


@query("overlap_sentences", f"""{CHUNKS}, p AS (SELECT source_file, chunk_index, text, lag(text) OVER (PARTITION BY source_file, section ORDER BY chunk_index) AS prev FROM chunks),
  s AS (SELECT *, list_filter(list_transform(regexp_extract_all(prev, '[^.!?\\n]+[.!?\\n]+|[^.!?\\n]+$'), lambda x: trim(x)), lambda x: x <> '') AS ss FROM p), t AS (SELECT *, CASE WHEN prev IS NULL THEN '' WHEN len(ss) = 0 THEN trim(prev) ELSE array_to_string(ss[greatest(1, len(ss) - 1):], ' ') END AS tail FROM s)
  SELECT source_file, chunk_index, CASE WHEN tail = '' OR starts_with(text, tail) THEN '' ELSE tail END AS overlap FROM t""")
def overlap_sentences(spark, sf_dir):
    return C.overlap_sentences(chunks(spark, sf_dir), ["source_file", "section"], "chunk_index").select("source_file", "chunk_index", "overlap")


@query("overlap", f"""{CHUNKS}, p AS (SELECT source_file, chunk_index, text, coalesce(lag(text) OVER (PARTITION BY source_file, section ORDER BY chunk_index), '') AS prev, 4 * least(80, greatest(0, 512 - CAST(ceil(length(text) / 4.0) AS BIGINT))) AS room FROM chunks),
  t AS (SELECT *, CASE WHEN room = 0 THEN '' ELSE right(prev, room) END AS tail FROM p) SELECT source_file, chunk_index, CASE WHEN tail = '' OR starts_with(text, tail) THEN '' ELSE tail END AS overlap FROM t""")
def overlap(spark, sf_dir):
    return C.overlap_previous(chunks(spark, sf_dir), ["source_file", "section"], "chunk_index").select("source_file", "chunk_index", "overlap")


@query("entity_refs", f"""{CHUNKS} SELECT source_file, section, chunk_index, '[table node: ' || section || '/t — ' || lang || ']' AS line, section || '#long' AS node_id FROM chunks WHERE chunk_index % 5 = 0
  UNION ALL SELECT source_file, section, chunk_index, '[checklist node: gone]', NULL FROM chunks WHERE chunk_index % 5 = 1""")
def entity_refs(spark, sf_dir):
    """The longest of three paths that begin the line, one of which is a fragment's; and orphans."""
    c = chunks(spark, sf_dir)
    mark = F.when(F.col("chunk_index") % 5 == 0, F.concat(F.lit("prose\n[table node: "), "section", F.lit("/t — "), "lang", F.lit("]"))).when(F.col("chunk_index") % 5 == 1, "[checklist node: gone]\nprose").otherwise("prose")
    s = c.select("source_file", "section").distinct()
    entity = lambda path, node, whole: s.select("source_file", "section", F.concat("section", F.lit(path)).alias("node_path"), F.concat("section", F.lit(node)).alias("node_id"), F.lit(whole).cast("string").alias("entity_id"))
    return C.attach_entity_refs(c.withColumn("text", mark), entity("/t", "#long", None).unionByName(entity("", "#short", None)).unionByName(entity("/t — ", "#part", "whole")))


@query("read_pandoc")
def read_pandoc(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


HITS = f"{CHUNKS}, hits AS (SELECT doc_id % 40 AS qid, source_file, section, chunk_index, text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source_file || '#' || chunk_index END AS node_id, CASE WHEN doc_id % 3 = 1 THEN source_file || '/' || section END AS parent_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY length(text) DESC, source_file, chunk_index) AS rank FROM chunks)"
EVIDENCE = f"""{HITS}, keyed AS (SELECT *, CASE WHEN node_id IS NOT NULL THEN 'node-scope:' || coalesce(parent_id, node_id) ELSE 'legacy:' || source_file || '::' || section END AS key FROM hits WHERE rank <= 30),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY rank) AS i FROM keyed), evidence AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n, key, source_file, section, left(text, 2800) AS text FROM firsts WHERE i = 1)"""


def hits(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("qid", F.col("doc_id") % 40)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.length("text")), "source_file", "chunk_index"))
    node = F.when(F.col("doc_id") % 3 != 0, F.concat("source_file", F.lit("#"), "chunk_index"))
    parent = F.when(F.col("doc_id") % 3 == 1, F.concat("source_file", F.lit("/"), "section"))
    return c.withColumns({"rank": rank, "node_id": node, "parent_id": parent}).filter("rank <= 30")


@query("build_evidence", f"{EVIDENCE} SELECT * FROM evidence")
def build_evidence(spark, sf_dir):
    return A.build_evidence(hits(spark, sf_dir))


BLOCK = "'[' || n || '] (' || source_file || ' § ' || section || ')' || chr(10) || text"


SYSTEM, STRUCTURAL_RULE = "Answer from the numbered sources only.", " Quote a node by its mark."


@query("fit_context", f"""{EVIDENCE}, e AS (SELECT *, key LIKE 'node-scope:%' AS structural FROM evidence), u AS (SELECT qid, n, CAST(ceil(({len(SYSTEM)} + CASE WHEN bool_or(structural) OVER w THEN {len(STRUCTURAL_RULE)} ELSE 0 END + sum(length({BLOCK})) OVER w + 2 * (n - 1)) / 4.0) AS BIGINT) AS used FROM e WINDOW w AS (PARTITION BY qid ORDER BY n))
  SELECT qid, n, used FROM u WHERE used <= 4096 - 1024""")
def fit_context(spark, sf_dir):
    e = A.build_evidence(hits(spark, sf_dir)).withColumn("node_id", F.when(F.col("key").startswith("node-scope:"), F.col("key")))
    return A.fit_context(e, 4096, system=SYSTEM, structural_rule=STRUCTURAL_RULE).select("qid", "n", "used")


@query("prompt_blocks", f"{EVIDENCE} SELECT qid, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY n) AS prompt FROM evidence GROUP BY qid")
def prompt_blocks(spark, sf_dir):
    return A.prompts(A.build_evidence(hits(spark, sf_dir)))


@query("node_blocks", f"""{EVIDENCE} SELECT qid, n, '[' || n || '] (' || source_file || ' § ' || section || CASE WHEN n % 2 = 0 THEN ' [node: ' || source_file || '#p-' || n || ']' ELSE '' END || ')' || chr(10) || text AS block FROM evidence""")
def node_blocks(spark, sf_dir):
    e = A.build_evidence(hits(spark, sf_dir)).withColumn("node_path", F.when(F.col("n") % 2 == 0, F.concat("source_file", F.lit("#p-"), "n")))
    return e.select("qid", "n", A.node_block().alias("block"))


@query("history_block", "SELECT conv_id, string_agg(role || ': ' || regexp_replace(text, '[\\n\\r\u2028\u2029]+', ' ', 'g'), chr(10) ORDER BY turn) AS history FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def history_block(spark, sf_dir):
    return A.history_block(table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant")))


@query("citations", """WITH a AS (SELECT doc_id, 'See [1] and [' || (doc_id % 7) || '], also [3] and [1].' AS answer FROM documents), c AS (SELECT doc_id, unnest(['1', CAST(doc_id % 7 AS VARCHAR), '3', '1']) AS x, unnest([1, 2, 3, 4]) AS pos FROM a),
  f AS (SELECT doc_id, CAST(x AS INTEGER) AS x, min(pos) AS pos FROM c WHERE doc_id % 5 <> 0 GROUP BY 1, 2)
  SELECT d.doc_id, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE x BETWEEN 1 AND 4), '') AS valid, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE NOT x BETWEEN 1 AND 4), '') AS invalid, d.doc_id % 5 = 0 AS refused FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def citations(spark, sf_dir):
    """Every fifth answer is a refusal."""
    answer = F.concat(F.lit("See [1] and ["), F.col("doc_id") % 7, F.lit("], also [3] and [1]."))
    answer = F.when(F.col("doc_id") % 5 == 0, f" {A.REFUSAL}\n").otherwise(answer)
    c = table(spark, sf_dir, "documents").select("doc_id", A.citations(answer, F.array(*[F.lit(i) for i in range(1, 5)])).alias("c"))
    return c.select("doc_id", F.array_join("c.valid", ",").alias("valid"), F.array_join("c.invalid", ",").alias("invalid"), "c.refused")


@query("history_budget", """WITH w AS (SELECT conv_id, turn, count(*) OVER v AS m, sum(length(text)) OVER v AS c, sum(ceil(length(text) / 4.0)) OVER v AS t FROM conversations WHERE role IN ('user', 'assistant')
  WINDOW v AS (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT conv_id, turn FROM w WHERE m <= 4 AND c <= 1200 AND t <= 200""")
def history_budget(spark, sf_dir):
    return A.history_budget(table(spark, sf_dir, "conversations"), 4, 1200, 200)


@query("history_with_summary", """WITH s AS (SELECT conv_id, repeat('word ', CAST(conv_id % 90 AS INTEGER) * 10) AS summary FROM conversations GROUP BY conv_id), n AS (SELECT conv_id, summary, CAST(ceil(length(summary) / 4.0) AS BIGINT) AS need FROM s),
  w AS (SELECT c.conv_id, turn, need, summary, count(*) OVER v AS m, sum(length(text)) OVER v AS k, sum(ceil(length(text) / 4.0)) OVER v AS t FROM conversations c JOIN n ON n.conv_id = c.conv_id WHERE role IN ('user', 'assistant') WINDOW v AS (PARTITION BY c.conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
  SELECT conv_id, turn, length(summary) AS summary_chars FROM w WHERE m <= 20 AND k <= 12000 AND t <= CASE WHEN need > 400 THEN 0 ELSE 400 - need END""")
def history_with_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s = c.select("conv_id").distinct().withColumn("summary", F.expr("repeat('word ', CAST(conv_id % 90 AS INT) * 10)"))
    return A.history_with_summary(c, s, tokens=400).select("conv_id", "turn", F.length("kept_summary").cast("bigint").alias("summary_chars"))


@query("compaction_fit", """WITH t AS (SELECT conv_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(role) + 2 + length(text)) OVER w + row_number() OVER w - 1 AS chars FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, any_value(n) AS n, coalesce(max(CASE WHEN n + 2 >= 4 AND i <= n - 1 AND ceil(chars / 4.0) <= 90 THEN i END), 0) AS compact FROM t GROUP BY conv_id""")
def compaction_fit(spark, sf_dir):
    return A.compaction_fit(table(spark, sf_dir, "conversations"), 90, at=4, retain=1)


@query("compaction_plan", "SELECT conv_id, count(*) AS n, CAST(CASE WHEN count(*) + 2 >= 8 THEN greatest(count(*) - 4, 0) ELSE 0 END AS BIGINT) AS compact FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def compaction_plan(spark, sf_dir):
    return A.compaction_plan(table(spark, sf_dir, "conversations"))


@query("truncate_words", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN 200 - strpos(reverse(left(text, 200)), ' ') > 100 AND contains(left(text, 200), ' ') THEN left(text, 200 - strpos(reverse(left(text, 200)), ' ')) ELSE left(text, 200) END AS value FROM documents")
def truncate_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", A.truncate_words(F.col("text"), 200).alias("value"))


@query("cursor_page", "SELECT doc_id, lang AS scope, doc_id % 9 AS edge FROM documents")
def cursor_page(spark, sf_dir):
    state = F.struct(F.col("lang").alias("scope"), (F.col("doc_id") % 9).alias("edge"))
    d = table(spark, sf_dir, "documents").select("doc_id", A.encode_cursor(state).alias("cursor"))
    d = d.select("doc_id", A.decode_cursor(F.col("cursor"), "scope string, edge bigint").alias("s"))
    return d.select("doc_id", "s.scope", "s.edge")


def line_documents(spark, sf_dir):
    """Documents whose segments are their lines."""
    c = chunks(spark, sf_dir)
    segment = F.struct(F.lit("prose").alias("kind"), F.concat("source_file", F.lit("#"), "chunk_index").alias("node_path"), F.col("chunk_index").cast("int").alias("chunk_index"), F.lit("paragraph").alias("node_type"), F.col("text").alias("content"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", segment.alias("s")))), lambda x: x["s"])
    return c.groupBy(F.col("source_file").alias("scope")).agg(ordered.alias("segments"))


def middle(documents):
    return documents.select("scope", F.get("segments", F.floor(F.size("segments") / 2).cast("int"))["node_path"].alias("anchor"))


ROOM = 100


@query("anchor_window", f"""{CHUNKS.replace('WITH doc_lines', 'WITH RECURSIVE doc_lines', 1)}, arr AS (SELECT source_file AS scope, list(CASE WHEN ceil(length(text) / 4.0) > {ROOM} THEN {len(D.OVERSIZED_NOTE)} ELSE length(text) END ORDER BY chunk_index) AS c, list(ceil(length(text) / 4.0) > {ROOM} ORDER BY chunk_index) AS big, sum(length(text)) + 2 * (count(*) - 1) AS total, count(*) AS n, count(*) // 2 AS a FROM chunks GROUP BY source_file),
  w AS (SELECT scope, c, big, n, a AS lo, a AS hi, c[a + 1] AS used, true AS back, 0 AS step FROM arr WHERE ceil(total / 4.0) > {ROOM}
    UNION ALL SELECT scope, c, big, n, CASE WHEN way THEN lo - 1 ELSE lo END, CASE WHEN way THEN hi ELSE hi + 1 END, used + 2 + CASE WHEN way THEN c[lo] ELSE c[hi + 2] END, NOT back, step + 1
    FROM (SELECT *, CASE WHEN back AND can_b THEN true WHEN NOT back AND can_f THEN false ELSE can_b END AS way FROM (SELECT *, lo > 0 AND ceil((used + 2 + c[lo]) / 4.0) <= {ROOM} AS can_b, hi < n - 1 AND ceil((used + 2 + c[hi + 2]) / 4.0) <= {ROOM} AS can_f FROM w) WHERE can_b OR can_f)),
  f AS (SELECT scope, arg_max(lo, step) AS first, arg_max(hi, step) AS last, arg_max(used, step) AS used, any_value(n) AS n, any_value(big) AS big FROM w GROUP BY scope)
  SELECT scope, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(ceil(used / 4.0) AS BIGINT) AS returned, first > 0 AS before, last < n - 1 AS after, CAST(len(list_filter(big[first + 1:last + 1], lambda x: x)) AS INTEGER) AS oversized FROM f
  UNION ALL SELECT scope, 0, CAST(n - 1 AS INTEGER), CAST(ceil(total / 4.0) AS BIGINT), false, false, 0 FROM arr WHERE ceil(total / 4.0) <= {ROOM}""")
def anchor_window(spark, sf_dir):
    """The window around each document's middle line."""
    d = line_documents(spark, sf_dir)
    return D.windows(d, middle(d), ROOM).select("scope", "first", "last", "returned", "before", "after", "oversized")


@query("cursor_walk", f"{CHUNKS} SELECT source_file AS scope, CAST(count(*) AS INTEGER) AS seen FROM chunks GROUP BY source_file")
def cursor_walk(spark, sf_dir):
    """The window and the pages that its cursors lead to show every segment."""
    d = line_documents(spark, sf_dir)
    return D.windows(d, middle(d), ROOM, follow=True).select("scope", "seen")


@query("window_errors", f"{CHUNKS} SELECT DISTINCT source_file AS scope, 'anchor_not_in_scope' AS error FROM chunks")
def window_errors(spark, sf_dir):
    d = line_documents(spark, sf_dir)
    return D.windows(d, d.select("scope", F.lit("elsewhere#0").alias("anchor")), ROOM).select("scope", "error")


@query("anchored_content", f"""{CHUNKS} SELECT source_file || '#' || chunk_index AS anchor, CASE WHEN point_kind = 'skeleton_nav' THEN 'anchor_is_navigation' WHEN chunk_index % 2 = 1 THEN 'no_section_scope' END AS error FROM chunks
  UNION ALL SELECT 'absent-' || doc_id, 'anchor_not_found' FROM documents""")
def anchored_content(spark, sf_dir):
    """Every point as a section's anchor, and as many that are not there; points of odd index have no section above."""
    c = chunks(spark, sf_dir)
    of = F.concat("source_file", F.lit("#"), "chunk_index")
    p = c.select(of.alias("node_id"), "point_kind", F.lit("paragraph").alias("node_type"), F.when(F.col("chunk_index") % 2 == 0, F.concat("source_file", F.lit("/"), "section")).alias("parent_id"), "source_file")
    nav = c.select(F.concat("source_file", F.lit("/"), "section").alias("node_id"), F.lit("skeleton_nav").alias("point_kind"), F.lit("section").alias("node_type"), F.lit(None).cast("string").alias("parent_id"), "source_file").distinct()
    absent = table(spark, sf_dir, "documents").select(F.concat(F.lit("absent-"), "doc_id").alias("anchor"))
    return D.anchored_errors(p.unionByName(nav), c.select(of.alias("anchor")).unionByName(absent), "section")


def assembly_chunks(spark, sf_dir):
    """Chunks of plain pages; those of even documents have stored references, those of every seventh a stale one in its first
    prose, which comes after the table where a text is too short to be a chunk."""
    c = K.skeleton_chunks(plain_markdown(spark, sf_dir, without="#"), 512).filter("chunk_index is not null")
    number = F.regexp_extract("source_file", r"doc-(\d+)\.md$", 1).cast("bigint")
    mark = F.regexp_extract_all("text", F.lit(r"(?m)^(\[(?:table|checklist) node: .*\])$"), 1)
    stored = F.transform(mark, lambda m: F.struct(m.alias("placeholder"), F.regexp_extract(m, r"node: ([^ ]+)", 1).alias("node_path")))
    stale = F.array(F.struct(F.lit("[table node: gone]").alias("placeholder"), F.lit("gone").alias("node_path")))
    empty = F.array().cast("array<struct<placeholder:string,node_path:string>>")
    first = F.col("node_path").endswith("/overview/paragraph-1")
    refs = F.concat(F.when(number % 2 == 0, stored).otherwise(empty), F.when((number % 7 == 0) & first, stale).otherwise(empty))
    return c.withColumn("refs", refs).withColumnRenamed("source_file", "scope")


@query("assemble", """SELECT lang || '/doc-' || doc_id || '.md' AS scope, CASE WHEN doc_id % 2 = 0 THEN 'entity_refs' ELSE 'placeholder_fallback' END AS mode, CAST(2 AS BIGINT) AS entities, CAST(0 AS BIGINT) AS marks_left,
  concat_ws(',', CASE WHEN doc_id % 2 = 1 THEN 'placeholder_fallback' END, CASE WHEN doc_id % 7 = 0 THEN 'ref_entity_missing' END) AS warnings FROM documents""")
def assemble(spark, sf_dir):
    """Whole pages from their chunks: each entity once, at its place, and no placeholder left in the prose."""
    d = D.assemble(assembly_chunks(spark, sf_dir))
    prose = F.filter("segments", lambda x: x["kind"] == "prose")
    left = F.aggregate(prose, F.lit(0), lambda n, x: n + F.size(F.regexp_extract_all(x["content"], F.lit(r"(?m)^(\[(?:table|checklist) node: .*\])$"), 1)))
    return d.select(
        "scope",
        "mode",
        F.size(F.array_distinct(F.transform(F.filter("segments", lambda x: x["kind"] == "entity"), lambda x: F.regexp_replace(x["node_path"], "/fragment-.*$", "")))).cast("bigint").alias("entities"),
        left.cast("bigint").alias("marks_left"),
        F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("warnings"),
    )


@query("wikilinks", "SELECT doc_id, lang AS link FROM documents")
def wikilinks(spark, sf_dir):
    made = F.concat(F.lit("see [["), "lang", F.lit("|label]] "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.wikilinks(made)).alias("link"))


@query("frontmatter", "SELECT doc_id, unnest(['lang', 'tags', 'tags', 'empty']) AS key, unnest([lang, source, 'two words', NULL]) AS value FROM documents")
def frontmatter(spark, sf_dir):
    """Pages with front matter, a repeated key and a line that is none."""
    page = F.concat(F.lit("---\nlang: xx\n# note\ntags: ["), "source", F.lit(", 'two words',]\nempty:\nlang: "), "lang", F.lit("\n---\nbody: no\n"))
    m = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.frontmatter(page)).alias("key", "values"))
    return m.select("doc_id", "key", F.explode_outer("values").alias("value"))


@query("entity_context", f"""{CHUNKS}, p AS (SELECT *, lag(text) OVER (PARTITION BY source_file ORDER BY chunk_index) AS before FROM chunks)
  SELECT source_file, chunk_index, concat_ws(' — ', source_file || ' › ' || section, CASE WHEN chunk_index % 2 = 0 THEN 'table' END, nullif(left(trim(regexp_replace(coalesce(before, ''), '\\s+', ' ', 'g')), 500), '')) AS context FROM p""")
def entity_context(spark, sf_dir):
    """The line before, with a placeholder under it that is left out."""
    before = F.lag("text").over(Window.partitionBy("source_file").orderBy("chunk_index"))
    near = F.concat(before, F.lit("\n [code block node: x — y]"))
    c = chunks(spark, sf_dir).withColumn("near", near)
    return c.select("source_file", "chunk_index", X.entity_context(X.deterministic_context(F.col("source_file"), F.col("section")), F.when(F.col("chunk_index") % 2 == 0, "table"), F.col("near")).alias("context"))


@query("redact_errors", "SELECT doc_id, 'fail token=[redacted] at ' || lang AS value FROM documents")
def redact_errors(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.redact_secrets(F.concat(F.lit("fail token="), F.md5("text"), F.lit(" at "), "lang")).alias("value"))


def hint_sql(profile: str) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in profile.split()) + "]"
    return f"len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda w: list_contains({words}, w)))"


HINTS = ", ".join(f"{hint_sql(v)} AS {k}" for k, v in X.LANGUAGE_WORDS.items())


@query("language_hint", f"""WITH n AS (SELECT doc_id, length(text) AS chars, {HINTS} FROM documents)
  SELECT doc_id, CASE WHEN chars < 100 OR greatest(de, en, es, fr) = 0 THEN NULL WHEN de >= greatest(en, es, fr) THEN 'de' WHEN en >= greatest(es, fr) THEN 'en' WHEN es >= fr THEN 'es' ELSE 'fr' END AS lang FROM n""")
def language_hint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.language_hint(F.col("text")).alias("lang"))


@query("parse_llm_json", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE doc_id END AS id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE lang END AS tag FROM documents")
def parse_llm_json(spark, sf_dir):
    body = F.concat(F.lit('{"id": '), "doc_id", F.lit(', "tag": "'), "lang", F.lit('"}'))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise(F.lit("{broken"))
    d = table(spark, sf_dir, "documents").select("doc_id", X.parse_model_json(raw, "id bigint, tag string").alias("j"))
    return d.select("doc_id", "j.id", "j.tag")
