"""One query per text and identity function, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as X
from ..operators import retrieval as R
from .fixtures import CHUNKS, chunks, table
from .registry import query


def on_table(name: str, source: str, key: str, column: Callable[[], Column], sql: str) -> None:
    """A query of ``key`` and the function's value for each row of a table."""

    @query(name, f"SELECT {key}, {sql} AS value FROM {source}")
    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, column().alias("value"))


def on_chunks(name: str, column: Callable[[], Column], sql: str) -> None:
    @query(name, f"{CHUNKS} SELECT source_file, chunk_index, {sql} AS value FROM chunks")
    def run(spark, sf_dir):
        return chunks(spark, sf_dir).select("source_file", "chunk_index", column().alias("value"))


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


SPARSE_SQL = (
    "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+'), "
    f"lambda t: length(t) > 1 AND NOT list_contains({quoted(X.SPARSE_STOP_WORDS)}, t))"
)
TECH_SQL = "(contains({0}, '_') OR regexp_matches({0}, '[A-Z]{{2,}}') OR regexp_matches({0}, '[a-z][A-Z]') OR length({0}) >= 8)"
BUCKET_SQL = (
    "list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), "
    "lambda a, c: xor((((a * 33) % 4294967296) + 4294967296 + 2147483648) % 4294967296 - 2147483648, c))"
)

on_table("file_hash", "documents", "doc_id", lambda: F.sha2(F.col("text"), 256), "sha256(text)")
on_table("tok_sparse", "documents", "doc_id", lambda: F.array_join(X.sparse_tokens(F.col("text")), " "), f"array_to_string({SPARSE_SQL}, ' ')")
on_table("tok_guard", "benchmark", "item_id", lambda: F.array_join(F.array_sort(X.guard_tokens(F.col("text"))), " "), "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_@.]+'), lambda t: length(t) >= 2))), ' ')")
on_table("heuristic_tokens", "documents", "doc_id", lambda: X.heuristic_tokens(F.col("text")), "CAST(ceil(length(text) / 4.0) AS BIGINT)")
on_table(
    "est_tokens_cyr",
    "documents",
    "doc_id",
    lambda: X.script_tokens(F.col("text")),
    "CASE WHEN length(text) = 0 THEN 0 ELSE CAST(ceil(length(text) / (4 - 2 * (CAST(length(regexp_replace(text, '[^\u0400-\u04ff]', '', 'g')) AS DOUBLE) / length(text)))) AS BIGINT) END",
)
on_table("take_last_tokens", "documents", "doc_id", lambda: X.last_tokens(F.col("text"), 40), "right(text, 160)")
on_table("truncate_to_budget", "documents", "doc_id", lambda: X.truncate_to_budget(F.col("text"), 700), "left(text, 2800)")
on_table("canonical_ws", "documents", "doc_id", lambda: X.canonical_whitespace(F.col("text")), "trim(regexp_replace(text, '\\s+', ' ', 'g'))")
on_table("slugify", "benchmark", "item_id", lambda: X.slugify(F.col("text")), "left(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 60)")
on_table("sanitize_header", "documents", "doc_id", lambda: X.sanitize_header(F.col("text")), "regexp_replace(text, '[\\n\\r\u2028\u2029]+', ' ', 'g')")
on_table("compact_snippet", "documents", "doc_id", lambda: X.compact_snippet(F.col("text")), "CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END")
#: Every page's url in six shapes by its id, and its host by cutting at slashes.
HOST_SQL = "lower(split_part(url, '/', 3))"
REDACT_SQL = f"""CASE page_id % 6 WHEN 0 THEN '(not set)' WHEN 1 THEN '(invalid URL)' WHEN 2 THEN split_part(url, ':', 1) || '://' || {HOST_SQL}
  WHEN 3 THEN split_part(url, ':', 1) || '://' || {HOST_SQL} || ':8080' WHEN 4 THEN 'https://' || {HOST_SQL} ELSE split_part(url, ':', 1) || '://' || {HOST_SQL} END"""


def shown_urls() -> Column:
    host, rest = F.element_at(F.split("url", "/"), 3), F.concat(F.lit("/"), F.array_join(F.slice(F.split("url", "/"), 4, 99), "/"))
    scheme = F.element_at(F.split("url", ":"), 1)
    kind = F.col("page_id") % 6
    return (
        F.when(kind == 0, F.lit(None).cast("string"))
        .when(kind == 1, F.concat(F.lit("not a url "), "url"))
        .when(kind == 2, F.concat(scheme, F.lit("://user:p@ss@"), F.upper(host), rest, F.lit("?key=secret#top")))
        .when(kind == 3, F.concat(scheme, F.lit("://name@"), host, F.lit(":8080"), rest))
        .when(kind == 4, F.concat(F.lit("HTTPS://"), host, F.lit(":443?token=1")))
        .otherwise(F.col("url"))
    )


on_table("redact_url", "pages", "page_id", lambda: X.redact_url(shown_urls()), REDACT_SQL)
on_table(
    "redact_messages",
    "pages",
    "page_id",
    lambda: X.redact_errors(F.concat(F.lit("key k-123 failed at https://user:pw@h"), "page_id", F.lit(".org/x?k=k-123 and http://plain.org, retry http://a.org/b")), ["k-123", None]),
    "'key [REDACTED] failed at https://h' || page_id || '.org and http://plain.org, retry http://a.org'",
)
on_table("page_markers", "documents", "doc_id", lambda: X.strip_page_markers(F.concat(F.lit("-- 1 of 3 --\n"), "lang", F.lit(" -- 2of 3-- "), "source", F.lit(" --3 of x--"))), "chr(10) || lang || '  ' || source || ' --3 of x--'")
on_table("classify_query", "benchmark", "item_id", lambda: X.classify_query(F.col("text")), """CASE
  WHEN regexp_matches(text, '(?i)увімкнути|\\benable\\b|\\bactivate\\b|without ollama|без ollama')
       AND regexp_matches(text, '(?i:bge-m3-onnx)|ONNX_EMBED|(?i:\\bprovider\\b)|(?i:провайдер)') THEN 'provider-activation'
  WHEN regexp_matches(text, '(?i)\\benv\\b|environment variable|config\\.json|\\bprovider\\b|провайдер') THEN 'config-env'
  WHEN regexp_matches(text, '(?i)де знаходиться|location in source|\\bsource\\b|експортує|\\bexports\\b|entry point|which file|where is') THEN 'source-navigation'
  WHEN regexp_matches(text, '[A-Z][A-Z_]{2,}[A-Z0-9]|[a-z][A-Za-z]{2,}[A-Z][A-Za-z]*|src/|\\.js\\b|\\.md\\b|@\\d+') THEN 'exact-token'
  ELSE 'semantic' END""")
#: Queries of known classes by item id: what each variant says of them is stated, not computed.
CLASS_CASES = [
    ("enable the bge-m3-onnx provider", "provider-activation", "provider-activation", "provider-activation"),
    ("where is the entry point", "source-navigation", "source-navigation", "source-navigation"),
    ("MAX_TOKENS default", "exact-token", "exact-token", "exact-token"),
    ("how do I wash a cat", "semantic", "semantic", "semantic"),
    ("enable provider by config.json", "provider-activation", "config-env", "provider-activation"),
    ("the collection of an article", "semantic", "config-env", "config-env"),
    ("rerank_model names", "semantic", "config-env", "config-env"),
]
for _variant, _at in (("v1", 1), ("v2", 2), ("v3-words", 3)):
    on_table(
        f"classify_query_{_variant.replace('-', '_')}",
        "documents",
        "doc_id",
        lambda v=_variant: X.classify_query(F.element_at(F.array(*[F.lit(c[0]) for c in CLASS_CASES]), (F.col("doc_id") % len(CLASS_CASES) + 1).cast("int")), None, v),
        "[" + ", ".join(f"'{c[_at]}'" for c in CLASS_CASES) + f"][1 + doc_id % {len(CLASS_CASES)}]",
    )
on_table("summary_tier", "documents", "doc_id", lambda: X.summary_tier(X.script_tokens(F.col("text"))), "CASE WHEN ceil(length(text) / 4.0) < 300 THEN 'short' WHEN ceil(length(text) / 4.0) < 1500 THEN 'medium' ELSE 'structured' END")
on_table("length_bucket", "documents", "doc_id", lambda: X.length_bucket(X.heuristic_tokens(F.col("text"))), "CAST(CASE WHEN ceil(length(text) / 4.0) <= 16 THEN 16 WHEN ceil(length(text) / 4.0) <= 32 THEN 32 WHEN ceil(length(text) / 4.0) <= 64 THEN 64 WHEN ceil(length(text) / 4.0) <= 128 THEN 128 WHEN ceil(length(text) / 4.0) <= 256 THEN 256 END AS BIGINT)")
on_table("has_pdf_structure", "documents", "doc_id", lambda: F.regexp_count(F.col("text"), F.lit(r"(?m)^#{1,6} ")) >= 3, "len(regexp_extract_all(text, '(?m)^#{1,6} ')) >= 3")
on_table("output_cap", "documents", "doc_id", lambda: F.ceil(F.length(F.col("text")) / 3) + 64, "CAST(ceil(length(text) / 3.0) AS BIGINT) + 64")
on_table("embed_fits", "documents", "doc_id", lambda: X.heuristic_tokens(F.col("text")) <= 512, "ceil(length(text) / 4.0) <= 512")

on_chunks("split_sentences", lambda: F.array_join(X.sentences(F.col("text")), "¶"), """array_to_string(CASE WHEN len(list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?\\n]+|[^.!?\\n]+$'), lambda x: trim(x)), lambda x: x <> '')) = 0 THEN [text]
  ELSE list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?\\n]+|[^.!?\\n]+$'), lambda x: trim(x)), lambda x: x <> '') END, '¶')""")
on_chunks("deterministic_context", lambda: X.deterministic_context(F.col("source_file"), F.col("section")), "source_file || ' › ' || section")
on_chunks("embed_input", lambda: F.concat(X.deterministic_context(F.col("source_file"), F.col("section")), F.lit("\n\n"), F.col("text")), "source_file || ' › ' || section || chr(10) || chr(10) || text")
on_chunks("dir_prefix", lambda: X.dir_prefix(F.col("source_file"), 1), "source || '/'")
on_chunks("normalize_tag", lambda: F.array_join(X.normalize_tags(F.array(F.concat(F.lit(" "), F.upper("lang"), F.lit(" Tag ")), F.col("source"), F.col("source"))), ","), "lower(lang) || '-tag,' || source")
on_chunks("combined_tags", lambda: F.array_join(X.combined_tags(F.array(F.upper("lang"), F.lit("x"), F.concat(F.lit(" Two  Words "), "section"), F.upper("lang"), F.lit("y" * 41), F.lit("z" * 40))), ","), f"lang || ',two-words-' || section || ',{'z' * 40}'")
on_chunks("listed_tags", lambda: F.array_join(X.listed_tags(F.concat(F.lit("- One\n* TWO words\n3. thr(ee)\n"), "lang", F.lit(", "), "lang", F.lit(", five, six, x, seven, eight"))), ","), "'one,two-words,three,' || lang || ',five,six'")
on_chunks("merge_tags", lambda: F.array_join(X.merge_tags(F.col("tags"), F.array("source", F.lit("generated"))), ","), "lang || ',' || source || ',generated'")
on_chunks("audit_hash", lambda: I.audit_hash(F.col("source_file")), "left(sha256(source_file), 16)")


def uuid_sql(name: str) -> str:
    h = f"sha1(unhex('{I.DNS}') || encode({name}))"
    return (
        f"left({h}, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab', 1 + (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


on_chunks("chunk_id", lambda: I.chunk_id(F.lit("main"), F.col("source_file"), F.col("chunk_index")), uuid_sql("'main' || chr(0) || source_file || chr(0) || chunk_index || chr(0) || '2'"))
on_chunks("node_id", lambda: I.node_id(F.col("source_file"), F.col("section"), F.lit("section"), F.lit(1)), uuid_sql("'node:' || chr(0) || '' || chr(0) || source_file || chr(0) || section || chr(0) || 'section' || chr(0) || '1'"))
on_chunks("skeleton_point_id", lambda: I.skeleton_point_id(F.lit("main"), F.col("source_file")), uuid_sql("'point:main' || chr(0) || source_file || chr(0) || '2'"))
on_table("evaluation_id", "benchmark", "item_id", lambda: I.evaluation_id("q", F.col("text")), "'q-' || left(sha1(text), 16)")


@query("hash_bucket", f"WITH t AS (SELECT DISTINCT unnest({SPARSE_SQL}) AS token FROM documents) SELECT token, CAST(abs({BUCKET_SQL.format('token')}) % 1048576 AS BIGINT) AS bucket FROM t")
def hash_bucket(spark, sf_dir):
    """Each distinct term's bucket: terms are made distinct before they are hashed."""
    tokens = R.sparse_terms(table(spark, sf_dir, "documents"), "doc_id").select(F.col("term").alias("token")).distinct()
    return tokens.select("token", X.hash_bucket(F.col("token")).alias("bucket"))


@query(
    "tok_query",
    f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS raw, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), 1) AS pos FROM benchmark),
    k AS (SELECT item_id, lower(raw) AS token, {TECH_SQL.format("raw")} AS technical, row_number() OVER (PARTITION BY item_id, lower(raw) ORDER BY pos DESC) AS n FROM t
          WHERE NOT list_contains({quoted(X.QUERY_STOP_WORDS)}, lower(raw)))
    SELECT item_id, token, technical FROM k WHERE n = 1""",
)
def tok_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.query_tokens(F.col("text"))).alias("token", "technical"))


@query("is_technical", f"SELECT DISTINCT token, {TECH_SQL.format('token')} AS technical FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS token FROM benchmark)")
def is_technical(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("token")).distinct()
    return words.select("token", X.is_technical(F.col("token")).alias("technical"))


#: Answers whose fate is stated.
SUMMARIES = [
    ('Summary: "A plain and useful sentence."', "A plain and useful sentence."), ("Sure, here it is, the whole summary", None), ("too short", None), ("word " * 30, None),
    ("# A heading that is markup", None), ("Some **bold** words of a summary", None), ("«Quoted words of a plain summary»", "Quoted words of a plain summary"), ("x" * 700, None), (" as plain as the sentence before it ", "as plain as the sentence before it"),
]


@query("sanitize_summary", "SELECT doc_id, [" + ", ".join("NULL" if w is None else f"'{w}'" for _, w in SUMMARIES) + f"][1 + doc_id % {len(SUMMARIES)}] AS summary FROM documents")
def sanitize_summary(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(r) for r, _ in SUMMARIES]), (F.col("doc_id") % len(SUMMARIES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", X.sanitize_summary(raw).alias("summary"))


@query("safe_last_tokens", """SELECT doc_id, CASE WHEN length(text) <= 160 THEN text WHEN regexp_matches(substr(text, length(text) - 160, 1), '^\\s$') OR regexp_matches(substr(right(text, 160), 1, 1), '^\\s$') THEN ltrim(right(text, 160))
  ELSE regexp_extract(right(text, 160), '\\s+([\\s\\S]*)$', 1) END AS tail FROM documents""")
def safe_last_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.safe_last_tokens(F.col("text"), 40).alias("tail"))


@query(
    "looks_like_follow_up",
    f"""SELECT conv_id, turn, turn > 0 AND (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 12
       OR coalesce(list_contains({quoted(X.FOLLOW_UP_WORDS)}, regexp_replace(lower(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1]), '[^\\p{{L}}]', '', 'g')), false)) AS follow_up FROM conversations""",
)
def looks_like_follow_up(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.looks_like_follow_up(F.col("text"), F.col("turn") > 0).alias("follow_up"))


URL_PATH = "regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"
BASE_NAME = f"list_last(string_split({URL_PATH}, '/'))"


def url_path() -> Column:
    return F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)


@query("scan_files", f"SELECT page_id, {URL_PATH} AS path FROM pages WHERE regexp_matches(lower({URL_PATH}), '\\.(md|txt|docx|odt|rtf|epub|html|htm|pdf)$') AND NOT starts_with({BASE_NAME}, '.')")
def scan_files(spark, sf_dir):
    from ..sources.files import eligible

    return table(spark, sf_dir, "pages").select("page_id", url_path().alias("path")).filter(eligible(F.col("path")))


@query("ignore_filter", f"SELECT page_id, {URL_PATH} AS path FROM pages WHERE NOT (regexp_matches({URL_PATH}, '^/en/[^/]*$') OR regexp_matches({BASE_NAME}, '^/en/[^/]*$') OR {BASE_NAME} = '25' OR regexp_matches({URL_PATH}, '^[^/]*7\\.html$') OR regexp_matches({BASE_NAME}, '^[^/]*7\\.html$'))")
def ignore_filter(spark, sf_dir):
    patterns = ["# folders", "/en/*", "25", "*7.html"]
    return table(spark, sf_dir, "pages").select("page_id", url_path().alias("path")).filter(~X.ignored(F.col("path"), patterns))
