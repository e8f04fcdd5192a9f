"""Canonical inputs derived from the tables, in Spark and as SQL common table expressions.

A document's non-blank lines are its chunks; embeddings whose id is divisible by 50 are queries against all of
them; benchmark passages are text queries whose relevant documents contain them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, doc_id, lang, source, chunk_index, total_chunks, section, text, tags, point_kind)."""
    d = table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = d.select("doc_id", "lang", "source", lines.alias("ls"))
    d = d.select("doc_id", "lang", "source", F.size("ls").cast("bigint").alias("total_chunks"), F.posexplode("ls").alias("chunk_index", "text"))
    i = F.col("chunk_index")
    return d.select(
        F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), "doc_id", F.lit(".md")).alias("source_file"),
        *["doc_id", "lang", "source"],
        i.cast("bigint").alias("chunk_index"),
        "total_chunks",
        F.concat(F.lit("s"), F.floor(i / 4)).alias("section"),
        "text",
        F.array("lang", "source").alias("tags"),
        F.when(i % 7 == 0, "skeleton_nav").when(i % 7 == 1, "entity_raw").when(i % 7 == 2, F.lit(None)).otherwise("retrieval_content").alias("point_kind"),
    )


CHUNKS = """
WITH doc_lines AS (
  SELECT doc_id, lang, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
raw_chunks AS (
  SELECT doc_id, lang, source, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS chunk_index, len(ls) AS total_chunks FROM doc_lines),
chunks AS (
  SELECT source || '/' || lang || '/doc-' || doc_id || '.md' AS source_file, doc_id, lang, source, chunk_index, total_chunks,
         's' || (chunk_index // 4) AS section, text, [lang, source] AS tags,
         CASE WHEN chunk_index % 7 = 0 THEN 'skeleton_nav' WHEN chunk_index % 7 = 1 THEN 'entity_raw'
              WHEN chunk_index % 7 = 2 THEN NULL ELSE 'retrieval_content' END AS point_kind
  FROM raw_chunks)
"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, doc_id, markdown): a page with headings, prose, a table, code and a checklist."""
    d = table(spark, sf_dir, "documents")
    parts = [
        F.concat(F.lit("# Document "), "doc_id"),
        F.lit("## Overview"),
        F.col("text"),
        F.concat(F.lit("| lang | source |\n| --- | --- |\n| "), "lang", F.lit(" | "), "source", F.lit(" |")),
        F.concat(F.lit("```py\nprint("), "doc_id", F.lit(")\nx = 1\n```")),
        F.lit("## Tasks"),
        F.lit("- [x] read\n- [ ] check"),
    ]
    return d.select(F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), "doc_id", F.lit(".md")).alias("source_file"), "doc_id", F.concat_ws("\n\n", *parts).alias("markdown"))


MARKDOWN = """
WITH md AS (
  SELECT source || '/' || lang || '/doc-' || doc_id || '.md' AS source_file, doc_id,
    concat_ws(chr(10) || chr(10), '# Document ' || doc_id, '## Overview', text,
      '| lang | source |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | ' || source || ' |',
      '```py' || chr(10) || 'print(' || doc_id || ')' || chr(10) || 'x = 1' || chr(10) || '```',
      '## Tasks', '- [x] read' || chr(10) || '- [ ] check') AS markdown
  FROM documents)
"""


def dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(qid, vec, q_label) of every vector whose id is divisible by 50, and (id, vec, label) of all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "vec", F.col("label").alias("q_label"))
    return queries, e.select(F.col("vec_id").alias("id"), "vec", "label")


DENSE = """
WITH dense_q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS vec, label AS q_label FROM embeddings WHERE vec_id % 50 = 0),
dense_c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
cos AS (SELECT qid, id, q_label, label, round(list_dot_product(q.vec, c.vec)
        / sqrt(list_dot_product(q.vec, q.vec) * list_dot_product(c.vec, c.vec)), 6) AS score FROM dense_q q, dense_c c),
dense_run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cos)
"""
