"""Navigation aggregates over chunks: files, folders, tags, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dir_prefix


def list_files(chunks: DataFrame, tags: list[str] | None = None, match: str = "any", prefix: str = "") -> DataFrame:
    """(source_file, chunk_count, first_section, tag_hits) per file; with tags the files that have any or all."""
    wanted = F.array(*[F.lit(t) for t in tags or []]).cast("array<string>")
    c = chunks.filter(F.col("source_file").startswith(prefix)) if prefix else chunks
    g = c.groupBy("source_file").agg(
        F.count("*").alias("chunk_count"),
        F.min_by("section", "chunk_index").alias("first_section"),
        F.sum(F.arrays_overlap("tags", wanted).cast("bigint")).alias("tag_hits"),
        F.array_distinct(F.flatten(F.collect_set("tags"))).alias("all_tags"),
    )
    g = g.withColumn("first_section", F.when(F.col("first_section") == "", "intro").otherwise(F.col("first_section")))
    if tags:
        g = g.filter(F.arrays_overlap("all_tags", wanted) if match == "any" else F.size(F.array_except(wanted, "all_tags")) == 0)
    return g.drop("all_tags")


def list_documents(chunks: DataFrame) -> DataFrame:
    """(source_file, chunk_count, tags): the sorted set of a file's tags."""
    t = chunks.select("source_file", F.explode("tags").alias("tag")).distinct()
    t = t.groupBy("source_file").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    return chunks.groupBy("source_file").agg(F.count("*").alias("chunk_count")).join(t, "source_file")


def list_directories(chunks: DataFrame, depth: int = 1) -> DataFrame:
    files = chunks.groupBy("source_file").agg(F.count("*").alias("n"))
    return files.groupBy(dir_prefix(F.col("source_file"), depth).alias("directory")).agg(F.count("*").alias("file_count"), F.sum("n").alias("chunk_count"))


def list_tags(chunks: DataFrame, prefix: str = "", contains: str = "", least: int = 1) -> DataFrame:
    t = chunks.select("source_file", F.explode("tags").alias("tag")).filter(F.col("tag").startswith(prefix) & F.col("tag").contains(contains))
    t = t.groupBy("tag", "source_file").agg(F.count("*").alias("n"))
    return t.groupBy("tag").agg(F.sum("n").alias("chunk_count"), F.count("*").alias("file_count")).filter(F.col("chunk_count") >= least)


def find_by_tag(chunks: DataFrame, tags: list[str], match: str = "any", limit: int | None = None) -> DataFrame:
    """(source_file, sections, n[, truncated]) of the files' chunks with the tags; sections in order of first
    appearance. ``limit``: only so many chunks in order of file and index, and whether there are more."""
    wanted = F.array(*[F.lit(t) for t in tags])
    hit = F.arrays_overlap("tags", wanted) if match == "any" else F.size(F.array_except(wanted, "tags")) == 0
    found = chunks.filter(hit)
    more = None
    if limit is not None:
        one_more = found.orderBy("source_file", "chunk_index").limit(limit + 1)
        more = one_more.count() > limit
        found = one_more.orderBy("source_file", "chunk_index").limit(limit)
    s = found.groupBy("source_file", "section").agg(F.min("chunk_index").alias("first"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "section")))
    out = s.groupBy("source_file").agg(F.array_join(F.transform(ordered, lambda x: x["section"]), ",").alias("sections"), F.sum("n").alias("n"))
    return out if more is None else out.withColumn("truncated", F.lit(more))


def inventory(nodes: DataFrame, by: str, kind: str) -> DataFrame:
    """(by, inventory): ``3 tables, 1 code`` - counts by kind, in code-point order of the kind."""
    n = nodes.groupBy(by, kind).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), "n")))
    text = F.transform(parts, lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["k"], F.when(x["n"] > 1, F.lit("s")).otherwise(F.lit(""))))
    return n.groupBy(by).agg(F.array_join(text, ", ").alias("inventory"))


def file_skeleton(chunks: DataFrame) -> DataFrame:
    """(source_file, section, order, n_chunks, first_chunk, last_chunk) in document order."""
    s = chunks.groupBy("source_file", "section").agg(F.count("*").alias("n_chunks"), F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"))
    return s.withColumn("order", F.row_number().over(Window.partitionBy("source_file").orderBy("first_chunk")).cast("bigint"))


def dir_rollup(files: DataFrame) -> DataFrame:
    """(directory, n_files, n_dirs): every folder above a file, with all files and folders below it."""
    parts = F.split("source_file", "/")
    depth = F.size(parts) - 1
    ups = F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = files.select("source_file", F.explode(F.concat(F.array(F.lit("")), F.when(depth > 0, ups).otherwise(F.array().cast("array<string>")))).alias("directory"), F.array_join(F.slice(parts, 1, depth), "/").alias("own"))
    up = up.groupBy("directory", "own").agg(F.count("*").alias("n"))
    below = F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("own", "/"))), lambda i: F.array_join(F.slice(F.split("own", "/"), 1, i), "/")))
    dirs = up.select("directory", below.alias("d")).filter((F.col("d") != F.col("directory")) & (F.col("d").startswith(F.concat("directory", F.lit("/"))) | (F.col("directory") == ""))).distinct()
    n_dirs = dirs.groupBy("directory").agg(F.count("*").alias("n_dirs"))
    return up.groupBy("directory").agg(F.sum("n").alias("n_files")).join(n_dirs, "directory", "left").withColumn("n_dirs", F.coalesce("n_dirs", F.lit(0).cast("bigint")))


def children_ordered(parents: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """(parent, node, position): a parent's children by its own list, at most ``limit`` (a stated cap)."""
    listed = parents.select("parent", F.posexplode("children").alias("position", "node"))
    return listed.join(nodes, "node").filter(F.col("position") < limit)


def get_children(parents: DataFrame, nodes: DataFrame, limit: int = 50) -> DataFrame:
    """(parent, children, total_children, returned_children, truncated): the known children of each parent in its own
    order, joined with commas, ``limit`` at most (a stated cap)."""
    total = parents.select("parent", F.size("children").cast("bigint").alias("total_children"))
    some = children_ordered(parents, nodes, limit).groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("c"))
    d = total.join(some, "parent", "left")
    n = F.size(F.coalesce("c", F.array().cast("array<struct<position:int,node:string>>"))).cast("bigint")
    return d.select("parent", F.array_join(F.transform("c", lambda x: x["node"]), ",").alias("children"), "total_children", n.alias("returned_children"), (F.col("total_children") > n).alias("truncated"))


def resolve_canonical(points: DataFrame) -> DataFrame:
    """``points`` (node_id, entity_id, point_kind, text, ...) with fragments replaced: the text and kind of the content
    point that a fragment's entity_id names, and ``canonical_id``; the point itself where there is none."""
    whole = points.filter(F.coalesce("point_kind", F.lit("")) != "skeleton_nav").select(F.col("node_id").alias("canonical_id"), F.col("text").alias("__t"), F.col("point_kind").alias("__k"))
    d = points.join(whole, points["entity_id"] == whole["canonical_id"], "left")
    resolved = F.col("canonical_id").isNotNull()
    return d.withColumns({
        "text": F.when(resolved, F.col("__t")).otherwise(F.col("text")),
        "point_kind": F.when(resolved, F.col("__k")).otherwise(F.col("point_kind")),
        "canonical_id": F.coalesce("canonical_id", "node_id"),
    }).drop("__t", "__k")


# Bounds of a preview.
PREVIEW_DEFAULT, PREVIEW_MIN, PREVIEW_MAX = 1500, 200, 8000


def get_nodes(points: DataFrame, wanted: DataFrame, preview: int = PREVIEW_DEFAULT) -> DataFrame:
    """(node_id, outcome, preview, truncated) for each ``wanted`` node_id: found, nav_node_not_content for a navigation
    node, not_found; the preview has 200 to 8000 characters of the canonical point's text."""
    most = max(PREVIEW_MIN, min(PREVIEW_MAX, preview))
    d = wanted.select("node_id").join(resolve_canonical(points).select("node_id", "text", "point_kind", F.lit(True).alias("there")), "node_id", "left")
    nav = F.coalesce("point_kind", F.lit("")) == "skeleton_nav"
    outcome = F.when(F.col("there").isNull(), "not_found").when(nav, "nav_node_not_content").otherwise("found")
    good = outcome == "found"
    text = F.coalesce("text", F.lit(""))
    return d.select("node_id", outcome.alias("outcome"), F.when(good, F.substring(text, 1, most)).alias("preview"), F.when(good, F.length(text) > most).alias("truncated"))
