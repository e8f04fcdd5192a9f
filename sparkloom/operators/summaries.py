"""Navigation nodes of files, folders and collections, and their summaries from below.

A summary is made by a generator, a function from columns (what it is of, its lines) to a column, null where it has
none; then the inventory stays. Nothing here runs row by row, and levels of folders are joined one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.collections import scratch_folder
from .chunking import outline

Generate = Callable[[Column, Column], Column]
OUTLINE = "source_file string, node_order int, kind string, path string, ordinal int, title string, heading_path string, text string"


def outline_nodes(files: DataFrame) -> DataFrame:
    """Every node of (source_file, markdown) files, sections included."""
    names = [c.split()[0] for c in OUTLINE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, n.order, n.kind, n.path, n.ordinal, n.headings[-1] if n.headings else "", " › ".join(n.headings), n.text) for f, m in zip(b["source_file"], b["markdown"], strict=True) for n in outline(m or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("source_file", "markdown").mapInPandas(run, OUTLINE)


def inventory_label(pairs: Column) -> Column:
    """``2 paragraphs, 1 table`` of an array of (kind, n, first) in order of first appearance; ``empty`` for none."""
    shown = F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(p["first"], p["kind"], p["n"]))), lambda p: F.concat(p["n"].cast("string"), F.lit(" "), p["kind"], F.when(p["n"] == 1, "").otherwise("s")))
    return F.coalesce(F.nullif(F.array_join(shown, ", "), F.lit("")), F.lit("empty"))


def nav_points(nodes: DataFrame) -> DataFrame:
    """(source_file, node_path, node_type, heading_path, summary, children) of each file and each of its sections, from
    ``outline_nodes``: a section's children are its own content nodes, a file's are its sections, in order."""
    content = nodes.filter(~F.col("kind").isin("section", "frontmatter"))
    name = lambda tail: F.concat("source_file", F.lit("#"), tail)
    child = F.struct("node_order", name(F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("/"))).otherwise(""), "kind", F.lit("-"), "ordinal")).alias("p"))
    counts = content.groupBy("source_file", "path", "kind").agg(F.count("*").alias("n"), F.min("node_order").alias("first"), F.collect_list(child).alias("c"))
    own = counts.groupBy("source_file", "path").agg(F.collect_list(F.struct("kind", "n", "first")).alias("pairs"), F.flatten(F.collect_list("c")).alias("c"))
    # a path that stands in a file twice is one section
    sections = nodes.filter(F.col("kind") == "section").groupBy("source_file", "path").agg(F.min("node_order").alias("node_order"), F.min_by("title", "node_order").alias("title"), F.min_by("heading_path", "node_order").alias("heading_path"))
    s = sections.join(own, ["source_file", "path"], "left")
    none = F.array().cast("array<struct<node_order:int,p:string>>")
    no_pairs = F.array().cast("array<struct<kind:string,n:bigint,first:int>>")
    listed = F.transform(F.array_sort(F.coalesce("c", none)), lambda x: x["p"])
    section_rows = s.select("source_file", name(F.col("path")).alias("node_path"), F.lit("section").alias("node_type"), "heading_path", F.concat("title", F.lit(" — "), inventory_label(F.coalesce("pairs", no_pairs))).alias("summary"), listed.alias("children"))
    totals = nodes.filter(F.col("kind") != "frontmatter").groupBy("source_file", "kind").agg(F.count("*").alias("n"), F.min("node_order").alias("first"))
    totals = totals.groupBy("source_file").agg(F.collect_list(F.struct("kind", "n", "first")).alias("pairs"))
    heads = sections.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("node_order", "title", name(F.col("path")).alias("p")))).alias("h"))
    first_line = content.filter(F.trim("text") != "").groupBy("source_file").agg(F.min_by(F.substring(F.substring_index("text", "\n", 1), 1, 80), "node_order").alias("line"))
    f = nodes.select("source_file").distinct().join(totals, "source_file", "left").join(heads, "source_file", "left").join(first_line, "source_file", "left")
    title = F.coalesce(F.get("h", F.lit(0))["title"], F.nullif(F.col("line"), F.lit("")), F.col("source_file"))
    paths = F.coalesce(F.transform("h", lambda x: x["p"]), F.array().cast("array<string>"))
    file_rows = f.select("source_file", name(F.lit("file")).alias("node_path"), F.lit("file").alias("node_type"), F.lit("").alias("heading_path"), F.concat(title, F.lit(" — "), inventory_label(F.coalesce("pairs", no_pairs))).alias("summary"), paths.alias("children"))
    return file_rows.unionByName(section_rows)


def nav_summaries(nav: DataFrame, sections: DataFrame, generate: Generate) -> DataFrame:
    """``nav`` with ``inventory``, a new summary and its ``summary_kind``. ``sections`` (source_file, node_path, text) is the
    text of each section, that before the first heading under the file's own path. A section is summarised from its
    text; a file from its sections' lines, or takes its only section's summary over where there is no text besides."""
    s = nav.filter("node_type = 'section'").join(sections.select("node_path", F.col("text").alias("__t")), "node_path", "left")
    label = F.concat(F.lit('section "'), F.coalesce(F.nullif(F.element_at(F.split("heading_path", " › "), -1), F.lit("")), F.col("node_path")), F.lit('"'))
    text = F.trim(F.coalesce("__t", F.lit("")))
    made = F.when(text != "", generate(label, F.array(text)))
    s = s.select(*[c for c in nav.columns if c != "summary"], F.col("summary").alias("inventory"), F.coalesce(made, F.col("summary")).alias("summary"), F.when(made.isNotNull(), "generated").otherwise("inventory").alias("summary_kind"))
    line = F.struct("__at", F.concat(F.lit("- "), F.element_at(F.split("heading_path", " › "), -1), F.lit(": "), "summary").alias("line"), "summary", "summary_kind")
    files = nav.filter("node_type = 'file'")
    order = files.select(F.posexplode("children").alias("__at", "node_path"))
    below = s.join(order, "node_path").groupBy("source_file").agg(F.array_sort(F.collect_list(line)).alias("l"))
    preamble = sections.filter((F.trim("text") != "") & F.col("node_path").endswith("#file")).select("source_file", F.lit(True).alias("pre")).distinct()
    f = files.join(below, "source_file", "left").join(preamble, "source_file", "left")
    only = (F.size("l") == 1) & F.col("pre").isNull() & (F.get("l", F.lit(0))["summary_kind"] != "inventory")
    lines = F.coalesce(F.transform("l", lambda x: x["line"]), F.array("summary"))
    new = F.when(only, F.get("l", F.lit(0))["summary"]).otherwise(generate(F.concat(F.lit('the document "'), "source_file", F.lit('"')), lines))
    kind = F.when(F.coalesce(only, F.lit(False)), "propagated").when(new.isNotNull(), "generated").otherwise("inventory")
    f = f.select(*[c for c in nav.columns if c != "summary"], F.col("summary").alias("inventory"), F.coalesce(new, F.col("summary")).alias("summary"), kind.alias("summary_kind"))
    return s.unionByName(f)


def directory_points(files: DataFrame, collection: str) -> DataFrame:
    """(path, node_path, parent, summary, children) of every folder above a file of (source_file): its folders, then its
    files, each in collated order, and how many there are of both."""
    parts = F.split("source_file", "/")
    depth = F.size(parts) - 1
    f = files.select("source_file").distinct().filter(depth > 0).withColumn("path", F.array_join(F.slice(parts, 1, depth), "/"))
    every = f.select("path").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("path")).distinct()
    up = every.filter(F.contains("path", F.lit("/"))).select(F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.col("path").alias("child"))
    node = lambda p: F.concat(F.lit(f"{collection}#dir/"), p)
    entry = lambda what, shown: F.struct(F.lit(what).alias("o"), F.col(shown).alias("s"))
    below = up.select(F.col("parent").alias("path"), entry(0, "child").alias("e"), node(F.col("child")).alias("n")).unionByName(f.select("path", entry(1, "source_file").alias("e"), F.concat("source_file", F.lit("#file")).alias("n")))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.col("e.o"), F.collate(F.col("e.s"), "UNICODE"), F.col("e.s")))
    g = below.withColumn("i", place).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("c"), F.count_if(F.col("e.o") == 1).alias("files"), F.count_if(F.col("e.o") == 0).alias("dirs"))
    count = lambda c, one, many: F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, f" {one}").otherwise(f" {many}"))
    summary = F.concat(F.element_at(F.split("path", "/"), -1), F.lit(" — "), count("files", "file", "files"), F.lit(", "), count("dirs", "directory", "directories"))
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return every.join(g, "path").select("path", node(F.col("path")).alias("node_path"), parent.alias("parent"), summary.alias("summary"), F.transform("c", lambda x: x["n"]).alias("children"))


def summary_rollup(directories: DataFrame, files: DataFrame, generate: Generate) -> DataFrame:
    """``directories`` with ``inventory``, summary and summary_kind, deepest first: without a known child or with one that
    has an inventory only, the inventory stays; one child's real summary is taken over; of two or more a new one is made.
    ``files``: (node_path, summary, summary_kind). A level of folders is a join with the files and the level below, which is
    written and read back, so no plan grows with how deep folders nest."""
    depth = F.size(F.split("path", "/"))
    deepest = directories.agg(F.max(depth)).first()[0] or 0
    spark, folder = directories.sparkSession, scratch_folder(directories.sparkSession, "rollup")
    leaves = files.select("node_path", F.regexp_replace("node_path", "#file$", "").alias("name"), "summary", "summary_kind")
    known, empty = leaves, None
    for level in range(deepest, 0, -1):
        d = directories.filter(depth == level)
        c = d.select("path", F.posexplode("children").alias("i", "node_path")).join(known, "node_path")
        line = F.struct("i", F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce("summary", F.lit(""))).alias("line"), "summary", "summary_kind")
        c = c.groupBy("path").agg(F.array_sort(F.collect_list(line)).alias("l"))
        d = d.join(c, "path", "left")
        n, only = F.coalesce(F.size("l"), F.lit(0)), F.get("l", F.lit(0))
        taken = F.when((n == 1) & (only["summary_kind"] != "inventory") & (F.coalesce(only["summary"], F.lit("")) != ""), only["summary"])
        label = F.concat(F.lit('directory "'), F.element_at(F.split("path", "/"), -1), F.lit('"'))
        made = F.when(n >= 2, generate(label, F.transform("l", lambda x: x["line"])))
        kind = F.when(taken.isNotNull(), "propagated").when(made.isNotNull(), "rollup").otherwise("inventory")
        d = d.select("path", "node_path", "parent", "children", F.col("summary").alias("inventory"), F.coalesce(taken, made, F.col("summary")).alias("summary"), kind.alias("summary_kind"))
        d.write.parquet(f"{folder}/level={level}")
        below = spark.read.schema(d.schema).parquet(f"{folder}/level={level}")
        known, empty = leaves.unionByName(below.select("node_path", F.col("node_path").alias("name"), "summary", "summary_kind")), d.schema
    if empty is None:
        text = F.lit(None).cast("string")
        return directories.select("path", "node_path", "parent", "children", F.col("summary").alias("inventory"), "summary", text.alias("summary_kind"))
    return spark.read.schema(empty).parquet(*[f"{folder}/level={i}" for i in range(deepest, 0, -1)])


def collection_summary(collection: str, files: DataFrame, top: DataFrame | None = None, generate: Generate | None = None) -> DataFrame:
    """One row (collection, summary, summary_kind, n_files): the inventory, or with a generator an overview of the top
    level (name, summary), after which the files (source_file, summary) are told unless they are the top level. What the
    generator is given is one text, so a collection of very many files should be given by its top level alone."""
    n = files.agg(F.count("*").alias("n_files"))
    inventory = F.concat(F.lit(f"{collection} — "), F.col("n_files").cast("string"), F.when(F.col("n_files") == 1, " file").otherwise(" files"))
    if generate is None:
        return n.select(F.lit(collection).alias("collection"), inventory.alias("summary"), F.lit("inventory").alias("summary_kind"), "n_files")
    told = lambda d, name: d.agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), name, F.lit(": "), F.coalesce("summary", F.lit(""))))).alias("l"))
    lines = F.array(F.lit(f"Collection: {collection}"), F.concat(F.lit("Files: "), F.col("n_files").cast("string")), F.lit("Top-level map:"))
    one = n.join(told(top if top is not None else files.withColumnRenamed("source_file", "name"), "name"))  # one row each
    every = F.concat(lines, F.col("l"))
    if top is not None:
        one = one.join(told(files, "source_file").withColumnRenamed("l", "f"))
        every = F.concat(lines, F.col("l"), F.when(F.size("f") > 0, F.concat(F.array(F.lit("File notes:")), "f")).otherwise(F.array().cast("array<string>")))
    made = F.when(F.col("n_files") > 0, generate(F.lit(f"collection {collection}"), every))
    return one.select(F.lit(collection).alias("collection"), F.coalesce(made, inventory).alias("summary"), F.when(made.isNotNull(), "collection_overview").otherwise("inventory").alias("summary_kind"), "n_files")
