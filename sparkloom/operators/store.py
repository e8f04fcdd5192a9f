"""Store operations on point tables: filters, upserts, deletes and repair aggregates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Point kinds that retrieval leaves out, and the fields of a stored identity.
NAV_KINDS = ("skeleton_nav", "entity_raw")
IDENTITY = ("file_hash", "chunking_model", "indexing_schema_version", "dense_provider", "dense_model", "sparse_provider", "embedding_schema_version", "chunking_schema_version", "token_count_mode", "vector_size")


def content_only(kind: str = "point_kind") -> Column:
    """True but for navigation kinds; a row without a kind is content."""
    return ~F.coalesce(F.col(kind), F.lit("")).isin(*NAV_KINDS)


def search_filter(source_file: str | None = None, tags: list[str] | None = None, exclude_nav: bool = True) -> Column:
    """source_file equality and any of the tags, without navigation."""
    out = F.lit(True)
    if source_file is not None:
        out = out & (F.col("source_file") == source_file)
    if tags:
        out = out & F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    return out & content_only() if exclude_nav else out


def is_managed(fields: tuple[str, ...] = IDENTITY) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f).isNotNull()
    return out


def path_contained(path: Column) -> Column:
    """A relative path that does not leave its root: no drive, no leading slash, no prefix that climbs out."""
    steps = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def walk(a: Column, s: Column) -> Column:
        depth = a["depth"] + F.when(s == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(a["least"], depth).alias("least"))

    inside = F.aggregate(steps, zero, walk)["least"] >= 0
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & inside


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Rows of ``stored`` whose key is not incoming, and of the incoming rows of each key the latest by ``order``
    (the last by all its columns where none is given, so that reruns agree). A null key is a key like any other."""
    # one column tells which row is the latest: an aggregate, so a key with very many rows is combined before it moves
    rank = F.struct(*([order.alias("__o")] if order is not None else []), *[F.col(c) for c in incoming.columns])
    latest = incoming.groupBy(F.col(key).alias("__key")).agg(F.max(rank).alias("__r")).select(*[F.col("__r")[c].alias(c) for c in incoming.columns])
    known = latest.select(F.col(key).alias("__key"))
    return stored.join(known, stored[key].eqNullSafe(F.col("__key")), "left_anti").unionByName(latest)


def set_payload(points: DataFrame, which: Column, values: dict[str, Column]) -> DataFrame:
    """``points`` with ``values`` merged into the rows that ``which`` holds; other columns stay."""
    new = {k: F.when(F.coalesce(which, F.lit(False)), v).otherwise(F.col(k) if k in points.columns else F.lit(None)) for k, v in values.items()}
    return points.withColumns(new)


def delete_payload_keys(points: DataFrame, which: Column, keys: list[str]) -> DataFrame:
    """``points`` without the values of ``keys`` where ``which`` holds."""
    return points.withColumns({k: F.when(~F.coalesce(which, F.lit(False)), F.col(k)) for k in keys})


def delete_where(points: DataFrame, which: Column) -> DataFrame:
    """``points`` without the rows that ``which`` holds; rows of which it is not known stay."""
    return points.filter(~F.coalesce(which, F.lit(False)))


def delete_by_source(points: DataFrame, files: DataFrame, key: str = "source_file") -> DataFrame:
    """``points`` without those of the listed files."""
    return points.join(files.select(key).distinct(), key, "left_anti")


def delete_trailing(stored: DataFrame, kept: DataFrame) -> DataFrame:
    """``stored`` without chunks at or beyond the new count of their file; ``kept``: (source_file, n)."""
    return stored.join(kept, "source_file", "left").filter(F.col("n").isNull() | (F.col("chunk_index") < F.col("n"))).drop("n")


def manifest_diff(new: DataFrame, old: DataFrame, fields: list[str], key: str = "source_file") -> DataFrame:
    """(key, action, reasons): new, reindex with the fields that differ, or skip."""
    pairs = new.join(old.select(F.col(key), *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("known")), key, "left")
    differs = [F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.lit(f)) for f in fields]
    reasons = F.array_compact(F.array(*differs))
    action = F.when(F.col("known").isNull(), "new").when(F.size(reasons) > 0, "reindex").otherwise("skip")
    return pairs.select(key, action.alias("action"), F.when(action == "reindex", F.array_join(reasons, ",")).otherwise("").alias("reasons"))


def stale_files(stored: DataFrame, indexed: DataFrame, key: str = "source_file") -> DataFrame:
    return stored.select(key).distinct().join(indexed.select(key), key, "left_anti")


def duplicate_groups(points: DataFrame) -> DataFrame:
    """(source_file, chunk_index, n, extra) of places that hold more than one point."""
    n = points.groupBy("source_file", "chunk_index").agg(F.count("*").alias("n"))
    return n.filter("n > 1").withColumn("extra", F.col("n") - 1)


#: What an embedding's provider is told by, and the whole of what makes two points of a place the same.
PROVIDER_FIELDS = ("dense_provider", "dense_model", "sparse_provider")
SIGNATURE_FIELDS = ("file_hash", "tags", "context", *PROVIDER_FIELDS, "embedding_schema_version", "vector_size")


def duplicate_classify(points: DataFrame) -> DataFrame:
    """(source_file, chunk_index, n, kind) of each duplicated place: exact-duplicate where all its points agree, else
    the first of different-file-hash, different-provider-or-schema, different-tags-and-context, different-tags
    and different-context that holds, else partial-difference. Nulls are values, and no tags are no tags."""
    tags = F.coalesce(F.to_json("tags"), F.lit("[]"))
    values = {
        "all": F.struct(*[(tags if f == "tags" else F.coalesce(F.md5(F.col(f)), F.lit("")) if f == "context" else F.col(f)).alias(f) for f in SIGNATURE_FIELDS]),
        "hash": F.struct("file_hash"),
        "tags": F.struct(tags.alias("t")),
        "context": F.struct(F.coalesce(F.md5("context"), F.lit("")).alias("c")),
        "provider": F.struct(*PROVIDER_FIELDS),
        "schema": F.struct("embedding_schema_version"),
    }
    g = points.groupBy("source_file", "chunk_index").agg(F.count("*").alias("n"), *[F.countDistinct(F.to_json(v, {"ignoreNullFields": "false"})).alias(f"d_{k}") for k, v in values.items()])
    more = lambda k: F.col(f"d_{k}") > 1
    kind = (
        F.when(~more("all"), "exact-duplicate")
        .when(more("hash"), "different-file-hash")
        .when(more("provider") | more("schema"), "different-provider-or-schema")
        .when(more("tags") & more("context"), "different-tags-and-context")
        .when(more("tags"), "different-tags")
        .when(more("context"), "different-context")
        .otherwise("partial-difference")
    )
    return g.filter("n > 1").select("source_file", "chunk_index", "n", kind.alias("kind"))


def cleanup_plan(points: DataFrame, expected: Column) -> DataFrame:
    """(point_id, action): in a duplicated place keep the point with the expected id and drop the others; a
    place without it is indexed anew."""
    w = Window.partitionBy("source_file", "chunk_index")
    p = points.withColumn("is_expected", F.col("point_id") == expected)
    p = p.select("source_file", "chunk_index", "point_id", "is_expected", F.count("*").over(w).alias("n"), F.max("is_expected").over(w).alias("has"))
    action = F.when(F.col("n") == 1, "keep").when(~F.col("has"), "reindex").when(F.col("is_expected"), "keep").otherwise("orphan")
    return p.select("source_file", "chunk_index", "point_id", action.alias("action"))


def payload_consistency(points: DataFrame, fields: list[str], key: str) -> DataFrame:
    """One row: how many points and identities there are, whether all share one, and the first disagreement: the
    least ``key`` whose identity is not that of the least key of all (null where all agree)."""
    one = F.to_json(F.struct(*[F.col(f) for f in fields]), {"ignoreNullFields": "false"})
    by = points.select(F.col(key), one.alias("one")).groupBy("one").agg(F.count("*").alias("n"), F.min(F.col(key)).alias("k"))
    first = by.agg(F.min(F.struct("k", "one")).alias("first"))  # one row
    other = F.min(F.when(F.col("one") != F.col("first.one"), F.col("k")))
    out = by.crossJoin(F.broadcast(first)).agg(F.sum("n").alias("n"), F.count("*").alias("identities"), other.alias("first_other"))
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), "identities", (F.col("identities") <= 1).alias("consistent"), "first_other")


def whole_number(value: Column) -> Column:
    """An integer as it is; null for what is none."""
    number = value.cast("string").try_cast("double")
    return F.when(number == F.floor(number), number.cast("bigint"))


def to_chunk(points: DataFrame) -> DataFrame:
    """Stored points as chunks: every field there, missing ones null, tags and heading path arrays, indexes integers."""
    have = lambda c, kind="string": F.col(c).cast(kind) if c in points.columns else F.lit(None).cast(kind)
    whole = lambda c: whole_number(F.col(c)) if c in points.columns else F.lit(None).cast("bigint")
    words = "array<string>"
    return points.select(
        *[have(c).alias(c) for c in ("source_file", "section", "text", "raw_content", "lang", "context", "node_type", "node_id", "node_path", "parent_id", "entity_id")],
        *[whole(c).alias(c) for c in ("chunk_index", "total_chunks", "fragment_index", "fragment_count")],
        F.coalesce(have("tags", words), F.array().cast(words)).alias("tags"),
        have("heading_path", words).alias("heading_path"),
        have("score", "double").alias("score"),
    )


def search_results(hits: DataFrame, window: DataFrame | None = None, form: str = "compact", snippet: Column | None = None) -> DataFrame:
    """(qid, rank, result) of hits (qid, rank and a chunk's fields): the public fields of each as a struct. ``window`` (qid,
    rank, source_file, chunk_index, section, text, is_match): the chunks around each hit, with snippets or (form
    ``full``) whole texts, in order."""
    fields = ["source_file", "chunk_index", "total_chunks", "section", "text", "tags", "score", "node_id"]
    shown = F.struct(*[F.coalesce("section", F.lit("")).alias(c) if c == "section" else F.col(c) for c in fields])
    d = hits.select("qid", "rank", shown.alias("result"))
    if window is None:
        return d
    text = F.col("text") if form == "full" else snippet
    part = F.struct("source_file", "chunk_index", F.coalesce("section", F.lit("")).alias("section"), "is_match", text.alias("text" if form == "full" else "text_snippet"))
    around = window.groupBy("qid", "rank").agg(F.array_sort(F.collect_list(part)).alias("window_chunks"))
    return d.join(around, ["qid", "rank"], "left")


def list_collections(points: DataFrame, profiles: DataFrame) -> DataFrame:
    """(collection, points, dense_provider, sparse_provider, profile_state) of every collection with points (collection) or a
    profile (collection, dense_provider, sparse_provider, valid): valid, invalid or missing; providers of a valid one only."""
    n = points.groupBy("collection").agg(F.count("*").alias("points"))
    d = n.join(profiles, "collection", "full")
    valid = F.coalesce("valid", F.lit(False))
    state = F.when(valid, "valid").when(F.col("valid").isNull(), "missing").otherwise("invalid")
    return d.select("collection", F.coalesce("points", F.lit(0)).alias("points"), F.when(valid, F.col("dense_provider")).alias("dense_provider"), F.when(valid, F.col("sparse_provider")).alias("sparse_provider"), state.alias("profile_state"))


def backfill_refs_plan(points: DataFrame, resolved: DataFrame) -> DataFrame:
    """(point_id, action): set where the references that a point's placeholders resolve to now (point_id, refs) are not the
    stored ones, clear where there are none any more, else unchanged. ``points``: (point_id, refs). Order counts."""
    empty = F.array().cast("array<string>")
    d = points.select("point_id", F.coalesce("refs", empty).alias("have")).join(resolved.select("point_id", F.col("refs").alias("want")), "point_id", "left")
    d = d.withColumn("want", F.coalesce("want", empty))
    return d.select("point_id", F.when(F.col("have") == F.col("want"), "unchanged").when(F.size("want") == 0, "clear").otherwise("set").alias("action"))


def _content(points: DataFrame) -> DataFrame:
    """Content chunks with a whole index: what the reads below give."""
    return points.filter(content_only() & (F.col("chunk_index") == F.floor("chunk_index")))


def fetch_window(points: DataFrame, requests: DataFrame, width: int) -> DataFrame:
    """For each request (request, source_file, chunk_index): the content chunks of its file at most ``width`` places from it,
    with ``is_center``. Places are listed, so this is an equi-join; none lies before 0."""
    near = requests.select("request", "source_file", F.col("chunk_index").alias("__c"), F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("chunk_index") - width), F.greatest(F.lit(0).cast("bigint"), F.col("chunk_index")) + width)).alias("chunk_index"))
    near = near.filter(F.col("chunk_index") <= F.col("__c") + width)
    return near.join(_content(points), ["source_file", "chunk_index"]).withColumn("is_center", F.col("chunk_index") == F.col("__c")).drop("__c")


def file_chunks(points: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (request, source_file): all content chunks of the file, with ``place``, their order by index from 1."""
    place = F.row_number().over(Window.partitionBy("request").orderBy("chunk_index"))
    return requests.select("request", "source_file").join(_content(points), "source_file").withColumn("place", place.cast("bigint"))


def section_chunks(points: DataFrame, requests: DataFrame, parent: str = "parent_id") -> DataFrame:
    """For each request (request, parent): all content chunks directly under one node, by its id and never by its heading, which
    may repeat in a file; with ``place``, their order by index from 1."""
    place = F.row_number().over(Window.partitionBy("request").orderBy("chunk_index"))
    return requests.select("request", parent).join(_content(points), parent).withColumn("place", place.cast("bigint"))


def first_in_section(points: DataFrame, parent: str = "parent_id") -> DataFrame:
    """The content chunk with the least index under each node."""
    rest = [c for c in points.columns if c != parent]
    first = _content(points).groupBy(parent).agg(F.min_by(F.struct(*rest), "chunk_index").alias("r"))
    return first.select(parent, *[F.col("r")[c].alias(c) for c in rest])


def collated(*columns: str) -> list[Column]:
    """An order by language rules, as people sort names (a, A, b, B), and by code points among equals."""
    return [x for c in columns for x in (F.collate(F.col(c), "UNICODE"), F.col(c))]


def schema_of(text: str) -> T.StructType:
    """A schema from its JSON form."""
    return T.StructType.fromJson(json.loads(text))
