"""A storage adapter over stored collections: what ``plugins.validate_adapter`` asks for, with a store behind it."""

from __future__ import annotations

import json

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import navigation as N
from .operators import retrieval as R
from .operators import search as H
from .operators import store as S
from .sources import collection_files as C
from .sources.collections import Collection

#: Fields of a point that tell how it was embedded, as a profile holds them.
PROFILE_FIELDS = ("dense_provider", "dense_model", "sparse_provider", "vector_size")


class StoredAdapter:
    """Collections under one folder, each with its points by ``point_id`` and a file of metadata. Sets of points are DataFrames,
    nodes are rows, what is not there is None; a name without a collection is a KeyError."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def name(self) -> str:
        return "stored"

    def capabilities(self) -> dict:
        return {"versions": True, "hybrid": True, "cloud_inference": False}

    def ping(self) -> dict:
        fs, at = C.file_system(self.root)
        return {"status": "ok" if fs.get_file_info(at).type == pafs.FileType.Directory else "unreachable"}

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def collection(self, name: str) -> Collection:
        if not C.versions(self._path(name)):
            raise KeyError(f"there is no collection {name}")
        return Collection(self.spark, self._path(name))

    def points(self, name: str) -> DataFrame:
        return self.collection(name).read()

    def list_collections(self) -> list[str]:
        fs, at = C.file_system(self.root)
        found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        return sorted(f.base_name for f in found if C.versions(self._path(f.base_name)))

    def get_collection(self, name: str) -> dict | None:
        if not C.versions(self._path(name)):
            return None
        m = self.collection(name).manifest()
        return {"name": name, "version": m.version, "points": sum(b.rows for b in m.buckets), "columns": T.StructType.fromJson(json.loads(m.schema)).names}

    def create_collection(self, name: str, points: DataFrame, key: str = "point_id") -> Collection:
        return Collection.create(points, self._path(name), key)

    def delete_collection(self, name: str) -> bool:
        fs, at = C.file_system(self._path(name))
        there = bool(C.versions(self._path(name)))
        if there:
            fs.delete_dir(at)
        return there

    def ensure_collection_schema(self, name: str, wanted: T.StructType) -> dict:
        """Columns that lack are added, null in the rows that are there: a new version with the same files. One of another type
        is warned of."""
        m = self.collection(name).manifest()
        have = T.StructType.fromJson(json.loads(m.schema))
        new = [f for f in wanted if f.name not in have.names]
        warnings = [f"{f.name} is {have[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}" for f in wanted if f.name in have.names and have[f.name].dataType != f.dataType]
        if new:
            C.publish(self._path(name), C.Manifest(m.version + 1, m.key, T.StructType([*have, *[T.StructField(f.name, f.dataType) for f in new]]).json(), m.buckets))
        return {"repaired": [f.name for f in new], "warnings": warnings}

    def _metadata(self, name: str) -> dict:
        self.collection(name)
        fs, at = C.file_system(f"{self._path(name)}/metadata.json")
        if not fs.get_file_info(at).is_file:
            return {}
        with fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def _keep(self, name: str, **values: object) -> None:
        told = json.dumps(self._metadata(name) | values).encode()
        fs, at = C.file_system(f"{self._path(name)}/metadata.json")
        with fs.open_output_stream(f"{at}.new") as f:
            f.write(told)
        fs.move(f"{at}.new", at)

    def get_embedding_profile(self, name: str) -> dict:
        found = self._metadata(name).get("profile")
        if found is None:
            return {"state": "missing"}
        wrong = [f for f in ("dense_provider", "dense_model", "vector_size") if found.get(f) is None]
        return {"state": "invalid", "errors": wrong} if wrong else {"state": "valid", "profile": found}

    def set_embedding_profile(self, name: str, profile: dict) -> None:
        self._keep(name, profile=profile)

    def set_indexing_state(self, name: str, state: dict) -> None:
        self._keep(name, indexing_state=state)

    def migrate_embedding_profile(self, name: str) -> dict:
        """The profile that all content points agree in, kept where there was none."""
        if self.get_embedding_profile(name)["state"] == "valid":
            return {"status": "present"}
        points = self.points(name).filter(S.content_only())
        told = S.payload_consistency(points, list(PROFILE_FIELDS), "point_id").first()
        if not told["n"]:
            return {"status": "no_payload"}
        if not told["consistent"]:
            return {"status": "ambiguous", "first_other": told["first_other"]}
        profile = points.select(*PROFILE_FIELDS).first().asDict()
        if profile["dense_provider"] is None:
            return {"status": "no_payload"}
        self.set_embedding_profile(name, profile)
        return {"status": "migrated", "profile": profile}

    def list_source_documents(self, name: str, prefix: str = "", limit: int | None = None) -> DataFrame:
        found = N.list_files(self.points(name).filter(S.content_only()), prefix=prefix).drop("tag_hits").orderBy("source_file")
        return found if limit is None else found.limit(limit)

    def _request(self, **values: object) -> DataFrame:
        return self.spark.range(1).select(F.lit(0).alias("request"), *[F.lit(v).alias(k) for k, v in values.items()])

    def get_chunk(self, name: str, source_file: str, chunk_index: int, window: int = 0) -> DataFrame:
        asked = self._request(source_file=source_file).withColumn("chunk_index", F.lit(chunk_index).cast("bigint"))
        return S.fetch_window(self.points(name), asked, window).drop("request").orderBy("chunk_index")

    def get_file_chunks(self, name: str, source_file: str) -> DataFrame:
        return S.file_chunks(self.points(name), self._request(source_file=source_file)).drop("request").orderBy("place")

    def get_section_chunks(self, name: str, node_id: str | None = None, node_path: str | None = None) -> DataFrame | None:
        node = self.get_skeleton_node(name, node_id, node_path)
        return None if node is None else S.section_chunks(self.points(name), self._request(parent_id=node["node_id"])).drop("request").orderBy("place")

    def _searched(self, name: str, which: Column | None) -> DataFrame:
        points = self.points(name).filter(S.content_only()).withColumnRenamed("point_id", "id")
        return points if which is None else points.filter(which)

    def search_hybrid_vectors(self, name: str, queries: DataFrame, limit: int = 5, which: Column | None = None) -> DataFrame:
        """(qid, id, score, rank) for queries (qid, vec, text): vectors against the points' ``vec``, texts by their terms; a null
        text has no sparse lane."""
        points = self._searched(name, which)
        dense = R.dense_scores(queries, points.filter("vec is not null"), k=H.prefetch(limit))
        sparse = R.sparse_search(queries.filter("text is not null"), points, "qid", "id")
        return H.hybrid_search(dense, sparse, limit)

    def search_hybrid_inference(self, name: str, queries: DataFrame, limit: int = 5, which: Column | None = None) -> DataFrame:
        """The same for texts alone (qid, text), which the default embedder embeds."""
        return H.hybrid_search(*R.both_lanes(queries, self._searched(name, which), "qid", "id", H.prefetch(limit)), limit)

    def check_cloud_inference_reachable(self) -> dict:
        return {"status": "ok"}

    def probe_inference(self, profile: dict) -> dict:
        return {"status": "unsupported"}

    def _nodes(self, name: str) -> DataFrame:
        return self.points(name).filter("point_kind = 'skeleton_nav'")

    def _one(self, nodes: DataFrame, node_id: str | None, node_path: str | None) -> Row | None:
        if node_id is None and node_path is None:
            raise ValueError("a node is asked for by its id or its path")
        found = nodes.filter(F.col("node_id") == node_id if node_id is not None else F.col("node_path") == node_path)
        return found.orderBy("point_id").first()

    def get_skeleton_root(self, name: str) -> Row | None:
        return self._nodes(name).filter("parent_id is null").orderBy("point_id").first()

    def get_skeleton_node(self, name: str, node_id: str | None = None, node_path: str | None = None) -> Row | None:
        return self._one(self._nodes(name), node_id, node_path)

    def get_skeleton_children(self, name: str, node_id: str | None = None, node_path: str | None = None, limit: int = 50) -> DataFrame | None:
        """The node's children in its own order, ``limit`` at most (a stated cap)."""
        node = self.get_skeleton_node(name, node_id, node_path)
        if node is None:
            return None
        parent = self.spark.range(1).select(F.lit(node["node_id"]).alias("parent"), F.array(*[F.lit(c) for c in node["children"] or []]).cast("array<string>").alias("children"))
        return N.children_ordered(parent, self._nodes(name).withColumn("node", F.col("node_path")), limit).orderBy("position").drop("parent", "node")

    def get_content_node(self, name: str, node_id: str | None = None, node_path: str | None = None) -> Row | None:
        return self._one(self.points(name).filter(F.coalesce("point_kind", F.lit("")) != "skeleton_nav"), node_id, node_path)

    def get_section_anchor(self, name: str, node_id: str | None = None, node_path: str | None = None) -> Row | None:
        """The first content chunk directly under a section."""
        node = self.get_skeleton_node(name, node_id, node_path)
        if node is None:
            return None
        return S.first_in_section(self.points(name).filter(F.col("parent_id") == node["node_id"])).first()
