"""The stored adapter: every method of the contract over a small collection."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import plugins
from sparkloom.adapter import StoredAdapter

SCHEMA = """point_id long, source_file string, chunk_index long, section string, text string, tags array<string>, point_kind string, node_type string, node_id string,
node_path string, parent_id string, children array<string>, vec array<double>, dense_provider string, dense_model string, sparse_provider string, vector_size long"""
PROFILE = ("hashed", "m", "tf", 2)


def chunk(i, file, at, parent, text, vec, profile=PROFILE):
    return (i, file, at, parent, text, ["t"], "retrieval_content", "paragraph", f"c{i}", f"{file}#{at}", parent, None, vec, *profile)


def nav(i, node, kind, parent, children):
    return (i, "a.md", None, None, None, [], "skeleton_nav", kind, node, f"p/{node}", parent, children, None, None, None, None, None)


ROWS = [
    nav(1, "root", "file", None, ["p/s2", "p/s1", "p/gone"]), nav(2, "s1", "section", "root", []), nav(3, "s2", "section", "root", []),
    chunk(10, "a.md", 0, "s1", "alpha words here", [1.0, 0.0]), chunk(11, "a.md", 1, "s1", "beta words", [0.0, 1.0]), chunk(12, "a.md", 2, "s2", "gamma alpha", [1.0, 1.0]),
    chunk(20, "b/b.md", 0, "s9", "other text", [-1.0, 0.0]),
]


@pytest.fixture
def adapter(spark, tmp_path):
    a = StoredAdapter(spark, f"file://{tmp_path}/store")
    a.create_collection("docs", spark.createDataFrame(ROWS, SCHEMA))
    return a


def ids(d):
    return [r["point_id"] for r in d.select("point_id").collect()]


def test_collections_and_metadata(spark, adapter):
    plugins.validate_adapter(adapter)
    assert adapter.ping() == {"status": "ok"} and adapter.list_collections() == ["docs"]
    assert adapter.get_collection("none") is None and adapter.get_collection("docs")["points"] == 7
    with pytest.raises(KeyError):
        adapter.points("none")
    assert adapter.get_embedding_profile("docs") == {"state": "missing"}
    assert adapter.migrate_embedding_profile("docs")["status"] == "migrated"
    assert adapter.get_embedding_profile("docs")["profile"] == {"dense_provider": "hashed", "dense_model": "m", "sparse_provider": "tf", "vector_size": 2}
    assert adapter.migrate_embedding_profile("docs") == {"status": "present"}
    adapter.set_embedding_profile("docs", {"dense_provider": "x"})
    assert adapter.get_embedding_profile("docs") == {"state": "invalid", "errors": ["dense_model", "vector_size"]}
    adapter.set_indexing_state("docs", {"phase": "done"})
    adapter.collection("docs").upsert(spark.createDataFrame([chunk(13, "a.md", 3, "s2", "delta", None, ("other", "m", "tf", 2))], SCHEMA))
    assert adapter.migrate_embedding_profile("docs") == {"status": "ambiguous", "first_other": 13}
    assert adapter.ensure_collection_schema("docs", T.StructType().add("lang", "string").add("text", "long")) == {"repaired": ["lang"], "warnings": ["text is string, not bigint"]}
    assert adapter.points("docs").filter("lang is null").count() == 8
    assert adapter.delete_collection("docs") and not adapter.delete_collection("docs") and adapter.list_collections() == []


def test_chunks_and_nodes(adapter):
    assert [tuple(r)[:2] for r in adapter.list_source_documents("docs").collect()] == [("a.md", 3), ("b/b.md", 1)]
    assert adapter.list_source_documents("docs", prefix="b/").count() == 1 and adapter.list_source_documents("docs", limit=1).count() == 1
    assert ids(adapter.get_chunk("docs", "a.md", 1)) == [11] and ids(adapter.get_chunk("docs", "a.md", 0, 1)) == [10, 11]
    assert ids(adapter.get_file_chunks("docs", "a.md")) == [10, 11, 12]
    assert ids(adapter.get_section_chunks("docs", node_id="s1")) == [10, 11] and ids(adapter.get_section_chunks("docs", node_path="p/s2")) == [12]
    assert adapter.get_section_chunks("docs", node_id="none") is None
    assert adapter.get_skeleton_root("docs")["node_id"] == "root" and adapter.get_skeleton_node("docs", node_path="p/s1")["node_id"] == "s1"
    assert ids(adapter.get_skeleton_children("docs", node_id="root")) == [3, 2] and adapter.get_skeleton_children("docs", node_id="x") is None
    assert adapter.get_content_node("docs", node_id="c12")["point_id"] == 12 and adapter.get_content_node("docs", node_id="s1") is None
    assert adapter.get_section_anchor("docs", node_id="s1")["point_id"] == 10
    with pytest.raises(ValueError, match="id or its path"):
        adapter.get_skeleton_node("docs")


def test_searches(spark, adapter):
    q = spark.createDataFrame([(1, [1.0, 0.1], "alpha"), (2, [0.0, 1.0], None)], "qid long, vec array<double>, text string")
    got = {}
    for r in adapter.search_hybrid_vectors("docs", q, 2).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got[1] == [10, 12] and got[2] == [11, 12]
    assert {r["id"] for r in adapter.search_hybrid_vectors("docs", q, 5, F.col("source_file") == "b/b.md").collect()} == {20}
    texts = spark.createDataFrame([(1, "gamma alpha")], "qid long, text string")
    assert adapter.search_hybrid_inference("docs", texts, 1).first()["id"] == 12
    assert adapter.probe_inference({})["status"] == "unsupported" and adapter.check_cloud_inference_reachable() == {"status": "ok"}
