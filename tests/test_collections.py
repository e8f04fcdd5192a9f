"""Stored collections: what a change rewrites, versions, conflicts, pages."""

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import collection_files as C
from sparkloom.sources.collections import Collection, bucket_of

SCHEMA = "id long, source string, text string"


def rows_of(n, start=0):
    return [(i, f"s{i % 5}", f"text {i}") for i in range(start, start + n)]


@pytest.fixture
def made(spark, tmp_path):
    return Collection.create(spark.createDataFrame(rows_of(1000), SCHEMA).repartition(3), f"file://{tmp_path}/c", "id", bucket_rows=50)


def ids(d):
    return sorted(r["id"] for r in d.select("id").collect())


def test_upsert_rewrites_the_buckets_of_its_keys(spark, made):
    before = made.manifest()
    assert len(before.buckets) >= 15 and sum(b.rows for b in before.buckets) == 1000
    new = spark.createDataFrame([(i, "new", None) for i in range(500, 510)] + [(501, "old", "x")], SCHEMA)
    after = made.upsert(new, F.col("source") == "new")
    changed = [b for b in after.buckets if b.files not in [x.files for x in before.buckets]]
    assert len(changed) <= 2 and len(after.buckets) == len(before.buckets)
    got = {r["id"]: (r["source"], r["text"]) for r in made.read().collect()}
    assert len(got) == 1000 and got[501] == ("new", None) and got[511] == ("s1", "text 511")
    assert {r["id"]: r["source"] for r in made.read(before.version).collect()}[501] == "s1"


def test_changes_equal_those_of_whole_tables(spark, made):
    made.delete(F.col("source") == "s1")
    made.set_payload(F.col("id") < 20, {"text": F.lit("seen")})
    made.delete_payload_keys(F.col("id") >= 990, ["source"])
    made.upsert(spark.createDataFrame([*rows_of(7, 5000), (None, "n", "n")], SCHEMA))
    made.delete(F.col("id").between(100, 400))
    want = {i: (None if i >= 990 else s, "seen" if i < 20 else t) for i, s, t in rows_of(1000) if s != "s1" and not 100 <= i <= 400} | {i: (s, t) for i, s, t in rows_of(7, 5000)} | {None: ("n", "n")}
    assert {r["id"]: (r["source"], r["text"]) for r in made.read().collect()} == want
    assert made.read().count() == len(want)
    assert made.upsert(spark.createDataFrame([], SCHEMA)).version == made.manifest().version


def test_buckets_split(spark, made):
    made.upsert(spark.createDataFrame(rows_of(900, 2000), SCHEMA))
    m = made.manifest()
    assert max(b.rows for b in m.buckets) <= 100 and ids(made.read()) == [*range(1000), *range(2000, 2900)]
    assert m.bounds == sorted(m.bounds) and m.buckets[0].low is None
    everywhere = made.read().select("id", bucket_of(F.col("id"), m.bounds).alias("b")).groupBy("b").count().collect()
    assert {r["b"]: r["count"] for r in everywhere} == {i: b.rows for i, b in enumerate(m.buckets)}


def test_one_writer_wins(spark, made):
    m = made.manifest()
    made.upsert(spark.createDataFrame([(1, "a", "a")], SCHEMA))
    with pytest.raises(C.Conflict):
        made._rewrite(m, [0], lambda old: old)
    with pytest.raises(C.Conflict):
        Collection.create(spark.createDataFrame(rows_of(3), SCHEMA), made.path, "id")
    assert C.versions(made.path) == [1, 2]
    assert C.vacuum(made.path) >= 1 and C.versions(made.path) == [2]
    assert made.read().count() == 1000


def test_pages_join_up_to_the_whole(spark, made):
    where = F.col("source") != "s2"
    pages, after = [], None
    while True:
        got = made.page(after, 130, where, ["source"])
        pages.append(got)
        if got.after is None:
            break
        after = got.after
    assert [r["id"] for p in pages for r in p.rows] == [i for i, s, _ in rows_of(1000) if s != "s2"]
    assert [len(p.rows) for p in pages] == [130] * 6 + [20]
    total = sum(len(b.files) for b in made.manifest().buckets)
    assert all(p.files < total for p in pages) and pages[-1].files <= 3
    numbers = {r["id"]: r["page"] for r in made.page_numbers(130, where).collect()}
    assert numbers == {r["id"]: i for i, p in enumerate(pages) for r in p.rows}


def test_early_stop_reads_no_further(made):
    seen = []
    assert made.each_page(lambda rows: seen.append(len(rows)) or len(seen) < 2, size=60) == 2 and seen == [60, 60]
    assert made.each_page(lambda rows: None, size=300) == 4


def test_an_empty_collection(spark, tmp_path):
    c = Collection.create(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e", "id", bucket_rows=10)
    assert c.read().collect() == [] and c.page().rows == []
    c.upsert(spark.createDataFrame(rows_of(45), SCHEMA))
    assert ids(c.read()) == list(range(45)) and max(b.rows for b in c.manifest().buckets) <= 20


def test_data_source_round_trip(spark, tmp_path):
    from sparkloom.sources import collection_source as D

    D.register(spark)
    path = f"file://{tmp_path}/d"
    rows = spark.createDataFrame([*rows_of(300), (None, "n", None)], SCHEMA).repartition(3)
    rows.write.format("collection").option("path", path).option("key", "id").mode("append").save()
    load = lambda **o: spark.read.format("collection").options(path=path, **o).load()
    assert sorted(map(str, load().collect())) == sorted(map(str, rows.collect()))
    c = Collection(spark, path, bucket_rows=40)
    c.compact()  # three files become one, which is split
    assert len(c.manifest().buckets) >= 5 and c.read().count() == 301
    spark.createDataFrame([(i, "again", "y") for i in (3, 299, 1000)], SCHEMA).write.format("collection").option("path", path).mode("append").save()
    want = {i: s for i, s, _ in rows_of(300)} | dict.fromkeys((3, 299, 1000), "again") | {None: "n"}
    assert {r["id"]: r["source"] for r in load().collect()} == want == {r["id"]: r["source"] for r in c.read().collect()}
    assert load(version=1).count() == 301
    assert ids(load().filter("id >= 290 and source = 'again'")) == [299, 1000]
    assert ids(load().filter("id in (1, 3)")) == [1, 3] and ids(load().filter("source = 's1' and id < 10")) == [1, 6]


def test_filters_leave_buckets_out(made):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

    from sparkloom.sources.collection_source import CollectionReader

    def left(*filters):
        r = CollectionReader(made.path, None, made.read().schema)
        rest = list(r.pushFilters(list(filters)))
        return len(r.partitions()), len(rest)

    whole = len(made.manifest().buckets)
    assert left() == (whole, 0)
    assert left(EqualTo(("id",), 500)) == (1, 0) and left(In(("id",), (3, 999))) == (2, 0)
    assert left(GreaterThan(("id",), 900))[0] < whole / 3 and left(LessThanOrEqual(("id",), 10))[0] <= 2
    assert left(EqualTo(("source",), "s1"), StringContains(("text",), "x")) == (whole, 1)


def test_a_failed_task_leaves_nothing(spark, made):
    from pyspark.sql.functions import udf

    from sparkloom.sources import collection_source as D

    D.register(spark)
    fs, root = C.file_system(made.path)
    listing = lambda: sorted(f.path for f in fs.get_file_info(D.C.pafs.FileSelector(root, recursive=True)) if f.is_file)
    before, version = listing(), made.manifest().version

    @udf("string")
    def fails(i):
        if i == 37:
            raise ValueError("on purpose")
        return "x"

    bad = spark.range(0, 100, 1, 4).select("id", F.lit("s").alias("source"), fails("id").alias("text"))
    with pytest.raises(Exception, match="on purpose"):
        bad.write.format("collection").option("path", made.path).mode("append").save()
    assert listing() == before and made.manifest().version == version and made.read().count() == 1000
