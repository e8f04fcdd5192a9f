"""Stored collections that change in place: copy-on-write over key ranges, versions, and pages by key."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import store as S
from . import collection_files as C

#: Rows of a bucket at which it is split, and of a page.
BUCKET_ROWS, PAGE = 100_000, 250
#: More parts than a bucket is ever cut into at once.
_PARTS = 1 << 24


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder in the one that driver and executors share (``spark.checkpoint.dir``, where it is unset the warehouse, but on
    a cluster no warehouse of a machine's own disk), deleted when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        if shared.startswith(("file:", "/")) and spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share; the warehouse is on a local disk")
    path = f"{shared.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` written to a scratch folder and read back: what several plans read is made once."""
    path = scratch_folder(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bucket_of(key: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by binary search; a null key is below all."""
    if not bounds:
        return F.lit(0)
    depth = len(bounds).bit_length()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(depth))])
    # a place beyond the last bound is null, which is not at most any key
    known = F.array(*[F.lit(b) for b in bounds])
    climb = lambda low, step: F.when(F.coalesce(F.get(known, low + step - 1) <= key, F.lit(False)), low + step).otherwise(low)
    return F.aggregate(steps, F.lit(0), climb)


@dataclass
class Page:
    rows: list[Row]
    after: object  # the key to go on from; None at the end
    files: int  # read for this page


class Collection:
    """A collection of rows by key at a path that driver and executors share.

    Rows are dealt to buckets by ranges of the key. A change finds the buckets that hold its keys, rewrites these and
    publishes a version with the other buckets' files as they are; a bucket that has grown beyond ``bucket_rows`` is split.
    Changes return when they can be read. Keys are of a type that JSON holds (integers, strings); a null key is a key like
    any other and lies in the first bucket.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.path, self.bucket_rows = spark, path.rstrip("/"), bucket_rows

    def manifest(self, version: int | None = None) -> C.Manifest:
        return C.load(self.path, version)

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, bucket_rows: int = BUCKET_ROWS) -> Collection:
        """A collection of ``rows``, whose keys are distinct; Conflict where there is one at ``path``."""
        made = cls(rows.sparkSession, path, bucket_rows)
        m = C.Manifest(1, key, rows.schema.json())
        if made.manifest().version:
            raise C.Conflict(f"there is a collection at {path}")
        n = rows.count()
        dealt = rows.repartitionByRange(max(1, -(-n // bucket_rows)), F.col(key).asc_nulls_first()).withColumn("__bucket", F.spark_partition_id())
        m.buckets = [b for _, b in made._written(dealt, key)]
        for b in m.buckets[:1]:
            b.low = None
        C.publish(path, m)
        return made

    def _written(self, rows: DataFrame, key: str) -> list[tuple[int, C.Bucket]]:
        """Write ``rows`` by their ``__bucket``, sorted by key within it; (number, bucket) in order, with the least key."""
        folder = f"data/{uuid.uuid4().hex}"
        sorted_rows = rows.sortWithinPartitions("__bucket", F.col(key).asc_nulls_first())
        sorted_rows.write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        fs, root = C.file_system(self.path)
        files: dict[int, list[str]] = {}
        for f in fs.get_file_info(pafs.FileSelector(f"{root}/{folder}", recursive=True)):
            if f.base_name.endswith(".parquet"):
                files.setdefault(int(f.path.rsplit("__bucket=", 1)[1].partition("/")[0]), []).append(f.path.removeprefix(f"{root}/"))
        if not files:
            return []
        # a row for each bucket
        told = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("__bucket").agg(F.count("*").alias("n"), F.min(key).alias("low"))
        return sorted((r["__bucket"], C.Bucket(r["low"], r["n"], sorted(files[r["__bucket"]]))) for r in told.collect())

    def _rows(self, m: C.Manifest, buckets: list[C.Bucket]) -> DataFrame:
        schema = S.schema_of(m.schema)
        single = [f for b in buckets if len(b.files) == 1 for f in b.files]
        many = [b for b in buckets if len(b.files) > 1]
        read = self.spark.read.schema(schema)
        out = read.parquet(*[f"{self.path}/{f}" for f in single]) if single else self.spark.createDataFrame([], schema)
        if many:
            parts = None
            for age in range(max(len(b.files) for b in many)):
                layer = read.parquet(*[f"{self.path}/{b.files[age]}" for b in many if age < len(b.files)]).withColumn("__age", F.lit(age))
                parts = layer if parts is None else parts.unionByName(layer)
            latest = parts.groupBy(F.col(m.key).alias("__key")).agg(F.max_by(F.struct(*schema.names), "__age").alias("r"))
            out = out.unionByName(latest.select(*[F.col("r")[c].alias(c) for c in schema.names]))
        return out

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m.version:
            raise FileNotFoundError(f"there is no collection at {self.path}")
        return self._rows(m, m.buckets)

    def _rewrite(self, m: C.Manifest, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> C.Manifest:
        """Publish ``m`` with ``change`` made to the rows of the buckets ``touched``."""
        touched = sorted(set(touched)) if m.buckets else []
        old = self._rows(m, [m.buckets[i] for i in touched])
        new = change(old).select(*old.columns)
        bucket = bucket_of(F.col(m.key), m.bounds)
        new = new.withColumn("__bucket", bucket).repartition("__bucket") if m.buckets else new.withColumn("__bucket", F.lit(0))
        # each of the touched ranges keeps its bound, so a key has one place whatever is left of it
        fresh = {i: replace(b, low=m.buckets[i].low if m.buckets else None) for i, b in self._written(new, m.key)}
        made = [fresh.get(i) if i in touched else b for i, b in enumerate(m.buckets)] if m.buckets else list(fresh.values())
        return self._split(self._next(m, [b for b in made if b]))

    def _next(self, m: C.Manifest, buckets: list[C.Bucket]) -> C.Manifest:
        if buckets:
            buckets[0] = replace(buckets[0], low=None)
        out = C.Manifest(m.version + 1, m.key, m.schema, buckets)
        C.publish(self.path, out)
        return out

    def _split(self, m: C.Manifest) -> C.Manifest:
        """Publish ``m`` with the buckets of too many rows cut by ranges."""
        large = [i for i, b in enumerate(m.buckets) if b.rows > 2 * self.bucket_rows]
        if not large:
            return m
        parts = -(-sum(m.buckets[i].rows for i in large) // self.bucket_rows)
        rows = self._rows(m, [m.buckets[i] for i in large]).withColumn("__b", bucket_of(F.col(m.key), m.bounds).cast("bigint"))
        dealt = rows.repartitionByRange(parts, F.col(m.key).asc_nulls_first()).withColumn("__bucket", F.col("__b") * _PARTS + F.spark_partition_id()).drop("__b")
        fresh: dict[int, list[C.Bucket]] = {}
        for number, b in self._written(dealt, m.key):
            mine = fresh.setdefault(number // _PARTS, [])
            mine.append(b if mine else replace(b, low=m.buckets[number // _PARTS].low))
        return self._next(m, [x for i, b in enumerate(m.buckets) for x in fresh.get(i, [b])])

    def _holding(self, m: C.Manifest, keys: DataFrame) -> list[int]:
        """The buckets of the keys: as many numbers as there are buckets, at most."""
        found = keys.select(bucket_of(F.col(m.key), m.bounds).alias("b")).distinct()
        return [r["b"] for r in found.collect()]

    def upsert(self, incoming: DataFrame, order: Column | None = None) -> C.Manifest:
        """Put the rows in, in place of those of their keys; of several of a key the latest by ``order``."""
        m = self.manifest()
        touched = self._holding(m, incoming)
        return self._rewrite(m, touched, lambda old: S.upsert(old, incoming.select(*old.columns), m.key, order)) if touched else m

    def _where(self, which: Column, change: Callable[[DataFrame], DataFrame]) -> C.Manifest:
        m = self.manifest()
        touched = self._holding(m, self._rows(m, m.buckets).filter(which))
        return self._rewrite(m, touched, change) if touched else m

    def delete(self, which: Column) -> C.Manifest:
        """Rows of which it is not known stay."""
        return self._where(which, lambda old: S.delete_where(old, which))

    def set_payload(self, which: Column, values: dict[str, Column]) -> C.Manifest:
        return self._where(which, lambda old: S.set_payload(old, which, values))

    def delete_payload_keys(self, which: Column, keys: list[str]) -> C.Manifest:
        return self._where(which, lambda old: S.delete_payload_keys(old, which, keys))

    def compact(self) -> C.Manifest:
        """One file for each bucket."""
        m = self.manifest()
        many = [i for i, b in enumerate(m.buckets) if len(b.files) > 1]
        return self._rewrite(m, many, lambda old: old) if many else m

    def page(self, after: object = None, size: int = PAGE, where: Column | None = None, fields: list[str] | None = None, version: int | None = None) -> Page:
        """The next ``size`` rows by key, of those that ``where`` holds. Only buckets from ``after`` on are read, one and then
        twice as many each time until the page is full."""
        m = self.manifest(version)
        at, run, rows, files = m.bucket_of(after), 1, [], 0
        while at < len(m.buckets) and len(rows) <= size:
            some = m.buckets[at : at + run]
            d = self._rows(m, some)
            d = d.filter(F.lit(True) if after is None else F.col(m.key) > F.lit(after))
            d = d if where is None else d.filter(where)
            names = list(dict.fromkeys([*(fields or d.columns), m.key]))
            rows += d.select(*names).orderBy(F.col(m.key).asc_nulls_first()).limit(size + 1 - len(rows)).collect()
            files += sum(len(b.files) for b in some)
            at, run = at + run, 2 * run
        return Page(rows[:size], rows[size - 1][m.key] if len(rows) > size else None, files)

    def each_page(self, on_page: Callable[[list[Row]], bool | None], size: int = PAGE, where: Column | None = None, fields: list[str] | None = None) -> int:
        """Hand one page after the other to ``on_page`` until it returns False, then read no further; how many pages. All are
        of one version."""
        version, after, n = self.manifest().version, None, 0
        while True:
            got = self.page(after, size, where, fields, version)
            if got.rows:
                n += 1
                if on_page(got.rows) is False:
                    return n
            if got.after is None:
                return n
            after = got.after

    def page_numbers(self, size: int = PAGE, where: Column | None = None) -> DataFrame:
        """All rows with ``page``, the number of the page (from 0) on which a scan would give each: rows are ranked within
        their bucket, and counts of the buckets before are added."""
        m = self.manifest()
        d = self._rows(m, m.buckets)
        d = (d if where is None else d.filter(where)).withColumn("__b", bucket_of(F.col(m.key), m.bounds))
        counts = {r["__b"]: r["n"] for r in d.groupBy("__b").agg(F.count("*").alias("n")).collect()}  # a row for each bucket
        before, so_far = [], 0
        for i in range(len(m.buckets)):
            before.append(so_far)
            so_far += counts.get(i, 0)
        rank = F.row_number().over(Window.partitionBy("__b").orderBy(F.col(m.key).asc_nulls_first()))
        first = F.get(F.array(*[F.lit(x).cast("bigint") for x in before or [0]]), F.col("__b"))
        return d.withColumn("page", F.floor((first + rank - 1) / size)).drop("__b")
