"""``spark.read.format("collection")`` and ``.write.format("collection")``: stored collections as a data source.

A read is planned as one partition for each bucket that the filters leave; filters on the key drop buckets by their bounds, the
others go to the parquet reader. A write deals each task's rows to the buckets, a file for each; the commit publishes one
manifest that lists the new files behind the old ones of their buckets, so that a written row counts before an older one of
its key. What fails before that leaves no file and no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import collection_files as C

_TESTS = {
    EqualTo: lambda f, v: f == v,
    GreaterThan: lambda f, v: f > v,
    GreaterThanOrEqual: lambda f, v: f >= v,
    LessThan: lambda f, v: f < v,
    LessThanOrEqual: lambda f, v: f <= v,
}


@dataclass
class BucketPartition(InputPartition):
    files: list[str]


def expression(filters: list[tuple]) -> pads.Expression | None:
    """The conjunction of (kind, column, value) as one that parquet readers take."""
    out = None
    for kind, column, value in filters:
        one = pc.field(column).isin(list(value)) if kind is In else _TESTS[kind](pc.field(column), value)
        out = one if out is None else out & one
    return out


def may_hold(low: object, above: object, kind: type, value: object) -> bool:
    """Whether a bucket of keys from ``low`` (None: any) to below ``above`` (None: any) can hold one that passes."""
    values = list(value) if kind is In else [value]
    under = lambda v: low is None or v >= low
    over = lambda v: above is None or v < above
    if kind in (EqualTo, In):
        return any(v is not None and under(v) and over(v) for v in values)
    return above is None or above > value if kind in (GreaterThan, GreaterThanOrEqual) else low is None or low <= value


class CollectionReader(DataSourceReader):
    def __init__(self, path: str, version: int | None, schema: StructType) -> None:
        self.path, self.schema = path, schema
        self.manifest, self.filters = C.load(path, version), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in (*_TESTS, In) and len(f.attribute) == 1:
                self.filters.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[BucketPartition]:
        m, out = self.manifest, []
        ends = [*m.bounds, None]
        for b, above in zip(m.buckets, ends, strict=False):
            if all(may_hold(b.low, above, kind, value) for kind, column, value in self.filters if column == m.key):
                out.append(BucketPartition(list(b.files)))
        return out

    def read(self, partition: BucketPartition) -> Iterator[pa.RecordBatch]:
        fs, root = C.file_system(self.path)
        files, which = [f"{root}/{f}" for f in partition.files], expression(self.filters)
        wanted = to_arrow_schema(self.schema)
        if len(files) == 1:
            batches = pads.dataset(files, filesystem=fs, format="parquet").to_batches(columns=wanted.names, filter=which)
        else:
            table = pa.concat_tables([pq.read_table(f, filesystem=fs, columns=wanted.names, partitioning=None) for f in files], promote_options="permissive")
            last = {k: i for i, k in enumerate(table[self.manifest.key].to_pylist())}
            table = table.take(pa.array(sorted(last.values())))
            batches = (table if which is None else table.filter(which)).to_batches()
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(n).cast(wanted.field(n).type) for n in wanted.names], schema=wanted)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, int]]  # bucket, file, rows


class CollectionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, schema.json(), overwrite
        self.start = C.load(path)
        if self.start.version and (self.start.key != key or {f.name for f in StructType.fromJson(json.loads(self.start.schema))} != set(schema.names)):
            raise ValueError(f"the collection at {path} has the key {self.start.key} and other columns")
        self.key = key
        self.folder = f"data/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = C.file_system(self.path)
        held: dict[int, list[pa.Table]] = {}
        for batch in iterator:
            of: dict[int, list[int]] = {}
            for i, k in enumerate(batch.column(self.key).to_pylist()):
                of.setdefault(self.start.bucket_of(k), []).append(i)
            for bucket, rows in of.items():
                held.setdefault(bucket, []).append(pa.Table.from_batches([batch.take(pa.array(rows))]))
        fs.create_dir(f"{root}/{self.folder}", recursive=True)
        made: list[tuple[int, str, int]] = []
        try:
            for bucket, tables in sorted(held.items()):
                name = f"{self.folder}/{bucket:06d}-{uuid.uuid4().hex}.parquet"
                made.append((bucket, name, sum(map(len, tables))))
                pq.write_table(pa.concat_tables(tables).sort_by(self.key), f"{root}/{name}", filesystem=fs, compression="zstd")
        except BaseException:
            self._delete([f for _, f, _ in made])
            raise
        return Written(made)

    def _delete(self, files: list[str]) -> None:
        fs, root = C.file_system(self.path)
        for f in files:
            if fs.get_file_info(f"{root}/{f}").is_file:
                fs.delete_file(f"{root}/{f}")

    def commit(self, messages: list[Written | None]) -> None:
        now = C.load(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        try:
            if now.version != self.start.version and (now.bounds != self.start.bounds or self.overwrite):
                raise C.Conflict(f"the collection at {self.path} has changed while it was written to")
            schema = now.schema or self.schema
            buckets = [C.Bucket(b.low, 0 if self.overwrite else b.rows, [] if self.overwrite else list(b.files)) for b in now.buckets] or [C.Bucket(None, 0, [])]
            for bucket, name, rows in sorted(files):
                buckets[bucket].files.append(name)
                buckets[bucket].rows += rows
            buckets = [b for b in buckets if b.files]
            if buckets:
                buckets[0].low = None
            C.publish(self.path, C.Manifest(now.version + 1, self.key, schema, buckets))
        except BaseException:
            self._delete([f for _, f, _ in files])
            raise

    def abort(self, messages: list[Written | None]) -> None:
        """Tasks that succeeded have told their files, others have deleted theirs or were lost: the whole folder goes."""
        fs, root = C.file_system(self.path)
        if fs.get_file_info(f"{root}/{self.folder}").type.name == "Directory":
            fs.delete_dir(f"{root}/{self.folder}")


class CollectionSource(DataSource):
    """Options: ``path``; ``version`` of a read; ``key`` of a first write. Keys of one write are distinct; after a write into a
    collection of many buckets ``Collection.compact`` merges files and splits what has grown."""

    @classmethod
    def name(cls) -> str:
        return "collection"

    def schema(self) -> StructType:
        found = C.load(self.options["path"], self._version())
        if not found.version:
            raise FileNotFoundError(f"there is no collection at {self.options['path']}")
        return StructType.fromJson(json.loads(found.schema))

    def _version(self) -> int | None:
        return int(self.options["version"]) if "version" in self.options else None

    def reader(self, schema: StructType) -> CollectionReader:
        return CollectionReader(self.options["path"], self._version(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> CollectionWriter:
        key = self.options.get("key") or C.load(self.options["path"]).key
        if key not in schema.names:
            raise ValueError(f"a written collection needs its key as a column; it is {key!r}")
        return CollectionWriter(self.options["path"], key, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.dataSource.register(CollectionSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
