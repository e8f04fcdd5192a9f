"""WARC archives and a two-level capture index.

Each task writes one archive, a gzip member per record, under a name of its own run and attempt, and returns
where its records lie; those rows are the commit. The index sorts captures by reversed-host key into
compressed blocks with a sparse directory of their first keys: a lookup binary-searches the directory,
then the block, and reads only the byte range of the record. Blocks and directory are files of range-ordered
parts, so that many keys are looked up in parallel: a task holds the directory of one part at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
BLOCK_LINES = 3000
CAPTURE = "key string, page_id bigint, file string, offset bigint, length bigint"
DIRECTORY = "part string, first_key string, last_key string, offset bigint, length bigint, n bigint"
#: Namespace of record ids.
RECORDS = uuid.UUID("8f1f3f0e-6a0a-5d0e-9a53-2f6f0a7f5b11")
#: Compressed bytes that a reading task takes: at least, and at most.
LEAST_READ, MOST_READ = 4 << 20, 128 << 20


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def surt(url: str | None) -> str:
    """The reversed-host key of a url: ``com,example,www)/path?query``, without scheme and fragment."""
    rest = (url or "").partition("://")[2] or (url or "")
    rest = rest.partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:] or "/"
    host, _, port = host.rpartition("@")[2].partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + path


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The id of a capture's record, so that a revisit knows its response's: rows that agree in id, url and
    payload share it."""
    return f"<urn:uuid:{uuid.uuid5(RECORDS, json.dumps([page_id, url, digest]))}>"


def _target(url: str | None) -> str:
    return quote(url or "", safe=":/?#[]@!$&()*+,;=%~-._")


def info_record(name: str, date: str = DATE) -> bytes:
    """The warcinfo record that an archive begins with."""
    block = f"software: sparkloom\r\nformat: WARC File Format 1.1\r\nisPartOf: {name.partition('-')[0]}\r\n".encode()
    lines = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(RECORDS, name)}>",
        f"WARC-Date: {date}",
        f"WARC-Filename: {name}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: tuple[int, str | None] | None, date: str = DATE) -> bytes:
    """One WARC record; with ``refers_to`` (the page_id and url of the response) a revisit, which has the HTTP
    head only. The page ids stand in extension fields."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_target(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if _target(url) != url:  # null, or with characters that a target may not have: the url itself, which reading gives back
        lines.append(f"Page-URL: {json.dumps(url)}")
    if refers_to is not None:
        first, first_url = refers_to
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(first, first_url, digest)}",
            f"WARC-Refers-To-Target-URI: {_target(first_url)}",
            f"WARC-Refers-To-Date: {date}",
            f"Refers-To-Page-ID: {first}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields and payload of one record; the payload's digest is recomputed where it is present."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(x) if x else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != size or found != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its record")
    return {
        "record_id": fields["WARC-Record-ID"],
        "page_id": number(fields.get("Page-ID")),
        "url": json.loads(fields["Page-URL"]) if "Page-URL" in fields else fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(fields.get("Refers-To-Page-ID")),
    }


def _payload_keys() -> list[Column]:
    html = F.coalesce("html", F.lit(""))
    return [F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.octet_length(html).cast("bigint").alias("size")]


def plan_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(sha1, size, first) of the payloads of at least ``least_bytes`` that more than one row has: ``first`` is
    the (page_id, url) of the smallest page_id, and rows with a larger one are its revisits. The html itself is
    not shuffled; hot payloads are counted before the shuffle."""
    keys = pages.select("page_id", "url", *_payload_keys()).filter(F.col("size") >= least_bytes)
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    return keys.groupBy("sha1", "size").agg(first, F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")


def write_archives(pages: DataFrame, out_dir: str, least_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) rows as archives under ``out_dir`` (a shared folder) and return the
    captures: (key, page_id, file, offset, length), one for each row. Archives bear the name of this run, and
    only such are deleted when their attempts did not count: what else lies in the folder stays."""
    # a written table: both sides of the join are plain exchanges, and a payload that many pages share is split
    shared = materialize(plan_revisits(pages, least_bytes), "warc-shared")
    sha1, size = _payload_keys()
    rows = pages.select("page_id", "url", "html", sha1, size).join(shared, ["sha1", "size"], "left")
    rows = rows.select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first.page_id"), F.col("first")).alias("first"))
    fs, root = _fs(out_dir)
    fs.create_dir(root, recursive=True)
    run_name = uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{run_name}-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        fs, root = _fs(out_dir)
        out, offset, found = None, 0, []
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not out:
                    out = fs.open_output_stream(f"{root}/{name}.open")
                    head = gzip.compress(info_record(name), LEVEL, mtime=0)
                    out.write(head)
                    offset = len(head)
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                refers_to = (first["page_id"], first["url"]) if first else None
                member = gzip.compress(record(page_id, url, payload, len(payload), digest, refers_to), LEVEL, mtime=0)
                out.write(member)
                found.append((surt(url), page_id, name, offset, len(member)))
                offset += len(member)
        if out:
            out.close()
            fs.move(f"{root}/{name}.open", f"{root}/{name}")
            columns = list(zip(*found, strict=True))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "page_id", "file", "offset", "length"])

    captures = materialize(rows.mapInArrow(run, CAPTURE), "warc-captures")
    _drop_others(out_dir, run_name, {r["file"] for r in captures.select("file").distinct().collect()})
    return captures


def _drop_others(folder: str, run_name: str, counted: set[str]) -> None:
    """Delete the files of this run that attempts left which did not count. ``counted``: a name for each task."""
    fs, root = _fs(folder)
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.base_name.startswith(f"{run_name}-") and info.base_name not in counted:
            fs.delete_file(info.path)


def build_index(captures: DataFrame, index_dir: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures into compressed blocks under ``index_dir``, and write the sparse directory of each part
    beside its blocks. Returns the parts' directories as (part, first_key, last_key, offset, length, n), a row per
    block."""
    fs, root = _fs(index_dir)
    fs.create_dir(root, recursive=True)
    run_name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        name = f"{run_name}-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.cdx"
        fs, root = _fs(index_dir)
        out, offset, found, lines, keys = None, 0, [], [], []

        def flush() -> None:
            nonlocal out, offset
            block = zlib.compress("\n".join(lines).encode(), 6)
            out = out or fs.open_output_stream(f"{root}/{name}")
            out.write(block)
            found.append((name, keys[0], keys[-1], offset, len(block), len(lines)))
            offset += len(block)
            lines.clear()
            keys.clear()

        for b in batches:
            for key, page_id, file, at, length in b.itertuples(index=False):
                keys.append(key)
                lines.append(f"{quote(key, safe=':/?[]@!$&()*+,;=~-._')} {'' if pd.isna(page_id) else int(page_id)} {file} {at} {length}")
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir") as directory:
                directory.write(zlib.compress(json.dumps([list(x[1:]) for x in found]).encode(), 6))
            yield pd.DataFrame(found, columns=["part", "first_key", "last_key", "offset", "length", "n"])

    order = ["key", "page_id", "file", "offset"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "page_id", "file", "offset", "length")
    directory = materialize(ranged.mapInPandas(run, DIRECTORY), "warc-directory")
    counted = {r["part"] for r in directory.select("part").distinct().collect()}
    _drop_others(index_dir, run_name, counted | {f"{x}.dir" for x in counted})
    return directory


def _block(index_dir: str, file: str, offset: int, length: int) -> list[tuple]:
    fs, root = _fs(index_dir)
    with fs.open_input_file(f"{root}/{file}") as f:
        text = zlib.decompress(f.read_at(length, offset)).decode()
    rows = []
    for line in text.split("\n"):
        key, page_id, name, at, size = line.split(" ")
        rows.append((unquote(key), int(page_id) if page_id else None, name, int(at), int(size)))
    return rows


class Index:
    """Lookups in a built index. The driver holds the first and last key of each part (a row per writing task);
    the directory of a part is read when a search enters it, blocks and records are range reads."""

    def __init__(self, directory: DataFrame, index_dir: str, archive_dir: str) -> None:
        parts = directory.groupBy("part").agg(F.min("first_key").alias("a"), F.max("last_key").alias("z")).collect()
        self.parts = sorted((r["a"], r["z"], r["part"]) for r in parts)
        self.index_dir, self.archive_dir = index_dir, archive_dir
        self._held: tuple[str, list] = ("", [])

    def _directory(self, part: str) -> list:
        if self._held[0] != part:
            fs, root = _fs(self.index_dir)
            with fs.open_input_file(f"{root}/{part}.dir") as f:
                self._held = part, json.loads(zlib.decompress(f.read()))
        return self._held[1]

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(part, offset, length) of each block that may hold the key: a search among the parts, then among a
        part's blocks. Keys sorted by the caller enter each part once."""
        for _, _, part in self.parts[bisect_left(self.parts, key, key=lambda p: p[1]) : bisect_right(self.parts, key, key=lambda p: p[0])]:
            rows = self._directory(part)
            for _, _, offset, length, _ in rows[bisect_left(rows, key, key=lambda r: r[1]) : bisect_right(rows, key, key=lambda r: r[0])]:
                yield part, offset, length

    def captures(self, url: str) -> list[tuple]:
        """The captures of one url."""
        key, out = surt(url), []
        for part, offset, length in self.blocks(key):
            rows = _block(self.index_dir, part, offset, length)
            out += rows[bisect_left(rows, key, key=lambda r: r[0]) : bisect_right(rows, key, key=lambda r: r[0])]
        return out

    def read(self, url: str) -> list[dict]:
        fs, root = _fs(self.archive_dir)
        found = []
        for _, _, file, offset, length in self.captures(url):
            with fs.open_input_file(f"{root}/{file}") as f:
                found.append(parse(gzip.decompress(f.read_at(length, offset))))
        return found


def look_up(urls: DataFrame, index: Index) -> DataFrame:
    """The captures of each distinct key of a column of urls: (key, page_id, file, offset, length).

    Sorted keys search the directory, part by part; the blocks they name are dealt to tasks, and each block is read
    once and searched for its keys. A key with captures in many blocks is looked up in each of them by a task of
    its own, so a url that very many pages share is not gathered.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column(0).to_pylist()], pa.string())], names=["key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(key, *block) for key in b.column(0).to_pylist() for block in index.blocks(key)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "part", "offset", "length"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            found: list[tuple] = []
            for key, *block in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if block != at:
                    at, rows = block, _block(index.index_dir, *block)
                found += rows[bisect_left(rows, key, key=lambda r: r[0]) : bisect_right(rows, key, key=lambda r: r[0])]
            cols = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "page_id", "file", "offset", "length"])

    wanted = urls.select(F.col(urls.columns[0]).alias("url")).distinct().mapInArrow(keys, "key string").distinct()
    blocks = wanted.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(find, "key string, part string, offset bigint, length bigint")
    dealt = blocks.repartition("part", "offset").sortWithinPartitions("part", "offset", "key")
    return dealt.mapInArrow(search, CAPTURE)


def read_archives(captures: DataFrame, archive_dir: str, payload: bool = False) -> DataFrame:
    """A row per capture, from a range read of its record: (page_id, payload_bytes, payload_digest,
    record_type, refers_to[, url, payload]). Captures are dealt by archive and read in order of offset."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["url", "payload"] * payload]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _fs(archive_dir)
        name, f = None, None
        for b in batches:
            rows = []
            for file, offset, length in b.itertuples(index=False):
                if file != name:
                    name, f = file, fs.open_input_file(f"{root}/{file}")
                found = parse(gzip.decompress(f.read_at(length, offset)))
                rows.append([found[k] for k in names])
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    spark = captures.sparkSession
    # captures are tiny, their records are not: the bytes they point to say how many tasks read
    total = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, min(-(-total // LEAST_READ), 4 * spark.sparkContext.defaultParallelism), -(-total // MOST_READ))
    order = captures.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / LEAST_READ)).sortWithinPartitions("file", "offset")
    kind = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return order.mapInPandas(run, kind + ", url string, payload binary" * payload)


def round_trip(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` as archives with an index in the shared folder, and read every record back through it:
    (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Of equal payloads of at least ``least_bytes`` that with the smallest page_id is a response, others are
    revisits of it; smaller ones are responses. A null html is an empty payload, a null url an empty
    target. Every row has a record of its own: rows that repeat a page_id are judged by their own payloads, and
    all that tie for a payload's smallest page_id are responses; a row without page_id is always a response. An
    empty table gives no archive and no row. Other columns of ``pages`` are not read.

    The records are found by looking up the keys of the pages' urls in the index.
    """
    spark = pages.sparkSession
    at = scratch_path(spark, "warc")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    captures = write_archives(rows, f"{at}/archives", least_bytes)
    index = Index(build_index(captures, f"{at}/index"), f"{at}/index", f"{at}/archives")
    return read_archives(materialize(look_up(rows.select("url"), index), "warc-found"), f"{at}/archives")
