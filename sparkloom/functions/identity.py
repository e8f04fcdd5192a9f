"""Deterministic identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the RFC 4122 DNS namespace.
DNS = "6ba7b8109dad11d180b400c04fd430c8"
SCHEMA_VERSION = 2


def uuid5(*parts: Column | str) -> Column:
    """Version-5 UUID of the parts joined by NUL, in the DNS namespace."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    name = F.encode(F.concat_ws("\0", *[c.cast("string") for c in cols]), "UTF-8")
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), name))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8)).cast("bigint")))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def chunk_id(collection: Column, source_file: Column, chunk_index: Column, version: int = SCHEMA_VERSION) -> Column:
    return uuid5(collection, F.replace(source_file, F.lit("\\"), F.lit("/")), chunk_index, F.lit(version))


def node_id(source_file: Column, path: Column, node_type: Column, ordinal: Column, collection: Column | None = None) -> Column:
    return uuid5(F.lit("node:"), collection if collection is not None else F.lit(""), source_file, path, node_type, ordinal)


def skeleton_point_id(collection: Column, node: Column, version: int = SCHEMA_VERSION) -> Column:
    return uuid5(F.concat(F.lit("point:"), collection), node, F.lit(version))


def audit_hash(value: Column) -> Column:
    """First 16 hex digits of SHA-256, for identifiers in logs."""
    return F.substring(F.sha2(value.cast("string"), 256), 1, 16)


def evaluation_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(text), 1, 16))
