"""Files as rows: discovery by name, and whole files with their hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ignored

# The file types that are read.
EXTENSIONS = ("md", "txt", "docx", "odt", "rtf", "epub", "html", "htm", "pdf")


def eligible(path: Column) -> Column:
    """A known extension, in any case, and a base name that is not hidden."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.lower(path).rlike(rf"\.({'|'.join(EXTENSIONS)})$") & ~base.startswith(".")


def read_files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, content, file_hash) of the eligible files below ``root``."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith("."))
    keep = eligible(F.col("path")) & ~hidden & ~ignored(F.col("path"), ignore or [])
    return d.filter(keep).select("path", "content", F.sha2("content", 256).alias("file_hash"))


def strip_html(html: Column) -> Column:
    """Readable text of a page: scripts, styles, comments and tags go, common entities are decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|article|section)>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"))
