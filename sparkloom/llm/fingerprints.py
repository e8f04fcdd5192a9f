"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame expressions only.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's word shingles, ascending. The
sketch of a union is the k smallest of both sketches together, so sketches merge across parts in any
order; the share of that union's sketch found in both estimates resemblance, and the k-th smallest
hash estimates the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words_of

K = 128
WORDS = 5
#: Bytes of text that a bucket of neighbours holds on average, and how many buckets there are at most
#: (their bounds are a list of as many ids on the driver).
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 1 << 16
_SPAN = float(2**64)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<bigint> of at most ``k`` hashes. A text of fewer words than a shingle has one shingle,
    all its words; a null, empty or blank text has an empty sketch."""

    def hashed(w: Column) -> Column:
        last = F.greatest(F.size(w) - words, F.lit(0))
        whole = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(whole)

    return F.slice(F.sort_array(F.array_distinct(let(words_of(text), hashed))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two texts' shingles, 0 to 1; two texts without a word are alike."""
    both = F.array_intersect(a, b)
    share = let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, both)) / F.size(u)))
    return F.when(a == b, F.lit(1.0)).otherwise(share)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k - 1) over the share of the
    hash space up to the k-th smallest."""
    spread = (F.element_at(s, -1).cast("double") + _SPAN / 2) / _SPAN
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and the distinct counts; 0 to 1."""
    r = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def merge_sketches(parts: DataFrame, by: str, column: str, k: int = K) -> DataFrame:
    """(by, column): one sketch per key from any number of partial ones. Hashes are made distinct by
    partial aggregation before they are dealt by key, and the k smallest are kept by rank."""
    hashes = parts.select(by, F.explode(column).alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy(by).orderBy("h"))
    least = hashes.withColumn("__r", rank).filter(F.col("__r") <= k)
    return least.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias(column))


def as_string(s: Column) -> Column:
    """A sketch as text: 16 lowercase hex digits for each hash, in order."""
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``, by binary search."""
    depth = max(1, len(bounds).bit_length())
    padded = F.lit(bounds + [2**63 - 1] * (2**depth - 1 - len(bounds)))
    steps = F.lit([2**i for i in reversed(range(depth))])
    found = let(
        padded.cast("array<bigint>"),
        lambda b: F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get(b, low + s - 1) <= value, low + s).otherwise(low)),
    )
    return F.least(F.when(value.isNull(), F.lit(0)).otherwise(found), F.lit(len(bounds)))


def with_next(docs: DataFrame, doc_id: str, text: str, buckets: int | None = None) -> DataFrame:
    """(doc_id, text, bucket, ghost), where rows of a bucket in (ghost, doc_id, text) order are
    neighbours and the row after a bucket's last is a ghost: a copy of the next bucket's first row.

    Bounds are quantiles of the ids, a bounded list; their number follows the bytes of the texts, and no task
    sees more than a bucket (whose rows are sorted, and spilled where they do not fit). After the
    largest id comes the smallest. Repeated ids stand in order of their texts, null ids first. Ids are
    integers; of any other type they are refused.
    """
    kind = docs.schema[doc_id].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_id} must be an integer column to have an ascending order of neighbours; it is {kind}")
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if buckets is None:
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MOST_BUCKETS, max(8, -(-size // BUCKET_BYTES)))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    row = d.agg(F.percentile_approx("doc_id", shares, 10 * buckets).alias("q"), F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted({b for b in (row["q"] or []) if b != row["low"]})
    own = _bucket(F.col("doc_id"), bounds)
    first_id = F.col("doc_id").isNull() if row["nulls"] else F.col("doc_id") == F.lit(row["low"])
    # the greatest bound that is no larger than the id is the one before its bucket
    is_bound = F.coalesce(F.get(F.lit(bounds or [0]).cast("array<bigint>"), own - 1) == F.col("doc_id"), F.lit(False))
    ghost = F.when(first_id, F.lit(len(bounds))).when(is_bound, own - 1)
    places = F.array_compact(F.array(F.struct(own.alias("bucket"), F.lit(False).alias("ghost")), F.when(ghost.isNotNull(), F.struct(ghost.alias("bucket"), F.lit(True).alias("ghost")))))
    return d.withColumn("__p", F.explode(places)).select("doc_id", "text", F.col("__p.bucket").alias("bucket"), F.col("__p.ghost").alias("ghost"))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Per row of ``docs``: its fingerprint, that of its edited text, and their likenesses.

    The edited text's last floor(n_chars/2) code points are the first as many (or all) of the next
    document by ascending id. Null texts count as empty; an empty table gives an empty result; rows
    that repeat an id follow each other in order of their texts; a single row is its own successor.
    Other columns of ``docs`` are not read. One shuffle, of the texts.
    """
    d = with_next(docs, doc_id, text)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    d = d.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    head = F.substring(F.col("text"), F.lit(1), n - half)
    edited = F.when(F.col("ghost"), F.lit("")).otherwise(F.concat(head, F.substring(F.col("next_text"), F.lit(1), half)))
    d = d.select("doc_id", "text", "bucket", "ghost", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    d = d.select(
        *["doc_id", "text", "bucket", "ghost", "n_chars"],
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        sketch(F.col("text"), k, words).alias("own"),
        sketch(F.col("edited"), k, words).alias("other"),
    )
    d = d.withColumn("next_own", F.lead("own").over(order)).filter(~F.col("ghost"))
    return d.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("own")).alias("fingerprint"),
        as_string(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"),
    )
