"""Hybrid search: request validation, lanes with a filter and a prefetch, fusion, and the fallback to one lane."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval as R
from .store import search_filter

# Bounds of a search request, the tools' bounds, and the prefetch rule.
TOP_DEFAULT, TOP_MIN, TOP_MAX = 3, 1, 20
WINDOW_MIN, WINDOW_MAX = 0, 5
WINDOW_FORMATS = ("compact", "full")
TOOL_TOP_DEFAULT, TOOL_WINDOW_MAX = 5, 2
PREFETCH_TIMES = 2


class BadRequest(ValueError):
    """A request that is refused, with the reason."""


@dataclass(frozen=True)
class SearchRequest:
    collection: str
    query: str
    top: int = TOP_DEFAULT
    window: int = 0
    window_format: str | None = None
    source_file: str | None = None
    tags: tuple[str, ...] | None = None


def _text(body: dict, name: str, required: bool) -> str | None:
    value = body.get(name)
    if value is None and not required:
        return None
    if not isinstance(value, str) or not value.strip():
        raise BadRequest(f"{name} must be a non-empty string")
    return value


def _whole(body: dict, name: str, default: int, low: int, high: int) -> int:
    value = body.get(name)
    if value is None:
        return default
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if not isinstance(value, int) or isinstance(value, bool):
        raise BadRequest(f"{name} must be an integer")
    if not low <= value <= high:
        raise BadRequest(f"{name} must be between {low} and {high}")
    return value


def validate_search_request(body: object) -> SearchRequest:
    """A request body as a SearchRequest; wrong types and values out of bounds are refused, never corrected. A
    window format stands only with a window, compact unless another is given."""
    if not isinstance(body, dict):
        raise BadRequest("the request must be an object")
    tags = body.get("tags")
    if tags is not None and (not isinstance(tags, (list, tuple)) or not tags or not all(isinstance(t, str) and t.strip() for t in tags)):
        raise BadRequest("tags must be a non-empty list of non-empty strings")
    form = body.get("windowFormat")
    if form is not None and form not in WINDOW_FORMATS:
        raise BadRequest(f"windowFormat must be one of {', '.join(WINDOW_FORMATS)}")
    window = _whole(body, "window", 0, WINDOW_MIN, WINDOW_MAX)
    return SearchRequest(
        collection=_text(body, "collection", True),
        query=_text(body, "query", True),
        top=_whole(body, "top", TOP_DEFAULT, TOP_MIN, TOP_MAX),
        window=window,
        window_format=(form or "compact") if window else None,
        source_file=_text(body, "sourceFile", False),
        tags=tuple(tags) if tags is not None else None,
    )


def clamp_tool_request(top: object = None, window: object = None) -> tuple[int, int]:
    """The tools' bounds, into which values are brought instead of being refused."""

    def whole(value: object, default: int, low: int, high: int) -> int:
        try:
            return max(low, min(high, int(str(value))))
        except ValueError:
            return default

    return whole(top, TOOL_TOP_DEFAULT, TOP_MIN, TOP_MAX), whole(window, 0, WINDOW_MIN, TOOL_WINDOW_MAX)


def prefetch(top: int, times: int = PREFETCH_TIMES) -> int:
    """How deep a lane is read for a result of ``top``."""
    return max(top * times, top + 1)


def hybrid_search(dense: DataFrame | None, sparse: DataFrame | None, top: int, k: int = R.RRF_K, rank_base: int = 0) -> DataFrame:
    """(qid, id, score, rank) of lanes (qid, id, score) that a filter has already been applied to: each is ranked to the
    prefetch depth, ranks are fused, the first ``top`` stay. Without a sparse lane the dense lane's own
    scores count, to the depth of ``top``."""
    order = [F.desc("score"), F.asc("id")]
    if sparse is None:
        return R.ranked(dense, order, limit=top).select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))
    lanes = [R.ranked(lane, order, limit=prefetch(top)) for lane in (dense, sparse)]
    fused = R.fuse_rrf(lanes, k, rank_base)
    return R.ranked(fused, order, limit=top).select("qid", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@dataclass
class Collection:
    """What a search reads: documents (id, text, source_file, tags, point_kind) and what is known of their
    embedding. ``vectors``: (id, vec), hashed from the texts where there are none."""

    documents: DataFrame
    vectors: DataFrame | None = None
    profile: dict | None = field(default_factory=lambda: {"dense": "hashed", "sparse": "hashed-tf"})


@dataclass
class SearchError:
    error: str
    message: str


def lanes_of(collection: Collection, queries: DataFrame, which: Column, top: int, embed=None) -> tuple[DataFrame, DataFrame | None]:
    """The dense and the sparse lane of text queries (qid, text), both over the documents that ``which`` holds.
    The sparse lane is None where the profile has none."""
    docs = collection.documents.filter(which)
    if embed is None and collection.vectors is None and collection.profile.get("sparse"):
        return R.both_lanes(queries.select("qid", "text"), docs.select("id", "text"), "qid", "id", prefetch(top))
    if embed is None:
        embed = lambda d, key: R.dense_vectors(R.hashed_embedding(d, key), key)
    vectors = collection.vectors
    vectors = vectors.join(docs.select("id"), "id", "left_semi") if vectors is not None else embed(docs.select("id", "text"), "id")
    dense = R.dense_scores(embed(queries.select("qid", "text"), "qid"), vectors, k=prefetch(top))
    if not collection.profile.get("sparse"):
        return dense, None
    return dense, R.sparse_search(queries, docs, "qid", "id")


def run_search(collections: dict[str, Collection], request: SearchRequest, queries: DataFrame, embed=None) -> DataFrame | SearchError:
    """The hits of ``queries`` (qid, text) under a request's collection, filter and top. What stands in the way is
    told, in order: collection_not_found, embedding_unresolved, embedding_unsupported, embedding_failed."""
    found = collections.get(request.collection)
    if found is None:
        return SearchError("collection_not_found", f"there is no collection {request.collection}")
    if not found.profile or not found.profile.get("dense"):
        return SearchError("embedding_unresolved", f"the embedding of {request.collection} is not known")
    if found.profile["dense"] != "hashed" and embed is None:
        return SearchError("embedding_unsupported", f"no embedder for {found.profile['dense']}")
    which = search_filter(request.source_file, list(request.tags) if request.tags else None)
    try:
        dense, sparse = lanes_of(found, queries, which, request.top, embed)
    except (ValueError, TypeError) as e:
        return SearchError("embedding_failed", str(e))
    return hybrid_search(dense, sparse, request.top)
