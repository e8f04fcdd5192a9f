"""Embedding profiles: legal pairs of providers, what old points tell of theirs, and whether a search can run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Providers and their legal pairs, and the states of a lane.
DENSE = ("ollama", "bge-m3-onnx", "qdrant-cloud")
SPARSE = ("hashed-tf", "bge-m3-onnx", "qdrant-cloud")
LEGAL = ("ollama:hashed-tf", "bge-m3-onnx:bge-m3-onnx", "qdrant-cloud:qdrant-cloud")
CLOUD, CLIENT = "qdrant-cloud", "client"
ATTEMPTABLE = ("available", "model_cached", "not_cached", "inference_unverified")
#: What a lane that cannot be tried makes of its collection; any other state: a missing model.
BLOCKED = {"missing_credentials": "missing_credentials", "cloud_unreachable": "missing_credentials", "unsupported_backend": "unsupported_backend"}


def legal_pair(dense: Column, sparse: Column) -> Column:
    """Whether two providers may serve one collection; false where one is missing."""
    return F.coalesce(F.concat(dense, F.lit(":"), sparse).isin(*LEGAL), F.lit(False))


def infer_legacy_profile() -> Column:
    """inferred, ambiguous or no_payload for a row per collection (n points with content, consistent, dense_provider,
    sparse_provider, vector_size, dense_dimensions of the live schema, has_sparse): inferred needs points that agree
    on a legal pair and on the live schema's dimensions and sparse vectors."""
    named = F.col("dense_provider").isNotNull() & F.col("sparse_provider").isNotNull()
    fits = (
        legal_pair(F.col("dense_provider"), F.col("sparse_provider"))
        & F.col("dense_dimensions").isNotNull()
        & F.coalesce(F.col("vector_size") == F.col("dense_dimensions"), F.lit(True))
        & F.coalesce("has_sparse", F.lit(False))
    )
    return F.when(F.col("n") == 0, "no_payload").when(~F.col("consistent"), "ambiguous").when(~named, "no_payload").when(fits, "inferred").otherwise("ambiguous")


def lane_status(execution: Column, provider: Column, known_model: Column, probe: Column) -> Column:
    """A lane's state by where it runs, its provider, whether the catalogue has its model, and what a probe of the
    provider said; a lane that is not configured (null execution) is available."""
    cloud = (
        F.when(provider != "qdrant-cloud", "unsupported_backend")
        .when(~known_model, "missing_model")
        .when(probe == "unreachable", "cloud_unreachable")
        .when(probe == "auth_failed", "missing_credentials")
        .otherwise("inference_unverified")
    )
    own = (
        F.when(provider == "hashed-tf", "available")
        .when(provider == "ollama", F.when(probe == "available", "available").otherwise("missing_model"))
        .when(provider == "bge-m3-onnx", F.when(probe == "model_cached", "model_cached").otherwise("not_cached"))
        .otherwise("unsupported_backend")
    )
    return F.when(execution.isNull(), "available").when(execution == CLOUD, cloud).when(execution == CLIENT, own).otherwise("unsupported_backend")


def availability(dense: Column, sparse: Column) -> Column:
    """struct(status, hybrid, attemptable) of a collection by its lanes' states; null: no sparse lane. A hybrid search is
    verified where both lanes are, and worth trying where both may be."""
    can = lambda lane: lane.isin(*ATTEMPTABLE)
    configured = sparse.isNotNull()
    hybrid = configured & (dense == "available") & F.coalesce(sparse == "available", F.lit(False))
    tried = configured & can(dense) & F.coalesce(can(sparse), F.lit(False))
    worse = F.when(can(dense), F.coalesce(sparse, dense)).otherwise(dense)
    blocked = F.lit("missing_model")
    for state, status in BLOCKED.items():
        blocked = F.when(worse == state, status).otherwise(blocked)
    alone = F.when(~can(dense), blocked).when(dense == "not_cached", "download_required").when(dense == "model_cached", "runtime_unverified").otherwise("available")
    both = F.when((dense == "not_cached") | (sparse == "not_cached"), "download_required").when(tried, "runtime_unverified").otherwise(blocked)
    return F.struct(F.when(hybrid, "available").when(~configured, alone).otherwise(both).alias("status"), hybrid.alias("hybrid"), tried.alias("attemptable"))
