"""Guards of a second ranking: what the first had among its first three and a rule protects is not pushed far down.

Rules are columns over the first ranking's head; the reordering works on one query's list, which is a bounded one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import classify_query, guard_tokens

# How far the protection reaches, and patterns of the rules.
HEAD, SLOT = 3, 2
GUIDE = r"(?i)\benable\b|\bactivate\b|увімкнути"
CANDIDATE = r"(?i)\bproviders?\b|ONNX_EMBED|bge.m3.onnx|enable|activat|увімкнути"
CANDIDATE_WORDS = r"(?i)\bproviders?\b|ONNX_EMBED|bge.m3.onnx|\benable\b|\bactivat|\bswitch\b|увімкнути"
VARIABLE, LEAST_VARIABLES, LEAST_BARS, TABLE_CHARS = r"\b[A-Z][A-Z_]{3,}[A-Z0-9]\b", 5, 6, 800
STRUCTURAL_WORDS = r"\bfunction\b|\bsource\b|\bmodule\b|\bexport\b|\.js\b|[a-z][A-Z]"


@dataclass(frozen=True)
class Files:
    """The names that the rules speak of."""

    guide: str = "providers.md"
    env: str = "config-env.md"
    structure: str = "project-structure.md"


@dataclass(frozen=True)
class Variant:
    """A guard: how queries are classed, whether it speaks of configuration, whether exact tokens have one best hit, how
    protected hits are put back, and whether a guide is lifted at the end."""

    classes: str
    config: bool
    idle: tuple[str, ...] = ("semantic",)
    best_only: bool = False
    slots: bool = False
    lift: bool = False
    files: Files = field(default_factory=Files)


VARIANTS = {
    "v1": Variant("v1", config=False),
    "v2": Variant("v2", config=True, slots=True),
    "v3": Variant("v3", config=False, idle=("semantic", "config-env"), best_only=True),
    "v3-words": Variant("v3-words", config=True, best_only=True, slots=True),
    "v4": Variant("v3", config=False, idle=("semantic", "config-env"), best_only=True, lift=True),
    "v4-words": Variant("v3-words", config=True, best_only=True, slots=True, lift=True),
}


def _overlap() -> Column:
    """Distinct query tokens that the candidate's file, section or text has."""
    held = guard_tokens(F.concat_ws(" ", "source_file", "section", "text"))
    return F.size(F.array_intersect(guard_tokens(F.col("query")), held))


def _env_table() -> Column:
    head = F.substring(F.coalesce("text", F.lit("")), 1, TABLE_CHARS)
    return (F.regexp_count(head, F.lit(r"\|")) >= LEAST_BARS) | (F.regexp_count(head, F.lit(VARIABLE)) >= LEAST_VARIABLES)


def protected(hits: DataFrame, v: Variant) -> DataFrame:
    """``hits`` (qid, id, rank, ce_rank, query, label, source_file, section, text) with ``route`` (the query's class),
    ``protected`` and ``guide`` (a guide that may be lifted)."""
    f = v.files
    d = hits.withColumn("route", classify_query(F.col("query"), F.col("label"), v.classes))
    d = d.withColumn("__n", _overlap())
    section, text = F.lower(F.coalesce("section", F.lit(""))), F.coalesce("text", F.lit(""))
    is_guide = (F.col("source_file") == f.guide) & text.rlike(CANDIDATE_WORDS if v.config else CANDIDATE)
    d = d.withColumn("__pool", F.max(F.coalesce(is_guide & (F.col("rank") <= 5), F.lit(False))).over(Window.partitionBy("qid")))
    said = F.concat(F.coalesce("section", F.lit("")), F.lit("\n"), text).rlike(GUIDE)
    structural = (F.col("source_file") == f.structure) | section.contains("src/") | section.contains("source tree") | section.contains("exports")
    env_only = (F.col("source_file") == f.env) & _env_table() & F.col("__pool")
    rule = F.col("__n") >= 2
    if v.config:
        rule = F.when(F.col("route") == "config-env", (F.col("source_file") == f.env) & (F.col("__n") >= 1)).otherwise(rule)
    rule = F.when(F.col("route") == "provider-activation", ~env_only & ((F.col("source_file") == f.guide) | said) & (F.col("__n") >= 2)).when(F.col("route") == "source-navigation", (F.col("__n") >= 1) & structural).otherwise(rule)
    if v.best_only:
        asks = F.array_join(guard_tokens(F.col("query")), " ").rlike(STRUCTURAL_WORDS)
        more = F.when(F.col("source_file") == f.structure, F.when(asks, 5).otherwise(2)).when(section.contains("src/") | section.contains("exports") | section.contains("source tree"), 3).otherwise(0)
        score = F.when((F.col("rank") <= HEAD) & (F.col("__n") >= 2), F.col("__n") * 10 + more - (F.col("rank") - 1))
        first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last(score), "rank")) == 1
        rule = F.when(F.col("route") == "exact-token", first & score.isNotNull()).otherwise(rule)
    held = F.coalesce(rule, F.lit(False)) & (F.col("rank") <= HEAD) & ~F.col("route").isin(*v.idle)
    lifts = (F.col("rank") <= HEAD - 1) & (F.col("route") == "provider-activation") & (F.col("source_file") == f.guide) & said
    return d.withColumns({"protected": held, "guide": F.coalesce(lifts, F.lit(False)) if v.lift else F.lit(False)}).drop("__n", "__pool")


def put_back(order: list, first_order: list, kept: set, slots: bool) -> list:
    """``order`` with what is kept and stands beyond three brought forward. One by one to the third place, so that the
    last comes to stand first of them; or (``slots``) in the first ranking's order to the first places that no kept one
    has, the third at last."""
    far = [x for x in order[HEAD:] if x in kept]
    if not slots:
        head = [x for x in order if x not in far]
        return head[:SLOT] + far[::-1] + head[SLOT:]
    out, at = list(order), 0
    for x in (y for y in first_order if y in far):
        while at < HEAD and out[at] in kept:
            at += 1
        at = min(at, SLOT)
        out.remove(x)
        out.insert(at, x)
        at += 1
    return out


def lift(order: list, guides: list) -> list:
    """``order`` with a guide that is third put second."""
    out = list(order)
    for g in guides:
        if len(out) > SLOT and out[SLOT] == g:
            out.remove(g)
            out.insert(SLOT - 1, g)
    return out


def _reordered(marked: DataFrame, slots: bool) -> DataFrame:
    def one(p: pd.DataFrame) -> pd.DataFrame:
        order = p.sort_values("ce_rank")["id"].tolist()
        head = p.sort_values("rank")
        new = put_back(order, head["id"].tolist(), set(p["id"][p["protected"]]), slots)
        new = lift(new, head["id"][head["guide"]].tolist())
        place = {x: i + 1 for i, x in enumerate(new)}
        return pd.DataFrame({"qid": p["qid"], "id": p["id"], "route": p["route"], "new_rank": p["id"].map(place), "fired": new != order})

    kind = marked.schema["id"].dataType.simpleString()
    q = marked.schema["qid"].dataType.simpleString()
    return marked.select("qid", "id", "rank", "ce_rank", "route", "protected", "guide").groupBy("qid").applyInPandas(one, f"qid {q}, id {kind}, route string, new_rank bigint, fired boolean")


def ce_guard(hits: DataFrame, variant: str | Variant = "v4") -> DataFrame:
    """(qid, id, route, new_rank, fired) of hits under a guard; ranks count from 1."""
    v = VARIANTS[variant] if isinstance(variant, str) else variant
    return _reordered(protected(hits, v), v.slots)


def oracle_guard(hits: DataFrame, qrels: DataFrame, least: int = 3) -> DataFrame:
    """The same with what the judgements (qid, id, rel) grade ``least`` or more protected: what a guard could do at best
    by this way of putting back."""
    good = qrels.filter(F.col("rel") >= least).select("qid", "id").distinct().withColumn("__g", F.lit(True))
    d = hits.join(good, ["qid", "id"], "left")
    d = d.withColumns({"route": F.lit("oracle"), "protected": F.coalesce("__g", F.lit(False)) & (F.col("rank") <= HEAD), "guide": F.lit(False)})
    return _reordered(d, False)
