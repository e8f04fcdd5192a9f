"""What may be plugged in: storage, token counters, embedders, generators, rerankers, agent tools, settings."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: text -> tokens, called in the splitters' tasks.
TokenCounter = Callable[[str], int]


@runtime_checkable
class Embedder(Protocol):
    """Texts to vectors of one profile; both keep the key column and add ``vec``."""

    def embed_for_index(self, texts: DataFrame, key: str) -> DataFrame: ...

    def embed_for_search(self, texts: DataFrame, key: str) -> DataFrame: ...


@runtime_checkable
class Generator(Protocol):
    """Prompts to answers; null where it has none."""

    def name(self) -> str: ...

    def capabilities(self) -> dict: ...

    def ready(self) -> bool: ...

    def generate(self, prompt: Column) -> Column: ...


@runtime_checkable
class Reranker(Protocol):
    """A deterministic reordering of hits, and a second scorer (null where it fails)."""

    def rerank(self, hits: DataFrame, limit: int) -> DataFrame: ...

    def score(self, query: Column, passage: Column) -> Column: ...


# What a storage adapter and a generator must offer.
ADAPTER_METHODS = """
name capabilities ping list_collections get_collection create_collection delete_collection ensure_collection_schema get_embedding_profile
set_embedding_profile set_indexing_state migrate_embedding_profile list_source_documents get_chunk get_file_chunks get_section_chunks
search_hybrid_vectors search_hybrid_inference check_cloud_inference_reachable probe_inference get_skeleton_root get_skeleton_node
get_skeleton_children get_content_node get_section_anchor
""".split()
GENERATOR_METHODS = ("name", "capabilities", "ready", "generate")


def _validated(thing: object, methods, what: str) -> None:
    if thing is None:
        raise TypeError(f"a {what} must be an object")
    missing = [m for m in methods if not callable(getattr(thing, m, None))]
    if missing:
        raise TypeError(f"a {what} lacks {', '.join(missing)}")
    if not isinstance(thing.capabilities(), dict):
        raise TypeError(f"the capabilities of a {what} must be a mapping")


def validate_adapter(adapter: object) -> None:
    _validated(adapter, ADAPTER_METHODS, "storage adapter")


def validate_generator(generator: object) -> None:
    _validated(generator, GENERATOR_METHODS, "generator")


class HashedEmbedder:
    """The default: deterministic vectors from sparse weights."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed_for_index(self, texts: DataFrame, key: str) -> DataFrame:
        from .operators.retrieval import dense_vectors, hashed_embedding

        return dense_vectors(hashed_embedding(texts, key, size=self.size), key, self.size)

    embed_for_search = embed_for_index


class FirstSentence:
    """A generator without a model: the first sentence of the prompt's last paragraph."""

    def name(self) -> str:
        return "first-sentence"

    def capabilities(self) -> dict:
        return {"deterministic": True}

    def ready(self) -> bool:
        return True

    def generate(self, prompt: Column) -> Column:
        last = F.element_at(F.split(prompt, "\n\n"), -1)
        return F.nullif(F.trim(F.regexp_extract(last, r"^[^.!?\n]*[.!?]?", 0)), F.lit(""))


class WordOverlap:
    """A reranker without a model."""

    def rerank(self, hits: DataFrame, limit: int) -> DataFrame:
        from .operators.retrieval import rerank_diverse, rerank_scores

        return rerank_diverse(rerank_scores(hits), limit)

    def score(self, query: Column, passage: Column) -> Column:
        words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0))
        return F.size(F.array_intersect(words(query), words(passage))).cast("double")


@dataclass(frozen=True)
class Setting:
    """A typed setting. What comes from outside as text and is not of the type or out of bounds counts as the
    default; a value given as such is refused."""

    name: str
    kind: str  # int, float, bool, enum, string
    default: Any
    low: float = -math.inf
    high: float = math.inf
    allowed: tuple[str, ...] = ()

    def parse(self, raw: str | None) -> Any:
        if raw is None or (raw == "" and self.kind != "bool"):
            return self.default
        if self.kind == "bool":
            return raw in ("1", "true")
        if self.kind == "string":
            return raw
        if self.kind == "enum":
            return raw if raw in self.allowed else self.default
        found = re.match(r"\s*[+-]?\d+" if self.kind == "int" else r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", raw)
        if not found:
            return self.default
        value = int(found[0]) if self.kind == "int" else float(found[0])
        return value if self.low <= value <= self.high else self.default

    def validate(self, value: Any) -> str | None:
        """What is wrong with a value, or None."""
        number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
        good = {
            "int": number and float(value).is_integer() and self.low <= value <= self.high if number else False,
            "float": number and self.low <= value <= self.high if number else False,
            "bool": isinstance(value, bool),
            "enum": value in self.allowed,
            "string": isinstance(value, str) and value != "",
        }[self.kind]
        return None if good else f"{self.name} must be {self.kind} within its bounds"

    def column(self, raw: Column) -> Column:
        """``parse`` over a column of texts, as text."""
        default = F.lit(self.default)
        if self.kind == "bool":
            return F.when(raw.isNull(), default).otherwise(raw.isin("1", "true")).cast("string")
        if self.kind == "enum":
            return F.when(F.coalesce(raw.isin(*self.allowed), F.lit(False)), raw).otherwise(default.cast("string"))
        if self.kind == "string":
            return F.coalesce(F.nullif(raw, F.lit("")), default)
        pattern, kind = (r"^\s*([+-]?\d+)", "bigint") if self.kind == "int" else (r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", "double")
        value = F.regexp_extract(raw, pattern, 1).try_cast(kind)
        return F.when(value.between(F.lit(self.low), F.lit(self.high)), value).otherwise(default.cast(kind)).cast("string")


# Settings that results depend on, with their defaults and bounds.
SETTINGS = {
    s.name: s
    for s in (
        Setting("MAX_CHUNK_TOKENS", "int", 512, 1, 100_000),
        Setting("MIN_CHUNK_TOKENS", "int", 160, 0, 100_000),
        Setting("CHUNK_OVERLAP_TOKENS", "int", 80, 0, 100_000),
        Setting("OVERLAP_SENTENCES", "int", 2, 0, 100),
        Setting("LLM_BATCH_SIZE", "int", 3, 1, 64),
        Setting("SKELETON_SUMMARY", "enum", "deterministic", allowed=("deterministic", "llm")),
        Setting("SKELETON_CARRYOVER_CHARS", "int", 500, 0, 100_000),
        Setting("SUMMARY_LANG", "string", "auto"),
        Setting("TAG_GEN", "bool", False),
        Setting("HYBRID_PREFETCH_LIMIT", "int", 2, 1, 100),
        Setting("RRF_K", "int", 60, 1, 10_000),
        Setting("RERANK_BOOST_SOURCE_FILE", "float", 0.08, 0, 10),
        Setting("RERANK_BOOST_SECTION", "float", 0.06, 0, 10),
        Setting("RERANK_BOOST_TAGS", "float", 0.05, 0, 10),
        Setting("RERANK_BOOST_TEXT", "float", 0.01, 0, 10),
        Setting("RERANK_PROTECT_TOP1_DELTA", "float", 0.05, 0, 10),
        Setting("RERANK_PENALTY_INTRO_CHUNK", "float", 0.02, 0, 10),
    )
}


def resolve(values: dict[str, str | None]) -> dict[str, Any]:
    """Every setting's active value from texts by name; names that are none are refused."""
    unknown = sorted(set(values) - set(SETTINGS))
    if unknown:
        raise KeyError(f"no such setting: {', '.join(unknown)}")
    return {name: s.parse(values.get(name)) for name, s in SETTINGS.items()}


# Limits of the tools that an agent may be given, and the keywords their schemas may use.
MOST_TOOLS, MOST_NAME, MOST_DESCRIPTION, MOST_DEPTH, MOST_NODES, MOST_PROPERTIES, MOST_ENUM, MOST_BYTES = 32, 64, 1024, 5, 200, 50, 50, 64 * 1024
SCHEMA_KEYS = {"type", "description", "properties", "required", "additionalProperties", "items", "enum"}
SCALARS = {"string": str, "boolean": bool, "integer": int, "number": (int, float)}


class ToolError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def _require(good: bool, code: str, message: str) -> None:
    if not good:
        raise ToolError(code, message)


def _node(node: Any, path: str, depth: int) -> int:
    """How many nodes a schema has; keywords that would not be enforced are refused."""
    _require(depth <= MOST_DEPTH, "schema_too_deep", f"{path} is nested too deep")
    _require(isinstance(node, dict), "invalid_schema", f"{path} must be an object")
    _require(set(node) <= SCHEMA_KEYS, "unsupported_schema_keyword", f"{path}: {sorted(set(node) - SCHEMA_KEYS)}")
    kind = node.get("type")
    _require(kind in {*SCALARS, "object", "array"}, "unsupported_type", f"{path}: {kind}")
    values = node.get("enum")
    if values is not None:
        of = SCALARS.get(kind)
        same = of is not None and all(isinstance(v, of) and (kind == "boolean" or not isinstance(v, bool)) for v in values)
        _require(bool(values) and len(values) <= MOST_ENUM and same, "invalid_enum", f"{path} has an enum of another type, or an empty or too long one")
    total = 1
    if kind == "object":
        properties = node.get("properties", {})
        _require(isinstance(properties, dict) and len(properties) <= MOST_PROPERTIES, "too_many_properties", path)
        _require(set(node.get("required", [])) <= set(properties), "invalid_required", path)
        total += sum(_node(v, f"{path}.{k}", depth + 1) for k, v in properties.items())
    elif kind == "array":
        _require("items" in node, "missing_items", path)
        total += _node(node["items"], f"{path}[]", depth + 1)
    return total


def validate_tools(tools: list[dict]) -> None:
    """Names, descriptions and schemas of agent tools within the limits; ToolError tells what is not."""
    _require(isinstance(tools, list) and len(tools) <= MOST_TOOLS, "too_many_tools", f"at most {MOST_TOOLS} tools")
    _require(len(json.dumps(tools).encode()) <= MOST_BYTES, "tools_too_large", f"at most {MOST_BYTES} bytes")
    names = [t.get("name") for t in tools]
    for t in tools:
        name = t.get("name")
        _require(isinstance(name, str) and len(name) <= MOST_NAME and bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name)), "invalid_name", f"{name}")
        _require(len(t.get("description") or "") <= MOST_DESCRIPTION, "description_too_long", name)
        schema = t.get("parameters")
        _require(isinstance(schema, dict) and schema.get("type") == "object", "invalid_schema", f"{name}: parameters must be an object schema")
        _require(_node(schema, name, 1) <= MOST_NODES, "schema_too_large", name)
    _require(len(set(names)) == len(names), "duplicate_name", "two tools have one name")
