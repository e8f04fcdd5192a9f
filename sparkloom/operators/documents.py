"""Documents put together again from their chunks, whole or as windows around an anchor.

A scope (a file or a section) is the unit: its chunks are one array, and each scope is handled by itself, so scopes
are spread over tasks and no fold crosses them.
"""

from __future__ import annotations

import base64
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import count_heuristic

# Modes, warnings, what stands for an entity that is too long, and the cursor's form.
ENTITY_REFS, PLACEHOLDER_FALLBACK, PLAIN_CHUNKS = "entity_refs", "placeholder_fallback", "plain_chunks"
STRUCTURAL = ("table", "code_block", "checklist")
OVERSIZED_NOTE = (
    "This entity exceeds the requested token budget and was not included inline. "
    "Request it explicitly with qdrant_get_node (primarily for user display), "
    "not as evidence to assemble into an answer."
)
CURSOR_PREFIX, CURSOR_VERSION = "ac1.", 1
_PLACEHOLDER = re.compile(r"^\[(?:table|code block|checklist) node: (.*)\]$")
CHUNK = "struct<chunk_index: int, node_path: string, node_type: string, section: string, text: string, raw_content: string, entity_path: string, refs: array<struct<placeholder: string, node_path: string>>>"
SEGMENT = "struct<kind: string, node_path: string, chunk_index: int, node_type: string, content: string>"
WARNING = "struct<code: string, chunk_index: int, placeholder: string>"
DOCUMENT = f"scope string, mode string, segments array<{SEGMENT}>, warnings array<{WARNING}>"


def _marks(text: str) -> list[tuple[int, str, str]]:
    """(line number, line, what it names) of the placeholder lines of a text."""
    found = ((i, x.strip(), _PLACEHOLDER.match(x.strip())) for i, x in enumerate(text.split("\n")))
    return [(i, line, m[1]) for i, line, m in found if m]


def _without(text: str, gone: set[int]) -> str:
    """A text without some of its lines, and without the gaps that they leave."""
    if not gone:
        return text
    rest = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return re.sub(r"\n{3,}", "\n\n", rest).strip("\n")


def assemble_scope(chunks: list[dict]) -> tuple[str, list[dict], list[dict]]:
    """(mode, segments, warnings) of a scope's chunks in order.

    Entities stand at their own places, so the placeholders that name them leave the prose: each one that a stored
    reference covers (as often as the reference is stored), and, in fallback, each further one that the longest
    fitting path of its section's entities answers to. What names nothing here stays and is told. Prose that is
    left empty goes. Chunks without structure are prose as they are.
    """
    is_entity = lambda c: c["node_type"] in STRUCTURAL
    if not any(c["node_path"] for c in chunks):
        return PLAIN_CHUNKS, [_segment(c, "prose", c["text"] or "") for c in chunks], []
    here = {p for c in chunks if is_entity(c) for p in (c["node_path"], c["entity_path"]) if p}
    by_section: dict = {}
    for c in chunks:
        if is_entity(c):
            by_section.setdefault(c["section"], set()).add(c["entity_path"] or c["node_path"])

    def answers(section: str | None, named: str) -> str | None:
        fits = [p for p in by_section.get(section, ()) if named == p or named.startswith(f"{p} — ")]
        return max(fits, key=len, default=None)

    segments, warnings, fallback = [], [], False
    for c in chunks:
        if is_entity(c):
            segments.append(_segment(c, "entity", c["raw_content"] or c["text"] or ""))
            continue
        text, at = c["text"] or "", c["chunk_index"]
        marks = _marks(text)
        stored = Counter((r["placeholder"], r["node_path"]) for r in c["refs"] or [])
        gone: set[int] = set()
        covered: Counter = Counter()
        for (placeholder, path), n in stored.items():
            places = [i for i, x in enumerate(text.split("\n")) if x.strip() == placeholder and i not in gone][:n]
            covered[placeholder] += n
            if path not in here:
                warnings += [{"code": "ref_entity_missing", "chunk_index": at, "placeholder": placeholder}] * n
                continue
            warnings += [{"code": "ref_placeholder_not_found", "chunk_index": at, "placeholder": placeholder}] * (n - len(places))
            gone |= set(places)
        for i, line, named in marks:
            if covered[line]:
                covered[line] -= 1
            elif answers(c["section"], named):
                fallback = True
                gone.add(i)
            else:
                fallback = True
                warnings.append({"code": "orphan_placeholder", "chunk_index": at, "placeholder": line})
        rest = _without(text, gone)
        if rest.strip():
            segments.append(_segment(c, "prose", rest))
    if fallback:
        warnings.insert(0, {"code": "placeholder_fallback", "chunk_index": None, "placeholder": None})
    return (PLACEHOLDER_FALLBACK if fallback else ENTITY_REFS), segments, warnings


def _segment(c: dict, kind: str, content: str) -> dict:
    return {"kind": kind, "node_path": c["node_path"], "chunk_index": c["chunk_index"], "node_type": c["node_type"], "content": content}


def assemble(chunks: DataFrame) -> DataFrame:
    """(scope, mode, segments, warnings) of chunks (scope and the fields of CHUNK): a scope's chunks are brought
    together, as its document once was one row."""
    fields = [x.split(":")[0].strip() for x in re.sub(r"array<struct<.*?>>|struct<", "", CHUNK).rstrip(">").split(",")]
    one = F.struct(*[F.col(f) for f in fields]).cast(CHUNK)
    scopes = chunks.groupBy("scope").agg(F.array_sort(F.collect_list(one)).alias("chunks"))
    kinds = scopes.sparkSession.createDataFrame([], DOCUMENT).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for b in batches:
            rows = []
            for scope, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mode, segments, warnings = assemble_scope(held)
                rows.append({"scope": scope, "mode": mode, "segments": segments, "warnings": warnings})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return scopes.mapInArrow(run, DOCUMENT)


def encode_cursor(state: dict) -> str:
    return CURSOR_PREFIX + base64.urlsafe_b64encode(json.dumps(state, ensure_ascii=False, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: object) -> dict | None:
    """A cursor's state; None for anything that is not a whole and sound one."""
    if not isinstance(cursor, str) or not cursor.startswith(CURSOR_PREFIX):
        return None
    raw = cursor[len(CURSOR_PREFIX) :]
    try:
        state = json.loads(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)))
    except ValueError:
        return None
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    good = (
        isinstance(state, dict)
        and whole(state.get("v"))
        and bool(state.get("collection")) and isinstance(state["collection"], str)
        and state.get("scope") in ("file", "section")
        and isinstance(state.get("sourceKey"), str)
        and (state.get("anchorNodeId", 0) is None or isinstance(state.get("anchorNodeId"), str))
        and whole(state.get("totalSegments")) and state["totalSegments"] >= 0
        and state.get("dir") in ("before", "after")
        and whole(state.get("edgeIndex")) and 0 <= state["edgeIndex"] < state["totalSegments"]
    )
    return state if good else None


class WindowError(ValueError):
    """invalid_cursor or anchor_not_in_scope."""


class Windows:
    """Windows over one scope's segments under a token budget.

    What a window costs is the count of its contents as they will be written, separators included. A segment that is
    beyond the budget alone stands in a window as a note, and costs what the note does.
    """

    def __init__(self, segments: list[dict], most: int, collection: str, scope: str, source: str, count: Callable[[str], int] = count_heuristic, separator: str = "") -> None:
        self.segments, self.most, self.count, self.separator = segments, most, count, separator
        self.alone = [count(s["content"]) if s["content"] else 0 for s in segments]
        ends = [s["node_path"] or f"chunkIndex:{s['chunk_index']}" for s in (segments[:1] + segments[-1:])]
        self.request = {"v": CURSOR_VERSION, "collection": collection, "scope": scope, "sourceKey": json.dumps([source, *ends], ensure_ascii=False), "totalSegments": len(segments)}

    def shown(self, i: int) -> str:
        return OVERSIZED_NOTE if self.alone[i] > self.most else self.segments[i]["content"]

    def cost(self, low: int, high: int) -> int:
        text = self.separator.join(x for x in map(self.shown, range(low, high + 1)) if x)
        return self.count(text) if text else 0

    def fits(self, low: int, high: int) -> bool:
        return self.cost(low, high) <= self.most

    def _page(self, low: int, high: int, anchor: str | None) -> dict:
        """``high`` below ``low``: an empty page."""
        items = [self.segments[i] | {"oversized": self.alone[i] > self.most, "tokens": self.alone[i], "content": None if self.alone[i] > self.most else self.segments[i]["content"]} for i in range(low, high + 1)]
        more = {"before": low > 0, "after": high < len(self.segments) - 1}
        cursor = lambda way, edge: encode_cursor(self.request | {"anchorNodeId": anchor, "dir": way, "edgeIndex": edge}) if items and more[way] else None
        return {"items": items, "returned": self.cost(low, high) if items else 0, "before": more["before"], "after": more["after"], "cursor_before": cursor("before", low), "cursor_after": cursor("after", high)}

    def around(self, anchor: str) -> dict:
        """The whole scope where it fits; else the anchor and what lies around it, one before and one after in turn, as
        long as either fits."""
        at = next((i for i, s in enumerate(self.segments) if s["node_path"] == anchor), None)
        if at is None:
            raise WindowError("anchor_not_in_scope")
        last = len(self.segments) - 1
        whole = self.separator.join(s["content"] for s in self.segments if s["content"])
        if (self.count(whole) if whole else 0) <= self.most:
            page = self._page(0, last, anchor)
            return page | {"items": [s | {"oversized": False, "tokens": n} for s, n in zip(self.segments, self.alone, strict=True)]}
        if not self.fits(at, at):
            return self._page(at, at - 1, anchor) | {"before": at > 0, "after": at < last}
        low = high = at
        backwards = True
        while True:
            can = {True: low > 0 and self.fits(low - 1, high), False: high < last and self.fits(low, high + 1)}
            if not any(can.values()):
                return self._page(low, high, anchor)
            way = backwards if can[backwards] else not backwards
            low, high = (low - 1, high) if way else (low, high + 1)
            backwards = not backwards

    def next_page(self, cursor: str, anchor: str | None) -> dict:
        """What follows a window on the cursor's side, as far as it fits."""
        state = decode_cursor(cursor)
        if state is None or any(state[k] != v for k, v in (self.request | {"anchorNodeId": anchor}).items()):
            raise WindowError("invalid_cursor")
        if state["dir"] == "before":
            high = state["edgeIndex"] - 1
            low = high + 1
            while low > 0 and self.fits(low - 1, high):
                low -= 1
        else:
            low = state["edgeIndex"] + 1
            high = low - 1
            while high < len(self.segments) - 1 and self.fits(low, high + 1):
                high += 1
        return self._page(low, high, anchor)

    def walk(self, anchor: str) -> list[dict]:
        """The window around an anchor and all pages on both its sides."""
        first = self.around(anchor)
        pages = [first]
        for way in ("before", "after"):
            cursor = first[f"cursor_{way}"]
            while cursor:
                page = self.next_page(cursor, anchor)
                pages.append(page)
                cursor = page[f"cursor_{way}"]
        return pages


WINDOW = "scope string, anchor string, error string, first int, last int, returned bigint, before boolean, after boolean, oversized int, pages int, seen int"


def windows(documents: DataFrame, anchors: DataFrame, most: int, collection: str = "main", count: Callable[[str], int] = count_heuristic, separator: str = "\n\n", follow: bool = False) -> DataFrame:
    """(scope, anchor, error, first, last, returned, before, after, oversized, pages, seen) for each anchor (scope, anchor)
    in its assembled document: the window's first and last segment, and (``follow``) how many pages the cursors
    lead to and how many different segments they show."""
    d = documents.select("scope", "segments").join(anchors, "scope").select("scope", "anchor", "segments")
    kinds = d.sparkSession.createDataFrame([], WINDOW).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for b in batches:
            rows = []
            for scope, anchor, segments in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                w = Windows(segments, most, collection, "file", scope, count, separator)
                try:
                    pages = w.walk(anchor) if follow else [w.around(anchor)]
                except WindowError as e:
                    rows.append({"scope": scope, "anchor": anchor, "error": str(e)})
                    continue
                at = {id_of: i for i, id_of in enumerate((s["node_path"], s["chunk_index"]) for s in segments)}
                shown = [[at[x["node_path"], x["chunk_index"]] for x in p["items"]] for p in pages]
                one = pages[0]
                rows.append({
                    "scope": scope, "anchor": anchor, "error": None, "first": min(shown[0], default=None), "last": max(shown[0], default=None), "returned": one["returned"],
                    "before": one["before"], "after": one["after"], "oversized": sum(x["oversized"] for x in one["items"]), "pages": len(pages), "seen": len({i for p in shown for i in p}),
                })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return d.mapInArrow(run, WINDOW)


def anchored_errors(points: DataFrame, anchors: DataFrame, scope: str = "file") -> DataFrame:
    """(anchor, error) of each wanted anchor: anchor_not_found, anchor_is_navigation, or (for a section) no_section_scope
    where the anchor's parent is no section; null where there is none. ``points``: (node_id, point_kind, node_type,
    parent_id, source_file)."""
    p = points.select("node_id", "point_kind", "parent_id", "source_file")
    parents = points.filter(F.col("node_type") == "section").select(F.col("node_id").alias("parent_id"), F.lit(True).alias("has_section")).distinct()
    d = anchors.join(p, anchors["anchor"] == p["node_id"], "left").join(parents, "parent_id", "left")
    nav = F.coalesce("point_kind", F.lit("")) == "skeleton_nav"
    error = F.when(F.col("node_id").isNull(), "anchor_not_found").when(nav, "anchor_is_navigation").when(F.col("source_file").isNull(), "anchor_not_found")
    if scope == "section":
        error = error.when(F.col("has_section").isNull(), "no_section_scope")
    return d.select("anchor", error.alias("error"))
