"""Markdown structure and token-budget chunking.

Row-wise parsers run as Arrow batches over files; a file is one row, so no fold crosses tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heuristic_tokens, sentences

# Budgets, and what becomes of each node type.
MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS, OVERLAP_SENTENCES = 512, 160, 80, 2
TINY_LINES, TINY_TOKENS, TINY_ONE_LINE, LEAST_CONTENT = 2, 12, 16, 4
NODE_POLICY = {
    "paragraph": ("chunk_text", "retrieval_content"),
    "list": ("chunk_text", "retrieval_content"),
    "blockquote": ("chunk_text", "retrieval_content"),
    "table": ("payload_raw_embed_context", "retrieval_content"),
    "code_block": ("payload_raw_embed_context", "retrieval_content"),
    "checklist": ("payload_raw_embed_context", "retrieval_content"),
    "section": ("nav_summary", "skeleton_nav"),
    "file": ("nav_summary", "skeleton_nav"),
    "collection": ("nav_summary", "skeleton_nav"),
    "image": ("future_processor", "skeleton_nav"),
    "frontmatter": ("payload_metadata_only", None),
    "unknown": ("chunk_text", "retrieval_content"),
}
NODE_SCHEMA = "source_file string, node_type string, heading_path string, structural_path string, ordinal int, start_line int, end_line int, node_order int, text string"
_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
_RULE = re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$")
_CHECKED = re.compile(r"^\s*[-*+]\s+\[[ xX]\]\s", re.M)
_IMAGE = re.compile(r"^!\[[^\]]*\]\([^)]*\)$")
_HTML = re.compile(r"^ {0,3}<(?:[A-Za-z/!?])")
_DEFINITION = re.compile(r"^ {0,3}\[(\^?[^\]]+)\]:\s")
_DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def slug(text: str) -> str:
    s = re.sub(r"[\W_]+", "-", text.lower()).strip("-")
    return s[:60] or "section"


def blocks(markdown: str) -> Iterator[tuple[str, int, int, list[str]]]:
    """(type, first line, last line, lines) of the top-level blocks; a heading's level stands in its type."""
    lines = markdown.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    i, n = 0, len(lines)
    if lines[0] == "---" and "---" in lines[1:]:
        end = lines.index("---", 1)
        yield "frontmatter", 0, end, lines[: end + 1]
        i = end + 1
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        start = i
        if fence := _FENCE.match(line):
            mark = fence[1]
            i += 1
            while i < n and not (lines[i].strip().startswith(mark) and set(lines[i].strip()) == {mark[0]}):
                i += 1
            i = min(i + 1, n)
            yield "code_block", start, i - 1, lines[start:i]
        elif heading := _HEADING.match(line):
            i += 1
            yield f"heading{len(heading[1])}", start, start, [heading[2]]
        elif _RULE.match(line):
            i += 1
        elif "|" in line and i + 1 < n and "-" in lines[i + 1] and _DELIMITER.match(lines[i + 1]):
            while i < n and lines[i].strip() and "|" in lines[i]:
                i += 1
            yield "table", start, i - 1, lines[start:i]
        elif _ITEM.match(line):
            while i < n and (lines[i].strip() or (i + 1 < n and (_ITEM.match(lines[i + 1]) or lines[i + 1].startswith("  ")))) and not _HEADING.match(lines[i]) and not _FENCE.match(lines[i]):
                i += 1
            yield "list", start, i - 1, lines[start:i]
        elif line.lstrip().startswith(">"):
            while i < n and lines[i].strip() and not _HEADING.match(lines[i]):
                i += 1
            yield "blockquote", start, i - 1, lines[start:i]
        elif _HTML.match(line) and not re.match(r"^ {0,3}<[a-z][a-z0-9+.-]*:", line):
            while i < n and lines[i].strip():
                i += 1
            yield "html", start, i - 1, lines[start:i]
        elif mark := _DEFINITION.match(line):
            i += 1
            yield ("footnoteDefinition" if mark[1].startswith("^") else "definition"), start, start, lines[start:i]
        else:
            i += 1
            while i < n and lines[i].strip() and not (_HEADING.match(lines[i]) or _FENCE.match(lines[i]) or lines[i].lstrip().startswith(">") or _ITEM.match(lines[i]) and not lines[i].lstrip()[0].isdigit()):
                if re.match(r"^ {0,3}(=+|-+)\s*$", lines[i]):
                    break
                i += 1
            if i < n and re.match(r"^ {0,3}(=+|-+)\s*$", lines[i]):
                level = 1 if "=" in lines[i] else 2
                yield f"heading{level}", start, i, [" ".join(x.strip() for x in lines[start:i])]
                i += 1
            else:
                yield "paragraph", start, i - 1, lines[start:i]


@dataclass
class Node:
    """A block of a file: ``path`` is that of the section it stands in, of a section its own."""

    kind: str
    headings: tuple[str, ...]
    path: str
    ordinal: int
    first: int
    last: int
    order: int
    text: str
    source_type: str
    warning: str | None = None


def outline(markdown: str) -> list[Node]:
    """All nodes of a file in order, sections included. A block of a kind that nothing is known of is ``unknown`` and
    says so."""
    stack: list[tuple[int, str]] = []
    seen: Counter = Counter()
    out: list[Node] = []

    def add(kind: str, path: str, first: int, last: int, text: str, source_type: str, warning: str | None = None, parent: str | None = None) -> None:
        at = (path if parent is None else parent, kind)
        seen[at] += 1
        out.append(Node(kind, tuple(s[1] for s in stack), path, seen[at], first + 1, last + 1, len(out), text, source_type, warning))

    for kind, first, last, lines in blocks(markdown):
        text = "\n".join(lines).strip("\n")
        if kind.startswith("heading"):
            level, title = int(kind[7:]), text.replace("**", "").strip()
            parent = [s for s in stack if s[0] < level]
            stack = [*parent, (level, title)]
            add("section", "/".join(slug(s[1]) for s in stack), first, last, title, "heading", parent="/".join(slug(s[1]) for s in parent))
            continue
        path = "/".join(slug(s[1]) for s in stack)
        if kind in ("html", "definition", "footnoteDefinition"):
            add("unknown", path, first, last, text, kind, f"no node type for {kind}")
        elif kind == "paragraph" and _IMAGE.match(text.strip()):
            add("image", path, first, last, text, kind)
        elif kind == "list" and _CHECKED.search(text):
            add("checklist", path, first, last, text, kind)
        else:
            add(kind, path, first, last, text, kind)
    return out


def skeleton(source_file: str, markdown: str) -> list[tuple]:
    """Flat content nodes with heading path, slug path and an ordinal among the same type below one parent."""
    content = [n for n in outline(markdown) if n.kind != "section"]
    return [(source_file, n.kind, " › ".join(n.headings), n.path, n.ordinal, n.first, n.last, i, n.text) for i, n in enumerate(content)]


def md_skeleton(files: DataFrame) -> DataFrame:
    """Node rows of (source_file, markdown); a null file has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for f, m in zip(b["source_file"], b["markdown"], strict=True) for r in skeleton(f, m or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    return files.select("source_file", "markdown").mapInPandas(run, NODE_SCHEMA)


WARNING_SCHEMA = "source_file string, kind string, source_type string, node_type string, start_line int, end_line int, reason string, excerpt string"


def skeleton_warnings(files: DataFrame, most: int = 200) -> DataFrame:
    """A row for each node that nothing is known of, with what it was and the first ``most`` characters (the excerpt)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, "unknown_node", n.source_type, n.kind, n.first, n.last, n.warning, n.text[:most]) for f, m in zip(b["source_file"], b["markdown"], strict=True) for n in outline(m or "") if n.warning]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WARNING_SCHEMA.split(", ")])

    return files.select("source_file", "markdown").mapInPandas(run, WARNING_SCHEMA)


def tiny_code(node_type: Column, text: Column) -> Column:
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    tokens = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    return (node_type == "code_block") & ~(((lines >= TINY_LINES) & (tokens >= TINY_TOKENS)) | (tokens >= TINY_ONE_LINE))


def node_policy(nodes: DataFrame) -> DataFrame:
    """Adds policy and point_kind; tiny code merges with its parent, an unknown type is text."""
    tiny = tiny_code(F.col("node_type"), F.col("text"))
    known = F.when(F.col("node_type").isin(*NODE_POLICY), F.col("node_type")).otherwise("unknown")
    policy = F.create_map(*[F.lit(x) for k, v in NODE_POLICY.items() for x in (k, v[0])])
    kind = F.create_map(*[F.lit(x) for k, v in NODE_POLICY.items() if v[1] for x in (k, v[1])])
    return nodes.withColumns({"policy": F.when(tiny, "merge_with_parent").otherwise(policy[known]), "point_kind": F.when(~tiny, F.try_element_at(kind, known))})


def content_bearing(kind: Column, node_type: Column, text: Column) -> Column:
    """A structural node, or text with a few meaningful words beside headings and placeholders."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*(#{1,6}\s|\[(table|code block|checklist|list|image) node: .*\]\s*$)"))
    words = F.size(F.filter(F.split(F.array_join(lines, " "), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))
    return (kind == "retrieval_content") & (node_type.isin("table", "code_block", "checklist") | (words >= LEAST_CONTENT))


def legacy_sections(files: DataFrame) -> DataFrame:
    """(source_file, section, n_lines): lines under the last heading before them; a heading (``#`` or underlined) is at
    most 120 characters and does not end like a sentence. The underline of a heading is no line of a section."""
    lines = files.select("source_file", F.posexplode(F.split("markdown", "\n")).alias("at", "line"))
    by_file = Window.partitionBy("source_file").orderBy("at")
    lines = lines.withColumns({"next": F.lead("line").over(by_file), "before": F.lag("line").over(by_file)})
    plain = lambda c: F.trim(F.replace(c, F.lit("**"), F.lit("")))
    good = lambda c: (c != "") & (F.length(c) <= 120) & ~c.rlike(r"[.!?]$")
    rule = lambda c: F.coalesce(c.rlike(r"^(={2,}|-{2,})$"), F.lit(False))
    # a line of dashes below a heading's underline is none itself: what it stands below is an underline, not a title
    titled = lambda c: F.coalesce((F.trim(c) != "") & good(plain(c)) & ~rule(c), F.lit(False))
    raw = plain(F.regexp_extract("line", r"^#{1,6} (.+)", 1))
    own = F.when(rule(F.col("next")) & titled(F.col("line")), plain(F.col("line"))).when(good(raw), raw)
    under = rule(F.col("line")) & titled(F.col("before"))
    marked = lines.withColumn("h", F.when(~under, own)).withColumn("under", under)
    w = by_file.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("no", F.count("h").over(w)).withColumn("section", F.coalesce(F.last("h", True).over(w), F.lit("")))
    return marked.filter("h is null and not under").groupBy("source_file", "no", "section").agg(F.count("*").alias("n_lines")).drop("no")


def count_heuristic(text: str) -> int:
    return -(-len(text) // 4)


def _sentences(text: str) -> list[str]:
    found = [s.strip() for s in re.findall(r"[^.!?\n]+[.!?\n]+|[^.!?\n]+$", text)]
    return [s for s in found if s] or [text]


Count = Callable[[str], int]


def _paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\n+", text) if p.strip()]


#: From coarse to fine: how a text is taken apart, and what stands between the parts when they are put together.
_LEVELS: tuple[tuple[Callable[[str], list[str]], str], ...] = ((_paragraphs, "\n\n"), (_sentences, " "), (str.split, " "))


class Pile:
    """Units put together in order. It tells what the pile would count with one more, without joining it anew where
    the count is the heuristic one (which goes by length) or is ``summed`` over the units."""

    def __init__(self, glue: str, count: Count, summed: bool = False) -> None:
        self.glue, self.count, self.summed = glue, count, summed
        self.clear()

    def clear(self) -> None:
        self.units: list[str] = []
        self.chars = self.total = self.total_now = 0

    def with_one(self, unit: str) -> int:
        if self.summed:
            return self.total + self.count(unit)
        if self.count is count_heuristic:
            return -(-(self.chars + len(self.glue) * bool(self.units) + len(unit)) // 4)
        return self.count(self.glue.join([*self.units, unit]))

    def add(self, unit: str) -> None:
        self.chars += len(self.glue) * bool(self.units) + len(unit)
        self.total += self.count(unit) if self.summed else 0
        self.units.append(unit)

    def take(self) -> list[str]:
        units = self.units
        self.clear()
        return units


def packed(units: list[str], most: int, glue: str, count: Count, summed: bool = False) -> Iterator[list[str]]:
    """Groups of units in order, each as long as the budget lets it be; a unit beyond the budget is a group alone."""
    pile = Pile(glue, count, summed)
    for unit in units:
        if pile.units and (count(unit) > most or pile.with_one(unit) > most):
            yield pile.take()
        pile.add(unit)
        if len(pile.units) == 1 and count(unit) > most:
            yield pile.take()
    if pile.units:
        yield pile.take()


def char_split(text: str, most: int, count: Callable[[str], int] = count_heuristic) -> list[str]:
    """Greedy longest pieces within the budget, each of one character at least; joined they are the text."""
    out, i = [], 0
    while i < len(text):
        low, high = 1, len(text) - i
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count(text[i : i + mid]) <= most else (low, mid - 1)
        out.append(text[i : i + low])
        i += low
    return out


def recursive_split(text: str, most: int = MAX_TOKENS, count: Count = count_heuristic, strict: bool = False) -> list[str]:
    """Paragraphs, sentences, then words, packed while the sum of their counts fits. ``strict``: the joined
    text is counted, and what still does not fit is cut by characters; every piece is then within the budget."""
    whole = re.sub(r"\n{3,}", "\n\n", text.replace("\r\n", "\n").replace("\r", "\n")).strip()
    pieces = [whole] if whole else []
    for split, glue in _LEVELS:
        finer: list[str] = []
        for piece in pieces:
            units = split(piece) if count(piece) > most else [piece]
            finer += [glue.join(g) for g in packed(units, most, glue, count, summed=not strict)] if len(units) > 1 else [piece]
        pieces = finer
    if strict:
        pieces = [cut for p in pieces for cut in (char_split(p, most, count) if count(p) > most else [p])]
        if any(count(p) > most for p in pieces):
            raise ValueError("a piece is above the budget, which a single character exceeds")
    return pieces


def sentence_pack(text: str, most: int = MAX_TOKENS, count: Count = count_heuristic) -> list[str]:
    """Sentences until the joined text reaches the budget, which it may pass."""
    out, pile = [], Pile(" ", count)
    for s in _sentences(text):
        reached = pile.with_one(s) >= most
        pile.add(s)
        if reached:
            out.append(" ".join(pile.take()))
    return [*out, " ".join(pile.units)] if pile.units else out


def merge_short(pieces: list[str], least: int = MIN_TOKENS, count: Count = count_heuristic, scopes: list | None = None) -> list[str]:
    """A piece below ``least`` takes the ones after it of its scope, or joins the one before where none is left."""
    scopes = scopes if scopes is not None else [None] * len(pieces)
    out: list[tuple[object, str]] = []
    short: Pile | None = None
    of: object = None

    def settle() -> None:
        nonlocal short
        if short is None:
            return
        held, short_one = "\n\n".join(short.units), short.total_now < least
        short = None
        if short_one and out and out[-1][0] == of:
            out[-1] = (of, out[-1][1] + "\n\n" + held)
        else:
            out.append((of, held))

    for piece, scope in zip(pieces, scopes, strict=True):
        if short is not None and (short.total_now >= least or scope != of):
            settle()
        if short is None:
            short, of = Pile("\n\n", count), scope
        now = short.with_one(piece)
        short.add(piece)
        short.total_now = now
    settle()
    return [text for _, text in out]


def greedy_group(units: list[str], most: int, count: Count = count_heuristic) -> list[list[str]]:
    """Units in order, a new group where the joined one would pass the budget."""
    return list(packed(units, most, "\n", count))


class RowUnsplittable(ValueError):
    """A table's row whose header and labels alone are above the budget."""

    code = "TABLE_ROW_UNSPLITTABLE"


def _longest(text: str, fits: Callable[[str], bool]) -> int:
    """How many characters of ``text`` fit, by bisection; fitting only ends, it does not begin again."""
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if fits(text[:mid]) else (low, mid - 1)
    return low


def _cells(line: str) -> list[str]:
    bare = re.sub(r"^\|", "", line.strip())
    bare = re.sub(r"(?<!\\)\|$", "", bare)
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", bare)]


class Table:
    """A table's header and rows, and its rows within a budget."""

    def __init__(self, text: str, most: int, count: Count) -> None:
        lines = text.split("\n")
        first = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
        good = first + 1 < len(lines) and "-" in lines[first + 1] and re.match(r"^\|?[\s:|-]+\|?$", lines[first + 1].strip())
        self.header = lines[: first + 2] if good else []
        self.rows = [x for x in lines[first + 2 :] if x.strip()] if good else []
        self.names = _cells(lines[first]) if good else []
        self.most, self.count = most, count

    def label(self, i: int) -> str:
        return f" ({self.names[i] if i < len(self.names) else f'col {i + 1}'} continued)"

    def row(self, cells: list[str], continued: list[bool]) -> str:
        shown = [c.replace("|", "\\|") + (self.label(i) if more else "") for i, (c, more) in enumerate(zip(cells, continued, strict=True))]
        return f"| {' | '.join(shown)} |"

    def text(self, rows: list[str]) -> str:
        return "\n".join([*self.header, *rows])

    def fits(self, rows: list[str]) -> bool:
        return self.count(self.text(rows)) <= self.most

    def pieces(self, cells: list[str]) -> list[str]:
        """A row too long by itself: the largest cells go, until what is left fits; that is the first piece, with the
        beginning of the first cell that went. Pieces of the cells that went follow, column by column, the
        other cells empty; a cell that is empty or goes on says so."""
        n = len(cells)
        for i, c in enumerate(cells):
            if c and not self.fits([self.row([""] * n, [j == i for j in range(n)])]):
                raise RowUnsplittable(f"the header and the label of column {i + 1} are above the budget of {self.most}")
        gone = {i for i, c in enumerate(cells) if not c}
        by_size = sorted((i for i in range(n) if cells[i]), key=lambda i: (-len(cells[i]), i))
        while not self.fits([self.row([("" if i in gone else c) for i, c in enumerate(cells)], [i in gone for i in range(n)])]):
            gone.add(by_size.pop(0))
        out: list[str] = []
        for i in sorted(i for i in gone if cells[i]):
            rest = cells[i]
            while rest:
                others = [("" if out or j in gone else c) for j, c in enumerate(cells)]
                more = [bool(out) or j in gone for j in range(n)]
                shown = lambda part, i=i, others=others, more=more: self.row([*others[:i], part, *others[i + 1 :]], more)
                size = _longest(rest, lambda part, shown=shown: self.fits([shown(part)]))
                if not size:
                    raise RowUnsplittable(f"not one character of column {i + 1} fits the budget of {self.most}")
                out.append(shown(rest[:size]))
                rest = rest[size:]
        return out or [self.row(cells, [False] * n)]


def split_table(text: str, most: int, count: Count = count_heuristic) -> list[str]:
    """Row groups within the budget, the header repeated in each; a row that is too long alone is split by its cells. A
    table within the budget, or without header or rows, is one piece."""
    t = Table(text, most, count)
    if not t.header or not t.rows or count(text) <= most:
        return [text]
    out: list[str] = []
    held: list[str] = []
    for line in t.rows:
        cells = _cells(line)
        row = t.row(cells, [False] * len(cells))
        if held and not t.fits([*held, row]):
            out.append(t.text(held))
            held = []
        if t.fits([*held, row]):
            held.append(row)
        else:
            out += [t.text([p]) for p in t.pieces(cells)]
    return [*out, t.text(held)] if held else out


def _fitting_parts(unit: str, shown: Callable[[str], str], most: int, count: Count) -> list[str]:
    """A unit too long alone, by characters, each part within the budget as it will be shown (one character at least)."""
    out = []
    while unit:
        size = max(1, _longest(unit, lambda part: count(shown(part)) <= most))
        out.append(unit[:size])
        unit = unit[size:]
    return out


def _groups_within(units: list[str], shown: Callable[[list[str]], str], parts: Callable[[str], list[str]], most: int, count: Count) -> list[str]:
    """Units in order in groups that are within the budget as shown; a unit that is not within it alone comes in parts."""
    out: list[str] = []
    held: list[str] = []
    for unit in units:
        if count(shown([*held, unit])) <= most:
            held.append(unit)
            continue
        if held:
            out.append(shown(held))
            held = []
        if count(shown([unit])) <= most:
            held = [unit]
        else:
            out += [shown([p]) for p in parts(unit)]
    return [*out, shown(held)] if held else out


def split_code(text: str, most: int, count: Count = count_heuristic) -> list[str]:
    """Line groups within the budget, each between the block's fences; a line too long alone is cut by characters."""
    lines = text.split("\n")
    opening = lines[:1] if _FENCE.match(lines[0]) else []
    closing = lines[-1:] if len(lines) > len(opening) and _FENCE.match(lines[-1].strip()) else []
    body = lines[len(opening) : len(lines) - len(closing)]
    closing = closing or ([_FENCE.match(lines[0])[1]] if opening else [])
    shown = lambda group: "\n".join([*opening, *group, *closing])
    if not body or count(text) <= most:
        return [text]
    return _groups_within(body, shown, lambda line: _fitting_parts(line, lambda p: shown([p]), most, count), most, count) or [text]


CONTINUED = "  (continued) "


def split_checklist(text: str, most: int, count: Count = count_heuristic) -> list[str]:
    """Items in groups within the budget; of an item too long alone the parts after the first say that they go on."""
    items = [x.rstrip("\n") for x in re.split(r"\n(?=[-*+]\s)", text) if x]
    if not items or count(text) <= most:
        return [text]

    def parts(item: str) -> list[str]:
        cut = _fitting_parts(item, lambda p: CONTINUED + p, most, count)
        return [cut[0], *(CONTINUED + p for p in cut[1:])]

    return _groups_within(items, "\n".join, parts, most, count)


def chunk_texts(docs: DataFrame, key: str, text: str, splitter: Callable[[str], list[str]]) -> DataFrame:
    """(key, chunk_index, total_chunks, text) by any splitter of one text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"], strict=True):
                pieces = splitter(t or "")
                rows += [(k, i, len(pieces), p) for i, p in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "total_chunks", "text"])

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, chunk_index bigint, total_chunks bigint, text string")


def overlap_sentences(chunks: DataFrame, by: list[str], order: str, n: int = OVERLAP_SENTENCES) -> DataFrame:
    """Adds ``overlap``: the last ``n`` sentences of the chunk before, of the same scope; empty where the chunk starts
    with them."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy(*by).orderBy(order)), F.lit(""))
    tail = F.trim(F.array_join(F.slice(sentences(before), -F.least(F.lit(n), F.size(sentences(before))), n), " "))
    return chunks.withColumn("overlap", F.when((tail == "") | F.startswith(F.col("text"), tail), "").otherwise(tail))


def overlap_previous(chunks: DataFrame, by: list[str], order: str, body_budget: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Adds ``overlap``: the last heuristic tokens of the chunk before, as many as the budget leaves; empty
    where the chunk starts with them."""
    before = F.lag("text").over(Window.partitionBy(*by).orderBy(order))
    room = F.least(F.lit(overlap), F.greatest(F.lit(0), body_budget - heuristic_tokens(F.col("text"))))
    tail = F.right(F.coalesce(before, F.lit("")), (4 * room).cast("int"))
    return chunks.withColumn("overlap", F.when((tail == "") | F.startswith(F.col("text"), tail), "").otherwise(tail))


PLACEHOLDER = r"^\[(?:table|code block|checklist) node: (.*)\]$"


def attach_entity_refs(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_file, section, chunk_index, line, node_id): each placeholder line ``[table node: path — hint]`` with the
    entity (source_file, section, node_path, node_id, entity_id) of its file and section whose path is the longest
    that is the line's content or its beginning before `` — ``. Fragments (with an entity_id) are no targets. A
    line that none fits is an orphan: its node_id is null."""
    lines = chunks.select("source_file", "section", "chunk_index", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim("line")).withColumn("inner", F.regexp_extract("line", PLACEHOLDER, 1)).filter("inner != ''")
    whole = entities.filter(F.col("entity_id").isNull()) if "entity_id" in entities.columns else entities
    whole = whole.select("source_file", "section", "node_path", "node_id")
    fits = (F.col("inner") == F.col("node_path")) | F.col("inner").startswith(F.concat("node_path", F.lit(" — ")))
    pairs = lines.join(whole, ["source_file", "section"]).filter(fits)
    key = ["source_file", "section", "chunk_index", "at"]
    best = pairs.groupBy(*key).agg(F.max(F.struct(F.length("node_path").alias("n"), "node_id")).alias("b")).select(*key, "b.node_id")
    return lines.join(best, key, "left").select("source_file", "section", "chunk_index", "line", "node_id")
