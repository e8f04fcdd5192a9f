"""Chunks of a file's structure: prose by section, and tables, code and checklists as entities of their own.

A file is one row, so its fold runs within one call over its nodes; files are independent and spread over tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .chunking import MAX_TOKENS, NODE_POLICY, TINY_LINES, TINY_ONE_LINE, TINY_TOKENS, Count, Node, count_heuristic, outline, recursive_split, split_checklist, split_code, split_table

# What an entity is called, and how much of the prose before it belongs to its context.
LABELS = {"table": "table", "code_block": "code block", "checklist": "checklist"}
SPLITTERS = {"table": split_table, "code_block": split_code, "checklist": split_checklist}
CARRY, HINT, LEAST_WORDS = 500, 60, 4
_PLACEHOLDER = re.compile(r"^\[(?:table|code block|checklist|list|image) node: .*\]$")
SCHEMA = (
    "source_file string, chunk_index int, total_chunks int, node_type string, node_path string, section string, heading_path string, context string, "
    "text string, raw_content string, point_kind string, entity_path string, fragment_index int, fragment_count int"
)


class OrphanPlaceholder(RuntimeError):
    """A placeholder that no entity of the same file answers to."""


def _body(n: Node) -> str:
    """What a node says, without its fences."""
    lines = n.text.split("\n")
    return "\n".join(lines[1:-1] if len(lines) > 1 and lines[-1].strip().startswith(("```", "~~~")) else lines[1:]) if n.kind == "code_block" else n.text


def is_tiny(n: Node) -> bool:
    lines, words = [x for x in _body(n).split("\n") if x.strip()], _body(n).split()
    return n.kind == "code_block" and not ((len(lines) >= TINY_LINES and len(words) >= TINY_TOKENS) or len(words) >= TINY_ONE_LINE)


def says_something(text: str) -> bool:
    """A few words with a letter or digit, beside headings and placeholders."""
    lines = [x.strip() for x in text.split("\n")]
    words = " ".join(x for x in lines if not _PLACEHOLDER.match(x) and not re.match(r"#{1,6}\s", x)).split()
    return sum(any(c.isalnum() for c in w) for w in words) >= LEAST_WORDS


class FileChunks:
    """The chunks of one file. Prose gathers until a section or an entity ends it; an entity leaves a placeholder in
    the prose before it: in what has gathered, else in the section's last prose chunk, else in what comes."""

    def __init__(self, source_file: str, most: int = MAX_TOKENS, count: Count = count_heuristic) -> None:
        self.file, self.most, self.count = source_file, most, count
        self.out: list[dict] = []
        self.raw: list[dict] = []
        self.prose: list[str] = []
        self.headings: tuple[str, ...] = ()
        self.path = ""
        self.last: dict | None = None  # the last prose chunk of this section
        self.ordinals: Counter = Counter()

    def section(self) -> str:
        return self.headings[-1] if self.headings else ""

    def node_path(self, kind: str, ordinal: int) -> str:
        return f"{self.file}#{self.path + '/' if self.path else ''}{kind}-{ordinal}"

    def _chunk(self, **more) -> dict:
        base = {"source_file": self.file, "section": self.section(), "heading_path": " › ".join(self.headings), "point_kind": "retrieval_content", "entity_path": None, "fragment_index": None, "fragment_count": None}
        return base | more

    def flush(self) -> None:
        text, self.prose = "\n\n".join(self.prose).strip(), []
        for piece in recursive_split(text, self.most, self.count, strict=True) if text else []:
            if not says_something(piece):
                # its placeholders still have to stand somewhere
                marks = [x for x in piece.split("\n") if _PLACEHOLDER.match(x.strip())]
                if marks and self.last:
                    self._append("\n\n".join(marks))
                elif marks:
                    self.prose += marks
                continue
            self.ordinals[self.path] += 1
            self.last = self._chunk(node_type="paragraph", node_path=self.node_path("paragraph", self.ordinals[self.path]), context=" › ".join(self.headings), text=piece, raw_content=piece)
            self.out.append(self.last)

    def _append(self, mark: str) -> None:
        self.last["text"] += f"\n\n{mark}"
        self.last["raw_content"] = self.last["text"]

    def entity(self, n: Node) -> None:
        gathered = bool(self.prose)
        near = " ".join(self.prose) if gathered else self.last["text"] if self.last else ""
        path = self.node_path(n.kind, n.ordinal)
        hint = next((x.strip() for x in _body(n).split("\n") if x.strip()), "")[:HINT]
        mark = f"[{LABELS[n.kind]} node: {path}{' — ' + hint if hint else ''}]"
        if gathered:
            self.prose.append(mark)
            self.flush()
        words = " ".join(" ".join(x for x in near.split("\n") if not re.match(r"\[[^\]]*node: ", x.strip())).split())[:CARRY]
        context = " — ".join(x for x in (" › ".join(self.headings), LABELS[n.kind], words) if x)
        parts = SPLITTERS[n.kind](n.text, self.most, self.count)
        own = self._chunk(node_type=n.kind, node_path=path, context=context, text=n.text, raw_content=n.text)
        if len(parts) == 1:
            self.out.append(own | {"text": parts[0]})
        else:
            self.raw.append(own | {"text": "", "context": "", "point_kind": "entity_raw"})
            self.out += [own | {"node_path": f"{path}/fragment-{i + 1}", "text": p, "raw_content": p, "entity_path": path, "fragment_index": i, "fragment_count": len(parts)} for i, p in enumerate(parts)]
        if not gathered:
            if self.last:
                self._append(mark)
            else:
                self.prose.append(mark)

    def add(self, n: Node) -> None:
        policy = "merge_with_parent" if is_tiny(n) else NODE_POLICY.get(n.kind, NODE_POLICY["unknown"])[0]
        if policy == "nav_summary":
            self.flush()
            self.prose, self.last = [], None  # a placeholder never crosses into another section
            self.headings, self.path = n.headings, n.path
        elif policy == "merge_with_parent":
            code = " ".join(_body(n).split())
            self.prose += [f"`{code}`"] if code else []
        elif policy == "payload_raw_embed_context":
            self.entity(n)
        elif policy == "chunk_text" and n.text.strip():
            self.prose.append(n.text.strip())

    def rows(self) -> list[dict]:
        self.flush()
        known = {c["node_path"] for c in (*self.out, *self.raw)}
        for c in self.out:
            for line in c["text"].split("\n") if c["node_type"] == "paragraph" else []:
                inner = re.match(r"^\[(?:table|code block|checklist) node: (.*)\]$", line.strip())
                if inner and not any(inner[1] == p or inner[1].startswith(f"{p} — ") for p in known):
                    raise OrphanPlaceholder(line)
        numbered = [c | {"chunk_index": i, "total_chunks": len(self.out)} for i, c in enumerate(self.out)]
        return numbered + [c | {"chunk_index": None, "total_chunks": len(self.out)} for c in self.raw]


def chunk_file(source_file: str, markdown: str, most: int = MAX_TOKENS, count: Count = count_heuristic) -> list[dict]:
    fold = FileChunks(source_file, most, count)
    for n in outline(markdown):
        fold.add(n)
    return fold.rows()


def skeleton_chunks(files: DataFrame, most: int = MAX_TOKENS, count: Count = count_heuristic) -> DataFrame:
    """Chunks of (source_file, markdown) files, and for each entity that was split its whole as ``entity_raw`` (without a
    chunk_index). Every text but a placeholder appended to prose is within the budget. A null file has none."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for f, m in zip(b["source_file"], b["markdown"], strict=True) for r in chunk_file(f, m or "", most, count)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in ("chunk_index", "total_chunks", "fragment_index", "fragment_count")})

    return files.select("source_file", "markdown").mapInPandas(run, SCHEMA)
