"""JSON in a model's answers, by shape: arrays of a known length, structured summaries, a context with tags."""

from __future__ import annotations

import json
import re
from typing import Any

# How much of a structured answer counts.
MOST_TOPICS, MOST_TERMS, MOST_OVERVIEW, MOST_FIELD = 8, 12, 10, 120


def bare(raw: str) -> str:
    """An answer without the code fence around it."""
    return re.sub(r"\s*```\s*$", "", re.sub(r"^```(?:json)?\s*", "", raw.strip(), flags=re.I)).strip()


def _loads(text: str) -> tuple[bool, Any]:
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def bracketed(text: str) -> list[str]:
    """The outermost balanced ``[...]`` of a text, from left to right, by one scan; brackets in strings do not count."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if depth and quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"' and depth:
            quoted, escaped = True, False
        elif c == "[":
            start = i if not depth else start
            depth += 1
        elif c == "]" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def _is_words(x: Any) -> bool:
    return isinstance(x, list) and all(isinstance(y, str) for y in x)


def _lists(value: Any) -> list[list]:
    """The lists of words that an array of arrays, or an array of words, stands for."""
    if not isinstance(value, list):
        return []
    if value and all(isinstance(x, list) for x in value):
        return value
    return [value] if _is_words(value) else []


def json_array(raw: str | None, expected: int) -> list[list] | None:
    """``expected`` lists from an answer: an array of arrays as such, the lists among an object's values, or those of
    all arrays that stand in the text; None where they are not as many."""
    if not isinstance(raw, str):
        return None
    text = bare(raw)
    good, value = _loads(text)
    if good:
        found = _lists(value) if isinstance(value, list) and all(isinstance(x, list) for x in value) else []
        if isinstance(value, dict):
            found = [x for v in value.values() for x in (_lists(v) if v else [[]] if v == [] else [])]
        if len(found) == expected:
            return found
    parts = [v for ok, v in map(_loads, bracketed(text)) if ok]
    for v in parts:
        if isinstance(v, list) and len(v) == expected and all(isinstance(x, list) for x in v):
            return v
    every = [x for v in parts for x in _lists(v)]
    return every if len(every) == expected else None


def _short(value: Any, most: int) -> list[str]:
    return [x.strip()[:MOST_FIELD] for x in value if isinstance(x, str) and x.strip()][:most] if isinstance(value, list) else []


def structured(raw: str | None) -> dict | None:
    """summary, key_topics, notable_terms and child_overview of an answer that is one object with a summary; the
    summary itself is still to be cleaned."""
    if not isinstance(raw, str):
        return None
    good, value = _loads(re.sub(r"^json\s*:\s*", "", bare(raw), flags=re.I).strip())
    if not good or not isinstance(value, dict) or not isinstance(value.get("summary"), str):
        return None
    return {
        "summary": value["summary"],
        "key_topics": _short(value.get("key_topics"), MOST_TOPICS),
        "notable_terms": _short(value.get("notable_terms"), MOST_TERMS),
        "child_overview": _short(value.get("child_overview"), MOST_OVERVIEW),
    }


def combined(raw: str | None) -> dict | None:
    """context and tags of an answer that is one such object, or an array that begins with one."""
    if not isinstance(raw, str):
        return None
    good, value = _loads(bare(raw))
    item = value[0] if good and isinstance(value, list) and value else value
    if not isinstance(item, dict) or not isinstance(item.get("context"), str) or not item["context"].strip() or not _is_words(item.get("tags")):
        return None
    return {"context": item["context"].strip(), "tags": item["tags"]}
