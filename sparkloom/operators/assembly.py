"""Evidence, prompts, citations, history budgets and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heuristic_tokens, sanitize_header, truncate_to_budget

# Budgets and marks.
PER_SOURCE, HEADROOM = 700, 1024
MOST_MESSAGES, MOST_CHARS, MOST_TOKENS = 20, 12_000, 2_000
COMPACT_AT, RETAIN = 8, 4
CITATION, NODE_MARK = r"\[(\d+)\]", r"\[node: ([^\]]+)\]"
CURSOR_PREFIX = "ac1."


def build_evidence(hits: DataFrame, per_source: int = PER_SOURCE) -> DataFrame:
    """(qid, n, key, text) from hits (qid, rank, source_file, section, node_id, parent_id, text): the best hit of
    each section, numbered from 1, its text cut to the budget."""
    scoped = F.concat(F.lit("node-scope:"), F.coalesce("parent_id", "node_id"))
    key = F.when(F.col("node_id").isNotNull(), scoped).otherwise(F.concat(F.lit("legacy:"), "source_file", F.lit("::"), F.coalesce("section", F.lit(""))))
    first = Window.partitionBy("qid", "key").orderBy("rank")
    d = hits.withColumn("key", key).withColumn("i", F.row_number().over(first)).filter("i = 1")
    n = F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("bigint")
    return d.select("qid", n.alias("n"), "key", "source_file", "section", truncate_to_budget(F.col("text"), per_source).alias("text"))


def fit_context(evidence: DataFrame, context: int, headroom: int = HEADROOM, system: str = "", structural_rule: str = "", question: Column | None = None) -> DataFrame:
    """The most sources of each question (the first ones by number) with which the whole prompt fits the model's
    ``context`` less a ``headroom``, and ``used``, what it counts.

    The prompt is the system text, with the rule for structural sources only where one of those kept is structural
    (a node_id, if that is a column), the blocks with a blank line between, and the question. Each prefix is
    counted as the one text it would be, so nothing is rounded source by source.
    """
    w = Window.partitionBy("qid").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    structural = F.max(F.col("node_id").isNotNull()).over(w) if "node_id" in evidence.columns else F.lit(False)
    blocks = F.sum(F.length(prompt_block())).over(w) + 2 * (F.row_number().over(w) - 1)
    rest = F.length(question) if question is not None else F.lit(0)
    chars = len(system) + F.when(structural, len(structural_rule)).otherwise(0) + blocks + rest
    d = evidence.withColumn("used", F.ceil(chars / 4))
    return d.filter(F.col("used") <= context - headroom)


def prompt_block() -> Column:
    """A source's number, where it is from (with its node, if there is a node_path), and its text."""
    head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), sanitize_header(F.concat_ws(" § ", "source_file", "section")))
    return F.concat(head, F.lit(")\n"), F.col("text"))


def node_block() -> Column:
    """The same with ``[node: path]`` for a structural source."""
    where = sanitize_header(F.concat_ws(" § ", "source_file", "section"))
    node = F.when(F.col("node_path").isNotNull(), F.concat(F.lit(" [node: "), sanitize_header(F.col("node_path")), F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), where, node, F.lit(")\n"), F.col("text"))


def history_block(turns: DataFrame) -> DataFrame:
    """(conv_id, history): the kept messages in order, ``role: text`` a line, line breaks as spaces."""
    line = F.concat("role", F.lit(": "), sanitize_header(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["l"]), "\n").alias("history"))


def prompts(evidence: DataFrame) -> DataFrame:
    """(qid, prompt): the numbered blocks in order, a blank line between."""
    parts = F.array_sort(F.collect_list(F.struct("n", prompt_block().alias("b"))))
    return evidence.groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["b"]), "\n\n").alias("prompt"))


#: What a model answers where the sources do not say.
REFUSAL = "[[INSUFFICIENT_EVIDENCE]]"


def citations(answer: Column, sources: Column, refusal: str = REFUSAL) -> Column:
    """struct(valid, invalid, refused) of the numbers an answer cites, each once in order of appearance; an answer that
    is the refusal mark alone cites nothing."""
    refused = F.regexp_replace(answer, r"^\s+|\s+$", "") == refusal
    found = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(CITATION), 1), lambda x: x.cast("int")))
    found = F.when(refused, F.array().cast("array<int>")).otherwise(found)
    return F.struct(F.array_intersect(found, sources).alias("valid"), F.array_except(found, sources).alias("invalid"), refused.alias("refused"))


def shown_answer(answer: Column, refusal: str = REFUSAL) -> Column:
    """The answer as it is shown: without the refusal mark."""
    return F.regexp_replace(F.replace(answer, F.lit(refusal), F.lit("")), r"^\s+|\s+$", "")


def strip_node_marks(answer: Column, valid: list[str]) -> Column:
    """The answer without marks of nodes that it was not shown."""
    keep = "".join(f"(?!\\Q{v}\\E\\])" for v in valid)
    return F.regexp_replace(answer, r"\[node: " + keep + r"[^\]]+\]", "")


def history_budget(turns: DataFrame, messages: int = MOST_MESSAGES, chars: int = MOST_CHARS, tokens: int = MOST_TOKENS) -> DataFrame:
    """(conv_id, turn) kept: walking from the newest, all turns before the first that would break a cap. Sums
    only grow along the walk, so a row is kept where all three still hold."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    d = turns.filter(F.col("role").isin("user", "assistant")).select("conv_id", "turn", F.count("*").over(w).alias("m"), F.sum(F.length("text")).over(w).alias("c"), F.sum(heuristic_tokens(F.col("text"))).over(w).alias("t"))
    return d.filter((F.col("m") <= messages) & (F.col("c") <= chars) & (F.col("t") <= tokens)).select("conv_id", "turn")


def history_with_summary(turns: DataFrame, summaries: DataFrame, messages: int = MOST_MESSAGES, chars: int = MOST_CHARS, tokens: int = MOST_TOKENS) -> DataFrame:
    """(conv_id, turn, kept_summary) of the messages kept beside a summary (conv_id, summary), which comes first: its
    tokens are taken from the messages' budget, and one beyond the whole budget is cut and leaves nothing."""
    need = F.coalesce(heuristic_tokens(F.col("summary")), F.lit(0))
    s = summaries.select("conv_id", need.alias("need"), F.when(need > tokens, truncate_words(F.col("summary"), 4 * tokens)).otherwise(F.col("summary")).alias("kept_summary"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    d = turns.filter(F.col("role").isin("user", "assistant")).join(s, "conv_id", "left")
    d = d.select("conv_id", "turn", "kept_summary", F.coalesce("need", F.lit(0)).alias("need"), F.count("*").over(w).alias("m"), F.sum(F.length("text")).over(w).alias("c"), F.sum(heuristic_tokens(F.col("text"))).over(w).alias("t"))
    room = F.when(F.col("need") > tokens, 0).otherwise(tokens - F.col("need"))
    return d.filter((F.col("m") <= messages) & (F.col("c") <= chars) & (F.col("t") <= room)).select("conv_id", "turn", "kept_summary")


def compaction_plan(turns: DataFrame, at: int = COMPACT_AT, retain: int = RETAIN) -> DataFrame:
    """(conv_id, n, compact): how many of the oldest messages are summarised; none below the trigger."""
    n = turns.filter(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.select("conv_id", "n", F.when(F.col("n") + 2 >= at, F.greatest(F.col("n") - retain, F.lit(0))).otherwise(0).cast("bigint").alias("compact"))


def compaction_fit(turns: DataFrame, budget: int, at: int = COMPACT_AT, retain: int = RETAIN, overhead: int = 0) -> DataFrame:
    """(conv_id, n, compact) where the oldest messages must also fit the summary prompt's ``budget`` of tokens: of those
    that are due, the longest run from the oldest whose text, a line a message, fits. 0: nothing is compacted."""
    talk = turns.filter(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    line = F.length("role") + 2 + F.length("text")
    d = talk.select("conv_id", "turn", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"), (F.sum(line).over(so_far) + F.row_number().over(w) - 1 + overhead).alias("chars"))
    due = F.when(F.col("n") + 2 >= at, F.greatest(F.col("n") - retain, F.lit(0))).otherwise(0)
    good = (F.col("i") <= due) & (F.ceil(F.col("chars") / 4) <= budget)
    return d.groupBy("conv_id").agg(F.first("n").alias("n"), F.coalesce(F.max(F.when(good, F.col("i"))), F.lit(0)).cast("bigint").alias("compact"))


def truncate_words(text: Column, most: int) -> Column:
    """The first characters, back to the last space where that is past the middle."""
    cut = F.substring(text, 1, most)
    last = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    return F.when(F.length(text) <= most, text).when(last > most * 0.5, F.left(cut, last)).otherwise(cut)


def encode_cursor(state: Column) -> Column:
    raw = F.base64(F.encode(F.to_json(state), "UTF-8"))
    return F.concat(F.lit(CURSOR_PREFIX), F.rtrim(F.translate(F.replace(F.replace(raw, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")), "+/=", "-_ ")))


def decode_cursor(cursor: Column, schema: str) -> Column:
    """The state of a cursor; null for one of another form."""
    body = F.translate(F.right(cursor, F.greatest(F.lit(0), F.length(cursor) - len(CURSOR_PREFIX))), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.when(cursor.startswith(CURSOR_PREFIX), F.from_json(F.decode(F.unbase64(padded), "UTF-8"), schema))
