"""JSON-lines sinks whose files are rotated by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.control import fold_in_order

# The size at which a file is closed, and how many closed ones are kept beside the open one.
MOST_BYTES, KEEP = 10 * 1024 * 1024, 4


def rotated(lines: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(sink, seq, line, file): each sink's lines in order of ``seq``, ``file`` counting from 0. A line goes to a new
    file where it would take the open one, if that is not empty, beyond the size."""

    def step(state: list, row: tuple) -> tuple:
        sink, seq, line = row
        size = len((line or "").encode()) + 1
        if state[1] and state[1] + size > most_bytes:
            state[0], state[1] = state[0] + 1, 0
        state[1] += size
        return sink, seq, line, state[0]

    rows = lines.select("sink", "seq", "line")
    return fold_in_order(rows, "sink", ["seq"], lambda _: [0, 0], step, "sink string, seq bigint, line string, file int")


def kept(rotated_lines: DataFrame, keep: int = KEEP) -> DataFrame:
    """The open file of each sink and the ``keep`` before it."""
    last = rotated_lines.groupBy("sink").agg(F.max("file").alias("last"))
    return rotated_lines.join(last, "sink").filter(F.col("file") >= F.col("last") - keep).drop("last")


def write_jsonl(lines: DataFrame, path: str, most_bytes: int = MOST_BYTES, keep: int = KEEP) -> None:
    """Writes what is kept as text below ``path``, a folder for each sink and file, lines in order."""
    d = kept(rotated(lines, most_bytes), keep)
    d = d.repartition("sink", "file").sortWithinPartitions("sink", "file", "seq")
    d.select("sink", "file", F.col("line").alias("value")).write.partitionBy("sink", "file").mode("append").text(path)
