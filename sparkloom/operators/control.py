"""Keyed rate and budget accounting over event tables, and log records."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Default limits.
RATE_PER_MINUTE, RATE_BURST = 30, 5
TOKENS_PER_HOUR, TOKENS_BURST = 200_000, 40_000
CALLS, RESERVED_TOKENS = 5, 60_000


class Bucket:
    """A token bucket: full at first, refilled with time up to its capacity."""

    def __init__(self, capacity: float, per_ms: float, now: int, tokens: float | None = None) -> None:
        self.capacity, self.per_ms, self.at = capacity, per_ms, now
        self.tokens = capacity if tokens is None else tokens

    def take(self, now: int, cost: float) -> tuple[bool, float, int | None]:
        """(allowed, left, wait in ms); the wait is null where the cost is above the capacity."""
        if now > self.at:
            self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.per_ms)
            self.at = now
        if cost > self.capacity:
            return False, self.tokens, None
        if self.tokens >= cost:
            self.tokens -= cost
            return True, self.tokens, 0
        return False, self.tokens, math.ceil((cost - self.tokens) / self.per_ms)

    def give(self, amount: float) -> None:
        """Tokens that were taken and not used come back."""
        self.tokens = min(self.capacity, self.tokens + amount)


def fold_in_order(rows: DataFrame, key: str, order: list[str], state: Callable[[tuple], object], step: Callable[[object, tuple], tuple], schema: str) -> DataFrame:
    """``step(state, row)`` over each key's rows in order; ``state(row)`` makes the state of a key from its first row.
    Rows are dealt by key, sorted, and streamed through in batches: a task holds one key's state, never its rows. One
    key's rows are one sequence by nature and go to one task."""
    columns = rows.columns
    at = columns.index(key)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, started = None, None, False
        arrow = to_arrow_schema(kinds)
        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(len(columns))), strict=True):
                if not started or row[at] != last:
                    now, last, started = state(row), row[at], True
                out.append(step(now, row))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def token_bucket(events: DataFrame, capacity: float, per_ms: float) -> DataFrame:
    """(key, event_id, allowed, remaining, retry_after_ms) of events (key, event_id, ts_ms, cost) in order of
    time: each decision rests on all before it. A negative cost gives tokens back, up to the capacity, and is
    always allowed."""

    def step(bucket: Bucket, row: tuple) -> tuple:
        key, event, now, cost = row
        if cost < 0:
            bucket.give(-cost)
            return key, event, True, bucket.tokens, 0
        return (key, event, *bucket.take(int(now), float(cost)))

    rows = events.select("key", "event_id", "ts_ms", F.col("cost").cast("double").alias("cost"))
    return fold_in_order(rows, "key", ["ts_ms", "event_id"], lambda row: Bucket(capacity, per_ms, int(row[2])), step, "key bigint, event_id bigint, allowed boolean, remaining double, retry_after_ms bigint")


class Account:
    """A key's bucket with its open reservations. The bucket's capacity and rate are those of the event that made it; one that
    was not asked for as long as it takes to fill is gone, with all that was open."""

    def __init__(self) -> None:
        self.bucket: Bucket | None = None
        self.last = 0
        self.open: dict[int, float] = {}

    def idle_ms(self) -> int:
        return math.ceil(self.bucket.capacity / self.bucket.per_ms)

    def sweep(self, now: int) -> None:
        if self.bucket is not None and now - self.last >= self.idle_ms():
            self.bucket, self.open = None, {}

    def act(self, kind: str, now: int, number: int, cost: float, capacity: float, per_ms: float) -> tuple[str, float | None]:
        """(outcome, left): reserve is ok, wait or too_large; release gives back what a reservation did not take and is
        refunded, unknown_reservation, or no_bucket where there is none to give to."""
        self.sweep(now)
        if kind == "release":
            if self.bucket is None:
                return "no_bucket", None
            reserved = self.open.pop(number, None)
            if reserved is None:
                return "unknown_reservation", self.bucket.tokens
            self.bucket.give(max(0.0, reserved - cost))
            return "refunded", self.bucket.tokens
        if self.bucket is None:
            self.bucket = Bucket(capacity, per_ms, now)
        allowed, left, wait = self.bucket.take(now, cost)
        self.last = max(self.last, now)
        if allowed:
            self.open[number] = cost
        return ("ok" if allowed else "too_large" if wait is None else "wait"), left


RESERVATIONS = "key bigint, event_id bigint, outcome string, remaining double"


def token_reservations(events: DataFrame) -> DataFrame:
    """(key, event_id, outcome, remaining) of events (key, event_id, ts_ms, kind, number, cost, capacity, per_ms) in order of time:
    ``reserve`` asks for tokens under a number, ``release`` of that number tells what was really taken."""

    def step(account: Account, row: tuple) -> tuple:
        key, event, now, kind, number, cost, capacity, per_ms = row
        return key, event, *account.act(kind, now, number, cost, capacity, per_ms)

    rows = events.select("key", "event_id", "ts_ms", "kind", "number", *[F.col(c).cast("double").alias(c) for c in ("cost", "capacity", "per_ms")])
    return fold_in_order(rows, "key", ["ts_ms", "event_id"], lambda _: Account(), step, RESERVATIONS)


class Ledger:
    """A request's calls and reserved tokens under ceilings; a reservation is settled by what it really took."""

    def __init__(self, calls: int, tokens: float) -> None:
        self.most_calls, self.most_tokens = calls, tokens
        self.calls, self.reserved = 0, 0.0
        self.open: dict[int, float] = {}

    def reserve(self, number: int, cost: float) -> str:
        if self.calls >= self.most_calls:
            return "request_call_ceiling_exceeded"
        if self.reserved + cost > self.most_tokens:
            return "request_token_ceiling_exceeded"
        self.calls += 1
        self.reserved += cost
        self.open[number] = cost
        return "ok"

    def settle(self, number: int, actual: float | None) -> str:
        cost = self.open.pop(number, None)
        if cost is None:
            return "unknown_reservation"
        if actual is None or actual < 0:
            return "kept"  # what was really taken is not known
        self.reserved -= max(0.0, cost - actual)
        return "settled"


def request_ledger(events: DataFrame, calls: int = CALLS, tokens: float = RESERVED_TOKENS) -> DataFrame:
    """(key, event_id, outcome, calls, reserved) of a request's events (key, event_id, ts_ms, kind, number, cost): reserve
    asks for tokens, settle gives back what a reservation of that number did not take. A refusal changes nothing."""

    def step(ledger: Ledger, row: tuple) -> tuple:
        key, event, _, kind, number, cost = row
        outcome = ledger.reserve(number, cost) if kind == "reserve" else ledger.settle(number, cost)
        return key, event, outcome, ledger.calls, round(ledger.reserved, 6)

    rows = events.select("key", "event_id", "ts_ms", "kind", "number", F.col("cost").cast("double").alias("cost"))
    return fold_in_order(rows, "key", ["ts_ms", "event_id"], lambda _: Ledger(calls, tokens), step, "key bigint, event_id bigint, outcome string, calls bigint, reserved double")


def budget_ledger(events: DataFrame, calls: int = CALLS, tokens: float = RESERVED_TOKENS) -> DataFrame:
    """(key, event_id, calls, spent, within): running calls and tokens of each request, and whether both
    ceilings hold."""
    w = Window.partitionBy("key").orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    d = events.select("key", "event_id", F.count("*").over(w).alias("calls"), F.round(F.sum("cost").over(w), 6).alias("spent"))
    return d.withColumn("within", (F.col("calls") <= calls) & (F.col("spent") <= tokens))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(key, start, end, n): runs of events with less than ``gap`` of idle time."""
    s = events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return s.select("key", F.col("w.start").alias("start"), "last", "n")


# The states of a job and what may follow each.
NEXT_STATES = {
    "queued": ("running", "cancelling", "failed", "cancelled"),
    "running": ("cancelling", "succeeded", "failed"),
    "cancelling": ("cancelled", "succeeded", "failed"),
    "succeeded": (),
    "failed": (),
    "cancelled": (),
}
LOG_LINES = 2000


def job_states(events: DataFrame) -> DataFrame:
    """(key, state, changes, illegal): a job's state after its events (key, event_id, ts, state) in order; an event whose
    state may not follow the one before changes nothing and is counted. A job begins queued."""

    def step(job: dict, row: tuple) -> tuple:
        key, _, _, state = row
        if state in NEXT_STATES[job["state"]]:
            job["state"], job["changes"] = state, job["changes"] + 1
        elif state != job["state"]:
            job["illegal"] += 1
        job["n"] += 1
        return key, job["n"], job["state"], job["changes"], job["illegal"]

    rows = events.select("key", "event_id", "ts", "state")
    folded = fold_in_order(rows, "key", ["ts", "event_id"], lambda _: {"state": "queued", "changes": 0, "illegal": 0, "n": 0}, step, "key bigint, n bigint, state string, changes bigint, illegal bigint")
    return folded.groupBy("key").agg(F.max(F.struct("n", "state", "changes", "illegal")).alias("j")).select("key", "j.state", "j.changes", "j.illegal")


def ring_log(lines: DataFrame, key: str, order: list[str], most: int = LOG_LINES) -> DataFrame:
    """The last ``most`` lines of each key's log, which is all that it holds."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return lines.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def last_state(events: DataFrame) -> DataFrame:
    """(key, state, n): a job's latest state by time."""
    return events.groupBy("key").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n"))


def phase_times(marks: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """``marks`` with ``took``: the time since the mark before, of the same key; null for the first."""
    return marks.withColumn("took", F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(at, order)))


def throughput(marks: DataFrame, key: str, at: str, per: float = 1e6) -> DataFrame:
    """(key, chunks, per_second): rows of a key over the time from its first to its last; null where that is none."""
    took = F.max(at) - F.min(at)
    return marks.groupBy(key).agg(F.count("*").alias("chunks"), F.when(took > 0, F.round(F.count("*") / (took / per), 6)).alias("per_second"))


# The outcomes of an audit event, its common fields, and the fields of each type (required ones marked).
OUTCOMES = ("accepted", "denied", "started", "requested", "cancelled", "succeeded", "failed", "changed", "synced", "deleted", "created", "revoked")
ENVELOPE = ("edition", "requestId", "route", "audience", "operation", "reason")
AUDIT_FIELDS = {
    "request.host_rejected": {},
    "request.origin_rejected": {},
    "auth.integration_accepted": {"keyId": "required", "keyName": ""},
    "auth.integration_denied": {"keyId": ""},
    "auth.rate_limited": {"keyId": "required", "retryAfterSeconds": "required number"},
    "authz.collection_denied": {"keyId": "", "collection": "required"},
    "budget.reservation_denied": {"keyId": "required", "label": "required", "estimatedInputTokens": "required number", "maxOutputTokens": "required number", "retryAfterSeconds": "number"},
    "index.root_denied": {"pathHash": "required hash"},
    "index.job_started": {"jobId": "required", "collection": "required", "pathHash": "required hash", "kind": "required", "rootMode": ""},
    "index.job_cancel_requested": {"jobId": "required"},
    "index.job_cancelled": {"jobId": "required", "exitCode": "number"},
    "index.job_succeeded": {"jobId": "required", "exitCode": "number"},
    "index.job_failed": {"jobId": "required", "exitCode": "number"},
    "admin.settings_changed": {"fields": "required"},
    "admin.collection_schema_synced": {"collection": "required"},
    "admin.collection_deleted": {"collection": "required"},
    "admin.key_created": {"keyId": "required", "keyName": ""},
    "admin.key_revoked": {"keyId": "required", "keyName": "", "status": "required"},
}


def audit_problem(kind: Column, outcome: Column, fields: Column) -> Column:
    """What is wrong with an audit event of a type, an outcome and a JSON object of fields, or null: unknown_type,
    bad_outcome, bad_fields (no object), then the first of ``missing:x``, ``unknown:x`` and ``invalid:x`` by name."""
    keys = F.coalesce(F.json_object_keys(fields), F.array().cast("array<string>"))
    first = lambda tag, names: F.when(F.size(names) > 0, F.concat(F.lit(f"{tag}:"), F.array_min(names)))
    out = F.when(~F.coalesce(kind.isin(*AUDIT_FIELDS), F.lit(False)), "unknown_type").when(~F.coalesce(outcome.isin(*OUTCOMES), F.lit(False)), "bad_outcome").when(F.json_object_keys(fields).isNull(), "bad_fields")
    for name, rules in AUDIT_FIELDS.items():
        need = F.array(*[F.lit(f) for f, r in rules.items() if "required" in r]).cast("array<string>")
        known = F.array(*[F.lit(f) for f in (*rules, *ENVELOPE)])
        value = lambda f: F.get_json_object(fields, f"$.{f}")
        wrong = [F.when(F.array_contains(keys, f) & F.coalesce(value(f).try_cast("double"), F.lit(float("nan"))).isNaN(), F.lit(f)) for f, r in rules.items() if "number" in r]
        wrong += [F.when(F.array_contains(keys, f) & ~F.coalesce(value(f).rlike("^[0-9a-f]{16}$"), F.lit(False)), F.lit(f)) for f, r in rules.items() if "hash" in r]
        bad = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
        out = out.when(kind == name, F.coalesce(first("missing", F.array_except(need, keys)), first("unknown", F.array_except(keys, known)), first("invalid", bad)))
    return out


def unknown_fields(payload: Column, allowed: list[str]) -> Column:
    """The keys of a JSON object that are not on the list, sorted."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), F.array(*[F.lit(a) for a in allowed])))


# How far a file is at each step.
STEP_WEIGHTS = {"preparing": 0.05, "chunking": 0.15, "summarizing": 0.45, "tagging": 0.55, "embedding": 0.80, "writing": 0.95, "done": 1.0}


def file_progress(step: Column, done_files: Column, all_files: Column) -> Column:
    """The share of a job that is done: whole files, and of the current one what its step stands for."""
    weights = F.create_map(*[x for k, v in STEP_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(all_files > 0, (done_files + F.coalesce(F.try_element_at(weights, step), F.lit(0.0))) / all_files)


# Statuses that are worth another try before a stream has begun, and the bounds of a wait.
RETRY_STATUSES = (429, 502, 503, 504)
RETRY_AFTER_MOST = 86_400


def retry_plan(status: Column, started: Column, attempt: Column, most_attempts: int, retry_after: Column, first_ms: float = 250, factor: float = 2, most_ms: float = 8000) -> Column:
    """struct(retry, delay_ms, source) of a failed request: another try only before its stream began, for a status that
    may pass (null: no answer at all) and while attempts are left. The wait grows with each attempt up to a bound; a
    longer retry-after counts instead, and one beyond the bound ends it."""
    backoff = F.least(F.lit(float(first_ms)) * F.pow(F.lit(float(factor)), attempt), F.lit(float(most_ms)))
    told = F.when((retry_after >= 0) & (retry_after <= RETRY_AFTER_MOST), retry_after * 1000.0)
    may = ~started & (status.isNull() | status.isin(*RETRY_STATUSES)) & (attempt + 1 < most_attempts) & ~F.coalesce(told > most_ms, F.lit(False))
    delay = F.when(may, F.greatest(backoff, F.coalesce(told, F.lit(0.0))))
    source = F.when(may, F.when(F.coalesce(told >= backoff, F.lit(False)), "retry-after").otherwise("backoff"))
    return F.struct(may.alias("retry"), F.round(delay).cast("bigint").alias("delay_ms"), source.alias("source"))


def progress_payload(line: Column, prefix: str, schema: str) -> Column:
    """The JSON after a prefix tag; null for a line without it."""
    return F.when(line.startswith(prefix), F.from_json(F.replace(line, F.lit(prefix), F.lit("")), schema))


def sse_frames(stream: Column) -> Column:
    """array<struct<event, data>> of an event stream's text."""
    frames = F.filter(F.split(F.replace(stream, F.lit("\r\n"), F.lit("\n")), "\n\n"), lambda f: F.trim(f) != "")
    field = lambda f, name: F.array_join(F.transform(F.filter(F.split(f, "\n"), lambda x: x.startswith(name + ":")), lambda x: F.ltrim(F.regexp_replace(x, f"^{name}:", ""))), "\n")
    return F.transform(frames, lambda f: F.struct(field(f, "event").alias("event"), field(f, "data").alias("data")))
