"""Stores of suspended runs: admission under ceilings of number and bytes, expiry, claims and releases.

A store's events are one sequence: whether a run is admitted depends on which runs before it were, and a refused run takes
no place. Each store is folded in order of time with the runs that it holds as its only state, which the ceilings bound;
stores are independent and dealt by their key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .control import fold_in_order

# Default limits.
TTL_MS = 600_000
RUNS, RUNS_OF_KEY = 100, 10
RUN_BYTES, ALL_BYTES = 1_000_000, 20_000_000


@dataclass
class Run:
    key: object
    size: int
    until: int
    calls: tuple = ()
    busy: bool = False


@dataclass
class RunStore:
    """The runs of one store. A run expires at its time unless a step is working on it."""

    ttl: int = TTL_MS
    most: int = RUNS
    most_of_key: int = RUNS_OF_KEY
    run_bytes: int = RUN_BYTES
    all_bytes: int = ALL_BYTES
    size: int = 0
    runs: dict = field(default_factory=dict)
    of_key: dict = field(default_factory=dict)
    times: list = field(default_factory=list)  # (expiry, number, run) of every time that a run was given; old ones are skipped
    given: int = 0

    def expire(self, now: int) -> None:
        while self.times and self.times[0][0] <= now:
            until, _, name = heapq.heappop(self.times)
            run = self.runs.get(name)
            if run is not None and not run.busy and run.until == until:
                self.drop(name)

    def drop(self, name: object) -> None:
        run = self.runs.pop(name)
        self.size -= run.size
        self.of_key[run.key] -= 1
        if not self.of_key[run.key]:
            del self.of_key[run.key]

    def _until(self, name: object, until: int) -> int:
        self.given += 1
        heapq.heappush(self.times, (until, self.given, name))
        return until

    def create(self, now: int, name: object, key: object, size: int, calls: tuple = (), until: int | None = None) -> str:
        self.expire(now)
        if name in self.runs:
            return "run_exists"
        if len(self.runs) >= self.most:
            return "store_full"
        if self.of_key.get(key, 0) >= self.most_of_key:
            return "principal_full"
        if size > self.run_bytes:
            return "run_too_large"
        if self.size + size > self.all_bytes:
            return "memory_full"
        self.runs[name] = Run(key, size, self._until(name, now + self.ttl if until is None else until), calls)
        self.size += size
        self.of_key[key] = self.of_key.get(key, 0) + 1
        return "ok"

    def _mine(self, now: int, name: object, key: object) -> Run | None:
        """The run, if it is there and of this key: another's run is as one that is not there."""
        self.expire(now)
        run = self.runs.get(name)
        return run if run is not None and run.key == key else None

    def claim(self, now: int, name: object, key: object, results: tuple) -> str:
        run = self._mine(now, name, key)
        if run is None:
            return "run_not_found"
        if run.busy:
            return "run_busy"
        if len(results) != len(set(results)) or set(results) != set(run.calls):
            return "results_mismatch"
        run.busy = True
        return "ok"

    def release(self, now: int, name: object, key: object, size: int | None, calls: tuple) -> str:
        """The step is done; without a size so is the run."""
        run = self._mine(now, name, key)
        if run is None:
            return "run_not_found"
        if not run.busy:
            return "not_claimed"
        if size is None:
            self.drop(name)
            return "ok"
        if size > self.run_bytes or self.size - run.size + size > self.all_bytes:
            self.drop(name)
            return "run_too_large"
        self.size += size - run.size
        run.size, run.calls, run.busy, run.until = size, calls, False, self._until(name, now + self.ttl)
        return "ok"

    def close(self, now: int, name: object, key: object) -> str:
        if self._mine(now, name, key) is None:
            return "run_not_found"
        self.drop(name)
        return "ok"

    def act(self, kind: str, now: int, name: object, key: object, size: int | None, calls: tuple) -> str:
        if kind == "create":
            return self.create(now, name, key, size or 0, calls)
        if kind == "claim":
            return self.claim(now, name, key, calls)
        if kind == "release":
            return self.release(now, name, key, size, calls)
        return self.close(now, name, key) if kind == "close" else "unknown_kind"


def run_stores(events: DataFrame, ttl_ms: int = TTL_MS, most: int = RUNS, most_of_key: int = RUNS_OF_KEY, run_bytes: int = RUN_BYTES, all_bytes: int = ALL_BYTES) -> DataFrame:
    """(store, event_id, outcome, runs, bytes): what each event (store, event_id, ts_ms, kind, run, key, bytes, calls) came to,
    and the store's runs and bytes after it.

    ``create`` asks for a place for a run with its bytes and pending calls; ``claim`` takes it up with results, which must be
    those of its pending calls, each once; ``release`` puts it back with new bytes and calls, or ends it (bytes null);
    ``close`` ends it. Events of a store go by time, then id.
    """

    def step(store: RunStore, row: tuple) -> tuple:
        at, event, now, kind, name, key, size, calls = row
        outcome = store.act(kind, now, name, key, size, tuple(calls or ()))
        store.expire(now)
        return at, event, outcome, len(store.runs), store.size

    rows = events.select(*[F.col(c).cast("bigint").alias(c) for c in ("store", "event_id", "ts_ms")], "kind", "run", "key", F.col("bytes").cast("bigint").alias("bytes"), "calls")
    start = lambda _: RunStore(ttl_ms, most, most_of_key, run_bytes, all_bytes)
    return fold_in_order(rows, "store", ["ts_ms", "event_id"], start, step, "store bigint, event_id bigint, outcome string, runs bigint, bytes bigint")


def open_sessions(sessions: DataFrame, ttl_ms: int, per_key: int, overall: int, store: Column | None = None) -> DataFrame:
    """(store, key, start_us, outcome, mine, all) of ``sessions`` (key, start, last): a session asks for a place as it starts
    and keeps it until ``ttl_ms`` after its last event; mine and all are the places taken after it asked, of its key and
    in its store. A refused session takes none."""
    micros = [F.unix_micros(c).alias(c) for c in ("start", "last")]
    rows = sessions.select((F.lit(0) if store is None else store).cast("bigint").alias("store"), "key", *micros)

    def step(held: RunStore, row: tuple) -> tuple:
        at, key, start, last = row
        outcome = held.create(start, (key, start), key, 0, until=last + 1000 * ttl_ms)
        return at, key, start, outcome, held.of_key.get(key, 0), len(held.runs)

    schema = "store bigint, key bigint, start_us bigint, outcome string, mine bigint, all bigint"
    return fold_in_order(rows, "store", ["start", "key"], lambda _: RunStore(0, overall, per_key), step, schema)
