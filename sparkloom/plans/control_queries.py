"""Rate, budget, job and log queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import continuations as R
from ..operators import control as K
from ..operators.asof import asof_join, refilled
from ..operators.quantiles import exact_quantiles
from ..sources import jsonl as J
from .fixtures import table
from .registry import query


def events(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", ts.alias("ts"), F.unix_millis(ts).alias("ts_ms"), F.col("value").alias("cost"), F.col("event_type").alias("state"), "props")


def bucket_sql(cost: str, capacity: float, per_ms: str) -> str:
    """A token bucket as a recursion over each key's events in order; what is given back does not refill it."""
    take = "CASE WHEN cost < 0 THEN least({cap}, r - cost) WHEN cost <= {cap} AND r >= cost THEN r - cost ELSE r END".format(cap=capacity)
    said = f"cost < 0 OR (cost <= {capacity} AND r >= cost) AS allowed, CASE WHEN cost < 0 THEN 0 WHEN cost > {capacity} THEN NULL WHEN r >= cost THEN 0 ELSE CAST(ceil((cost - r) / ({per_ms})) AS BIGINT) END AS wait"
    return f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) // 1000 AS t, CAST({cost} AS DOUBLE) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
  b AS (SELECT key, event_id, i, t AS since, {take} AS tokens, {said} FROM (SELECT *, CAST({capacity} AS DOUBLE) AS r FROM e WHERE i = 1)
    UNION ALL SELECT key, event_id, i, since, {take}, {said.replace(' AS allowed', '').replace(' AS wait', '')}
    FROM (SELECT e.*, CASE WHEN e.cost < 0 THEN b.since ELSE e.t END AS since, CASE WHEN e.cost < 0 THEN b.tokens ELSE least({capacity}, b.tokens + (e.t - b.since) * ({per_ms})) END AS r FROM b JOIN e ON e.key = b.key AND e.i = b.i + 1))
  SELECT key, event_id, allowed, round(tokens, 4) AS remaining, wait AS retry_after_ms FROM b"""


def rounded(d):
    return d.withColumn("remaining", F.round("remaining", 4))


@query("rate_limit", bucket_sql("1", 5, "30e0 / 60000"))
def rate_limit(spark, sf_dir):
    return rounded(K.token_bucket(events(spark, sf_dir).withColumn("cost", F.lit(1.0)), K.RATE_BURST, K.RATE_PER_MINUTE / 60_000))


@query("token_budget", bucket_sql("value * 100", 40_000, "200000e0 / 3600000"))
def token_budget(spark, sf_dir):
    return rounded(K.token_bucket(events(spark, sf_dir).withColumn("cost", F.col("cost") * 100), K.TOKENS_BURST, K.TOKENS_PER_HOUR / 3_600_000))


@query("budget_ledger", "SELECT user_id AS key, event_id, count(*) OVER w AS calls, round(sum(value) OVER w, 6) AS spent, count(*) OVER w <= 5 AND round(sum(value) OVER w, 6) <= 60000 AS within FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def budget_ledger(spark, sf_dir):
    return K.budget_ledger(events(spark, sf_dir))


@query("token_budget_release", bucket_sql("CASE WHEN event_id % 3 = 0 THEN -value * 50 ELSE value * 400 END", 40_000, "200000e0 / 3600000"))
def token_budget_release(spark, sf_dir):
    """Every third event gives back half of what it names."""
    cost = F.when(F.col("event_id") % 3 == 0, -F.col("cost") * 50).otherwise(F.col("cost") * 400)
    return rounded(K.token_bucket(events(spark, sf_dir).withColumn("cost", cost), K.TOKENS_BURST, K.TOKENS_PER_HOUR / 3_600_000))


LEDGER = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id, event_id % 2 = 0 AS reserve, round(value * 100, 2) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events),
r AS (SELECT key, event_id, i, CASE WHEN NOT reserve THEN 'unknown_reservation' WHEN cost > 20000 THEN 'request_token_ceiling_exceeded' ELSE 'ok' END AS outcome, CASE WHEN reserve AND cost <= 20000 THEN 1 ELSE 0 END AS calls, CASE WHEN reserve AND cost <= 20000 THEN cost ELSE 0 END AS reserved,
    CASE WHEN reserve AND cost <= 20000 THEN cost END AS open FROM e WHERE i = 1
  UNION ALL SELECT e.key, e.event_id, e.i, CASE WHEN e.reserve THEN CASE WHEN r.calls >= 40 THEN 'request_call_ceiling_exceeded' WHEN r.reserved + e.cost > 20000 THEN 'request_token_ceiling_exceeded' ELSE 'ok' END WHEN r.open IS NULL THEN 'unknown_reservation' ELSE 'settled' END,
    r.calls + CASE WHEN e.reserve AND r.calls < 40 AND r.reserved + e.cost <= 20000 THEN 1 ELSE 0 END,
    r.reserved + CASE WHEN e.reserve AND r.calls < 40 AND r.reserved + e.cost <= 20000 THEN e.cost WHEN NOT e.reserve AND r.open IS NOT NULL THEN -greatest(0, r.open - e.cost / 10) ELSE 0 END,
    CASE WHEN e.reserve AND r.calls < 40 AND r.reserved + e.cost <= 20000 THEN e.cost WHEN e.reserve THEN r.open END
  FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1)
SELECT key, event_id, outcome, CAST(calls AS BIGINT) AS calls, round(reserved, 4) AS reserved FROM r"""


@query("request_ledger", LEDGER)
def request_ledger(spark, sf_dir):
    """Even events reserve under the number 1, odd ones settle it at a tenth of their own cost."""
    even = F.col("event_id") % 2 == 0
    cost = F.round(F.col("cost") * 100, 2)
    e = events(spark, sf_dir).withColumns({"kind": F.when(even, "reserve").otherwise("settle"), "number": F.lit(1), "cost": F.when(even, cost).otherwise(cost / 10)})
    return K.request_ledger(e, 40, 20_000).withColumn("reserved", F.round("reserved", 4))


JOB_STEPS = ["running", "queued", "cancelling", "succeeded", "running", "cancelled", "failed"]


@query("job_states", f"""WITH RECURSIVE e AS (SELECT user_id AS key, {JOB_STEPS}[1 + event_id % 7] AS state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  legal AS (SELECT * FROM (VALUES ('queued', 'running'), ('queued', 'cancelling'), ('queued', 'failed'), ('queued', 'cancelled'), ('running', 'cancelling'), ('running', 'succeeded'), ('running', 'failed'), ('cancelling', 'cancelled'), ('cancelling', 'succeeded'), ('cancelling', 'failed')) AS t(a, b)),
  j AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, 'queued' AS state, 0 AS changes, 0 AS illegal FROM e
    UNION ALL SELECT e.key, e.i, CASE WHEN l.b IS NOT NULL THEN e.state ELSE j.state END, j.changes + CASE WHEN l.b IS NOT NULL THEN 1 ELSE 0 END, j.illegal + CASE WHEN l.b IS NULL AND e.state <> j.state THEN 1 ELSE 0 END FROM j JOIN e ON e.key = j.key AND e.i = j.i + 1 LEFT JOIN legal l ON l.a = j.state AND l.b = e.state)
  SELECT key, arg_max(state, i) AS state, CAST(max(changes) AS BIGINT) AS changes, CAST(max(illegal) AS BIGINT) AS illegal FROM j GROUP BY key""")
def job_states(spark, sf_dir):
    """Every user's events as the states of one job, by event id."""
    step = F.element_at(F.array(*[F.lit(x) for x in JOB_STEPS]), (F.col("event_id") % 7 + 1).cast("int"))
    return K.job_states(events(spark, sf_dir).withColumn("state", step))


@query("last_state", "SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY user_id")
def last_state(spark, sf_dir):
    return K.last_state(events(spark, sf_dir))


@query("ring_log", "SELECT user_id AS key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def ring_log(spark, sf_dir):
    """The last twenty lines of each log, which is what the ring holds."""
    return K.ring_log(events(spark, sf_dir).select("key", "ts", "event_id"), "key", ["ts", "event_id"], 20).select("key", "event_id")


SESSIONS_ASK = """WITH RECURSIVE g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g),
  s AS (SELECT user_id % 8 AS store, user_id AS key, epoch_us(min(ts)) AS a, epoch_us(max(ts)) + 43200000000 AS z FROM n GROUP BY user_id, s),
  e AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY a, key) AS i FROM s),
  r AS (SELECT DISTINCT store, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS key, CAST(0 AS BIGINT) AS a, '' AS outcome, CAST([] AS STRUCT(key BIGINT, z BIGINT)[]) AS held FROM e
    UNION ALL SELECT store, i, key, a, outcome, CASE WHEN outcome = 'ok' THEN list_append(held, {'key': key, 'z': z}) ELSE held END FROM (
      SELECT *, CASE WHEN len(held) >= 12 THEN 'store_full' WHEN len(list_filter(held, lambda x: x.key = q.key)) >= 2 THEN 'principal_full' ELSE 'ok' END AS outcome
      FROM (SELECT e.*, list_filter(r.held, lambda x: x.z > e.a) AS held FROM r JOIN e ON e.store = r.store AND e.i = r.i + 1) q))
  SELECT key, a AS start_us, outcome, CAST(len(list_filter(held, lambda x: x.key = r.key)) AS BIGINT) AS mine, CAST(len(held) AS BIGINT) AS "all" FROM r WHERE i > 0"""


@query("open_sessions", SESSIONS_ASK)
def open_sessions(spark, sf_dir):
    s = K.sessions(events(spark, sf_dir), "10 minutes")
    return R.open_sessions(s, 43_200_000, 2, 12, F.col("key") % 8).select("key", "start_us", "outcome", "mine", "all")


RUNS_SQL = """WITH RECURSIVE v AS (SELECT event_id // 4 AS run, event_id, epoch_us(ts) // 1000 AS t, CASE WHEN event_id % 7 = 0 THEN user_id ELSE event_id // 4 % 10 END AS key,
    ['create', 'claim', 'release', 'close'][1 + event_id % 4] AS kind, CASE WHEN event_id % 4 <> 2 OR event_id % 9 > 1 THEN CAST(round(value * 1000) AS BIGINT) END AS bytes,
    CASE WHEN event_id % 4 = 1 AND event_id % 5 = 0 THEN ['a', 'a'] WHEN event_id % 3 = 0 THEN ['b', 'a'] ELSE ['a', 'b'] END AS calls, event_type FROM events),
  e AS (SELECT run % 16 AS store, *, row_number() OVER (PARTITION BY run % 16 ORDER BY t, event_id) AS i FROM v WHERE kind <> 'close' OR event_type = 'purchase'),
  s AS (SELECT DISTINCT store, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST([] AS STRUCT(run BIGINT, key BIGINT, bytes BIGINT, until BIGINT, busy BOOLEAN, calls VARCHAR[])[]) AS held FROM e
    UNION ALL SELECT store, i, event_id, outcome,
      CASE WHEN kind = 'create' AND outcome = 'ok' THEN list_append(held, {'run': run, 'key': key, 'bytes': bytes, 'until': t + 36000000, 'busy': false, 'calls': list_sort(calls)})
        WHEN kind = 'claim' AND outcome = 'ok' THEN list_append(others, {'run': run, 'key': key, 'bytes': mine.bytes, 'until': mine.until, 'busy': true, 'calls': mine.calls})
        WHEN kind = 'release' AND outcome = 'ok' AND bytes IS NOT NULL THEN list_append(others, {'run': run, 'key': key, 'bytes': bytes, 'until': t + 36000000, 'busy': false, 'calls': list_sort(calls)})
        WHEN kind IN ('release', 'close') AND outcome IN ('ok', 'run_too_large') THEN others ELSE held END
    FROM (SELECT *, CASE
        WHEN kind = 'create' THEN CASE WHEN mine IS NOT NULL THEN 'run_exists' WHEN len(held) >= 6 THEN 'store_full' WHEN len(list_filter(held, lambda x: x.key = q.key)) >= 2 THEN 'principal_full'
          WHEN bytes > 150000 THEN 'run_too_large' WHEN total + bytes > 250000 THEN 'memory_full' ELSE 'ok' END
        WHEN mine IS NULL OR mine.key <> key THEN 'run_not_found'
        WHEN kind = 'claim' THEN CASE WHEN mine.busy THEN 'run_busy' WHEN list_sort(calls) <> mine.calls THEN 'results_mismatch' ELSE 'ok' END
        WHEN kind = 'release' THEN CASE WHEN NOT mine.busy THEN 'not_claimed' WHEN bytes > 150000 OR total - mine.bytes + bytes > 250000 THEN 'run_too_large' ELSE 'ok' END
        ELSE 'ok' END AS outcome
      FROM (SELECT *, list_filter(held, lambda x: x.run = p.run)[1] AS mine, list_filter(held, lambda x: x.run <> p.run) AS others, coalesce(list_sum(list_transform(held, lambda x: x.bytes)), 0) AS total
        FROM (SELECT e.*, list_filter(s.held, lambda x: x.busy OR x.until > e.t) AS held FROM s JOIN e ON e.store = s.store AND e.i = s.i + 1) p) q))
  SELECT store, event_id, outcome, CAST(len(held) AS BIGINT) AS runs, CAST(coalesce(list_sum(list_transform(held, lambda x: x.bytes)), 0) AS BIGINT) AS bytes FROM s WHERE i > 0"""


@query("run_stores", RUNS_SQL)
def run_stores(spark, sf_dir):
    """Every four events are one run's: it is created, claimed, released and (some) closed, now and then by another key or
    with other results. Sixteen stores with tight ceilings."""
    e, n = events(spark, sf_dir), F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("create", "claim", "release", "close")]), (n % 4 + 1).cast("int"))
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    run = (n / 4).cast("bigint")
    rows = e.select(
        (run % 16).alias("store"), "event_id", "ts_ms", kind.alias("kind"), run.alias("run"),
        F.when(n % 7 == 0, F.col("key")).otherwise(run % 10).alias("key"),
        F.when((n % 4 != 2) | (n % 9 > 1), F.round(F.col("cost") * 1000)).alias("bytes"),
        F.when((n % 4 == 1) & (n % 5 == 0), pair("a", "a")).when(n % 3 == 0, pair("b", "a")).otherwise(pair("a", "b")).alias("calls"),
        "state",
    )
    asked = rows.filter((F.col("kind") != "close") | (F.col("state") == "purchase"))
    return R.run_stores(asked, ttl_ms=36_000_000, most=6, most_of_key=2, run_bytes=150_000, all_bytes=250_000)


AUDIT_CASES = [
    ("index.job_started", "started", '{"jobId": "j", "collection": "c", "pathHash": "0123456789abcdef", "kind": "index"}', None),
    ("index.job_started", "started", '{"jobId": "j", "pathHash": "0123456789abcdef", "kind": "index"}', "missing:collection"),
    ("auth.rate_limited", "denied", '{"keyId": "k", "retryAfterSeconds": "soon"}', "invalid:retryAfterSeconds"),
    ("auth.rate_limited", "denied", '{"keyId": "k", "retryAfterSeconds": 3, "reason": "x"}', None),
    ("request.host_rejected", "denied", '{"host": "h"}', "unknown:host"),
    ("request.host_rejected", "maybe", "{}", "bad_outcome"),
    ("request.other", "denied", "{}", "unknown_type"),
    ("admin.key_created", "created", "[1]", "bad_fields"),
    ("index.root_denied", "denied", '{"pathHash": "/etc"}', "invalid:pathHash"),
]


@query("audit_problem", "SELECT event_id, [" + ", ".join("NULL" if c[3] is None else f"'{c[3]}'" for c in AUDIT_CASES) + f"][1 + event_id % {len(AUDIT_CASES)}] AS problem FROM events")
def audit_problem(spark, sf_dir):
    """Events of nine kinds; what is wrong with each is stated."""
    at = (F.col("event_id") % len(AUDIT_CASES) + 1).cast("int")
    of = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in AUDIT_CASES]), at)
    return table(spark, sf_dir, "events").select("event_id", K.audit_problem(of(0), of(1), of(2)).alias("problem"))


@query("file_progress", "SELECT event_id, round((user_id + [0.05, 0.15, 0.45, 0.55, 0.8, 0.95, 1.0, 0][1 + event_id % 8]) / (user_id + 3), 6) AS share FROM events")
def file_progress(spark, sf_dir):
    step = F.element_at(F.array(*[F.lit(x) for x in (*K.STEP_WEIGHTS, "no step")]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.round(K.file_progress(step, F.col("user_id"), F.col("user_id") + 3), 6).alias("share"))


RETRY_CASES = [
    (429, False, 0, None, True, 500, "backoff"), (429, False, 1, 3, True, 3000, "retry-after"), (503, False, 2, 1, True, 2000, "backoff"), (503, True, 0, None, False, None, None),
    (400, False, 0, None, False, None, None), (None, False, 1, None, True, 1000, "backoff"), (500, False, 3, None, False, None, None), (429, False, 0, 60, False, None, None),
]


@query("retry_plan", "SELECT event_id, " + ", ".join(f"{[c[i] for c in RETRY_CASES]}[1 + event_id % 8] AS {name}".replace("None", "NULL").replace("True", "true").replace("False", "false") for i, name in ((4, "retry"), (5, "delay_ms"), (6, "source"))) + " FROM events")
def retry_plan(spark, sf_dir):
    """Failures of eight kinds; what follows each is stated."""
    at = (F.col("event_id") % len(RETRY_CASES) + 1).cast("int")
    of = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in RETRY_CASES]), at)
    plan = K.retry_plan(of(0), of(1), of(2), 4, of(3), first_ms=500)
    return table(spark, sf_dir, "events").select("event_id", plan.alias("p")).select("event_id", "p.*")


@query("jsonl_rotation", """WITH RECURSIVE l AS (SELECT event_type AS sink, event_id AS seq, length(props) + 1 AS size, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
  r AS (SELECT sink, seq, i, 0 AS file, size AS used FROM l WHERE i = 1 UNION ALL SELECT l.sink, l.seq, l.i, r.file + CASE WHEN r.used + l.size > 4000 THEN 1 ELSE 0 END, CASE WHEN r.used + l.size > 4000 THEN l.size ELSE r.used + l.size END FROM r JOIN l ON l.sink = r.sink AND l.i = r.i + 1)
  SELECT sink, seq, file FROM r QUALIFY file >= max(file) OVER (PARTITION BY sink) - 4""")
def jsonl_rotation(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.col("event_type").alias("sink"), F.col("event_id").alias("seq"), F.col("props").alias("line"))
    return J.kept(J.rotated(lines, 4000)).select("sink", "seq", "file")


@query("continuations", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g) SELECT user_id AS key, count(*) AS n, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS us FROM s GROUP BY user_id, s""")
def continuations(spark, sf_dir):
    return K.sessions(events(spark, sf_dir), "10 minutes").select("key", "n", (F.unix_micros("last") - F.unix_micros("start")).alias("us"))


@query("audit_validate", "SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k NOT IN ('a'))), ',') AS unknown, event_type IN ('view', 'click', 'purchase') AS legal FROM events")
def audit_validate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(K.unknown_fields(F.col("props"), ["a"]), ",").alias("unknown"), F.col("event_type").isin("view", "click", "purchase").alias("legal"))


@query("progress", "SELECT event_id, event_type AS phase, CASE WHEN event_id % 2 = 0 THEN user_id END AS done FROM events")
def progress(spark, sf_dir):
    line = F.concat(F.when(F.col("event_id") % 2 == 0, "@progress ").otherwise("plain "), F.lit('{"done": '), "user_id", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("phase"), K.progress_payload(line, "@progress ", "done bigint")["done"].alias("done"))


@query("sse_frames", "SELECT event_id, event_type AS event, CAST(user_id AS VARCHAR) AS data FROM events UNION ALL SELECT event_id, 'done', '' FROM events")
def sse_frames(spark, sf_dir):
    stream = F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), "user_id", F.lit("\n\nevent: done\ndata:\n\n"))
    f = table(spark, sf_dir, "events").select("event_id", F.explode(K.sse_frames(stream)).alias("f"))
    return f.select("event_id", "f.event", "f.data")


@query("event_windows", "SELECT event_type, CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_us, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    w = events(spark, sf_dir).groupBy("state", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("state").alias("event_type"), F.unix_micros("w.start").alias("start_us"), "n")


ASOF = """WITH p AS (SELECT user_id, ts, max(event_id) AS last_event FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts),
  r AS (SELECT p.user_id, p.ts, last_event, least(e.value, 5) AS tokens FROM p JOIN events e ON e.event_id = p.last_event)
SELECT e.event_id, r.last_event, round(coalesce(least(5e0, r.tokens + (epoch_us(e.ts) // 1000 - epoch_us(r.ts) // 1000) * (30e0 / 6000000)), 5e0), 6) AS tokens
FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN r ON r.user_id = e.user_id AND r.ts <= e.ts"""


@query("asof_refill", ASOF)
def asof_refill(spark, sf_dir):
    """What each event finds in its user's bucket, which the last purchase before left with its value."""
    e = events(spark, sf_dir)
    bought = e.filter("state = 'purchase'").select("key", "ts", "event_id", "ts_ms", F.least("cost", F.lit(5.0)).alias("tokens"))
    asked = e.filter("state <> 'purchase'").select("key", "ts", "event_id", "ts_ms")
    d = asof_join(asked, bought, ["key"], "ts", ["event_id"])
    tokens = refilled(F.col("last_tokens"), F.col("ts_ms") - F.col("last_ts_ms"), 5, 30 / 6_000_000)
    return d.select("event_id", F.col("last_event_id").alias("last_event"), F.round(tokens, 6).alias("tokens"))


RESERVED = """WITH RECURSIVE e AS (SELECT event_id // 2 % 40 AS key, event_id, epoch_us(ts) // 1000 AS t, event_id % 2 = 0 AS ask, CASE WHEN event_id % 2 = 0 THEN event_id // 2 ELSE event_id // 2 - CASE WHEN event_id % 3 = 0 THEN 0 ELSE 40 END END AS number,
    value AS cost, 300e0 + event_id % 3 * 100 AS cap, row_number() OVER (PARTITION BY event_id // 2 % 40 ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
  s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, '' AS outcome, CAST(NULL AS DOUBLE) AS tokens, CAST(NULL AS BIGINT) AS since, CAST(NULL AS DOUBLE) AS cap, CAST([] AS STRUCT(number BIGINT, cost DOUBLE)[]) AS held FROM e
    UNION ALL SELECT key, i, event_id, outcome,
      CASE WHEN outcome = 'ok' THEN now - cost WHEN outcome = 'refunded' THEN least(c, now + greatest(0, mine - cost)) ELSE now END,
      CASE WHEN ask THEN t ELSE since END, c,
      CASE WHEN outcome = 'ok' THEN list_append(list_filter(held, lambda x: x.number <> q.number), {'number': number, 'cost': cost}) ELSE CASE WHEN outcome = 'refunded' THEN list_filter(held, lambda x: x.number <> q.number) ELSE held END END
    FROM (SELECT *, CASE WHEN ask THEN CASE WHEN cost > c THEN 'too_large' WHEN now >= cost THEN 'ok' ELSE 'wait' END WHEN now IS NULL THEN 'no_bucket' WHEN mine IS NULL THEN 'unknown_reservation' ELSE 'refunded' END AS outcome
      FROM (SELECT key, i, event_id, t, ask, number, cost, since, held, CASE WHEN gone AND ask THEN own WHEN NOT gone THEN had END AS c,
          CASE WHEN gone AND ask THEN own WHEN NOT gone AND ask THEN least(had, tokens + (t - since) * (1e0 / 90000)) WHEN NOT gone THEN tokens END AS now, list_filter(held, lambda x: x.number = p.number)[1].cost AS mine
        FROM (SELECT e.key, e.i, e.event_id, e.t, e.ask, e.number, e.cost, e.cap AS own, s.cap AS had, s.tokens, s.since, s.cap IS NULL OR e.t - s.since >= ceil(s.cap / (1e0 / 90000)) AS gone,
            CASE WHEN s.cap IS NULL OR e.t - s.since >= ceil(s.cap / (1e0 / 90000)) THEN [] ELSE s.held END AS held FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1) p)) q)
  SELECT key, event_id, outcome, round(tokens, 4) AS remaining FROM s WHERE i > 0"""


def reservation_events(spark, sf_dir):
    """Pairs of events: the first reserves, the second releases the same number or that of the key's pair before."""
    n = F.col("event_id")
    pair = F.expr("event_id div 2")
    number = F.when((n % 2 == 0) | (n % 3 == 0), pair).otherwise(pair - 40)
    e = events(spark, sf_dir).select((pair % 40).alias("key"), "event_id", "ts_ms", F.when(n % 2 == 0, "reserve").otherwise("release").alias("kind"), number.alias("number"), "cost")
    return e.withColumns({"capacity": 300.0 + n % 3 * 100, "per_ms": F.lit(1 / 90_000)})


@query("token_reservations", RESERVED)
def token_reservations(spark, sf_dir):
    return rounded(K.token_reservations(reservation_events(spark, sf_dir)))


@query("exact_quantiles", "SELECT event_type, CAST(0.5 AS DOUBLE) AS share, quantile_disc(value, 0.5) AS value FROM events GROUP BY event_type UNION ALL SELECT event_type, CAST(0.95 AS DOUBLE), quantile_disc(value, 0.95) FROM events GROUP BY event_type")
def exact_quantile_values(spark, sf_dir):
    return exact_quantiles(events(spark, sf_dir).select("state", "cost"), ["state"], "cost", [0.5, 0.95]).select(F.col("state").alias("event_type"), "share", "value")
