"""Stores of runs against a plain list of runs."""

import collections
import random

from sparkloom.operators import continuations as R

SCHEMA = "store long, event_id long, ts_ms long, kind string, run long, key long, bytes long, calls array<string>"


def brute(rows, ttl, most, most_of_key, run_bytes, all_bytes):
    out, stores = [], collections.defaultdict(list)
    for store, event, now, kind, run, key, size, calls in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        held = stores[store] = [r for r in stores[store] if r["busy"] or r["until"] > now]
        total = sum(r["size"] for r in held)
        mine = next((r for r in held if r["run"] == run), None)
        calls, outcome = calls or [], "ok"
        if kind == "create":
            checks = [(mine, "run_exists"), (len(held) >= most, "store_full"), (sum(r["key"] == key for r in held) >= most_of_key, "principal_full"), (size > run_bytes, "run_too_large"), (total + size > all_bytes, "memory_full")]
            outcome = next((name for bad, name in checks if bad), "ok")
            if outcome == "ok":
                held.append({"run": run, "key": key, "size": size, "until": now + ttl, "busy": False, "calls": sorted(calls)})
        elif mine is None or mine["key"] != key:
            outcome = "run_not_found"
        elif kind == "claim":
            outcome = "run_busy" if mine["busy"] else "ok" if len(set(calls)) == len(calls) and set(calls) == set(mine["calls"]) else "results_mismatch"
            mine["busy"] = mine["busy"] or outcome == "ok"
        elif kind == "close":
            held.remove(mine)
        elif not mine["busy"]:
            outcome = "not_claimed"
        elif size is None:
            held.remove(mine)
        elif size > run_bytes or total - mine["size"] + size > all_bytes:
            outcome = "run_too_large"
            held.remove(mine)
        else:
            mine.update(size=size, calls=sorted(calls), busy=False, until=now + ttl)
        out.append((store, event, outcome, len([r for r in held if r["busy"] or r["until"] > now]), sum(r["size"] for r in held if r["busy"] or r["until"] > now)))
    return sorted(out)


def test_run_stores(spark):
    r = random.Random(3)
    rows = []
    for i in range(1500):
        kind = r.choice(["create", "create", "claim", "claim", "release", "close"])
        calls = r.choice([["a"], ["a", "b"], ["b", "a"], ["a", "a"], [], None])
        rows.append((r.randrange(3), i, i * 40 + r.randrange(3), kind, r.randrange(60), r.randrange(4), None if kind == "release" and r.random() < 0.2 else r.randrange(60), calls))
    limits = (4000, 9, 4, 50, 180)
    got = sorted(map(tuple, R.run_stores(spark.createDataFrame(rows, SCHEMA).repartition(5), *limits).collect()))
    assert got == brute(rows, *limits)
    met = {x[2] for x in got}
    assert met == {"ok", "run_exists", "store_full", "principal_full", "run_too_large", "memory_full", "run_not_found", "run_busy", "results_mismatch", "not_claimed"}


def test_refused_runs_take_no_place(spark):
    rows = [(1, i, i, "create", i, 7, 10, None) for i in range(5)] + [(1, 5, 2000, "create", 5, 7, 10, None)]
    got = [tuple(x)[2:] for x in sorted(R.run_stores(spark.createDataFrame(rows, SCHEMA), 1000, 100, 2, 100, 1000).collect(), key=lambda x: x["event_id"])]
    assert got == [("ok", 1, 10), ("ok", 2, 20), *[("principal_full", 2, 20)] * 3, ("ok", 1, 10)]


def test_a_run_at_work_does_not_expire():
    s = R.RunStore(ttl=10)
    assert s.create(0, "r", "k", 5, ("c",)) == "ok" and s.claim(9, "r", "k", ("c",)) == "ok"
    s.expire(100)
    assert len(s.runs) == 1 and s.claim(100, "r", "k", ("c",)) == "run_busy"
    assert s.release(101, "r", "k", 7, ("d",)) == "ok" and s.size == 7
    assert s.claim(110, "r", "k", ("c",)) == "results_mismatch" and s.close(111, "r", "k") == "run_not_found" and s.size == 0


def test_accounts():
    from sparkloom.operators.control import Account

    a = Account()
    assert a.act("release", 0, 1, 5.0, 10.0, 1.0) == ("no_bucket", None)
    assert a.act("reserve", 0, 1, 8.0, 10.0, 1.0) == ("ok", 2.0)
    assert a.act("reserve", 1, 2, 8.0, 99.0, 9.0) == ("wait", 3.0)  # the first event's limits hold
    assert a.act("reserve", 1, 3, 50.0, 99.0, 9.0) == ("too_large", 3.0)
    assert a.act("release", 2, 2, 1.0, 0, 0) == ("unknown_reservation", 3.0)
    assert a.act("release", 2, 1, 3.0, 0, 0) == ("refunded", 8.0) and a.act("release", 2, 1, 3.0, 0, 0)[0] == "unknown_reservation"
    assert a.act("reserve", 11, 4, 50.0, 99.0, 9.0) == ("ok", 49.0)  # idle for 10 ms: a new bucket, with the event's limits
