"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by membership pattern (their set of
sources), each pattern's tokens are routed to source quotas at a cost that rises with each
repetition, and each pattern's share is then drawn in a seeded order of its documents.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, words_of

SEED = 7
#: Parts of the seeded order whose sums are taken first; only the part in which the cut falls is
#: then walked document by document.
PARTS_BITS = 12


def targets(sizes: list[int], weights: list[float], most_times: int) -> list[float]:
    """Shares of the whole by weight; a share above ``most_times`` its source's size stops there, and
    the excess goes to the others by weight until none is above."""
    whole = float(sum(sizes))
    order = sorted(range(len(sizes)), key=lambda i: (most_times * sizes[i] / weights[i], i))
    stopped, open_weight = 0.0, float(sum(weights))
    level = 0.0
    for i in order:
        level = (whole - stopped) / open_weight
        if level <= most_times * sizes[i] / weights[i]:
            break
        stopped += most_times * sizes[i]
        open_weight -= weights[i]
        level = 0.0
    out = []
    for size, weight in zip(sizes, weights, strict=True):
        top = float(most_times * size)
        out.append(top if level == 0.0 else min(top, level * weight))
    return out


class Flow:
    """Min-cost maximum flow by successive cheapest paths."""

    def __init__(self, nodes: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for frm, to, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[frm].append(len(self.to))
            self.to.append(to)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def cheapest(self, s: int, t: int) -> list[int] | None:
        far = [float("inf")] * len(self.out)
        via = [-1] * len(self.out)
        far[s] = 0
        queue, waiting = deque([s]), {s}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] and far[a] + self.cost[e] < far[b]:
                    far[b], via[b] = far[a] + self.cost[e], e
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if via[t] < 0:
            return None
        path = []
        while t != s:
            path.append(via[t])
            t = self.to[via[t] ^ 1]
        return path

    def run(self, s: int, t: int) -> None:
        while path := self.cheapest(s, t):
            most = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= most
                self.room[e ^ 1] += most


def route(patterns: list[tuple[tuple, int]], quotas: dict, most_times: int) -> list[int]:
    """Tokens to take from each (sources, size) pattern so that the quotas are met as far as they can
    be at the least cost; the r-th pass over a pattern costs r - 1 a token."""
    sources = list(quotas)
    n = len(patterns)
    flow = Flow(n + len(sources) + 2)
    s, t = n + len(sources), n + len(sources) + 1
    at = {q: n + i for i, q in enumerate(sources)}
    taken = []
    for i, (members, size) in enumerate(patterns):
        taken.append([flow.arc(s, i, size, r) for r in range(most_times)])
        for m in members:
            flow.arc(i, at[m], most_times * size, 0)
    for q in sources:
        flow.arc(at[q], t, quotas[q], 0)
    flow.run(s, t)
    return [sum(flow.room[e ^ 1] for e in arcs) for arcs in taken]


def _fill(drawn: DataFrame) -> DataFrame:
    """``drawn`` with ``more`` 1 also for the largest undrawn row that fits what its pattern is still due,
    and so on until no undrawn row with a word fits; of equal sizes the first in the seeded order.

    What is due is less than one document here, so sizes are counted, the counts of a pattern (a row per
    size, not per document) are walked from the largest down, and a size that is not taken whole is cut
    by parts of the seeded order, of which only the one with the cut is ranked.
    """
    part = F.shiftright("draw", 52 - PARTS_BITS)
    left = drawn.groupBy("sources").agg((F.max("due") - F.sum(F.col("size") * F.col("more"))).alias("left"))
    left = materialize(left.filter("left > 0"), "mix-left")
    fit = drawn.filter("more = 0").join(left, "sources").filter("0 < size and size <= left")
    counts = materialize(fit.groupBy("sources", "size", part.alias("part")).agg(F.count("*").alias("n"), F.first("left").alias("left")), "mix-counts")
    sizes = counts.groupBy("sources", "size").agg(F.sum("n").alias("n"), F.first("left").alias("left"))
    offers = sizes.groupBy("sources").agg(F.first("left").alias("left"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("offers"))

    def take(state, offer):
        n = F.least(offer["n"], F.floor(state["left"] / offer["size"]))
        pick = F.struct(offer["size"].alias("size"), n.alias("want"), offer["n"].alias("n"))
        picks = F.when(n > 0, F.concat(state["picks"], F.array(pick))).otherwise(state["picks"])
        return F.struct((state["left"] - n * offer["size"]).alias("left"), picks.alias("picks"))

    none = F.expr("cast(array() as array<struct<size: bigint, want: bigint, n: bigint>>)")
    picks = offers.select("sources", F.explode(F.aggregate("offers", F.struct("left", none.alias("picks")), take)["picks"]).alias("pick"))
    picks = materialize(picks.select("sources", "pick.*"), "mix-picks")
    so_far = Window.partitionBy("sources", "size").orderBy("part")
    parts = counts.drop("left").join(picks.filter("want < n").select("sources", "size", "want"), ["sources", "size"])
    parts = parts.withColumn("through", F.sum("n").over(so_far)).filter("through - n < want and want <= through")
    cuts = parts.select("sources", "size", F.col("part").alias("cut"), (F.col("want") - F.col("through") + F.col("n")).alias("rest"))
    picks = materialize(picks.select("sources", "size", F.lit(True).alias("picked")).join(cuts, ["sources", "size"], "left"), "mix-cuts")
    rows = drawn.withColumn("part", part).join(picks, ["sources", "size"], "left")
    at_cut = F.coalesce((F.col("more") == 0) & (F.col("part") == F.col("cut")), F.lit(False))
    walk = Window.partitionBy("sources", "size").orderBy("draw", "doc_id", "tie")
    ranked = rows.filter(at_cut).withColumn("more", (F.row_number().over(walk) <= F.col("rest")).cast("bigint"))
    taken = F.coalesce(F.col("picked") & (F.col("cut").isNull() | (F.col("part") < F.col("cut"))), F.lit(False))
    others = rows.filter(~at_cut).withColumn("more", F.greatest("more", taken.cast("bigint")))
    return materialize(ranked.unionByName(others).select(*drawn.columns), "mix-filled")


def mix_sources(
    docs: DataFrame,
    membership: Column,
    weights: tuple[float, ...] = (5, 2, 1),
    doc_id: str = "doc_id",
    text: str = "text",
    most_times: int = 3,
    seed: int = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, *keep, sources, size, source_size, target, times, taken): how many words the mix takes of each
    row of ``docs``, repeats counted. ``membership`` gives its sources, an array<string>.

    Sources in code-point order, null last, take ``weights`` in turn. source_size and target are sums over
    the row's sources. A row's size is its words (null text: 0). Passes are whole
    but for a pattern's last, which takes documents in the order of a seeded digest as long as they fit
    what is due, then the largest that fits the rest, again and again until none is left that does. A null or empty membership is the null source. Rows that repeat an
    id have one digest and stand in order of size, then of a digest of their text and other columns, so that only rows
    that are the same in all of them could change places: reruns agree, however the rows are dealt; an empty table gives an empty result.

    The driver holds one row per distinct membership pattern, which is metadata, not data; the flow among them
    takes a search for each path it fills and suits some thousands of patterns.
    """
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.when(F.size(F.coalesce(membership, F.array())) == 0, F.array(F.lit(None).cast("string"))).otherwise(membership)))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint")
    d = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            *keep,
            members.alias("sources"),
            F.size(words_of(F.col(text))).cast("bigint").alias("size"),
            draw.alias("draw"),
            F.sha2(F.concat_ws(":", F.sha2(F.col(text), 256), F.to_json(F.struct(*[c for c in docs.columns if c not in (*keep, text)]))), 256).alias("tie"),
        ),
        "mix-sizes",
    )
    part = F.shiftright("draw", 52 - PARTS_BITS)
    sums = materialize(d.groupBy("sources", part.alias("part")).agg(F.sum("size").alias("size")), "mix-parts")
    patterns = [(tuple(r["sources"]), r["size"]) for r in sums.groupBy("sources").agg(F.sum("size").alias("size")).collect()]
    patterns.sort(key=lambda p: tuple((x is None, (x or "").encode("utf-8", "surrogatepass")) for x in p[0]))
    by_source: dict = {}
    for m, size in patterns:
        for x in m:
            by_source[x] = by_source.get(x, 0) + size
    names = sorted(by_source, key=lambda x: (x is None, (x or "").encode("utf-8", "surrogatepass")))
    # shares of the whole, each document counted once
    whole = sum(size for _, size in patterns)
    counted = sum(by_source.values())
    share = targets([by_source[x] for x in names], [weights[i % len(weights)] for i in range(len(names))], most_times)
    share = [t * (whole / counted) if counted != whole else t for t in share]
    target = dict(zip(names, share, strict=True))
    take = route(patterns, {x: int(target[x] + 0.5) for x in names}, most_times)
    due = [
        (list(m), sum(by_source[x] for x in m), float(sum(target[x] for x in m)), took // size if size else 0, took % size if size else 0)
        for (m, size), took in zip(patterns, take, strict=True)
    ]
    plan = spark.createDataFrame(due, "sources array<string>, source_size bigint, target double, passes bigint, due bigint")

    so_far = Window.partitionBy("sources").orderBy("part")
    cuts = (
        sums.withColumn("through", F.sum("size").over(so_far))
        .join(plan.select("sources", "due"), "sources")
        .filter((F.col("through") - F.col("size") < F.col("due")) & (F.col("due") < F.col("through")))
        .select("sources", F.col("part").alias("cut"), (F.col("through") - F.col("size")).alias("before"))
    )
    # no cut: the due ends between parts
    ends = (
        sums.withColumn("through", F.sum("size").over(so_far))
        .join(plan.select("sources", "due"), "sources")
        .filter(F.col("through") <= F.col("due"))
        .groupBy("sources")
        .agg(F.max("part").alias("last"))
    )
    limits = materialize(plan.join(cuts, "sources", "left").join(ends, "sources", "left"), "mix-limits")
    rows = d.withColumn("part", part).join(limits, "sources")
    walk = Window.partitionBy("sources").orderBy("draw", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.filter(F.col("part") == F.col("cut"))
    inside = inside.withColumn("more", (F.col("before") + F.sum("size").over(walk) <= F.col("due")).cast("bigint"))
    outside = rows.filter(~F.col("part").eqNullSafe(F.col("cut"))).withColumn("more", (F.col("part") <= F.coalesce("last", F.lit(-1))).cast("bigint"))
    drawn = materialize(inside.unionByName(outside).select("doc_id", *keep, "sources", "size", "draw", "tie", "source_size", "target", "passes", "due", "more"), "mix-drawn")
    drawn = _fill(drawn)
    times = F.col("passes") + F.col("more")
    return drawn.select("doc_id", *keep, "sources", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mixed_rows(docs: DataFrame, membership: Column, weights: tuple[float, ...] = (5, 2, 1), doc_id: str = "doc_id", text: str = "text", most_times: int = 3, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns. A row without a word
    is never taken."""
    rows = numbered(docs, "mix-rows")
    times = mix_sources(rows, membership, weights, doc_id, text, most_times, seed, keep=("__row",))
    taken = times.filter("taken > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("__time"))
    return rows.join(taken, "__row").select(*docs.columns)
