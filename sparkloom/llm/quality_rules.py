"""Quality rules: word and line statistics of each text, and robust multivariate outliers.

Everything here is DataFrame expressions. Minimum covariance determinant per (language, source), of
groups of any size: from two deterministic starts (coordinate-wise medians with MADs, and medians with the
floors alone), concentration steps (keep the ``coverage`` nearest rows of each group, take their mean and
covariance) as grouped aggregates over the written statistics, and of both the estimate of the smaller
determinant. Each group's estimate is then drawn towards that of all rows together, which counts as ``PRIOR``
rows of the group: a group of many rows keeps its own, one of few leans on the whole, and
nothing changes at any one size. A group's parameters are one small row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, words_of

SYMBOLS = "#*$%&|<>"
#: The transformed vector, with the least scale each part is given (a part that is constant
#: over a group would otherwise reject every other value).
FLOORS = {"v_length": 0.6, "v_word": 0.08, "v_symbol": 0.12, "v_line": 0.15, "v_repeat": 0.15}
#: Chosen on half of the labels, held against the other half (see the README).
QUANTILE = 0.9999
#: Rows of a group that the estimate over all rows counts as.
PRIOR = 100
#: Groups whose parameters (some 200 bytes each) are broadcast at most; those of more are joined, with
#: each group's rows dealt to SALTS tasks.
MOST_BROADCAST, SALTS = 20_000, 32
POOLED = "pooled"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more, the first included.

    Windows are compared by 64-bit hashes within one text. They are sorted with their places; each
    repeated window then adds the words it reaches beyond the repeated window before it.
    """

    def keyed(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.array_sort(F.transform(at, lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(
            s,
            lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])),
        )
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(p, i - 1))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(let(keyed(words), places), covered)).cast("long")


def _statistics(text: Column) -> Column:
    """A struct of the statistics of one text; words are split once."""
    words = words_of(text)
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    n_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    n_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return F.struct(
        n_word.alias("word"),
        n_line.alias("line"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def text_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words
    and base_failed. A null or empty text has no word and so fails the base rules."""
    kept = [F.col(c) for c in (keep if keep is not None else docs.columns)]
    d = docs.select(*kept, _statistics(F.col(text)).alias("__s"))
    s = F.col("__s")
    d = d.select(
        *kept,
        s["word"]["n_words"].alias("n_words"),
        s["word_chars"].alias("word_chars"),
        s["n_symbols"].alias("n_symbols"),
        s["line"]["n_lines"].alias("n_lines"),
        s["line"]["n_dup_lines"].alias("n_dup_lines"),
        s["word"]["n_repeat_words"].alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1.0 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_quantile(p: float, df: int) -> float:
    """By bisection of the distribution function."""
    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(df / 2, mid / 2) < p else (low, mid)
    return low


def _cholesky(n: int, cov) -> list[tuple[str, Column]]:
    """The lower factor of a covariance matrix as columns l_i_j, row by row; each later one uses
    the earlier ones by name. Pivots are kept at 1e-12 or more."""
    out = []
    for i in range(n):
        for j in range(i + 1):
            rest = cov(i, j)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out.append((f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}")))
    return out


def _with_parameters(rows: DataFrame, params: DataFrame, groups: int) -> DataFrame:
    """``rows`` with the columns of ``params`` (a row per ``grp``, ``groups`` of them) beside them; rows
    without any stay."""
    if groups <= MOST_BROADCAST:
        return rows.join(F.broadcast(params), "grp", "left")
    salted = params.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["grp", "__salt"], "left").drop("__salt")


def _distances(rows: DataFrame, params: DataFrame, groups: int, names: list[str]) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance from the group's centre."""
    d = _with_parameters(rows, params, groups)
    for i, v in enumerate(names):
        rest = F.col(v) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        d = d.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, len(names))), F.col("z_0") * F.col("z_0"))
    return d.withColumn("d2", total).select(*rows.columns, "d2")


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1)]


def _factored(d: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """``keep``, m_i and the Cholesky factor l_i_j of the covariances c_i_j."""
    for name, value in _cholesky(n, lambda i, j: F.col(f"c_{i}_{j}")):
        d = d.withColumn(name, value)
    return d.select(*keep, *[f"m_{i}" for i in range(n)], *[f"l_{i}_{j}" for i, j in _pairs(n)])


def robust_parameters(rows: DataFrame, floors: dict[str, float], coverage: float, steps: int, prior: float = PRIOR) -> tuple[DataFrame, int]:
    """A row per ``grp`` of ``rows`` (a written table with the columns of ``floors``), and one for POOLED, all rows
    together: centre m_i and Cholesky factor l_i_j of the minimum-covariance-determinant estimate,
    drawn towards the pooled one; and the number of rows.

    A group's rows never meet in one task: medians and cuts are mergeable sketches (exact up to 2,000 rows), means
    and products are sums. The floors are added to the variances, so a group of one row has an estimate, too.
    Both starts of a group go through the same jobs as two groups.
    """
    names = list(floors)
    n = len(names)
    pairs = _pairs(n)
    correction = coverage / _gamma_p(n / 2 + 1, chi2_quantile(coverage, n) / 2)

    groups = rows.select("grp").distinct().count()
    start = materialize(rows.groupBy("grp").agg(*[F.percentile_approx(v, 0.5, 2000).alias(f"m_{i}") for i, v in enumerate(names)]), "mcd-median")
    dev = _with_parameters(rows, start, groups)
    spread = dev.groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(v) - F.col(f"m_{i}")), 0.5, 2000).alias(f"s_{i}") for i, v in enumerate(names)])

    def diagonal(scale) -> Column:
        return F.struct(*[(scale(i) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j in pairs])

    floor = [F.lit(float(floors[v])) for v in names]
    starts = F.array(diagonal(lambda i: F.greatest(1.4826 * F.col(f"s_{i}"), floor[i])), diagonal(lambda i: floor[i]))
    first = start.join(spread, "grp").select("grp", *[f"m_{i}" for i in range(n)], F.posexplode(starts).alias("start", "l"))
    tagged = F.concat(F.col("start").cast("string"), F.lit(":"), F.col("grp"))
    params = materialize(first.select(tagged.alias("grp"), *[f"m_{i}" for i in range(n)], "l.*"), "mcd-start")
    twice = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))).select(tagged.alias("grp"), *names)
    for step in range(steps):
        near = _distances(twice, params, 2 * groups, names)
        cut = materialize(near.groupBy("grp").agg(F.percentile_approx("d2", coverage, 2000).alias("cut")), "mcd-cut")
        half = _with_parameters(near, cut, 2 * groups).filter(F.col("d2") <= F.col("cut"))
        sums = half.groupBy("grp").agg(
            F.count("*").alias("h"),
            *[F.avg(v).alias(f"m_{i}") for i, v in enumerate(names)],
            *[F.covar_pop(names[i], names[j]).alias(f"c_{i}_{j}") for i, j in pairs],
        )
        regular = [(F.col(f"c_{i}_{j}") * correction + (floors[names[i]] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in pairs]
        sums = materialize(sums.select("grp", "h", *[f"m_{i}" for i in range(n)], *regular), "mcd-step")
        params = _factored(sums, n, ["grp"])
    log_det = sum((F.log(f"l_{i}_{i}") for i in range(1, n)), F.log("l_0_0"))
    better = params.select(F.split_part(F.col("grp"), F.lit(":"), F.lit(1)).alias("start"), F.expr("substr(grp, 3)").alias("own"), log_det.alias("log_det"))
    better = better.groupBy("own").agg(F.min(F.struct("log_det", "start"))["start"].alias("start"))
    best = better.select(F.concat("start", F.lit(":"), "own").alias("grp"), F.col("own"))
    best = materialize(sums.join(best, "grp").drop("grp").withColumnRenamed("own", "grp"), "mcd-best")

    whole = best.filter(F.col("grp") == POOLED).first()
    if whole is None:  # no row, no parameters
        return _factored(best, n, ["grp"]), groups
    own = F.when(F.col("grp") == POOLED, F.lit(1.0)).otherwise(F.col("h") / (F.col("h") + F.lit(float(prior))))
    mixed = lambda c: (F.col("__w") * F.col(c) + (1 - F.col("__w")) * F.lit(whole[c])).alias(c)
    drawn = best.withColumn("__w", own).select("grp", *[mixed(f"m_{i}") for i in range(n)], *[mixed(f"c_{i}_{j}") for i, j in pairs])
    return materialize(_factored(drawn, n, ["grp"]), "mcd-params"), groups


def _judge(docs: DataFrame, text: str, by: tuple[str, ...], keep: list[str], prior: float, coverage: float, steps: int, quantile: float) -> DataFrame:
    """The ``keep`` columns as __k0, __k1, ... with the statistics, d2 and __kept."""
    inner = [f"__k{i}" for i in range(len(keep))]
    group = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(by)]), {"ignoreNullFields": "false"})
    d = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)], F.col(text).alias("__text"), group.alias("__own"))
    d = text_statistics(d, "__text", [*inner, "__own"])
    n = F.greatest(F.col("n_words"), F.lit(1))
    d = materialize(
        d.select(
            "*",
            F.log(n).alias("v_length"),
            F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("v_word"),
            F.sqrt(F.col("n_symbols") / n).alias("v_symbol"),
            F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("v_line"),
            F.sqrt(F.col("n_repeat_words") / n).alias("v_repeat"),
        ),
        "quality-stats",
    )
    good = d.filter(~F.col("base_failed")).select(F.explode(F.array("__own", F.lit(POOLED))).alias("grp"), *FLOORS)
    params, groups = robust_parameters(good, FLOORS, coverage, steps, prior)
    judged = _distances(d.withColumnRenamed("__own", "grp"), params, groups, list(FLOORS))
    good_enough = F.coalesce(F.col("d2") <= chi2_quantile(quantile, len(FLOORS)), F.lit(True))
    return judged.select(*inner, *STATISTICS, "d2", (~F.col("base_failed") & good_enough).alias("__kept"))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    by: tuple[str, ...] = ("lang", "source"),
    keep: list[str] | None = None,
    prior: float = PRIOR,
    coverage: float = 0.75,
    steps: int = 3,
    quantile: float = QUANTILE,
) -> DataFrame:
    """Per row of ``docs``: the ``keep`` columns (all by default), then the statistics, ``d2`` (squared
    Mahalanobis distance from the group's robust centre) and ``kept``.

    ``kept`` is false if the base rules fail (under 50 words, or over half of the words in repeated
    3-word windows) or ``d2`` lies beyond the chi-square ``quantile``. Rows that fail the base rules
    take no part in the estimates. Every group has an estimate of its own, drawn towards that of all
    rows together as if ``prior`` rows stood for them; nulls of ``by`` form groups of their own. Null and empty texts
    fail; repeated rows are judged alike; an empty table gives an empty result. Columns of ``docs``
    may have any names; one that is kept and named like a statistic comes out twice.
    """
    keep = list(keep if keep is not None else docs.columns)
    d = _judge(docs, text, by, keep, prior, coverage, steps, quantile)
    return d.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *STATISTICS, "d2", F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), prior: float = PRIOR, coverage: float = 0.75, steps: int = 3, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that the quality rules keep, with its columns."""
    d = _judge(docs, text, by, docs.columns, prior, coverage, steps, quantile)
    return d.filter("__kept").select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)])
