"""Quality rules: counts per text, base limits and robust outlier distances.

Every text gives five transformed statistics. For each (lang, source) group a
minimum-covariance-determinant estimate of their mean and covariance is made:
from four deterministic starts (medians, shortest halves, and the correlations of
bounded values and of spatial signs), concentration steps keep the nearest half
of the rows, (n + p + 1) / 2 of n, and estimate again until the determinant
stays. The start that ends at the least determinant counts; as usual, one last
estimate is made from all rows within its 97.5 % limit. A text is rejected when
its squared Mahalanobis distance to its group is over the limit.

All steps are column expressions and grouped sums. Only the five numbers of a
text are shuffled, summed before the exchange; the quantile of the distances is
a mergeable sketch, so a group with a third of all rows costs no task more.

Defined results: a null or empty text has no words and fails the base rules;
null ``lang`` or ``source`` are groups of their own; repeated rows are judged
row by row, each by its own values; other columns are not read. An empty table
gives no rows. A group of a few rows falls back on the tolerances, which are
added to every covariance, so the estimate is never singular.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words, written

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Words in a window of the repeat rule.
WINDOW = 5
#: Standard deviation that every transformed statistic has at least.
TOLERANCE = {"x_words": 0.5, "x_length": 0.05, "x_symbols": 0.05, "x_lines": 0.1, "x_repeats": 0.05}
STATS = list(TOLERANCE)
#: Part of normal rows within the limit of the last estimate.
WITHIN = 0.975


def counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, n_words, n_lines, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = docs.select(
        "doc_id",
        *keep,
        words(F.col("text")).alias("_w"),
        lines.alias("_l"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    hashed = base.select(
        "doc_id",
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_w") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("_w") - WINDOW),
                lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_g"),
    )
    plain = ["doc_id", *keep, "n_words", "n_lines", "word_chars", "n_symbols", "n_dup_lines"]
    # Texts whose windows all differ have nothing to sort.
    ordered = hashed.select(
        *plain,
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).alias("_s"),
    )
    twice = ordered.select(
        *plain,
        F.array_sort(
            F.transform(
                F.filter(
                    "_s",
                    lambda x, k: (F.get("_s", k - 1)["g"] == x["g"]) | (F.get("_s", k + 1)["g"] == x["g"]),
                ),
                lambda x: x["i"],
            )
        ).alias("_p"),
    )
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    return twice.select(*plain, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed(least_words: int = 10, most_repeats: int = 20) -> Column:
    """Fewer words than ``least_words``, or over ``most_repeats`` in a hundred of them in repeated windows."""
    return (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeats)


def transformed() -> list[Column]:
    """The five statistics on scales where honest texts lie close together."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")).alias("x_words"),
        # Ten words of five letters are added: the mean of a few words says little.
        F.log1p((F.col("word_chars") + 50) / (n + 10)).alias("x_length"),
        F.log1p(F.col("n_symbols") / n).alias("x_symbols"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x_lines"),
        (F.col("n_repeat_words") / n).alias("x_repeats"),
    ]


def chi2_cdf(x: float, df: int) -> float:
    """Chi-squared distribution function, by its power series."""
    term = total = 1.0 / (df / 2)
    k = 0
    while term > total * 1e-15:
        k += 1
        term *= x / 2 / (df / 2 + k)
        total += term
    return min(1.0, total * math.exp(-x / 2 + df / 2 * math.log(x / 2) - math.lgamma(df / 2))) if x > 0 else 0.0


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < p else (low, mid)
    return high


def _solved(mean: str = "m", factor: str = "c") -> list[Column]:
    """The row less its mean, solved by the Cholesky factor of the covariance, one part after the other.

    Mean and lower triangle are array columns ``m`` and ``c`` of the joined
    group row. The factor is worked out once per group in ``_factored``.
    """
    p = len(STATS)
    y: list[Column] = []
    for i in range(p):
        rest = F.col(STATS[i]) - F.get(mean, F.lit(i))
        for k in range(i):
            rest = rest - F.get(factor, F.lit(i * p + k)) * F.col(f"_y{k}")
        y.append(rest / F.get(factor, F.lit(i * p + i)))
    return y


def _with_distance(rows: DataFrame, name: str) -> DataFrame:
    """Adds the squared distance; needs ``m`` (means) and ``c`` (factor, row by row)."""
    for i, part in enumerate(_solved()):
        rows = rows.withColumn(f"_y{i}", part)
    total = F.lit(0.0)
    for i in range(len(STATS)):
        total = total + F.col(f"_y{i}") * F.col(f"_y{i}")
    return rows.withColumn(name, total).drop(*[f"_y{i}" for i in range(len(STATS))])


def _factored(groups: DataFrame, *keep: str) -> DataFrame:
    """lang, source, m, the Cholesky factor c of columns ``s_i_j`` (one row each) and the log determinant."""
    p = len(STATS)
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"s_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"f_{i}_{k}") * F.col(f"f_{j}_{k}")
            # The tolerances on the diagonal keep the root positive but for rounding.
            part = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"f_{j}_{j}")
            groups = groups.withColumn(f"f_{i}_{j}", part)
    cells = [F.col(f"f_{i}_{j}") if j <= i else F.lit(0.0) for i in range(p) for j in range(p)]
    size = sum((2 * F.log(f"f_{i}_{i}") for i in range(p)), F.lit(0.0))
    return groups.select("lang", "source", *keep, "m", F.array(*cells).alias("c"), size.alias("log_det"))


def _joined(rows: DataFrame, groups: DataFrame, how: str = "left") -> DataFrame:
    """Every row with the estimate of its group; null is a group like any other."""
    g = groups.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return rows.join(
        g, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), how
    ).drop("_lang", "_source")


def _moments(widen: Column) -> list[Column]:
    """Means m and widened covariances ``s_i_j`` of a group."""
    return [F.array(*[F.avg(x) for x in STATS]).alias("m")] + [
        (F.covar_pop(a, STATS[j]) * widen + (TOLERANCE[a] ** 2 if i == j else 0.0)).alias(f"s_{i}_{j}")
        for i, a in enumerate(STATS)
        for j in range(i + 1)
    ]


def starts(rows: DataFrame) -> DataFrame:
    """lang, source, start, n, m, c and log_det of four starting estimates per group.

    0: medians and median absolute deviations. 1: centre and width of the
    shortest half of each statistic. 2 and 3: the same with the correlations of
    the hyperbolic tangents, and of the spatial signs, of the rows so scaled.
    """
    p = len(STATS)
    at = [k / 100 for k in range(101)]
    quantiles = rows.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, at, 1000).alias(f"q{i}") for i, x in enumerate(STATS)]
    )

    def half(q: str) -> Column:
        return F.array_min(
            F.transform(
                F.sequence(F.lit(0), F.lit(50)),
                lambda k: F.struct((F.get(q, k + 50) - F.get(q, k)).alias("width"), F.get(q, k + 25).alias("centre")),
            )
        )

    quantiles = written(
        quantiles.select(
            "lang", "source", "n", F.array(*[F.get(f"q{i}", F.lit(50)) for i in range(p)]).alias("m0"), F.array(*[half(f"q{i}") for i in range(p)]).alias("h")
        ).select(
            "lang", "source", "n", "m0", F.transform("h", lambda x: x["centre"]).alias("m1"),
            F.array(*[F.sqrt(F.pow(F.get("h", F.lit(i))["width"] * 0.7413, 2) + TOLERANCE[x] ** 2) for i, x in enumerate(STATS)]).alias("e"),
        )
    )
    scaled = _joined(rows, quantiles)
    for i, x in enumerate(STATS):
        scaled = scaled.withColumn(f"z{i}", (F.col(x) - F.get("m1", F.lit(i))) / F.get("e", F.lit(i)))
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)), F.lit(1e-12)))
    scaled = scaled.withColumn("_r", length)
    sums = written(
        scaled.groupBy("lang", "source").agg(
            *[F.first(x).alias(x) for x in ("n", "m0", "m1", "e")],
            *[F.percentile_approx(F.abs(F.col(x) - F.get("m0", F.lit(i))), 0.5, 1000).alias(f"d{i}") for i, x in enumerate(STATS)],
            *[F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{j}")).alias(f"t_{i}_{j}") for i in range(p) for j in range(i + 1)],
            *[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / (F.col("_r") * F.col("_r"))).alias(f"v_{i}_{j}") for i in range(p) for j in range(i + 1)],
        )
    )

    def one(number: int, m: str, scale, between) -> DataFrame:
        cells = [
            ((F.pow(scale(i), 2) if i == j else F.coalesce(between(i, j), F.lit(0.0)) * scale(i) * scale(j))).alias(f"s_{i}_{j}")
            for i in range(p)
            for j in range(i + 1)
        ]
        return sums.select("lang", "source", F.lit(number).alias("start"), "n", F.col(m).alias("m"), *cells)

    def mad(i: int) -> Column:
        return F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + TOLERANCE[STATS[i]] ** 2)

    def width(i: int) -> Column:
        return F.get("e", F.lit(i))

    def ratio(name: str):
        """Correlation from the sums of that name; constant statistics have none."""
        both = lambda i, j: F.sqrt(F.col(f"{name}_{i}_{i}") * F.col(f"{name}_{j}_{j}"))
        return lambda i, j: F.when(both(i, j) > 0, F.col(f"{name}_{i}_{j}") / both(i, j))

    made = one(0, "m0", mad, lambda i, j: F.lit(0.0)).unionByName(one(1, "m1", width, lambda i, j: F.lit(0.0)))
    made = made.unionByName(one(2, "m1", width, ratio("t"))).unionByName(one(3, "m1", width, ratio("v")))
    return _factored(made, "start", "n")


def estimates(rows: DataFrame, share: float = 0.5, steps: int = 40) -> DataFrame:
    """Location and factor of the scatter per (lang, source): the minimum-covariance-determinant estimate.

    ``rows``: a written table of lang, source and the five statistics. ``share``
    is the least part that is kept, ``steps`` bounds the concentration steps.
    """
    p, parts = len(STATS), 200
    # Kept part of a group of n rows, as a place in a table of limits and of consistency factors.
    tabled = [k / parts for k in range(int(share * parts), parts + 1)]
    factors = [x / chi2_cdf(chi2_quantile(x, p), p + 2) if x < 1 else 1.0 for x in tabled]
    part = F.greatest(F.lit(share), F.least(F.lit(1.0), (F.col("n") + p + 1) / (2 * F.col("n"))))
    place = F.least(F.lit(len(tabled) - 1), F.ceil(F.round((part - tabled[0]) * parts, 6)).cast("int"))
    moving = written(starts(rows).withColumn("log_det", F.lit(1e300)).withColumn("place", place).drop("n"))
    ended = []
    for _ in range(steps):
        near = _with_distance(_joined(rows, moving, "inner"), "d2")
        limits = near.groupBy("lang", "source", "start").agg(
            *[F.first(x).alias(x) for x in ("m", "c", "place", "log_det")], F.percentile_approx("d2", tabled, 1000).alias("_at")
        )
        limits = written(limits.withColumn("_limit", F.get("_at", F.col("place"))).drop("_at"))
        kept = _with_distance(_joined(rows, limits, "inner"), "d2").where("d2 <= _limit")
        widen = F.get(F.array(*[F.lit(x) for x in factors]), F.first("place"))
        sums = kept.groupBy("lang", "source", "start").agg(F.first("place").alias("place"), F.first("log_det").alias("before"), *_moments(widen))
        step = written(_factored(sums, "start", "place", "before"))
        # Quantiles are sketches: a gain below their error is none.
        goes_on = F.col("before") - F.col("log_det") > 1e-3
        ended.append(step.where(~goes_on).drop("before"))
        moving = step.where(goes_on).drop("before")
        if moving.isEmpty():
            break
    ended.append(moving)
    every = functools.reduce(DataFrame.unionByName, [x.select("lang", "source", "log_det", "m", "c") for x in ended])
    best = every.groupBy("lang", "source").agg(F.min(F.struct("log_det", "m", "c")).alias("x"))
    best = written(best.select("lang", "source", "x.m", "x.c"))
    near = _with_distance(_joined(rows, best, "inner"), "d2").where(F.col("d2") <= chi2_quantile(WITHIN, p))
    widen = F.lit(WITHIN / chi2_cdf(chi2_quantile(WITHIN, p), p + 2))
    return written(_factored(near.groupBy("lang", "source").agg(*_moments(widen))))


def judge(
    docs: DataFrame,
    least_words: int = 10,
    most_repeats: int = 20,
    share: float = 0.5,
    steps: int = 40,
    confidence: float = 1 - 1e-9,
) -> DataFrame:
    """Counts, base verdict, squared distance and ``kept`` of every document.

    Texts that fail the base rules are not part of the estimates. ``confidence``
    is the share of honest texts inside the limit if their statistics were
    normal; theirs have longer tails, so it lies close to one.
    """
    stats = written(
        counts(docs, ("lang", "source")).withColumn("base_failed", base_failed(least_words, most_repeats)).select(
            "*", *transformed()
        )
    )
    groups = estimates(stats.where("not base_failed").select("lang", "source", *STATS), share, steps)
    limit = chi2_quantile(confidence, len(STATS))
    return _with_distance(_joined(stats, groups), "distance2").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "distance2", (~F.col("base_failed") & (F.col("distance2") <= limit)).alias("kept"),
    )
