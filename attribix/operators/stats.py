"""Rank tests, correlations and variance analysis as aggregations.

Ranks are computed on counted distinct values, so ties cost one row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attribix.functions.numeric import col, order_bucket, pearson, ratio
from attribix.functions.tails import p_correlation, p_f, p_normal
from attribix.operators.keyed import value_map
from attribix.operators.ordered import average_ranks, exact_quantiles, running_totals
from attribix.session import checkpointed


def stack_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (input row, metric pair), complete cases only."""
    items = F.array(
        *[
            F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), col(x).cast("double").alias("vx"), col(y).cast("double").alias("vy"))
            for x, y in pairs
        ]
    )
    return df.select(*keep, F.inline(items)).filter("vx IS NOT NULL AND vy IS NOT NULL")


def stack_flag_counts(df: DataFrame, pairs: Sequence[tuple[str, str]], kinds: Sequence[str]) -> DataFrame:
    """Points (x, y, vx, vy) of :func:`stack_pairs` with their number ``c``, from rows that stand for several ones.

    ``kinds`` are columns with the number of rows of each kind; as y such a column is 1 for its own rows and 0 for those of the
    other kinds. Equal values are counted before they are stacked for each y.
    """
    names = list(dict.fromkeys(x for x, _ in pairs))
    values = F.array(*[F.struct(F.lit(i).alias("i"), col(x).cast("double").alias("vx")) for i, x in enumerate(names)])
    counted = df.select(*kinds, F.inline(values)).filter("vx IS NOT NULL").groupBy("i", "vx").agg(*[F.sum(k).alias(k) for k in kinds])
    items = F.array(
        *[
            F.struct(
                F.lit(names.index(x)).alias("of"), F.lit(x).alias("x"), F.lit(y).alias("y"),
                F.lit(float(kind == y)).alias("vy"), col(kind).cast("bigint").alias("c"))
            for x, y in pairs
            for kind in kinds
        ]
    )
    return counted.select("i", "vx", F.inline(items)).filter("of = i AND c > 0").select("x", "y", "vx", "vy", "c")


def with_scopes(df: DataFrame, qualified: Column, name: str = "qualified_only") -> DataFrame:
    """Each row once for the full scope and once more for the qualified scope if it qualifies."""
    scopes = F.when(qualified, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return df.withColumn(name, F.explode(scopes))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), min_n: int = 0) -> DataFrame:
    """Rank correlation per group. Works on distinct (x, y) points with their counts."""
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__c"))
    return _point_spearman(points, x, y, list(by), min_n)


def _point_spearman(points: DataFrame, x: str, y: str, by: Sequence[str], min_n: int = 0) -> DataFrame:
    rx = _point_ranks(points, by, x, "__rx")
    ry = _point_ranks(points, by, y, "__ry").drop("n_group")
    joined = points.join(rx, [*by, x]).join(ry, [*by, y])
    mid = (F.col("n_group") + 1) / F.lit(2.0)
    dx, dy, c = F.col("__rx") - mid, F.col("__ry") - mid, F.col("__c")
    return (
        joined.groupBy(*by)
        .agg(
            F.sum("__c").alias("n"),
            ratio(F.sum(c * dx * dy), F.sqrt(F.sum(c * dx * dx)) * F.sqrt(F.sum(c * dy * dy))).alias("spearman_rho"),
        )
        .filter(F.col("n") >= min_n)
        .withColumn("spearman_p", p_correlation("spearman_rho", "n"))
    )


def _point_ranks(points: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    counted = points.groupBy(*by, value).agg(F.sum("__c").alias("__t"))
    cum = running_totals(counted, by, [value], order_bucket(value), {"__cum": F.col("__t")}, {"__cum": "n_group"})
    return cum.select(*by, value, "n_group", (F.col("__cum") - (F.col("__t") - 1) / F.lit(2.0)).alias(name))


def correlations(stacked: DataFrame, by: Sequence[str], min_n: int = 10) -> DataFrame:
    """Pearson and Spearman with their p values for each stacked metric pair with at least ``min_n`` rows."""
    keys = [*by, "x", "y"]
    lin = stacked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("vx", "vy").alias("pearson_r")).filter(F.col("n") >= min_n)
    out = lin.join(spearman(stacked, "vx", "vy", keys).drop("n", "spearman_p"), keys)
    return out.withColumn("pearson_p", p_correlation("pearson_r", "n")).withColumn("spearman_p", p_correlation("spearman_rho", "n"))


def counted_correlations(points: DataFrame, min_n: int = 10) -> DataFrame:
    """:func:`correlations` of the points of :func:`stack_flag_counts`; the metric pairs are few by design.

    Deviations are taken from a mean that lies between the least and the largest value, so a constant has none at all.
    """
    c = F.col("c")

    def centre(v: str) -> Column:
        return F.greatest(F.min(v), F.least(F.max(v), F.sum(c * F.col(v)) / F.sum(c)))

    means = points.groupBy("x", "y").agg(centre("vx").alias("mx"), centre("vy").alias("my"))
    at = value_map(means.withColumn("pair", F.struct("x", "y")), "pair", "mx", "my")
    near = points.withColumn("__m", at).withColumn("__m", F.col("__m")[F.struct("x", "y")])
    dx, dy = F.col("vx") - F.col("__m.mx"), F.col("vy") - F.col("__m.my")
    lin = near.groupBy("x", "y").agg(
        F.sum(c).alias("n"),
        ratio(F.sum(c * dx * dy), F.sqrt(F.sum(c * dx * dx)) * F.sqrt(F.sum(c * dy * dy))).alias("pearson_r"),
    ).filter(F.col("n") >= min_n)
    ranks = _point_spearman(points.withColumnRenamed("c", "__c"), "vx", "vy", ["x", "y"]).drop("n", "spearman_p")
    return lin.join(ranks, ["x", "y"]).withColumn("pearson_p", p_correlation("pearson_r", "n")).withColumn("spearman_p", p_correlation("spearman_rho", "n"))


#: Both samples below this size and no ties: the exact distribution of U. This is the published rule of the statistic.
EXACT_BELOW = 50


@lru_cache(None)
def _u_shares(n: int, m: int) -> np.ndarray:
    """Share of the arrangements of n and m untied values that have each U, by the side of the largest value."""
    if n == 0 or m == 0:
        return np.ones(1)
    out = np.zeros(n * m + 1)
    out[m:] += _u_shares(n - 1, m) * (n / (n + m))
    out[: n * (m - 1) + 1] += _u_shares(n, m - 1) * (m / (n + m))
    return out


def _exact_tails(sizes: DataFrame) -> DataFrame:
    """(n_a, n_b, tails): for each u the two-sided p of a U at least so far from the middle. Sizes are below ``EXACT_BELOW``."""
    found = sizes.select("n_a", "n_b").distinct().collect()  # at most EXACT_BELOW squared
    rows = [(a, b, np.minimum(1.0, 2 * np.cumsum(_u_shares(a, b)[::-1])[::-1]).tolist()) for a, b in found]
    return sizes.sparkSession.createDataFrame(rows, "n_a long, n_b long, tails array<double>")


def mann_whitney(df: DataFrame, value: str, in_a: Column, by: Sequence[str] = ()) -> DataFrame:
    """Two-sided U test of the rows in sample a against the rest: one row for each group of ``by``.

    Small samples without ties have the exact p value, all others that of the tie-corrected normal approximation with
    continuity correction; ``exact`` says which. Without rows on either side there is no statistic.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("v"), in_a.alias("a")).filter("v IS NOT NULL AND a IS NOT NULL")
    counted = rows.groupBy(*by, "v").agg(
        F.count_if("a").alias("na"), F.count_if(~F.col("a")).alias("nb"), F.count(F.lit(1)).alias("t")
    )
    ranked = running_totals(counted, by, ["v"], order_bucket("v"), {"cum": F.col("t")})
    rank = F.col("cum") - (F.col("t") - 1) / F.lit(2.0)
    t = F.col("t").cast("double")
    s = ranked.groupBy(*by).agg(
        F.sum("na").alias("n_a"),
        F.sum("nb").alias("n_b"),
        ratio(F.sum(F.col("na") * F.col("v")), F.sum("na")).alias("mean_a"),
        ratio(F.sum(F.col("nb") * F.col("v")), F.sum("nb")).alias("mean_b"),
        F.sum(rank * F.col("na")).alias("r_a"),
        F.sum(t * t * t - t).alias("ties"),
    )
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.when((na > 0) & (nb > 0), F.col("r_a") - na * (na + 1) / 2)
    var = na * nb / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1)))
    s = s.withColumn("u", u).withColumn(
        "z", ratio(F.greatest(F.abs(F.col("u") - na * nb / 2) - 0.5, F.lit(0.0)), F.sqrt(var))
    )
    small = (F.col("ties") == 0) & (F.col("n_a").between(1, EXACT_BELOW - 1)) & (F.col("n_b").between(1, EXACT_BELOW - 1))
    s = checkpointed(s.withColumn("exact", small))
    tails = _exact_tails(s.filter("exact"))
    far = F.greatest("u", na * nb - F.col("u")).cast("int")
    s = s.join(tails, ["n_a", "n_b"], "left").withColumn(
        "p_value", F.when(F.col("exact"), F.get("tails", far)).otherwise(p_normal("z")))
    q = exact_quantiles(rows, [*by, "a"], "v", {"med": 0.5})
    medians = [F.max(F.when(F.col("a"), F.col("med"))).alias("median_a"), F.max(F.when(~F.col("a"), F.col("med"))).alias("median_b")]
    names = [*by, "n_a", "n_b", "mean_a", "mean_b", "median_a", "median_b", "u", "z", "p_value", "exact"]
    if by:
        return s.join(q.groupBy(*by).agg(*medians), by).select(*names)
    return s.withColumn("__m", q.agg(F.struct(*medians)).scalar()).select(
        *[F.col("__m")[c].alias(c) if c.startswith("median") else F.col(c) for c in names])


def anova(df: DataFrame, actor: str, value: str, by: Sequence[str] = (), min_n: int = 30) -> DataFrame:
    """One-way analysis of variance between actors with at least ``min_n`` rows."""
    by = list(by)
    cells = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, actor)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
        .filter(F.col("n") >= min_n)
    )
    grand = cells.groupBy(*by).agg(ratio(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("grand"))
    joined = cells.join(grand, by) if by else cells.withColumn("grand", grand.scalar())
    gap = F.col("mean") - F.col("grand")
    s = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_actors"),
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") * gap * gap).alias("ss_between"),
        F.sum(F.col("n") * F.col("var")).alias("ss_within"),
        ratio(F.stddev_samp("mean"), F.avg("mean")).alias("cv_of_means"),
    )
    out = (
        s.withColumn("df_between", F.col("n_actors") - 1)
        .withColumn("df_within", F.col("n_rows") - F.col("n_actors"))
        .withColumn("f", ratio(ratio("ss_between", "df_between"), ratio("ss_within", "df_within")))
        .withColumn("eta2", ratio("ss_between", F.col("ss_between") + F.col("ss_within")))
    )
    return out.withColumn("p_value", p_f("f", "df_between", "df_within"))


def residualise(df: DataFrame, y: str, x: str, out: str) -> DataFrame:
    """``y`` less its straight-line fit on ``x`` over all rows."""
    line = df.agg(F.struct(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))).scalar()
    return df.withColumn("__l", line).withColumn(out, F.col(y) - F.col("__l.a") - F.col("__l.b") * F.col(x)).drop("__l")


__all__ = [
    "anova", "average_ranks", "correlations", "counted_correlations", "mann_whitney", "residualise", "spearman", "stack_flag_counts", "stack_pairs",
    "with_scopes",
]
