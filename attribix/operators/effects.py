"""Subject-by-actor effects: a subject's rate with an actor on the team, versus without.

The complement set is never scanned: ``without = subject total - pair sum``.
One pass over (subject, session, actor) rows gives every pair at once, with
map-side partial sums; only one row per pair reaches the join with the totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attribix.functions.numeric import per_unit, pearson, ratio
from attribix.operators.profiles import first_per_key
from attribix.operators.keyed import spread_join

# Exposure scale and covariate slope of the published adjustment.
UNIT = 36.0
COVARIATE_SLOPE = 0.15


def dedupe_sessions(rows: DataFrame, subject: str, session: str, order: Sequence[Column]) -> DataFrame:
    """One row per (subject, session), before any totals are taken."""
    return first_per_key(rows, [subject, session], order)


def with_team(rows: DataFrame, team: DataFrame, session: str) -> DataFrame:
    """Subject rows fanned out to the members of the session's team."""
    return rows.join(team, session)


def _sums(y: str, m: str | None, cov: str | None, target: str | None, period: str | None) -> list[Column]:
    out = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("y")]
    if m:
        out.append(F.sum(m).alias("m"))
    if cov:
        out += [F.sum(cov).alias("cov"), F.count(cov).alias("n_cov")]
    if target:
        out.append(F.sum(target).alias("t"))
    if period:
        out += [F.count_if(F.col(period) == p).alias(f"n_{p.lower()}") for p in ("RS", "PO")]
    return out


def with_without_sums(
    rows: DataFrame,
    team: DataFrame,
    subject: str,
    session: str,
    actor: str,
    y: str,
    m: str | None = None,
    cov: str | None = None,
    target: str | None = None,
    period: str | None = None,
    by: Sequence[str] = (),
    need_team: bool = True,
) -> DataFrame:
    """Additive sums per (subject, actor, *by): ``x_with``, ``x_without`` and ``x_total``.

    ``rows`` holds one row per (subject, session). With ``need_team`` the totals
    cover sessions that have a team; otherwise all sessions of the subject.
    """
    keys = [subject, *by]
    names = ["n", "y", *(["m"] if m else []), *(["cov", "n_cov"] if cov else []), *(["t"] if target else [])]
    sums = _sums(y, m, cov, target, period)
    pair = with_team(rows, team, session).groupBy(*keys, actor).agg(*sums)
    base = rows.join(team.select(session), session, "left_semi") if need_team else rows
    total = base.groupBy(*keys).agg(*_sums(y, m, cov, target, None))
    total = total.select(*keys, *[F.col(x).alias(f"{x}_total") for x in names])
    joined = pair.join(total, keys)
    none_left = F.col("n_total") == F.col("n")
    return joined.select(
        *keys,
        actor,
        *[F.col(x).alias(f"{x}_with") for x in names],
        *[F.when(none_left, F.lit(0)).otherwise(F.col(f"{x}_total") - F.col(x)).alias(f"{x}_without") for x in names],
        *[f"{x}_total" for x in names],
        *([f"n_{p.lower()}" for p in ("RS", "PO")] if period else []),
    )


def with_without(sums: DataFrame) -> DataFrame:
    """Per-session rates with and without the actor, their difference, and the subject baselines."""
    out = sums
    for x, name in (("y", "outcome"), ("t", "target")):
        out = (
            out.withColumn(f"{name}_per_session_with", ratio(f"{x}_with", "n_with", "floor1"))
            .withColumn(f"{name}_per_session_without", ratio(f"{x}_without", "n_without", "floor1"))
            .withColumn(f"{name}_delta", F.col(f"{name}_per_session_with") - F.col(f"{name}_per_session_without"))
            .withColumn(f"baseline_{name}_per_session", ratio(f"{x}_total", "n_total", "floor1"))
        )
    return out


def adjusted_delta(
    sums: DataFrame, min_with: int = 5, min_without: int = 0, slope: float | Column = COVARIATE_SLOPE, unit: float = UNIT
) -> DataFrame:
    """Rate difference per exposure unit, less what the covariate explains.

    A side without any covariate value makes the adjusted difference null. ``slope`` is a number or a one-value column,
    such as that of :func:`covariate_slope`.
    """
    per_cov = F.lit(slope) if isinstance(slope, (int, float)) else slope
    gated = sums.filter((F.col("n_with") >= min_with) & (F.col("n_without") >= min_without))
    return (
        gated.withColumn("rate_with", per_unit("y_with", "m_with", unit))
        .withColumn("rate_without", per_unit("y_without", "m_without", unit))
        .withColumn("raw_delta", F.col("rate_with") - F.col("rate_without"))
        .withColumn("cov_with", ratio("cov_with", "n_cov_with"))
        .withColumn("cov_without", ratio("cov_without", "n_cov_without"))
        .withColumn("cov_delta", F.col("cov_with") - F.col("cov_without"))
        .withColumn("__slope", per_cov)
        .withColumn("adj_delta", F.col("raw_delta") - F.col("__slope") * F.col("cov_delta"))
        .withColumn("adjustment", F.abs(F.col("__slope") * F.col("cov_delta")))
        .drop("__slope")
        .withColumn("baseline_rate", per_unit("y_total", "m_total", unit, "one"))
    )


def covariate_slope(rows: DataFrame, subject: str, y: str, m: str, cov: str, unit: float = UNIT) -> DataFrame:
    """What the rate changes per unit of the covariate within a subject: one row with slope, rows and subjects.

    The slope with an intercept for every subject (fixed effects). Each subject gives its covariance and variance from
    partial sums of one pass; only one row per subject is summed up. Null where the covariate never varies.
    """
    rated = rows.select(F.col(subject).alias("s"), per_unit(y, m, unit).alias("r"), F.col(cov).cast("double").alias("c")).dropna(subset=["r", "c"])
    parts = rated.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("r", "c").alias("rc"), F.var_pop("c").alias("cc"))
    return parts.agg(
        ratio(F.sum(F.col("n") * F.col("rc")), F.sum(F.col("n") * F.col("cc"))).alias("slope"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_subjects"))


def first_covariate(rows: DataFrame, session: str, cov: str, order: Sequence[Column]) -> DataFrame:
    """Each session's first covariate value that is present, in a declared order; null where none is."""
    present = F.when(F.col(cov).isNotNull(), F.struct(*order))
    return rows.groupBy(session).agg(F.min_by(cov, present).alias(cov))


def subject_baseline(rows: DataFrame, subject: str, session: str, y: str, m: str, cov: str) -> DataFrame:
    return (
        rows.groupBy(subject)
        .agg(
            F.countDistinct(session).alias("n_sessions"),
            F.sum(y).alias("total_y"),
            F.sum(m).alias("total_m"),
            F.avg(cov).alias("mean_cov"),
        )
        .withColumn("rate", per_unit("total_y", "total_m", UNIT, "one"))
    )


def actor_rollup(pairs: DataFrame, subject: str, actor: str, delta: str = "adj_delta", raw: str = "raw_delta") -> DataFrame:
    """One row per actor. A missing delta counts in the suppressor denominator."""
    return pairs.groupBy(actor).agg(
        F.avg(delta).alias("mean_delta"),
        F.stddev_samp(delta).alias("std_delta"),
        F.countDistinct(subject).alias("n_subjects"),
        F.count(subject).alias("n_pairs"),
        F.avg(F.when(F.col(delta) < 0, 1.0).otherwise(0.0)).alias("suppressor_score"),
        F.avg(raw).alias("mean_raw_delta"),
    )


def period_shift(pairs: DataFrame, actor: str, period: str, delta: str = "adj_delta") -> DataFrame:
    """Mean pair delta per actor in each period, and the shift; both periods are required."""
    rs, po = F.when(F.col(period) == "RS", F.col(delta)), F.when(F.col(period) == "PO", F.col(delta))
    return (
        pairs.groupBy(actor)
        .agg(
            F.avg(rs).alias("mean_delta_rs"),
            F.avg(po).alias("mean_delta_po"),
            F.count(rs).alias("n_subjects_rs"),
            F.count(po).alias("n_subjects_po"),
        )
        .filter((F.col("n_subjects_rs") > 0) & (F.col("n_subjects_po") > 0))
        .withColumn("rs_po_delta", F.col("mean_delta_po") - F.col("mean_delta_rs"))
    )


def adjustment_summary(pairs: DataFrame, raw: str = "raw_delta", adj: str = "adj_delta", size: str = "adjustment") -> DataFrame:
    flipped = F.signum(raw) * F.signum(adj) < 0
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg(size).alias("mean_adjustment"),
        F.max(size).alias("max_adjustment"),
        pearson(raw, adj).alias("raw_adj_r"),
        F.count_if(flipped).alias("n_sign_flips"),
    )


def extreme_actors(pairs: DataFrame, subject: str, actor: str, delta: str) -> DataFrame:
    """Actor with the lowest and the highest delta for each subject; ties go to the lower actor."""
    low, high = F.struct(F.col(delta), F.col(actor)), F.struct(-F.col(delta), F.col(actor))
    return (
        pairs.filter(F.col(delta).isNotNull())
        .groupBy(subject)
        .agg(
            F.min_by(actor, low).alias("lowest_actor"),
            F.min(delta).alias("lowest_delta"),
            F.min_by(actor, high).alias("highest_actor"),
            F.max(delta).alias("highest_delta"),
        )
    )


def baseline_delta(rows: DataFrame, subject: str, rate: str, is_base: Column) -> DataFrame:
    """Each row's rate minus the subject's mean rate over its base-period rows.

    The base is aggregated first and joined to rows dealt over many parts, so one
    subject with many rows becomes neither one window nor one join task.
    """
    base = rows.groupBy(subject).agg(
        F.avg(F.when(is_base, F.col(rate))).alias("base_rate"), F.count_if(is_base).alias("base_n")
    )
    return spread_join(rows, base, [subject]).withColumn("rate_delta", F.col(rate) - F.col("base_rate"))


def flag_breakdown(rows: DataFrame, subject: str, flag: Column, measures: Sequence[str]) -> DataFrame:
    return (
        rows.filter(flag)
        .groupBy(subject)
        .agg(F.count(F.lit(1)).alias("n_flagged"), *[F.avg(c).alias(f"{c}_mean") for c in measures])
    )

