"""Actor profiles: how often each actor triggers the target event per session worked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attribix.functions.numeric import col, ratio

PERIODS = ("RS", "PO")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in a declared order, as a partial aggregate (no sort of the group)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def attach_dim(facts: DataFrame, dim: DataFrame, on: str, order: Sequence[Column]) -> DataFrame:
    """Left join to a dimension after reducing it to its first row per key."""
    return facts.join(first_per_key(dim, [on], order), on, "left")


def exposure(team: DataFrame, sessions: DataFrame, actor: str, session: str, period: str) -> DataFrame:
    """Sessions each actor was assigned to, by period. The denominator includes quiet sessions."""
    return (
        team.select(session, actor)
        .distinct()
        .join(sessions.select(session, period), session)
        .groupBy(actor, period)
        .agg(F.count(F.lit(1)).alias("n_assigned"))
    )


def actor_profile(
    events: DataFrame,
    sessions: DataFrame,
    team: DataFrame | None,
    actor: str,
    session: str,
    period: str,
    is_target: Column,
) -> DataFrame:
    """Target events, sessions called, sessions assigned and the rate, by (actor, period).

    Rows without an actor drop out. Without a team table the sessions called
    stand in for the sessions assigned.
    """
    calls = (
        events.filter(is_target & col(actor).isNotNull())
        .groupBy(session, actor)
        .agg(F.count(F.lit(1)).alias("__n"))
        .join(sessions.select(session, period), session)
        .groupBy(actor, period)
        .agg(F.sum("__n").alias("n_events"), F.count(F.lit(1)).alias("n_called"))
    )
    if team is None:
        assigned = calls.withColumn("n_assigned", F.col("n_called"))
    else:
        assigned = calls.join(exposure(team, sessions, actor, session, period), [actor, period], "left").withColumn(
            "n_assigned", F.coalesce("n_assigned", "n_called")
        )
    return assigned.withColumn("per_session", ratio("n_events", "n_assigned"))


def profile_of_counts(counts: DataFrame, sessions: DataFrame, actor: str, session: str, period: str, targets: str) -> DataFrame:
    """:func:`actor_profile` from one row per (session, actor) with its target events; such a row is also an assignment."""
    return (
        counts.filter(col(actor).isNotNull()).join(sessions.select(session, period), session)
        .groupBy(actor, period)
        .agg(F.sum(targets).alias("n_events"), F.count_if(F.col(targets) > 0).alias("n_called"), F.count(F.lit(1)).alias("n_assigned"))
        .filter("n_called > 0")
        .withColumn("per_session", ratio("n_events", "n_assigned"))
    )


def pivot_profile(
    profile: DataFrame,
    actor: str,
    period: str,
    measures: Sequence[str] = ("n_events", "n_assigned", "per_session"),
    periods: Sequence[str] = PERIODS,
    parity: bool = True,
) -> DataFrame:
    """One row per actor with ``measure_PERIOD`` columns, the rate shift and totals.

    ``parity`` fills absent periods with 0, so an actor with one period only
    gets minus its rate as the shift. Otherwise the shift is null.
    """
    wide = profile.groupBy(actor).pivot(period, list(periods)).agg(*[F.first(m).alias(m) for m in measures])
    named = wide.select(actor, *[F.col(f"{p}_{m}").alias(f"{m}_{p}") for p in periods for m in measures])
    base, other = periods
    out = named.na.fill(0) if parity else named
    return (
        out.withColumn("per_session_delta", F.col(f"per_session_{other}") - F.col(f"per_session_{base}"))
        .withColumn("total_events", sum((F.coalesce(F.col(f"n_events_{p}"), F.lit(0)) for p in periods), F.lit(0)))
        .withColumn("total_sessions", sum((F.coalesce(F.col(f"n_assigned_{p}"), F.lit(0)) for p in periods), F.lit(0)))
    )


def name_conflicts(dim: DataFrame, name: str, ident: str) -> DataFrame:
    """Names carried by more than one id."""
    return dim.groupBy(name).agg(F.countDistinct(ident).alias("n_ids")).filter(F.col("n_ids") > 1)


def session_counts(events: DataFrame, session: str, is_target: Column) -> DataFrame:
    return events.groupBy(session).agg(
        F.count_if(is_target).alias("n_target"),
        F.count(F.lit(1)).alias("n_events"),
        ratio(F.count_if(is_target), F.count(F.lit(1))).alias("target_rate"),
    )


def event_share(events: DataFrame, team: DataFrame, actor: str, session: str, is_target: Column) -> DataFrame:
    """Target share of all events in the sessions an actor worked, whoever triggered them."""
    per_session = events.groupBy(session).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(is_target).alias("__t")
    )
    return (
        team.select(session, actor)
        .distinct()
        .join(per_session, session)
        .groupBy(actor)
        .agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("__n").alias("n_events"), F.sum("__t").alias("n_target"))
        .withColumn("target_share", ratio("n_target", "n_events"))
    )


def share_of_counts(counts: DataFrame, actor: str, session: str, events: str, targets: str) -> DataFrame:
    """:func:`event_share` from one row per (session, actor) with its events and target events."""
    per_session = counts.groupBy(session).agg(F.sum(events).alias("__n"), F.sum(targets).alias("__t"))
    return (
        counts.select(session, actor).join(per_session, session).groupBy(actor)
        .agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("__n").alias("n_events"), F.sum("__t").alias("n_target"))
        .withColumn("target_share", ratio("n_target", "n_events"))
    )


def context_share(events: DataFrame, actor: str, margin: str) -> DataFrame:
    """Share of an actor's events called while leading, trailing or level."""
    m = F.col(margin)
    return events.groupBy(actor).agg(
        F.count(m).alias("n_events"),
        ratio(F.count_if(m > 0), F.count(m)).alias("leading_share"),
        ratio(F.count_if(m < 0), F.count(m)).alias("trailing_share"),
        ratio(F.count_if(m == 0), F.count(m)).alias("level_share"),
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Report of the first ``k`` rows; the order must end in key columns."""
    return df.orderBy(*order).limit(k)


def top_and_bottom(df: DataFrame, value: str, keys: Sequence[str], k: int, n_col: str, min_n: int) -> DataFrame:
    """The ``k`` highest and ``k`` lowest rows among those with enough sessions."""
    gated = df.filter((F.col(n_col) >= min_n) & F.col(value).isNotNull())
    tie = [F.col(c).asc() for c in keys]
    high = top_k(gated, [F.col(value).desc(), *tie], k).withColumn("side", F.lit("top"))
    low = top_k(gated, [F.col(value).asc(), *tie], k).withColumn("side", F.lit("bottom"))
    return high.unionByName(low)


def top_k_per_class(df: DataFrame, cls: str, order: Sequence[Column], k: int) -> DataFrame:
    """Preference-ordered ``k`` rows per class; Spark keeps k rows per task before the shuffle."""
    w = Window.partitionBy(cls).orderBy(*order)
    return df.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= k)
