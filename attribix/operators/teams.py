"""Teams of actors: wide form, prior-only profiles, team features, pair residuals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attribix.functions.numeric import per_unit, ratio
from attribix.operators.effects import COVARIATE_SLOPE, UNIT
from attribix.operators.ordered import exact_quantiles


def team_sizes(team: DataFrame, session: str) -> DataFrame:
    return team.groupBy(session).agg(F.count(F.lit(1)).alias("n_actors"))


def team_long(team: DataFrame, session: str, actor: str) -> DataFrame:
    """One row per member: session, slot (from 1, in actor order), actor and n_actors. Teams may be of any size; no array is built."""
    over = Window.partitionBy(session)
    return team.select(
        session, F.row_number().over(over.orderBy(actor)).alias("slot"), actor, F.count(F.lit(1)).over(over).alias("n_actors"))


def team_slots(team: DataFrame, session: str, actor: str, size: int) -> DataFrame:
    """Members of exact-size teams with their slot, numbered from 1 in actor order.

    Of any team at most ``size`` + 1 members leave a task, which is enough to tell its size from ``size``.
    """
    over = Window.partitionBy(session)
    few = team.select(session, actor).withColumn("slot", F.row_number().over(over.orderBy(actor))).filter(F.col("slot") <= size + 1)
    return few.withColumn("__n", F.count(F.lit(1)).over(over)).filter(F.col("__n") == size).select(session, "slot", actor)


def team_wide(team: DataFrame, session: str, actor: str, size: int) -> DataFrame:
    """One row per session of exactly ``size`` actors: team size and the sorted actors."""
    return team_slots(team, session, actor, size).groupBy(session).agg(
        F.count(F.lit(1)).alias("n_actors"), F.array_sort(F.collect_list(actor)).alias("actors"))


def prior_sums(
    per_season: DataFrame, keys: Sequence[str], season: str, sums: Sequence[str], out: str = "profile_season",
    seasons: DataFrame | None = None,
) -> DataFrame:
    """Sums over all strictly earlier seasons, for every season after a key's first.

    ``per_season`` has one row per (keys, season), so a key gathers at most one
    entry per season. A key absent in a season still gets a row for it.
    ``seasons`` may name a cheaper table to list the seasons from.
    """
    keys = list(keys)
    listed = (per_season if seasons is None else seasons).agg(F.array_sort(F.collect_set(season)).alias("s")).scalar()
    entries = per_season.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(season, *sums))).alias("__e"))
    later = F.filter("__all", lambda s: s > F.get("__e", F.lit(0))[season])
    rows = entries.withColumn("__all", listed).select(*keys, "__e", F.explode(later).alias(out))
    earlier = F.filter("__e", lambda e: e[season] < F.col(out))

    def total(name: str) -> Column:
        zero = F.lit(0).cast(per_season.schema[name].dataType)
        return F.aggregate(F.col("__past"), zero, lambda acc, e: acc + F.coalesce(e[name], zero))

    return rows.withColumn("__past", earlier).select(*keys, out, *[total(s).alias(s) for s in sums])


def prior_profile(
    calls: DataFrame, assigned: DataFrame, actor: str, season: str, seasons: DataFrame | None = None
) -> DataFrame:
    """Rate of each actor from seasons before ``profile_season``.

    ``calls`` has ``n_events`` and ``assigned`` has ``n_assigned`` per (actor, season).
    """
    joined = assigned.join(calls, [actor, season], "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))
    return (
        prior_sums(joined, [actor], season, ["n_events", "n_assigned"], seasons=seasons)
        .withColumn("per_session", ratio("n_events", "n_assigned", "floor1"))
    )


def prior_pair_deltas(
    rows: DataFrame, team: DataFrame, subject: str, session: str, actor: str, season: str,
    y: str, m: str, cov: str, min_both: int, slope: float = COVARIATE_SLOPE, seasons: DataFrame | None = None,
) -> DataFrame:
    """Covariate-adjusted pair deltas from seasons before ``profile_season`` only.

    Pair sums and subject sums are both cut at the same season boundary, so the
    complement by subtraction never sees a later season.
    """
    aggs = [
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(m).alias("m"),
        F.sum(cov).alias("cov"), F.count(cov).alias("n_cov"),
    ]
    names = ["n", "y", "m", "cov", "n_cov"]
    pair = prior_sums(
        rows.join(team, session).groupBy(subject, actor, season).agg(*aggs), [subject, actor], season, names, seasons=seasons
    )
    total = prior_sums(rows.groupBy(subject, season).agg(*aggs), [subject], season, names, seasons=seasons)
    total = total.select(subject, "profile_season", *[F.col(n).alias(f"{n}_total") for n in names])
    s = pair.join(total, [subject, "profile_season"])
    s = s.select(
        subject, actor, "profile_season",
        *[F.col(n).alias(f"{n}_with") for n in names],
        *[(F.col(f"{n}_total") - F.col(n)).alias(f"{n}_without") for n in names],
    ).filter((F.col("n_with") >= min_both) & (F.col("n_without") >= min_both))
    raw = per_unit("y_with", "m_with", UNIT) - per_unit("y_without", "m_without", UNIT)
    cov_delta = ratio("cov_with", "n_cov_with") - ratio("cov_without", "n_cov_without")
    return s.select(
        subject, actor, "profile_season", "n_with", "n_without", (raw - F.lit(slope) * cov_delta).alias("adj_delta")
    )


def median_defaults(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact median of each value per key, one row per key; all values share one pass."""
    items = F.array(*[F.struct(F.lit(v).alias("__name"), F.col(v).cast("double").alias("__v")) for v in values])
    stacked = df.select(*keys, F.inline(items))
    q = exact_quantiles(stacked, [*keys, "__name"], "__v", {"__med": 0.5})
    picks = [F.max(F.when(F.col("__name") == v, F.col("__med"))).alias(v) for v in values]
    return q.groupBy(*keys).agg(*picks) if keys else q.agg(*picks)


def with_defaults(
    rows: DataFrame, defaults: DataFrame, on: Sequence[str], values: Sequence[str], overall: Mapping[str, Column]
) -> DataFrame:
    """Fill nulls from the matching default row, then from the overall default."""
    d = defaults.select(*on, *[F.col(v).alias(f"__d_{v}") for v in values])
    out = rows.join(d, list(on), "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(F.col(v), F.col(f"__d_{v}"), overall[v]))
    return out.drop(*[f"__d_{v}" for v in values])


def team_features(
    members: DataFrame, session: str, features: Sequence[str], known: Column, size: int, name: str = "actor_id"
) -> DataFrame:
    """Team mean / min / max / std / sum per feature, slot values, and how many members were profiled.

    ``known`` is taken before imputing. A single value has a spread of 0.
    """
    aggs = [F.count_if(known).alias("n_profiled")]
    for f in features:
        aggs += [
            F.avg(f).alias(f"team_mean_{f}"),
            F.min(f).alias(f"team_min_{f}"),
            F.max(f).alias(f"team_max_{f}"),
            F.when(F.count(f) > 0, F.coalesce(F.stddev_samp(f), F.lit(0.0))).alias(f"team_std_{f}"),
            F.sum(f).alias(f"team_sum_{f}"),
        ]
        aggs += [F.max(F.when(F.col("slot") == i, F.col(f))).alias(f"slot{i}_{f}") for i in range(1, size + 1)]
    aggs += [F.max(F.when(F.col("slot") == i, F.col(name))).alias(f"slot{i}_actor") for i in range(1, size + 1)]
    return members.groupBy(session).agg(*aggs)


def team_subject_features(members: DataFrame, keys: Sequence[str], delta: str, known: Column) -> DataFrame:
    """Team features of a subject session; the spread divides by n, not n-1."""
    return members.groupBy(*keys).agg(
        F.avg(delta).alias("team_mean_delta"),
        F.sum(delta).alias("team_sum_delta"),
        F.max(delta).alias("team_max_delta"),
        F.min(delta).alias("team_min_delta"),
        F.stddev_pop(delta).alias("team_std_delta"),
        F.count_if(known).alias("n_matched"),
    )


def team_metrics(team: DataFrame, metrics: DataFrame, session: str, actor: str, values: Sequence[str]) -> DataFrame:
    """Per session mean, min and count of the members' metrics; members without a metric are skipped."""
    joined = team.join(metrics.select(actor, *values), actor, "left")
    return joined.groupBy(session).agg(
        *[F.avg(v).alias(f"mean_{v}") for v in values],
        *[F.min(v).alias(f"min_{v}") for v in values],
        F.count(values[0]).alias("n_profiled"),
    )


def team_pair_z(team: DataFrame, residuals: DataFrame, session: str, actor: str, residual: str, size: int, min_n: int) -> DataFrame:
    """Residual mean, spread and z of each actor pair over exact-size teams.

    The size is fixed, so a session gives exactly ``size * (size - 1) / 2`` pairs
    from its slots and there is no self-join.
    """
    wide = team_wide(team, session, actor, size).join(residuals.select(session, residual), session)
    pairs = F.array(
        *[
            F.struct(F.col("actors")[i].alias("actor_a"), F.col("actors")[j].alias("actor_b"))
            for i, j in combinations(range(size), 2)
        ]
    )
    return (
        wide.select(F.explode(pairs).alias("p"), residual)
        .groupBy("p.actor_a", "p.actor_b")
        .agg(
            F.avg(residual).alias("mean_residual"),
            F.count(F.lit(1)).alias("n_sessions"),
            F.stddev_samp(residual).alias("std_residual"),
        )
        .filter(F.col("n_sessions") >= min_n)
        .withColumn("se_mean", F.col("std_residual") / F.sqrt("n_sessions"))
        .withColumn("z_score", ratio("mean_residual", "se_mean"))
    )


def pair_z_summary(pairs: DataFrame, critical: float = 1.96, level: float = 0.05) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.abs("z_score") > critical).alias("n_significant"),
        (F.count(F.lit(1)) * F.lit(level)).alias("n_expected"),
        F.avg(F.abs("z_score")).alias("mean_abs_z"),
    )
