"""Queries over subject-by-actor effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from attribix.functions.numeric import per_unit
from attribix.operators import effects as E
from attribix.operators import profiles as P
from attribix.operators.ordered import exact_quantiles
from attribix.plans import roles
from attribix.plans.profiles import PROFILE_SQL, target
from attribix.plans.registry import query
from attribix.plans.roles import BASE_SQL
from attribix.plans.shape import r, rounded
from attribix.session import checkpointed

# Gates of the published tables: pairs, both sides, and by period.
MIN_WITH = 5
MIN_BOTH = 10
MIN_BY_PERIOD = {"RS": 5, "PO": 3}


def pair_sums_sql(by: str = "") -> str:
    b = f", {by}" if by else ""
    return f"""pair AS (
  SELECT subject_id, actor_id{b}, count(*) AS n, sum(y) AS y, sum(m) AS m, sum(cov) AS cov, count(cov) AS n_cov
  FROM subject_session JOIN team USING (session_id) GROUP BY ALL),
total AS (
  SELECT subject_id{b}, count(*) AS n, sum(y) AS y, sum(m) AS m, sum(cov) AS cov, count(cov) AS n_cov
  FROM subject_session GROUP BY ALL),
side AS (
  SELECT p.subject_id, p.actor_id{', p.' + by if by else ''}, p.n AS n_with, t.n - p.n AS n_without,
         p.y AS y_with, CASE WHEN t.n = p.n THEN 0 ELSE t.y - p.y END AS y_without,
         p.m AS m_with, CASE WHEN t.n = p.n THEN 0 ELSE t.m - p.m END AS m_without,
         p.cov / nullif(p.n_cov, 0) AS cov_with,
         CASE WHEN t.n = p.n THEN 0 ELSE t.cov - p.cov END / nullif(t.n_cov - p.n_cov, 0) AS cov_without,
         t.y AS y_total, t.m AS m_total
  FROM pair p JOIN total t ON p.subject_id = t.subject_id {f'AND p.{by} = t.{by}' if by else ''}),
adjusted_all AS (
  SELECT *, 36 * y_with / greatest(m_with, 1) AS rate_with, 36 * y_without / greatest(m_without, 1) AS rate_without,
         36 * y_with / greatest(m_with, 1) - 36 * y_without / greatest(m_without, 1) AS raw_delta,
         cov_with - cov_without AS cov_delta,
         36 * y_with / greatest(m_with, 1) - 36 * y_without / greatest(m_without, 1)
           - 0.15 * (cov_with - cov_without) AS adj_delta,
         abs(0.15 * (cov_with - cov_without)) AS adjustment,
         36 * y_total / CASE WHEN m_total = 0 THEN 1 ELSE m_total END AS baseline_rate
  FROM side)"""


ADJUSTED_SQL = f"{BASE_SQL}, {pair_sums_sql()}, adjusted AS (SELECT * FROM adjusted_all WHERE n_with >= {MIN_WITH})"
BOTH_SQL = f"{BASE_SQL}, {pair_sums_sql()}, adjusted AS (SELECT * FROM adjusted_all WHERE n_with >= {MIN_BOTH} AND n_without >= {MIN_BOTH})"
PERIOD_SQL = f"""{BASE_SQL}, {pair_sums_sql('season_type')},
adjusted AS (SELECT * FROM adjusted_all
  WHERE (season_type = 'RS' AND n_with >= 5 AND n_without >= 5) OR (season_type = 'PO' AND n_with >= 3 AND n_without >= 3))"""
OUT_SQL = ", ".join(
    ["subject_id", "actor_id", "n_with", "n_without"]
    + [
        f"{r(c)} AS {c}"
        for c in ("rate_with", "rate_without", "raw_delta", "cov_with", "cov_without", "cov_delta", "adj_delta", "adjustment", "baseline_rate")
    ]
)
OUT = [
    "subject_id", "actor_id", "n_with", "n_without", "rate_with", "rate_without", "raw_delta",
    "cov_with", "cov_without", "cov_delta", "adj_delta", "adjustment", "baseline_rate",
]


def sums(spark, sf, by=(), rows=None, team=None):
    # A subject session is built from its events, so each has a team and no check is needed.
    return E.with_without_sums(
        rows or roles.subject_sessions(spark, sf), team or roles.team(spark, sf),
        "subject_id", "session_id", "actor_id", "y", "m", "cov", by=by, need_team=False,
    )


def adjusted(spark, sf, **inputs):
    return E.adjusted_delta(sums(spark, sf, **inputs), MIN_WITH)


def adjusted_both(spark, sf, **inputs):
    return E.adjusted_delta(sums(spark, sf, **inputs), MIN_BOTH, MIN_BOTH)


def adjusted_by_period(spark, sf, **inputs):
    gate = F.when(F.col("season_type") == "RS", MIN_BY_PERIOD["RS"]).otherwise(MIN_BY_PERIOD["PO"])
    s = sums(spark, sf, ["season_type"], **inputs).filter((F.col("n_with") >= gate) & (F.col("n_without") >= gate))
    return E.adjusted_delta(s, 0)


@query(
    "with_without",
    f"""{BASE_SQL}, full_session AS (
      SELECT c.c_nationkey AS subject_id, s.session_id, s.season_type, coalesce(e.y, 0) AS y, coalesce(e.t, 0) AS t
      FROM session s JOIN customer c ON c.c_custkey = s.cust_id
      LEFT JOIN (SELECT session_id, sum(outcome) AS y, count(*) FILTER (WHERE event_type = 'R') AS t FROM event GROUP BY 1) e
        USING (session_id)),
    pair AS (SELECT subject_id, actor_id, count(*) AS n, sum(y) AS y, CAST(sum(t) AS BIGINT) AS t,
               count(*) FILTER (WHERE season_type = 'RS') AS n_rs, count(*) FILTER (WHERE season_type = 'PO') AS n_po
             FROM full_session JOIN team USING (session_id) GROUP BY ALL),
    total AS (SELECT subject_id, count(*) AS n, sum(y) AS y, CAST(sum(t) AS BIGINT) AS t FROM full_session GROUP BY 1),
    side AS (SELECT p.subject_id, p.actor_id, p.n AS n_with, t.n - p.n AS n_without, p.n_rs, p.n_po,
               p.y AS y_with, CASE WHEN p.n = t.n THEN 0 ELSE t.y - p.y END AS y_without,
               p.t AS t_with, t.t - p.t AS t_without, t.n AS n_total, t.y AS y_total, t.t AS t_total
             FROM pair p JOIN total t USING (subject_id))
    SELECT subject_id, actor_id, n_with, n_without, n_rs, n_po, {r('y_with', 2)} AS y_with, {r('y_without', 2)} AS y_without,
      t_with, t_without,
      {r('y_with / greatest(n_with, 1)')} AS outcome_per_session_with,
      {r('y_without / greatest(n_without, 1)')} AS outcome_per_session_without,
      {r('y_with / greatest(n_with, 1) - y_without / greatest(n_without, 1)')} AS outcome_delta,
      {r('t_with / CAST(greatest(n_with, 1) AS DOUBLE)')} AS target_per_session_with,
      {r('t_without / CAST(greatest(n_without, 1) AS DOUBLE)')} AS target_per_session_without,
      {r('t_with / CAST(greatest(n_with, 1) AS DOUBLE) - t_without / CAST(greatest(n_without, 1) AS DOUBLE)')} AS target_delta,
      {r('y_total / greatest(n_total, 1)')} AS baseline_outcome_per_session,
      {r('t_total / CAST(greatest(n_total, 1) AS DOUBLE)')} AS baseline_target_per_session
    FROM side""",
)
def with_without(spark, sf):
    """Totals cover every session of the subject, also those without a team."""
    per_session = (
        roles.events(spark, sf).groupBy("session_id")
        .agg(F.sum("outcome").alias("y"), F.count_if(target()).alias("t"))
    )
    customer = roles.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cust_id"), F.col("c_nationkey").alias("subject_id")
    )
    rows = (
        roles.sessions(spark, sf).join(per_session, "session_id", "left").join(customer, "cust_id")
        .select("subject_id", "session_id", "season_type", F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("t", F.lit(0)).alias("t"))
    )
    s = E.with_without_sums(
        rows, roles.team(spark, sf), "subject_id", "session_id", "actor_id", "y",
        target="t", period="season_type", need_team=False,
    )
    out = E.with_without(s).drop("n_total", "y_total", "t_total")
    return rounded(out, y_with=2, y_without=2)


@query("adjusted_delta", f"{ADJUSTED_SQL} SELECT {OUT_SQL} FROM adjusted")
def adjusted_delta(spark, sf):
    return rounded(adjusted(spark, sf).select(*OUT))


FITTED_SQL = """fitted AS (SELECT sum(n * rc) / nullif(sum(n * cc), 0) AS slope, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows, count(*) AS n_subjects FROM (
  SELECT subject_id, count(*) AS n, covar_pop(36 * y / greatest(m, 1), cov) AS rc, var_pop(cov) AS cc FROM subject_session WHERE cov IS NOT NULL GROUP BY 1))"""


def fitted_slope(spark, sf):
    return E.covariate_slope(roles.subject_sessions(spark, sf), "subject_id", "y", "m", "cov")


@query("covariate_slope", f"{BASE_SQL}, {FITTED_SQL} SELECT {r('slope', 6)} AS slope, n_rows, n_subjects FROM fitted")
def covariate_slope(spark, sf):
    return rounded(fitted_slope(spark, sf), slope=6)


@query(
    "session_covariate",
    """SELECT l_orderkey AS session_id, arg_min(l_discount, (l_linenumber, l_partkey, l_suppkey)) FILTER (WHERE l_discount > 0.02) AS cov FROM lineitem GROUP BY 1""",
)
def session_covariate(spark, sf):
    """First covariate of each session, here the discount of its first event that has one above two per cent."""
    rows = roles.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("cov"), "l_linenumber", "l_partkey", "l_suppkey")
    return E.first_covariate(rows, "session_id", "cov", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])


@query(
    "adjusted_delta_fitted",
    f"""{BASE_SQL}, {FITTED_SQL}, {pair_sums_sql().replace('0.15', '(SELECT slope FROM fitted)')}, adjusted AS (SELECT * FROM adjusted_all WHERE n_with >= {MIN_WITH})
        SELECT {OUT_SQL} FROM adjusted""",
)
def adjusted_delta_fitted(spark, sf):
    """The adjusted differences with the slope that the data give in place of the published one."""
    slope = checkpointed(fitted_slope(spark, sf)).select("slope").scalar()
    return rounded(E.adjusted_delta(sums(spark, sf), MIN_WITH, slope=slope).select(*OUT))


@query("adjusted_delta_sym", f"{BOTH_SQL} SELECT {OUT_SQL} FROM adjusted")
def adjusted_delta_sym(spark, sf):
    return rounded(adjusted_both(spark, sf).select(*OUT))


@query("adjusted_delta_type", f"{PERIOD_SQL} SELECT season_type, {OUT_SQL} FROM adjusted")
def adjusted_delta_type(spark, sf):
    return rounded(adjusted_by_period(spark, sf).select("season_type", *OUT))


@query(
    "subject_baseline",
    f"""{BASE_SQL} SELECT subject_id, count(DISTINCT session_id) AS n_sessions, {r('sum(y)', 2)} AS total_y, {r('sum(m)', 2)} AS total_m,
        {r('avg(cov)')} AS mean_cov, {r('36 * sum(y) / CASE WHEN sum(m) = 0 THEN 1 ELSE sum(m) END')} AS rate
        FROM subject_session GROUP BY 1""",
)
def subject_baseline(spark, sf):
    out = E.subject_baseline(roles.subject_sessions(spark, sf), "subject_id", "session_id", "y", "m", "cov")
    return rounded(out, total_y=2, total_m=2)


ROLLUP_SQL = f"""{BOTH_SQL}, rolled AS (
  SELECT actor_id, avg(adj_delta) AS mean_delta, stddev_samp(adj_delta) AS std_delta,
         count(DISTINCT subject_id) AS n_subjects, count(*) AS n_pairs,
         avg(CASE WHEN adj_delta < 0 THEN 1.0 ELSE 0.0 END) AS suppressor_score, avg(raw_delta) AS mean_raw_delta
  FROM adjusted GROUP BY 1)"""


def rollup(spark, sf, **inputs):
    return E.actor_rollup(adjusted_both(spark, sf, **inputs), "subject_id", "actor_id")


def shift(spark, sf, **inputs):
    return E.period_shift(adjusted_by_period(spark, sf, **inputs), "actor_id", "season_type")


_PERIOD_CTES = (
    pair_sums_sql("season_type")
    .replace("pair AS", "p_pair AS").replace("total AS", "p_total AS").replace("side AS", "p_side AS")
    .replace("adjusted_all AS", "p_adjusted_all AS")
    .replace("FROM pair p JOIN total t", "FROM p_pair p JOIN p_total t").replace("FROM side)", "FROM p_side)")
)
_SHIFT_BODY = """SELECT actor_id, avg(adj_delta) FILTER (WHERE season_type = 'RS') AS mean_delta_rs,
    avg(adj_delta) FILTER (WHERE season_type = 'PO') AS mean_delta_po,
    count(adj_delta) FILTER (WHERE season_type = 'RS') AS n_subjects_rs,
    count(adj_delta) FILTER (WHERE season_type = 'PO') AS n_subjects_po
  FROM {src} GROUP BY 1
  HAVING count(adj_delta) FILTER (WHERE season_type = 'RS') > 0 AND count(adj_delta) FILTER (WHERE season_type = 'PO') > 0"""


@query(
    "type_shift",
    f"""{PERIOD_SQL}, s AS ({_SHIFT_BODY.format(src='adjusted')})
        SELECT actor_id, {r('mean_delta_rs')} AS mean_delta_rs, {r('mean_delta_po')} AS mean_delta_po, n_subjects_rs, n_subjects_po,
               {r('mean_delta_po - mean_delta_rs')} AS rs_po_delta FROM s""",
)
def type_shift(spark, sf):
    return rounded(shift(spark, sf))


def rollup_full(spark, sf):
    """Roll-up, period shift, profile rates and event share of each actor.

    The subject sessions and the counts of (session, actor) are written once; all four read them in place of the events.
    """
    counts = checkpointed(roles.events(spark, sf).groupBy("session_id", "actor_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(target()).alias("t")))
    team = counts.select("session_id", "actor_id")
    inputs = {"rows": checkpointed(roles.subject_sessions(spark, sf)), "team": team}
    prof = P.pivot_profile(P.profile_of_counts(counts, roles.sessions(spark, sf), "actor_id", "session_id", "season_type", "t"), "actor_id", "season_type").select(
        "actor_id", "per_session_RS", "per_session_PO", "per_session_delta", "total_events", "total_sessions",
        (F.col("total_events") / F.nullif(F.col("total_sessions"), F.lit(0))).alias("per_session"),
    )
    share = P.share_of_counts(counts, "actor_id", "session_id", "n", "t").select("actor_id", "target_share", "n_sessions")
    return (
        rollup(spark, sf, **inputs)
        .join(shift(spark, sf, **inputs), "actor_id", "left")
        .join(prof, "actor_id", "left")
        .join(share, "actor_id", "left")
    )


@query(
    "actor_rollup",
    f"""{ROLLUP_SQL}, {_PERIOD_CTES},
      p_adjusted AS (SELECT * FROM p_adjusted_all
        WHERE (season_type = 'RS' AND n_with >= 5 AND n_without >= 5) OR (season_type = 'PO' AND n_with >= 3 AND n_without >= 3)),
      s AS ({_SHIFT_BODY.format(src='p_adjusted')}),
      {PROFILE_SQL[len(BASE_SQL) + 1:]},
      c AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'R') AS t FROM event GROUP BY 1),
      share AS (SELECT actor_id, count(*) AS n_sessions, sum(t) / CAST(sum(n) AS DOUBLE) AS target_share
                FROM team JOIN c USING (session_id) GROUP BY 1)
      SELECT k.actor_id, {r('mean_delta')} AS mean_delta, {r('std_delta')} AS std_delta, n_subjects, n_pairs,
        {r('suppressor_score')} AS suppressor_score, {r('mean_raw_delta')} AS mean_raw_delta,
        {r('mean_delta_rs')} AS mean_delta_rs, {r('mean_delta_po')} AS mean_delta_po, n_subjects_rs, n_subjects_po,
        {r('mean_delta_po - mean_delta_rs')} AS rs_po_delta,
        {r('per_session_RS')} AS per_session_RS, {r('per_session_PO')} AS per_session_PO,
        {r('per_session_PO - per_session_RS')} AS per_session_delta,
        n_events_RS + n_events_PO AS total_events, n_assigned_RS + n_assigned_PO AS total_sessions,
        {r('(n_events_RS + n_events_PO) / CAST(n_assigned_RS + n_assigned_PO AS DOUBLE)')} AS per_session,
        {r('target_share')} AS target_share, n_sessions
      FROM rolled k LEFT JOIN s USING (actor_id) LEFT JOIN wide USING (actor_id) LEFT JOIN share USING (actor_id)""",
)
def actor_rollup(spark, sf):
    return rounded(rollup_full(spark, sf))


@query(
    "adjust_summary",
    f"""{ADJUSTED_SQL} SELECT count(*) AS n_pairs, {r('avg(adjustment)')} AS mean_adjustment, {r('max(adjustment)')} AS max_adjustment,
        {r('''covar_pop(raw_delta, adj_delta) / nullif(
             stddev_pop(raw_delta) FILTER (WHERE adj_delta IS NOT NULL) * stddev_pop(adj_delta) FILTER (WHERE raw_delta IS NOT NULL), 0)''')} AS raw_adj_r,
        count(*) FILTER (WHERE sign(raw_delta) * sign(adj_delta) < 0) AS n_sign_flips FROM adjusted""",
)
def adjust_summary(spark, sf):
    return rounded(E.adjustment_summary(adjusted(spark, sf)))


@query(
    "actor_spread",
    f"""{ROLLUP_SQL} SELECT count(*) AS n_actors, {r('stddev_samp(mean_delta)')} AS std_delta,
        {r('quantile_cont(mean_delta, 0.1)')} AS p10, {r('quantile_cont(mean_delta, 0.9)')} AS p90,
        {r('quantile_cont(mean_delta, 0.9) - quantile_cont(mean_delta, 0.1)')} AS p10_p90 FROM rolled""",
)
def actor_spread(spark, sf):
    means = rollup(spark, sf).select("mean_delta")
    spread = means.agg(F.count("mean_delta").alias("n_actors"), F.stddev_samp("mean_delta").alias("std_delta"))
    q = exact_quantiles(means, [], "mean_delta", {"p10": 0.1, "p90": 0.9})
    out = spread.select("*", q.select(F.struct("p10", "p90")).scalar().alias("q"))
    return rounded(out.select("n_actors", "std_delta", "q.p10", "q.p90", (F.col("q.p90") - F.col("q.p10")).alias("p10_p90")))


@query(
    "subject_team",
    f"{BASE_SQL} SELECT s.subject_id, s.session_id, t.actor_id, s.season_type, {r('s.y', 2)} AS y, {r('s.m', 2)} AS m "
    "FROM subject_session s JOIN team t USING (session_id)",
)
def subject_team(spark, sf):
    rows = roles.subject_sessions(spark, sf).select("subject_id", "session_id", "season_type", "y", "m")
    out = E.with_team(rows, roles.team(spark, sf), "session_id")
    return rounded(out.select("subject_id", "session_id", "actor_id", "season_type", "y", "m"), y=2, m=2)


@query(
    "extreme_actor",
    f"""{ADJUSTED_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY adj_delta, actor_id) AS lo,
          row_number() OVER (PARTITION BY subject_id ORDER BY adj_delta DESC, actor_id) AS hi
        FROM adjusted WHERE adj_delta IS NOT NULL)
        SELECT subject_id, max(actor_id) FILTER (WHERE lo = 1) AS lowest_actor, {r('min(adj_delta)')} AS lowest_delta,
               max(actor_id) FILTER (WHERE hi = 1) AS highest_actor, {r('max(adj_delta)')} AS highest_delta
        FROM k GROUP BY 1""",
)
def extreme_actor(spark, sf):
    return rounded(E.extreme_actors(adjusted(spark, sf), "subject_id", "actor_id", "adj_delta"))


@query(
    "topk_abs",
    f"""{ADJUSTED_SQL} SELECT subject_id, actor_id, {r('adj_delta')} AS adj_delta, n_with FROM adjusted
        WHERE adj_delta IS NOT NULL ORDER BY abs(adj_delta) DESC, subject_id, actor_id LIMIT 40""",
)
def topk_abs(spark, sf):
    rows = adjusted(spark, sf).filter("adj_delta IS NOT NULL").select("subject_id", "actor_id", "adj_delta", "n_with")
    return rounded(P.top_k(rows, [F.abs("adj_delta").desc(), F.asc("subject_id"), F.asc("actor_id")], 40))


RATE_SQL = f"""{BASE_SQL}, rated AS (
  SELECT *, 36 * y / nullif(m, 0) AS rate FROM subject_session WHERE season >= 1996 AND m >= 10),
base AS (SELECT subject_id, avg(rate) FILTER (WHERE season_type = 'RS') AS base_rate,
         count(*) FILTER (WHERE season_type = 'RS') AS base_n FROM rated GROUP BY 1)"""


def rated(spark, sf):
    """Subject sessions in the coverage window with enough exposure, and their rate."""
    rows = roles.subject_sessions(spark, sf).filter((F.col("season") >= 1996) & (F.col("m") >= 10))
    return rows.withColumn("rate", per_unit("y", "m", 36.0, "null"))


@query(
    "baseline_delta",
    f"""{RATE_SQL} SELECT subject_id, session_id, season_type, {r('rate')} AS rate, {r('base_rate')} AS base_rate, base_n,
        {r('rate - base_rate')} AS rate_delta FROM rated JOIN base USING (subject_id)""",
)
def baseline_delta(spark, sf):
    rows = rated(spark, sf).select("subject_id", "session_id", "season_type", "rate")
    return rounded(E.baseline_delta(rows, "subject_id", "rate", F.col("season_type") == "RS"))


@query(
    "flag_breakdown",
    f"""{RATE_SQL} SELECT subject_id, count(*) AS n_flagged, {r('avg(rate)')} AS rate_mean, {r('avg(rate - base_rate)')} AS rate_delta_mean
        FROM rated JOIN base USING (subject_id) WHERE season_type = 'PO' AND n_target >= 2 GROUP BY 1""",
)
def flag_breakdown(spark, sf):
    rows = rated(spark, sf).select("subject_id", "season_type", "n_target", "rate")
    out = E.baseline_delta(rows, "subject_id", "rate", F.col("season_type") == "RS")
    flag = (F.col("season_type") == "PO") & (F.col("n_target") >= 2)
    return rounded(E.flag_breakdown(out, "subject_id", flag, ["rate", "rate_delta"]))
