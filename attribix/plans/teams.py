"""Queries over teams, prior-only profiles and the holdout models."""

from __future__ import annotations

from pyspark.sql import functions as F

from attribix.functions.numeric import pearson, per_unit, ratio
from attribix.operators import models as M
from attribix.operators import teams as T
from attribix.operators.keyed import spread_join, value_map
from attribix.plans import effects as FX
from attribix.plans import roles
from attribix.plans.profiles import target
from attribix.plans.registry import query
from attribix.plans.roles import BASE_SQL
from attribix.plans.shape import r, rounded
from attribix.session import checkpointed

SIZE = 3
MIN_EXPOSURE = 10
PAIR_MIN = 10
PAIR_Z_MIN = 3
TRAIN, TEST = (1995, 1999), (2000, 2001)
RATES = ["per_session", "n_assigned"]

PRIOR_SQL = f"""{BASE_SQL},
season_actor AS (
  SELECT a.actor_id, a.season, a.n_assigned, coalesce(c.n_events, 0) AS n_events
  FROM (SELECT actor_id, season, count(*) AS n_assigned FROM team JOIN session USING (session_id) GROUP BY ALL) a
  LEFT JOIN (SELECT actor_id, season, count(*) AS n_events FROM event JOIN session USING (session_id)
             WHERE event_type = 'R' GROUP BY ALL) c USING (actor_id, season)),
season_list AS (SELECT DISTINCT season FROM session),
prior AS (
  SELECT a.actor_id, z.season AS profile_season, CAST(sum(n_events) AS BIGINT) AS n_events,
         CAST(sum(n_assigned) AS BIGINT) AS n_assigned,
         sum(n_events) / CAST(greatest(sum(n_assigned), 1) AS DOUBLE) AS per_session
  FROM season_actor a JOIN season_list z ON a.season < z.season GROUP BY ALL),
med AS (SELECT profile_season, median(per_session) AS per_session, median(n_assigned) AS n_assigned FROM prior GROUP BY 1),
gmed AS (SELECT median(per_session) AS per_session, median(n_assigned) AS n_assigned FROM prior),
slot AS (
  SELECT session_id, actor_id, row_number() OVER (PARTITION BY session_id ORDER BY actor_id) AS slot
  FROM team QUALIFY count(*) OVER (PARTITION BY session_id) = {SIZE}),
member AS (
  SELECT t.session_id, t.slot, t.actor_id, s.season, s.season_type, p.actor_id IS NOT NULL AS known,
         coalesce(p.per_session, m.per_session, g.per_session) AS per_session,
         coalesce(p.n_assigned, m.n_assigned, g.n_assigned) AS n_assigned
  FROM slot t JOIN session s USING (session_id) JOIN med m ON m.profile_season = s.season
  LEFT JOIN prior p ON p.actor_id = t.actor_id AND p.profile_season = s.season CROSS JOIN gmed g),
counts AS (SELECT session_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'R') AS n_target FROM event GROUP BY 1),
feature AS (
  SELECT session_id, any_value(season) AS season, any_value(season_type) AS season_type,
         count(*) FILTER (WHERE known) AS n_profiled,
         avg(per_session) AS team_mean_per_session, min(per_session) AS team_min_per_session,
         max(per_session) AS team_max_per_session, stddev_samp(per_session) AS team_std_per_session,
         sum(per_session) AS team_sum_per_session, avg(n_assigned) AS team_mean_n_assigned,
         max(per_session) FILTER (WHERE slot = 1) AS slot1_per_session,
         max(per_session) FILTER (WHERE slot = 2) AS slot2_per_session,
         max(per_session) FILTER (WHERE slot = 3) AS slot3_per_session,
         max(actor_id) FILTER (WHERE slot = 1) AS slot1_actor,
         max(actor_id) FILTER (WHERE slot = 2) AS slot2_actor,
         max(actor_id) FILTER (WHERE slot = 3) AS slot3_actor
  FROM member GROUP BY 1),
dataset AS (
  SELECT f.*, c.n_target, c.n_events, c.n_target / CAST(c.n_events AS DOUBLE) AS target_rate,
         CASE WHEN season_type = 'PO' THEN 1 ELSE 0 END AS is_playoff,
         CASE WHEN season BETWEEN 1995 AND 1999 THEN 'train' WHEN season BETWEEN 2000 AND 2001 THEN 'test' END AS fold
  FROM feature f JOIN counts c USING (session_id) WHERE f.n_profiled >= 2)"""

KEEP = [
    "session_id", "season", "season_type", "n_profiled", "team_mean_per_session", "team_min_per_session",
    "team_max_per_session", "team_std_per_session", "team_sum_per_session", "team_mean_n_assigned",
    "slot1_per_session", "slot2_per_session", "slot3_per_session", "slot1_actor", "slot2_actor", "slot3_actor",
    "n_target", "n_events", "target_rate", "is_playoff",
]


def worked(spark, sf):
    """One written row per (session, actor): its events, and how many count. All that the models read of the events."""
    ev = roles.events(spark, sf).select("session_id", "actor_id", target().alias("t"))
    return checkpointed(ev.groupBy("session_id", "actor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("n_target")))


def season_actor(spark, sf, rows=None):
    rows = worked(spark, sf) if rows is None else rows
    both = (
        rows.join(roles.sessions(spark, sf).select("session_id", "season"), "session_id")
        .groupBy("actor_id", "season").agg(F.sum("n_target").alias("n_events"), F.count(F.lit(1)).alias("n_assigned"))
    )
    return both.filter("n_events > 0").select("actor_id", "season", "n_events"), both.select("actor_id", "season", "n_assigned")


def prior(spark, sf, rows=None):
    calls, assigned = season_actor(spark, sf, rows)
    return T.prior_profile(calls, assigned, "actor_id", "season", roles.sessions(spark, sf))


def static(spark, sf):
    calls, assigned = season_actor(spark, sf)
    return (
        assigned.join(calls, ["actor_id", "season"], "left").groupBy("actor_id")
        .agg(F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"), F.sum("n_assigned").alias("n_assigned"))
        .withColumn("per_session", ratio("n_events", "n_assigned", "floor1"))
    )


def dataset(spark, sf):
    """Sessions with an exact-size team: prior-only team features and the session outcome.

    The profile has three readers, so it is written once; it holds one row per
    actor and season.
    """
    rows = worked(spark, sf)
    profile = checkpointed(prior(spark, sf, rows))
    defaults = T.median_defaults(profile, ["profile_season"], RATES)
    league = T.median_defaults(profile, [], RATES).select(F.struct(*RATES)).scalar()
    slots = T.team_slots(rows, "session_id", "actor_id", SIZE)
    by_session = roles.sessions(spark, sf).select("session_id", F.col("season").alias("profile_season"), "season_type")
    looked_up = (
        slots.join(by_session, "session_id")
        .withColumn("by_season", value_map(defaults, "profile_season", *RATES))
        .filter(F.map_contains_key("by_season", F.col("profile_season")))
        .join(profile.select("actor_id", "profile_season", *RATES, F.lit(True).alias("known")), ["actor_id", "profile_season"], "left")
    )
    members = looked_up.withColumn("league", league).withColumns(
        {v: F.coalesce(v, F.col("by_season")[F.col("profile_season")][v], F.col("league")[v]) for v in RATES}
    )
    feats = T.team_features(members, "session_id", RATES, F.col("known"), SIZE)
    counts = rows.groupBy("session_id").agg(F.sum("n").alias("n_events"), F.sum("n_target").alias("n_target"))
    counts = counts.withColumn("target_rate", F.col("n_target") / F.col("n_events"))
    return (
        feats.filter("n_profiled >= 2")
        .join(counts, "session_id")
        .join(by_session.withColumnRenamed("profile_season", "season"), "session_id")
        .withColumn("is_playoff", (F.col("season_type") == "PO").cast("int"))
    )


def folded(spark, sf):
    return dataset(spark, sf).withColumn("fold", M.holdout("season", TRAIN, TEST))


@query(
    "team_wide",
    f"""{BASE_SQL} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY actor_id) AS INTEGER) AS slot, actor_id,
        count(*) OVER (PARTITION BY session_id) AS n_actors FROM team""",
)
def team_wide(spark, sf):
    """The ordered long form, which has no bound on the team."""
    return T.team_long(roles.team(spark, sf), "session_id", "actor_id")


@query(
    "prior_profile",
    f"{PRIOR_SQL} SELECT actor_id, profile_season, n_events, n_assigned, {r('per_session', 6)} AS per_session FROM prior",
)
def prior_profile(spark, sf):
    return rounded(prior(spark, sf), 6)


@query(
    "median_defaults",
    f"""{PRIOR_SQL} SELECT profile_season, {r('per_session', 6)} AS per_session, {r('n_assigned')} AS n_assigned FROM med
        UNION ALL SELECT NULL, {r('per_session', 6)}, {r('n_assigned')} FROM gmed""",
)
def median_defaults(spark, sf):
    profile = prior(spark, sf)
    by_season = T.median_defaults(profile, ["profile_season"], RATES)
    overall = T.median_defaults(profile, [], RATES).select(F.lit(None).cast("int").alias("profile_season"), *RATES)
    return rounded(by_season.unionByName(overall), per_session=6)


@query("team_features", f"""{PRIOR_SQL} SELECT {', '.join(r(c, 6) + ' AS ' + c if ('per_session' in c or c in ('team_mean_n_assigned', 'target_rate')) else c for c in KEEP)} FROM dataset""")
def team_features(spark, sf):
    return rounded(dataset(spark, sf).select(*KEEP), 6)


@query(
    "impute_train",
    f"""{PRIOR_SQL},
      raw AS (SELECT t.session_id, s.season,
                max(p.per_session) FILTER (WHERE slot = 1 AND p.n_assigned >= 150) AS slot1,
                max(p.per_session) FILTER (WHERE slot = 2 AND p.n_assigned >= 150) AS slot2
              FROM slot t JOIN session s USING (session_id)
              LEFT JOIN prior p ON p.actor_id = t.actor_id AND p.profile_season = s.season GROUP BY ALL),
      m AS (SELECT median(slot1) AS slot1, median(slot2) AS slot2 FROM raw WHERE season BETWEEN 1995 AND 1999)
      SELECT session_id, {r('coalesce(raw.slot1, m.slot1)', 6)} AS slot1, {r('coalesce(raw.slot2, m.slot2)', 6)} AS slot2
      FROM raw CROSS JOIN m""",
)
def impute_train(spark, sf):
    """Slot rates of actors with too short a history are missing, and get the training median."""
    rates = prior(spark, sf).filter("n_assigned >= 150").select("actor_id", F.col("profile_season").alias("season"), "per_session")
    slots = T.team_slots(roles.team(spark, sf), "session_id", "actor_id", SIZE)
    raw = (
        slots.join(roles.sessions(spark, sf).select("session_id", "season"), "session_id")
        .join(rates, ["actor_id", "season"], "left")
        .groupBy("session_id", "season")
        .agg(*[F.max(F.when(F.col("slot") == i, F.col("per_session"))).alias(f"slot{i}") for i in (1, 2)])
    )
    train = raw.filter(F.col("season").between(*TRAIN))
    out = M.impute(raw, T.median_defaults(train, [], ["slot1", "slot2"]), ["slot1", "slot2"])
    return rounded(out.select("session_id", "slot1", "slot2"), 6)


@query(
    "ols_single",
    f"""{BASE_SQL}, c AS (SELECT s.season, e.y, e.m FROM subject_session e JOIN session s USING (session_id))
        SELECT season, {r('regr_slope(y, m)')} AS slope, {r('regr_intercept(y, m)')} AS intercept,
               {r('regr_r2(y, m)', 6)} AS r2, regr_count(y, m)::BIGINT AS n FROM c GROUP BY 1""",
)
def ols_single(spark, sf):
    rows = roles.subject_sessions(spark, sf).select("season", "y", "m")
    return rounded(M.line_fit(rows, "m", "y", ["season"]), r2=6)


TWO = ["team_mean_per_session", "is_playoff"]
FIT2_SQL = """mom AS (
  SELECT count(*) AS n, avg(team_mean_per_session) AS m1, avg(is_playoff) AS m2, avg(n_target) AS my,
         var_pop(team_mean_per_session) AS c11, var_pop(is_playoff) AS c22,
         covar_pop(team_mean_per_session, is_playoff) AS c12,
         covar_pop(team_mean_per_session, n_target) AS c1y, covar_pop(is_playoff, n_target) AS c2y
  FROM dataset WHERE fold = 'train')"""


@query(
    "ols_gram",
    f"""{PRIOR_SQL}, {FIT2_SQL}, b AS (SELECT m1, m2, my,
          (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS b1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS b2 FROM mom)
        SELECT session_id, n_target, {r('my + b1 * (team_mean_per_session - m1) + b2 * (is_playoff - m2)')} AS predicted
        FROM dataset CROSS JOIN b WHERE fold = 'test'""",
)
def ols_gram(spark, sf):
    data = checkpointed(folded(spark, sf).select("session_id", "fold", "n_target", *TWO))
    model = M.fit_ols(data.filter("fold = 'train'"), TWO, "n_target")
    return rounded(data.filter("fold = 'test'").select("session_id", "n_target", model.column().alias("predicted")))


@query(
    "ridge_gram",
    f"""{PRIOR_SQL}, {FIT2_SQL}, z AS (SELECT *, sqrt(c11) AS s1, sqrt(c22) AS s2 FROM mom),
        a AS (SELECT z.*, alpha, n * 1.0 + alpha AS g11, n * 1.0 + alpha AS g22, n * c12 / (s1 * s2) AS g12,
                n * c1y / s1 AS r1, n * c2y / s2 AS r2 FROM z CROSS JOIN (SELECT unnest([1.0, 10.0, 100.0])::DOUBLE AS alpha)),
        b AS (SELECT alpha, m1, m2, my, (r1 * g22 - r2 * g12) / (g11 * g22 - g12 * g12) / s1 AS b1,
                (r2 * g11 - r1 * g12) / (g11 * g22 - g12 * g12) / s2 AS b2 FROM a)
        SELECT alpha, {r('my - b1 * m1 - b2 * m2')} AS intercept, {r('b1')} AS coef_rate, {r('b2')} AS coef_playoff FROM b""",
)
def ridge_gram(spark, sf):
    """Coefficients for every penalty; the training rows are read once."""
    train = folded(spark, sf).filter("fold = 'train'")
    fits = M.fit_ridge(train, TWO, "n_target")
    rows = [(a, m.intercept, *[m.coef[c] for c in TWO]) for a, m in fits.items()]
    return rounded(spark.createDataFrame(rows, "alpha double, intercept double, coef_rate double, coef_playoff double"))


LINE_SQL = """line AS (SELECT regr_slope(n_target, team_sum_per_session) AS b, regr_intercept(n_target, team_sum_per_session) AS a,
                avg(n_target) AS mean_y FROM dataset WHERE fold = 'train')"""
SCORE_SQL = f"""{PRIOR_SQL}, {LINE_SQL},
scored AS (
  SELECT session_id, season, fold, n_target, mean_y AS league_mean, team_sum_per_session AS team_sum,
         a + b * team_sum_per_session AS ols_team_sum FROM dataset CROSS JOIN line WHERE fold IS NOT NULL),
eval_long AS (
  SELECT fold, n_target AS y, m AS model, p FROM scored
  UNPIVOT (p FOR m IN (league_mean, team_sum, ols_team_sum))),
evaluation AS (
  SELECT fold, model, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
         coalesce(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0), 0) AS r2,
         CASE WHEN max(p) > min(p) THEN covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0) END AS corr, count(*) AS n_test
  FROM eval_long GROUP BY ALL)"""
MODELS = ["league_mean", "team_sum", "ols_team_sum"]


def scored(spark, sf):
    """Every modelled session with its predictions. Coefficients come from the training seasons."""
    data = checkpointed(
        folded(spark, sf).filter("fold IS NOT NULL").select("session_id", "season", "fold", "n_target", "team_sum_per_session")
    )
    m = M.moments(data.filter("fold = 'train'"), ["team_sum_per_session"], "n_target")
    line = M.solve_ols(m, ["team_sum_per_session"])
    return data.select(
        "session_id", "season", "fold", "n_target",
        F.lit(float(m.mean[-1])).alias("league_mean"),
        F.col("team_sum_per_session").alias("team_sum"),
        line.column().alias("ols_team_sum"),
    )


EVAL_OUT = f"model, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('r2')} AS r2, {r('corr')} AS corr, n_test"


@query("regression_metrics", f"{SCORE_SQL} SELECT fold, {EVAL_OUT} FROM evaluation")
def regression_metrics(spark, sf):
    return rounded(M.regression_metrics(scored(spark, sf), "n_target", MODELS, ["fold"]))


@query(
    "best_model",
    f"{SCORE_SQL} SELECT model, {r('rmse')} AS rmse FROM evaluation WHERE fold = 'test' AND model <> 'league_mean' ORDER BY evaluation.rmse, model LIMIT 1",
)
def best_model(spark, sf):
    metrics = M.regression_metrics(scored(spark, sf).filter("fold = 'test'"), "n_target", MODELS)
    return rounded(M.best_model(metrics, F.col("model") == "league_mean"))


@query(
    "residuals",
    f"{SCORE_SQL} SELECT session_id, season, n_target, {r('ols_team_sum')} AS predicted, {r('n_target - ols_team_sum')} AS residual FROM scored",
)
def residuals(spark, sf):
    out = scored(spark, sf).select(
        "session_id", "season", "n_target", F.col("ols_team_sum").alias("predicted"),
        (F.col("n_target") - F.col("ols_team_sum")).alias("residual"),
    )
    return rounded(out)


@query(
    "team_pair_z",
    f"""{SCORE_SQL}, k AS (SELECT a.actor_id AS actor_a, b.actor_id AS actor_b, n_target - ols_team_sum AS e
          FROM slot a JOIN slot b ON a.session_id = b.session_id AND a.actor_id < b.actor_id JOIN scored s ON s.session_id = a.session_id),
        g AS (SELECT actor_a, actor_b, avg(e) AS mean_residual, count(*) AS n_sessions, stddev_samp(e) AS std_residual
              FROM k GROUP BY ALL HAVING count(*) >= {PAIR_Z_MIN})
        SELECT actor_a, actor_b, {r('mean_residual')} AS mean_residual, n_sessions, {r('std_residual')} AS std_residual,
               {r('std_residual / sqrt(n_sessions)')} AS se_mean,
               CASE WHEN std_residual > 1e-9 THEN {r('mean_residual / (std_residual / sqrt(n_sessions))', 3)} END AS z_score FROM g""",
)
def team_pair_z(spark, sf):
    res = scored(spark, sf).withColumn("residual", F.col("n_target") - F.col("ols_team_sum"))
    out = T.team_pair_z(roles.team(spark, sf), res, "session_id", "actor_id", "residual", SIZE, PAIR_Z_MIN)
    out = out.withColumn("z_score", F.when(F.col("std_residual") > 1e-9, F.col("z_score")))
    return rounded(out, z_score=3)


@query(
    "pair_z_summary",
    f"""{SCORE_SQL}, k AS (SELECT a.actor_id AS actor_a, b.actor_id AS actor_b, n_target - ols_team_sum AS e
          FROM slot a JOIN slot b ON a.session_id = b.session_id AND a.actor_id < b.actor_id JOIN scored s ON s.session_id = a.session_id),
        g AS (SELECT avg(e) AS mean_e, count(*) AS n, stddev_samp(e) AS sd FROM k GROUP BY actor_a, actor_b HAVING count(*) >= {PAIR_Z_MIN}),
        z AS (SELECT CASE WHEN sd > 1e-9 THEN mean_e / (sd / sqrt(n)) END AS z FROM g)
        SELECT count(*) AS n_pairs, count(*) FILTER (WHERE abs(z) > 1.96) AS n_significant, {r('count(*) * 0.05')} AS n_expected,
          {r('avg(abs(z))', 3)} AS mean_abs_z FROM z""",
)
def pair_z_summary(spark, sf):
    """How many pairs stand out, against the twentieth that chance alone gives."""
    res = scored(spark, sf).withColumn("residual", F.col("n_target") - F.col("ols_team_sum"))
    out = T.team_pair_z(roles.team(spark, sf), res, "session_id", "actor_id", "residual", SIZE, PAIR_Z_MIN)
    return rounded(T.pair_z_summary(out.withColumn("z_score", F.when(F.col("std_residual") > 1e-9, F.col("z_score")))), mean_abs_z=3)


@query(
    "signal_diag",
    f"""{PRIOR_SQL}, {LINE_SQL},
      fixed AS (SELECT actor_id, sum(n_events) / CAST(sum(n_assigned) AS DOUBLE) AS per_session FROM season_actor GROUP BY 1),
      both_ AS (SELECT d.session_id, any_value(d.fold) AS fold, any_value(d.n_target) AS y,
                any_value(d.team_sum_per_session) AS prior_sum, sum(f.per_session) AS static_sum
              FROM dataset d JOIN slot USING (session_id) JOIN fixed f USING (actor_id) WHERE d.fold IS NOT NULL GROUP BY 1)
      SELECT fold, count(*) AS n,
        {r('covar_pop(y, prior_sum) / nullif(stddev_pop(y) * stddev_pop(prior_sum), 0)')} AS r_prior,
        {r('covar_pop(y, static_sum) / nullif(stddev_pop(y) * stddev_pop(static_sum), 0)')} AS r_static,
        {r('sqrt(avg((y - prior_sum) * (y - prior_sum)))')} AS rmse_prior,
        {r('sqrt(avg((y - static_sum) * (y - static_sum)))')} AS rmse_static,
        {r('sqrt(avg((y - mean_y) * (y - mean_y)))')} AS rmse_baseline
      FROM both_ CROSS JOIN line GROUP BY 1""",
)
def signal_diag(spark, sf):
    """Leaky all-season rates against prior-only rates, on the same sessions."""
    data = checkpointed(folded(spark, sf).filter("fold IS NOT NULL").select(
        "session_id", "fold", F.col("n_target").alias("y"), F.col("team_sum_per_session").alias("prior_sum")
    ))
    fixed = static(spark, sf).select("actor_id", "per_session")
    static_sum = (
        T.team_slots(roles.team(spark, sf), "session_id", "actor_id", SIZE)
        .join(fixed, "actor_id").groupBy("session_id").agg(F.sum("per_session").alias("static_sum"))
    )
    train_mean = data.filter("fold = 'train'").agg(F.avg("y")).scalar()

    def rmse(p):
        e = F.col("y") - F.col(p)
        return F.sqrt(F.avg(e * e)).alias(f"rmse_{p}")

    out = (
        data.join(static_sum, "session_id").withColumn("baseline", train_mean).groupBy("fold")
        .agg(
            F.count(F.lit(1)).alias("n"), pearson("y", "prior_sum").alias("r_prior"),
            pearson("y", "static_sum").alias("r_static"), rmse("prior_sum"), rmse("static_sum"), rmse("baseline"),
        )
        .withColumnsRenamed({"rmse_prior_sum": "rmse_prior", "rmse_static_sum": "rmse_static"})
    )
    return rounded(out)


PAIR_PRIOR_SQL = f"""{BASE_SQL},
season_list AS (SELECT DISTINCT season FROM session),
psum AS (SELECT subject_id, actor_id, season, count(*) AS n, sum(y) AS y, sum(m) AS m, sum(cov) AS cov, count(cov) AS n_cov
         FROM subject_session JOIN team USING (session_id) GROUP BY ALL),
tsum AS (SELECT subject_id, season, count(*) AS n, sum(y) AS y, sum(m) AS m, sum(cov) AS cov, count(cov) AS n_cov
         FROM subject_session GROUP BY ALL),
pp AS (SELECT subject_id, actor_id, z.season AS profile_season, sum(n) AS n, sum(y) AS y, sum(m) AS m, sum(cov) AS cov, sum(n_cov) AS n_cov
       FROM psum p JOIN season_list z ON p.season < z.season GROUP BY ALL),
tt AS (SELECT subject_id, z.season AS profile_season, sum(n) AS n, sum(y) AS y, sum(m) AS m, sum(cov) AS cov, sum(n_cov) AS n_cov
       FROM tsum p JOIN season_list z ON p.season < z.season GROUP BY ALL),
delta AS (
  SELECT subject_id, actor_id, profile_season, CAST(pp.n AS BIGINT) AS n_with, CAST(tt.n - pp.n AS BIGINT) AS n_without,
         36 * pp.y / greatest(pp.m, 1) - 36 * (tt.y - pp.y) / greatest(tt.m - pp.m, 1)
           - 0.15 * (pp.cov / nullif(pp.n_cov, 0) - (tt.cov - pp.cov) / nullif(tt.n_cov - pp.n_cov, 0)) AS adj_delta
  FROM pp JOIN tt USING (subject_id, profile_season) WHERE pp.n >= {PAIR_MIN} AND tt.n - pp.n >= {PAIR_MIN}),
smed AS (SELECT subject_id, profile_season, median(adj_delta) AS d FROM delta GROUP BY ALL),
lmed AS (SELECT profile_season, median(adj_delta) AS d FROM delta GROUP BY ALL),
slot AS (SELECT session_id, actor_id, row_number() OVER (PARTITION BY session_id ORDER BY actor_id) AS slot
         FROM team QUALIFY count(*) OVER (PARTITION BY session_id) = {SIZE}),
lookup AS (
  SELECT s.subject_id, s.session_id, s.season, t.slot, t.actor_id, d.adj_delta IS NOT NULL AS known,
         coalesce(d.adj_delta, sm.d, l.d) AS delta
  FROM subject_session s JOIN slot t USING (session_id) JOIN lmed l ON l.profile_season = s.season
  LEFT JOIN smed sm ON sm.subject_id = s.subject_id AND sm.profile_season = s.season
  LEFT JOIN delta d ON d.subject_id = s.subject_id AND d.actor_id = t.actor_id AND d.profile_season = s.season
  WHERE s.m >= {MIN_EXPOSURE})"""


def written_sessions(spark, sf):
    """The subject sessions, written once for all that the subject models read of them."""
    return checkpointed(roles.subject_sessions(spark, sf).drop("n_target"))


def pair_prior(spark, sf, rows=None):
    return T.prior_pair_deltas(
        written_sessions(spark, sf) if rows is None else rows, roles.team(spark, sf), "subject_id", "session_id", "actor_id",
        "season", "y", "m", "cov", PAIR_MIN, seasons=roles.sessions(spark, sf),
    )


def pair_members(spark, sf, rows=None):
    """Members of each subject session with their prior pair delta, else the subject's or the season's median."""
    rows = written_sessions(spark, sf) if rows is None else rows
    deltas = checkpointed(pair_prior(spark, sf, rows).withColumnRenamed("profile_season", "season"))
    by_subject = T.median_defaults(deltas, ["subject_id", "season"], ["adj_delta"]).withColumnRenamed("adj_delta", "d_subject")
    by_season = T.median_defaults(deltas, ["season"], ["adj_delta"]).withColumnRenamed("adj_delta", "d_season")
    rows = rows.filter(F.col("m") >= MIN_EXPOSURE).select("subject_id", "session_id", "season", "season_type", "y", "m")
    slots = T.team_slots(roles.team(spark, sf), "session_id", "actor_id", SIZE)
    joined = (
        rows.join(slots, "session_id")
        .withColumn("by_season", value_map(by_season, "season", "d_season"))
        .filter(F.map_contains_key("by_season", F.col("season")))
        .withColumn("d_season", F.col("by_season")[F.col("season")]["d_season"])
        .drop("by_season")
    )
    # The few pairs are hashed, so the many members need no sort.
    return (
        spread_join(joined, by_subject, ["subject_id", "season"], ["session_id", "actor_id"])
        .join(deltas.select("subject_id", "actor_id", "season", "adj_delta").hint("shuffle_hash"), ["subject_id", "actor_id", "season"], "left")
        .withColumn("known", F.col("adj_delta").isNotNull())
        .withColumn("delta", F.coalesce("adj_delta", "d_subject", "d_season"))
    )


@query(
    "prior_pair_delta",
    f"{PAIR_PRIOR_SQL} SELECT subject_id, actor_id, profile_season, n_with, n_without, {r('adj_delta')} AS adj_delta FROM delta",
)
def prior_pair_delta(spark, sf):
    return rounded(pair_prior(spark, sf))


@query(
    "pair_lookup",
    f"{PAIR_PRIOR_SQL} SELECT subject_id, session_id, season, slot, actor_id, known, {r('delta')} AS delta FROM lookup",
)
def pair_lookup(spark, sf):
    out = pair_members(spark, sf).select("subject_id", "session_id", "season", F.col("slot").cast("bigint").alias("slot"), "actor_id", "known", "delta")
    return rounded(out)


@query(
    "team_subject_features",
    f"""{PAIR_PRIOR_SQL} SELECT subject_id, session_id, season, {r('avg(delta)')} AS team_mean_delta, {r('sum(delta)')} AS team_sum_delta,
        {r('max(delta)')} AS team_max_delta, {r('min(delta)')} AS team_min_delta, {r('stddev_pop(delta)')} AS team_std_delta,
        count(*) FILTER (WHERE known) AS n_matched FROM lookup GROUP BY ALL""",
)
def team_subject_features(spark, sf):
    out = T.team_subject_features(pair_members(spark, sf), ["subject_id", "session_id", "season"], "delta", F.col("known"))
    return rounded(out)


def subject_dataset(spark, sf):
    """Subject sessions with enough history: actual rate, prior baseline, mean prior team delta, fold."""
    played = written_sessions(spark, sf)
    feats = pair_members(spark, sf, played).groupBy("subject_id", "session_id", "season").agg(
        F.avg("delta").alias("d"), F.first("y").alias("y"), F.first("m").alias("m")
    )
    totals = T.prior_sums(
        played.groupBy("subject_id", "season")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ty"), F.sum("m").alias("tm")),
        ["subject_id"], "season", ["n", "ty", "tm"], "season", roles.sessions(spark, sf),
    ).filter(F.col("n") >= PAIR_MIN)
    return (
        spread_join(feats, totals, ["subject_id", "season"], ["session_id"], "inner")
        .withColumn("rate", per_unit("y", "m"))
        .withColumn("prior_baseline", per_unit("ty", "tm"))
        .withColumn("baseline_plus_team", F.col("prior_baseline") + F.col("d"))
        .withColumn("fold", F.when(F.col("season").between(*TRAIN), "train").otherwise("test"))
        .select("subject_id", "session_id", "fold", "rate", "d", "prior_baseline", "baseline_plus_team")
    )


HOLDOUT_SQL = f"""{PAIR_PRIOR_SQL},
sdata AS (
  SELECT k.subject_id, k.session_id, k.season, k.d, 36 * s.y / greatest(s.m, 1) AS rate,
         36 * t.y / greatest(t.m, 1) AS prior_baseline,
         CASE WHEN k.season BETWEEN 1995 AND 1999 THEN 'train' ELSE 'test' END AS fold
  FROM (SELECT subject_id, session_id, season, avg(delta) AS d FROM lookup GROUP BY ALL) k
  JOIN subject_session s USING (session_id) JOIN tt t ON t.subject_id = k.subject_id AND t.profile_season = k.season
  WHERE t.n >= {PAIR_MIN}),
smean AS (SELECT subject_id, avg(rate) AS v FROM sdata WHERE fold = 'train' GROUP BY 1),
lmean AS (SELECT avg(rate) AS v FROM sdata WHERE fold = 'train'),
preds AS (
  SELECT rate AS y, l.v AS league_mean, coalesce(m.v, l.v) AS subject_mean, prior_baseline, prior_baseline + d AS baseline_plus_team
  FROM sdata LEFT JOIN smean m USING (subject_id) CROSS JOIN lmean l WHERE fold = 'test'),
long AS (SELECT y, m AS model, p FROM preds UNPIVOT (p FOR m IN (league_mean, subject_mean, prior_baseline, baseline_plus_team)))"""


@query(
    "holdout_eval",
    f"""{HOLDOUT_SQL} SELECT model, {r('sqrt(avg((y - p) * (y - p)))')} AS rmse, {r('avg(abs(y - p))')} AS mae,
        {r('coalesce(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0), 0)')} AS r2,
        CASE WHEN model <> 'league_mean' THEN {r('covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0)')} END AS corr,
        count(*) AS n_test FROM long GROUP BY 1""",
)
def holdout_eval(spark, sf):
    """Season holdout of the subject-session predictors that need no fitted weights."""
    data = checkpointed(subject_dataset(spark, sf))
    train = data.filter("fold = 'train'")
    test = M.group_mean_predictor(data.filter("fold = 'test'"), train, "subject_id", "rate", "subject_mean")
    test = test.withColumn("league_mean", train.agg(F.avg("rate")).scalar())
    names = ["league_mean", "subject_mean", "prior_baseline", "baseline_plus_team"]
    out = M.regression_metrics(test, "rate", names)
    return rounded(out.withColumn("corr", F.when(F.col("model") != "league_mean", F.col("corr"))))


@query(
    "team_metrics",
    f"""{FX.ROLLUP_SQL} SELECT session_id, {r('avg(mean_delta)')} AS mean_mean_delta, {r('avg(suppressor_score)')} AS mean_suppressor_score,
        {r('min(mean_delta)')} AS min_mean_delta, {r('min(suppressor_score)')} AS min_suppressor_score, count(mean_delta) AS n_profiled
        FROM team LEFT JOIN rolled USING (actor_id) GROUP BY 1""",
)
def team_metrics(spark, sf):
    metrics = FX.rollup(spark, sf)
    out = T.team_metrics(roles.team(spark, sf), metrics, "session_id", "actor_id", ["mean_delta", "suppressor_score"])
    return rounded(out)


@query(
    "team_effect",
    f"""{FX.BOTH_SQL} SELECT s.subject_id, s.session_id, {r('avg(adj_delta)')} AS predicted_effect, count(adj_delta) AS n_matched
        FROM subject_session s JOIN team t USING (session_id) LEFT JOIN adjusted a ON a.subject_id = s.subject_id AND a.actor_id = t.actor_id
        WHERE s.season_type = 'PO' GROUP BY ALL""",
)
def team_effect(spark, sf):
    rows = roles.subject_sessions(spark, sf).filter("season_type = 'PO'").select("subject_id", "session_id")
    deltas = FX.adjusted_both(spark, sf).select("subject_id", "actor_id", "adj_delta")
    out = (
        rows.join(roles.team(spark, sf), "session_id").join(deltas, ["subject_id", "actor_id"], "left")
        .groupBy("subject_id", "session_id")
        .agg(F.avg("adj_delta").alias("predicted_effect"), F.count("adj_delta").alias("n_matched"))
    )
    return rounded(out)


@query(
    "subject_corr",
    f"""{HOLDOUT_SQL} SELECT subject_id, count(*) AS n, {r('covar_pop(rate, d) / nullif(stddev_pop(rate) * stddev_pop(d), 0)')} AS r_team,
        {r('covar_pop(rate, prior_baseline) / nullif(stddev_pop(rate) * stddev_pop(prior_baseline), 0)')} AS r_baseline
        FROM sdata GROUP BY 1 HAVING count(*) > 20""",
)
def subject_corr(spark, sf):
    """Signal per subject: actual rate against the prior-only team delta and the prior-only baseline."""
    return rounded(
        subject_dataset(spark, sf).groupBy("subject_id")
        .agg(F.count(F.lit(1)).alias("n"), pearson("rate", "d").alias("r_team"), pearson("rate", "prior_baseline").alias("r_baseline"))
        .filter("n > 20")
    )
