"""The full families of holdout models: means, prior baselines, OLS and ridge, each scored on the held-out seasons.

In the SQL counterparts the normal equations of standardised features are solved by elimination steps over the small
table of feature products.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attribix.functions.numeric import per_unit
from attribix.operators import models as M
from attribix.operators import teams as T
from attribix.operators.keyed import spread_join
from attribix.plans import roles
from attribix.plans.registry import query
from attribix.plans.shape import r, rounded
from attribix.plans.teams import HOLDOUT_SQL, PAIR_MIN, PRIOR_SQL, TEST, TRAIN, dataset, pair_members, written_sessions
from attribix.session import checkpointed

TEAM = [
    "team_mean_per_session", "team_min_per_session", "team_max_per_session", "team_std_per_session", "team_sum_per_session",
    "team_mean_n_assigned", "slot1_per_session", "slot2_per_session", "slot3_per_session", "is_playoff",
]
TEAM_OLS = ["team_sum_per_session", "team_std_per_session", "team_max_per_session", "team_mean_n_assigned", "is_playoff"]
TEAM_RATE = ["team_mean_n_assigned", "team_sum_per_session", "is_playoff"]
SUBJECT = ["prior_baseline", "mean_delta", "sum_delta", "max_delta", "min_delta", "cov", "is_playoff"]
SUBJECT_OLS = ["prior_baseline", "mean_delta", "cov", "is_playoff"]
RIDGES = {f"ridge_a{a:g}": a for a in M.RIDGE_ALPHAS}


def solved_sql(rows: str, features: list[str], targets: list[str], models: list[tuple[str, list[str], float, str]], given: dict[str, tuple[str, str]]) -> str:
    """CTEs up to ``evaluation`` over the rows of a CTE with ``fold``.

    models: (name, features, penalty, target); given: name -> (prediction, target) of models without fitted weights.
    """
    at = {f: i + 1 for i, f in enumerate(features)}
    spec = ", ".join(
        f"('{name}', '{target}', {float(alpha)}, {pos + 1}, {at[f]})" for name, use, alpha, target in models for pos, f in enumerate(use))
    listed = ", ".join(targets)
    shifted = " UNION ALL ".join(
        f"SELECT '{t}' AS target, i, sum(z * ({t} - m_{t})) AS b FROM fz, ty WHERE fold = 'train' GROUP BY i" for t in targets)
    means = " UNION ALL ".join(f"SELECT '{t}' AS target, m_{t} AS m FROM ty" for t in targets)
    truth = "CASE target " + " ".join(f"WHEN '{t}' THEN {t}" for t in targets) + " END"
    plain = "".join(f" UNION ALL SELECT '{n}', {t}::DOUBLE, ({p})::DOUBLE FROM {rows}, ty WHERE fold = 'test'" for n, (p, t) in given.items())
    return f"""
fx AS (SELECT row_number() OVER () AS rid, fold, {listed}, [{", ".join(f"{f}::DOUBLE" for f in features)}] AS x FROM {rows} WHERE fold IS NOT NULL),
fl AS (SELECT rid, fold, {listed}, i, x[i] AS v FROM (SELECT *, unnest(range(1, {len(features) + 1})) AS i FROM fx)),
fm AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s FROM fl WHERE fold = 'train' GROUP BY i),
fz AS (SELECT rid, fold, {listed}, i, (v - m) / s AS z FROM fl JOIN fm USING (i)),
ty AS (SELECT {", ".join(f"avg({t}) AS m_{t}" for t in targets)} FROM fx WHERE fold = 'train'),
fg AS (SELECT a.i, b.i AS j, sum(a.z * b.z) AS g FROM fz a JOIN fz b USING (rid) WHERE a.fold = 'train' GROUP BY ALL),
fb AS ({shifted}),
spec(model, target, alpha, pos, i) AS (VALUES {spec}),
lhs AS (SELECT a.model, a.pos, a.target, a.i, list(g + CASE WHEN a.i = b.i THEN a.alpha ELSE 0 END ORDER BY b.pos) AS l
        FROM spec a JOIN spec b USING (model) JOIN fg ON fg.i = a.i AND fg.j = b.i GROUP BY ALL),
sys AS (SELECT model, list(list_append(l, b) ORDER BY pos) AS m FROM lhs JOIN fb USING (target, i) GROUP BY model),
steps AS (
  SELECT model, 1 AS p, m FROM sys UNION ALL
  SELECT model, p + 1, list_transform(m, lambda l, i: CASE WHEN i = p THEN list_transform(l, lambda v: v / m[p][p])
    ELSE list_transform(l, lambda v, j: v - l[p] / m[p][p] * m[p][j]) END) FROM steps WHERE p <= len(m)),
weights AS (SELECT s.model, s.target, s.i, m[s.pos][len(m) + 1] AS w FROM steps JOIN spec s USING (model) WHERE p = len(m) + 1),
means AS ({means}),
fitted AS (SELECT model, rid, any_value({truth})::DOUBLE AS y, any_value(mm.m) + sum(z * w) AS p
           FROM fz JOIN weights USING (i) JOIN means mm USING (target) WHERE fold = 'test' GROUP BY model, rid),
eval_long AS (SELECT model, y, p FROM fitted{plain}),
evaluation AS (
  SELECT model, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
         coalesce(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(y), 0), 0) AS r2,
         CASE WHEN max(p) - min(p) > 1e-9 THEN covar_pop(y, p) / nullif(stddev_pop(y) * stddev_pop(p), 0) END AS corr, count(*) AS n_test
  FROM eval_long GROUP BY model)"""


OUT = f"SELECT model, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('r2')} AS r2, {r('corr')} AS corr, n_test FROM evaluation"


def evaluated(test, columns, target):
    """Metrics of prediction columns; a constant prediction has no correlation."""
    spread = {name: p for name, p in columns.items()}
    out = M.regression_metrics(test.select(target, *[p.alias(n) for n, p in spread.items()]), target, list(spread))
    return out.withColumn("corr", F.when(~F.col("model").isin("league_mean"), F.col("corr")))


def session_models_table(spark, sf):
    data = M.with_holdout(dataset(spark, sf), "season", TRAIN, TEST).filter("fold IS NOT NULL")
    data = checkpointed(data.select("session_id", "season", "fold", "n_target", "target_rate", *TEAM))
    train, test = data.filter("fold = 'train'"), data.filter("fold = 'test'")
    m = M.moments(train, TEAM, "n_target")
    columns = {
        "league_mean": F.lit(float(m.mean[-1])), "team_sum": F.col("team_sum_per_session"),
        "ols_additive": M.solve_ols(m.of(TEAM, TEAM_OLS), TEAM_OLS).column(),
        **{name: M.solve_ridge(m, TEAM, a).column() for name, a in RIDGES.items()},
    }
    rate = M.fit_ols(train, TEAM_RATE, "target_rate").column()
    return evaluated(test, columns, "n_target").unionByName(evaluated(test, {"ols_rate": rate}, "target_rate"))


SESSION_SQL = PRIOR_SQL.replace("WITH", "WITH RECURSIVE", 1) + "," + solved_sql(
    "dataset", TEAM, ["n_target", "target_rate"],
    [("ols_additive", TEAM_OLS, 0, "n_target"), ("ols_rate", TEAM_RATE, 0, "target_rate"), *[(n, TEAM, a, "n_target") for n, a in RIDGES.items()]],
    {"league_mean": ("m_n_target", "n_target"), "team_sum": ("team_sum_per_session", "n_target")},
)


@query("session_models", f"{SESSION_SQL} {OUT}")
def session_models(spark, sf):
    """Every model of the session outcome: mean, sum, additive OLS, OLS of the rate, ridge at three penalties."""
    return rounded(session_models_table(spark, sf))


@query(
    "session_best_model",
    f"{SESSION_SQL} SELECT model, {r('rmse')} AS rmse FROM evaluation WHERE model NOT IN ('league_mean', 'ols_rate') ORDER BY evaluation.rmse, model LIMIT 1",
)
def session_best_model(spark, sf):
    return rounded(M.best_model(session_models_table(spark, sf), F.col("model").isin("league_mean", "ols_rate")))


def subject_rows(spark, sf):
    """Subject sessions with enough history: rate, prior baseline, the team's prior deltas, covariate and season type."""
    every = written_sessions(spark, sf)
    deltas = pair_members(spark, sf, every).groupBy("subject_id", "session_id", "season", "season_type").agg(
        F.avg("delta").alias("mean_delta"), F.sum("delta").alias("sum_delta"), F.max("delta").alias("max_delta"), F.min("delta").alias("min_delta"))
    played = every.select("session_id", "y", "m", "cov")
    totals = T.prior_sums(
        every.groupBy("subject_id", "season")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ty"), F.sum("m").alias("tm")),
        ["subject_id"], "season", ["n", "ty", "tm"], "season", roles.sessions(spark, sf),
    ).filter(F.col("n") >= PAIR_MIN)
    rows = (
        spread_join(deltas.join(played, "session_id"), totals, ["subject_id", "season"], ["session_id"], "inner")
        .withColumn("rate", per_unit("y", "m")).withColumn("prior_baseline", per_unit("ty", "tm"))
        .withColumn("is_playoff", (F.col("season_type") == "PO").cast("int"))
    )
    rows = checkpointed(M.with_holdout(rows, "season", TRAIN, None).select("subject_id", "session_id", "fold", "rate", *SUBJECT))
    return M.impute(rows, T.median_defaults(rows.filter("fold = 'train'"), [], ["cov"]), ["cov"])


@query(
    "subject_models",
    HOLDOUT_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""",
dstat AS (SELECT session_id, avg(delta) AS mean_delta, sum(delta) AS sum_delta, max(delta) AS max_delta, min(delta) AS min_delta FROM lookup GROUP BY 1),
srow AS (SELECT k.subject_id, k.fold, k.rate, k.prior_baseline, mean_delta, sum_delta, max_delta, min_delta, s.cov AS cov0,
           CASE WHEN s.season_type = 'PO' THEN 1 ELSE 0 END AS is_playoff
         FROM sdata k JOIN dstat USING (session_id) JOIN subject_session s USING (session_id)),
cmed AS (SELECT median(cov0) AS c FROM srow WHERE fold = 'train'),
slmean AS (SELECT avg(rate) AS v FROM srow WHERE fold = 'train'),
srows AS (SELECT srow.*, coalesce(cov0, c) AS cov, coalesce(m.v, l.v) AS subject_mean
          FROM srow LEFT JOIN smean m USING (subject_id), cmed, slmean l),
""" + solved_sql(
        "srows", SUBJECT, ["rate"], [("ols_team", SUBJECT_OLS, 0, "rate"), *[(n, SUBJECT, a, "rate") for n, a in RIDGES.items()]],
        {"league_mean": ("m_rate", "rate"), "subject_mean": ("subject_mean", "rate"), "prior_baseline": ("prior_baseline", "rate"),
         "baseline_plus_team": ("prior_baseline + mean_delta", "rate")},
    ) + " " + OUT,
)
def subject_models(spark, sf):
    """Every model of the subject's rate: means, prior baseline with and without the team, OLS, ridge at three penalties."""
    data = checkpointed(subject_rows(spark, sf))
    train, test = data.filter("fold = 'train'"), data.filter("fold = 'test'")
    m = M.moments(train, SUBJECT, "rate")
    test = M.group_mean_predictor(test, train, "subject_id", "rate", "subject_mean")
    columns = {
        "league_mean": F.lit(float(m.mean[-1])), "subject_mean": F.col("subject_mean"), "prior_baseline": F.col("prior_baseline"),
        "baseline_plus_team": F.col("prior_baseline") + F.col("mean_delta"),
        "ols_team": M.solve_ols(m.of(SUBJECT, SUBJECT_OLS), SUBJECT_OLS).column(),
        **{name: M.solve_ridge(m, SUBJECT, a).column() for name, a in RIDGES.items()},
    }
    return rounded(evaluated(test, columns, "rate"))
