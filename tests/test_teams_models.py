"""Prior-only profiles, team features, linear models and metrics."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attribix.operators import models as M
from attribix.operators import teams as T


def test_team_wide_and_slots(spark):
    team = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 5), (2, 4), (3, 1), (3, 2), (3, 3), (3, 4)], "session int, actor int")
    wide = {r.session: (r.n_actors, r.actors) for r in T.team_wide(team, "session", "actor", 3).collect()}
    assert wide == {1: (3, [1, 2, 3])}
    many = team.union(spark.createDataFrame([(9, i) for i in range(65)], "session int, actor int"))
    long = T.team_long(many, "session", "actor").filter("session = 9").orderBy("slot").collect()
    assert [(r.slot, r.actor, r.n_actors) for r in long] == [(i + 1, i, 65) for i in range(65)]
    slots = sorted((r.session, r.slot, r.actor) for r in T.team_slots(team, "session", "actor", 3).collect())
    assert slots == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]


def test_prior_profile_covers_gaps_and_never_the_own_season(spark):
    assigned = spark.createDataFrame([("r", 2010, 4), ("r", 2012, 2), ("q", 2011, 5)], "actor string, season int, n_assigned long")
    calls = spark.createDataFrame([("r", 2010, 2), ("q", 2011, 5)], "actor string, season int, n_events long")
    got = {(r.actor, r.profile_season): (r.n_events, r.n_assigned, r.per_session) for r in T.prior_profile(calls, assigned, "actor", "season").collect()}
    assert got == {("r", 2011): (2, 4, 0.5), ("r", 2012): (2, 4, 0.5), ("q", 2012): (5, 5, 1.0)}


def test_a_later_season_changes_no_earlier_profile(spark):
    rnd = random.Random(2)
    base = [(f"r{i % 4}", 2010 + i % 3, rnd.randint(1, 9)) for i in range(12)]
    def profiles(extra):
        df = spark.createDataFrame(base + extra, "actor string, season int, n long").groupBy("actor", "season").agg(F.sum("n").alias("n"))
        return {(r.actor, r.profile_season): r.n for r in T.prior_sums(df, ["actor"], "season", ["n"]).collect()}
    before, after = profiles([]), profiles([("r0", 2015, 100)])
    assert before.items() <= after.items() and set(k[1] for k in set(after) - set(before)) == {2015}


def test_prior_pair_deltas_match_a_refit_per_season(spark):
    rnd = random.Random(5)
    rows, team = [], []
    for s in range(240):
        rows.append((rnd.choice("ab"), s, 2010 + s % 4, float(rnd.randint(0, 9)), float(rnd.randint(10, 40)), rnd.choice([None, 1.0, 3.0])))
        team += [(s, x) for x in rnd.sample("pqrst", 3)]
    got = {
        (r.subject, r.actor, r.profile_season): r.adj_delta
        for r in T.prior_pair_deltas(
            spark.createDataFrame(rows, "subject string, session int, season int, y double, m double, cov double"),
            spark.createDataFrame(team, "session int, actor string"), "subject", "session", "actor", "season", "y", "m", "cov", 10,
        ).collect()
    }
    seen = {}
    for s, a in team:
        seen.setdefault(s, set()).add(a)
    n = 0
    for subject in "ab":
        for actor in "pqrst":
            for season in (2011, 2012, 2013):
                past = [r for r in rows if r[0] == subject and r[2] < season]
                yes, no = [r for r in past if actor in seen[r[1]]], [r for r in past if actor not in seen[r[1]]]
                if min(len(yes), len(no)) < 10:
                    assert (subject, actor, season) not in got
                    continue
                n += 1
                rate = [36 * sum(r[3] for r in p) / max(sum(r[4] for r in p), 1) for p in (yes, no)]
                cov = [np.mean([r[5] for r in p if r[5] is not None]) for p in (yes, no)]
                assert got[(subject, actor, season)] == pytest.approx(rate[0] - rate[1] - 0.15 * (cov[0] - cov[1]))
    assert n == len(got) > 5


def test_team_features_count_before_imputing(spark):
    rows = [(1, 1, 7, 2.0, True), (1, 2, 8, 4.0, True), (1, 3, 9, 3.0, None), (2, 1, 7, 2.0, True)]
    df = spark.createDataFrame(rows, "session int, slot int, actor_id int, f double, known boolean")
    got = {r.session: r for r in T.team_features(df, "session", ["f"], F.col("known"), 3).collect()}
    assert (got[1].n_profiled, got[1].team_mean_f, got[1].team_sum_f, got[1].slot2_f, got[1].slot3_actor) == (2, 3.0, 9.0, 4.0, 9)
    assert got[1].team_std_f == pytest.approx(1.0) and got[2].team_std_f == 0.0 and got[2].slot2_f is None
    pop = T.team_subject_features(df, ["session"], "f", F.col("known")).filter("session = 1").first()
    assert pop.team_std_delta == pytest.approx(np.std([2, 4, 3]))


def test_team_pair_z(spark):
    team = spark.createDataFrame([(s, a) for s in range(6) for a in ("x", "y", "z")] + [(9, "x"), (9, "y")], "session int, actor string")
    res = spark.createDataFrame([(s, float(s)) for s in range(6)] + [(9, 50.0)], "session int, e double")
    got = T.team_pair_z(team, res, "session", "actor", "e", 3, 5).collect()
    assert sorted((r.actor_a, r.actor_b) for r in got) == [("x", "y"), ("x", "z"), ("y", "z")]
    v = np.arange(6.0)
    assert got[0].z_score == pytest.approx(v.mean() / (v.std(ddof=1) / np.sqrt(6)))
    s = T.pair_z_summary(T.team_pair_z(team, res, "session", "actor", "e", 3, 5)).first()
    assert (s.n_pairs, s.n_significant, round(s.n_expected, 2)) == (3, 3, 0.15)


def data(spark, n=300, seed=0):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 4)) * [1, 5, 0.1, 2] + [3, -1, 0, 100]
    y = x @ [1.0, -0.5, 4.0, 0.2] + 7 + g.normal(size=n)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in [*names, "y"]))
    return df, names, x, y


def test_ols_and_ridge_match_numpy(spark):
    df, names, x, y = data(spark)
    fit = M.fit_ols(df, names, "y")
    beta = np.linalg.lstsq(np.c_[np.ones(len(y)), x], y, rcond=None)[0]
    assert np.allclose([fit.intercept, *fit.coef.values()], beta)
    z = (x - x.mean(0)) / x.std(0)
    for alpha, model in M.fit_ridge(df, names, "y").items():
        b = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (y - y.mean()))
        pred = [r[0] for r in df.select(model.column()).collect()]
        assert np.allclose(sorted(pred), sorted(y.mean() + z @ b))


def test_collinear_and_constant_features(spark):
    df, _, x, y = data(spark)
    df = df.withColumn("a3", 3 * F.col("a")).withColumn("k", F.lit(2.0))
    fit = M.fit_ols(df, ["a", "a3", "k"], "y")
    b, a = np.polyfit(x[:, 0], y, 1)
    got = [r[0] for r in df.select(fit.column()).collect()]
    assert np.allclose(sorted(got), sorted(a + b * x[:, 0]))
    assert M.fit_ridge(df, ["a", "k"], "y", [1.0])[1.0].coef["k"] == 0.0


def test_regression_metrics_and_best_model(spark):
    rows = [(1.0, 1.5, 2.0), (2.0, 2.5, 2.0), (3.0, 2.5, 2.0), (4.0, None, 2.0)]
    df = spark.createDataFrame(rows, "y double, p double, mean double")
    got = {r.model: r for r in M.regression_metrics(df, "y", ["p", "mean"]).collect()}
    assert got["p"].n_test == 3 and got["p"].rmse == 0.5 and got["p"].mae == 0.5 and got["p"].r2 == pytest.approx(1 - 0.75 / 2)
    assert got["mean"].corr is None
    best = M.best_model(M.regression_metrics(df, "y", ["p", "mean"]), F.col("model") == "p").first()
    assert best.model == "mean"
    flat = M.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "y double, p double"), "y", ["p"]).first()
    assert flat.r2 == 0.0


def test_group_mean_and_imputing_use_training_rows(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "s string, y double")
    out = {r.s: r.p for r in M.group_mean_predictor(spark.createDataFrame([("a",), ("z",)], "s string"), train, "s", "y", "p").collect()}
    assert out == {"a": 2.0, "z": 4.0}
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (9.0, 7.0), (None, 1.0)], "u double, v double")
    med = T.median_defaults(df.limit(3), [], ["u", "v"])
    assert tuple(med.first()) == (2.0, 6.0)
    assert sorted(tuple(r) for r in M.impute(df, med, ["u", "v"]).collect()) == [(1.0, 6.0), (2.0, 1.0), (2.0, 5.0), (9.0, 7.0)]


def test_holdout_falls_back_to_all_other_seasons(spark):
    df = spark.createDataFrame([(2010,), (2011,), (2012,), (2015,)], "season int")
    folds = lambda test: {r.season: r.fold for r in M.with_holdout(df, "season", (2010, 2011), test).collect()}
    assert folds((2012, 2013)) == {2010: "train", 2011: "train", 2012: "test", 2015: None}
    assert folds((2020, 2021)) == folds(None) == {2010: "train", 2011: "train", 2012: "test", 2015: "test"}
