"""Logistic regression by Newton steps, stacking, and the gains of tree splits."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attribix.operators import classifiers as C
from attribix.operators import logistic as G
from attribix.plans.logistic import irls_sql

NAMES = ["a", "b", "c"]


def data(seed=0, n=300):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(5, 3, n), rng.exponential(2, n), np.full(n, 7.0)]
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.6 * x[:, 0] - x[:, 1] - 1.5)))).astype(int)
    return x, y


def newton(x, y, penalty=1.0, balanced=True):
    """Probabilities by plain Newton steps on all rows."""
    std = x.std(0)
    z = (x - x.mean(0)) / np.where(std > 0, std, 1)
    a = np.c_[np.ones(len(z)), z]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    b, ridge = np.zeros(a.shape[1]), penalty * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + ridge, a.T @ (w * (p - y)) + ridge @ b)
    return b


def frame(spark, x, y, fold=None):
    fold = np.zeros(len(y), int) if fold is None else fold
    return spark.createDataFrame([(i, *map(float, r), int(t), int(f)) for i, (r, t, f) in enumerate(zip(x, y, fold))], "i int, a double, b double, c double, y int, fold int")


@pytest.mark.parametrize("penalty, balanced", [(1.0, True), (10.0, False)])
def test_matches_newton(spark, penalty, balanced):
    x, y = data()
    got = G.fit_logistic(frame(spark, x, y), NAMES, "y", penalty=penalty, balanced=balanced)[None]
    assert got.beta == pytest.approx(newton(x, y, penalty, balanced), abs=1e-8)
    raw = got.raw()
    assert raw[0] + x @ raw[1:] == pytest.approx(got.beta[0] + ((x - got.mean) / got.std) @ got.beta[1:])


def test_groups_are_fitted_apart(spark):
    x, y = data(1)
    fold = np.arange(len(y)) % 3
    got = G.fit_logistic(frame(spark, x, y, fold), NAMES, "y", by="fold")
    assert sorted(got) == [0, 1, 2]
    for f in range(3):
        assert got[f].beta == pytest.approx(newton(x[fold == f], y[fold == f]), abs=1e-8)


def test_scores_are_out_of_fold(spark):
    x, y = data(2, 120)
    fold = np.arange(len(y)) % 4
    got = {r.i: r.p for r in G.out_of_fold(frame(spark, x, y, fold), NAMES, "y", "fold", range(4), "p").collect()}
    for f in range(4):
        rest = fold != f
        b, m, s = newton(x[rest], y[rest]), x[rest].mean(0), np.where(x[rest].std(0) > 0, x[rest].std(0), 1)
        want = 1 / (1 + np.exp(-(b[0] + ((x[fold == f] - m) / s) @ b[1:])))
        assert [got[i] for i in np.nonzero(fold == f)[0]] == pytest.approx(want, abs=1e-8)


def test_odd_inputs(spark):
    """Separable rows have finite coefficients; one class gives a certain answer; missing values take no part."""
    rows = [(float(i), int(i > 4)) for i in range(10)]
    model = G.fit_logistic(spark.createDataFrame(rows, "a double, y int"), ["a"], "y")[None]
    assert np.isfinite(model.beta).all() and model.beta[1] > 1
    one = G.fit_logistic(spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, y int"), ["a"], "y")[None]
    assert one.beta.tolist() == [G.CERTAIN, 0.0]
    holes = spark.createDataFrame([*rows, (None, 1), (3.0, None)], "a double, y int")
    assert G.fit_logistic(holes, ["a"], "y")[None].beta == pytest.approx(model.beta)
    shown = G.scored(holes, {None: model}, "p")
    assert shown.filter("p IS NULL").count() == 1
    empty = spark.createDataFrame([], "a double, y int")
    assert G.fit_logistic(empty, ["a"], "y") == {} and G.scored(empty, {}, "p").count() == 0


def test_sql_takes_the_same_steps(spark):
    """The upper model of a stack, followed in SQL from the stored scores of the lower ones."""
    x, y = data(3, 200)
    rng = np.random.default_rng(4)
    scores = np.c_[(rng.random(200) < 0.3 + 0.4 * y).astype(float), np.clip(0.5 * y + rng.normal(0.2, 0.3, 200), 0, 1), 1 / (1 + np.exp(-x[:, 0] + 4))]
    fold = np.arange(200) % 5
    df = frame(spark, scores, y, fold)
    got = {r.i: r.stacked for r in G.stacked(df, NAMES, "y", "fold", range(5)).collect()}
    con = duckdb.connect()
    con.register("rows", df.toPandas())
    for f in range(5):
        want = con.execute(f"""WITH RECURSIVE t AS (SELECT * FROM rows WHERE fold <> {f}), {irls_sql('t', NAMES)}
            SELECT i, 1 / (1 + exp(-(b0 + b1 * (a - m1) / s1 + b2 * (b - m2) / s2 + b3 * (c - m3) / s3))) FROM rows, scale_, irls
            WHERE fold = {f} AND step = (SELECT max(step) FROM irls)""").fetchall()
        assert len(want) == 40
        for i, p in want:
            assert got[i] == pytest.approx(p, abs=1e-7)


def test_rules_see_other_folds_only(spark):
    """In fold 0 a high zone goes with the label, elsewhere a long overlap does; each votes by what the others teach."""
    rows = [(i, 0, i % 2, 0.6 * (i % 2), 0, 9.0, 9.0) for i in range(20)] + [(i, 1, i % 2, 0.0, 5 * (i % 2), 9.0, 9.0) for i in range(20, 40)]
    df = spark.createDataFrame(rows, "i int, fold int, y int, z double, o int, d double, h double")
    got = {r.i: r.v for r in G.rules_out_of_fold(df, "y", "fold", range(2), "z", "o", "d", "h", "v").collect()}
    assert all(v in (0.0, 1.0) for v in got.values())
    # The point chosen on fold 1 takes the lowest zone of equal ones, so it also votes for fold 0's positives.
    assert [got[i] for i in range(20, 40)] == [float(i % 2) for i in range(20, 40)]


def test_no_condition_holds_all_features(spark, monkeypatch):
    """The optimizer copies a condition once for every choice of the renamed columns in it: 2 ** 21 times at 19 features."""
    names, plans, real = [f"f{i}" for i in range(19)], [], G.checkpointed
    monkeypatch.setattr(G, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or real(df))
    columns = [F.when(F.lit(i == 3) & (F.col("id") == 7), float("nan")).otherwise(F.rand(i) + F.col("id") % (i + 2)).alias(n) for i, n in enumerate(names)]
    rows = real(spark.range(60).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 3).alias("fold"), *columns))
    got = G.out_of_fold(rows, names, "y", "fold", range(3), "p", steps=1)
    assert got.count() == 60 and got.filter("p IS NULL OR isnan(p)").count() == 1
    assert "atleastnnonnulls" not in plans[0].lower()


def walked(node, tree, names):
    if node.numDescendants() == 0:
        return []
    split = node.split()
    here = [(tree, names[split.featureIndex()], node.gain(), node.gain() * node.impurityStats().count())]
    return here + walked(node.leftChild(), tree, names) + walked(node.rightChild(), tree, names)


def test_gains_agree_with_a_walk_of_the_trees(spark):
    x, y = data(5, 240)
    x[:, 2] = np.random.default_rng(6).normal(size=240)
    df = C.assemble(frame(spark, x, y, np.arange(240) % 2), NAMES)
    models = C.boosted_models(df, "y", "fold", range(2), rounds=5)
    splits = C.tree_splits(spark, models, NAMES)
    shares = C.gain_importances(splits, NAMES).collect()
    assert len(shares) == 6
    for fold, model in models.items():
        trees = model._java_obj.trees()
        want = [row for t in range(len(trees)) for row in walked(trees[t].rootNode(), t, NAMES)]
        got = [(r.tree, r.feature, r.gain, r.weighted_gain) for r in splits.filter(F.col("fold") == fold).collect()]
        assert sorted(got) == [(w[0], w[1], pytest.approx(w[2]), pytest.approx(w[3])) for w in sorted(want)]
        whole = sum(w[3] for w in want)
        for r in (r for r in shares if r.fold == fold):
            mine = [w for w in want if w[1] == r.feature]
            assert r.n_splits == len(mine) and r.share == pytest.approx(sum(w[3] for w in mine) / whole)
        assert sum(r.share for r in shares if r.fold == fold) == pytest.approx(1)


def test_a_planted_feature_comes_first(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    df = C.assemble(frame(spark, x, (x[:, 1] > 0.2).astype(int), np.arange(200) % 2), NAMES)
    splits = C.tree_splits(spark, C.boosted_models(df, "y", "fold", range(2), rounds=3), NAMES)
    best = {r.fold: r for r in C.gain_importances(splits, NAMES).collect() if r.feature == "b"}
    assert all(best[f].share > 0.9 for f in range(2))
