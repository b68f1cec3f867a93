"""Logistic regression, stacking and split gains as queries, with the SQL that takes the same Newton steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from attribix.operators import classifiers as C
from attribix.operators import labels as L
from attribix.operators import logistic as G
from attribix.operators import trajectory as T
from attribix.plans import keypoints, roles
from attribix.plans.registry import query
from attribix.plans.shape import r, rounded
from attribix.session import checkpointed

SEED, FOLDS = 42, 5
#: Newton steps of the SQL; both sides have settled long before.
SQL_STEPS = 12
SCORES = ("rules", "trees", "linear")


def solved(n: int, inner: str, carry: Sequence[str]) -> str:
    """SELECT of x0..x{n-1} with a x = r, for a symmetric positive a given by its upper half a{i}_{j}, by elimination."""
    kept = ", ".join(carry)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    for p in range(n - 1):
        a = [f"a{i}_{j}" if i <= p else f"a{i}_{j} - a{p}_{i} / a{p}_{p} * a{p}_{j} AS a{i}_{j}" for i, j in upper]
        right = [f"r{i}" if i <= p else f"r{i} - a{p}_{i} / a{p}_{p} * r{p} AS r{i}" for i in range(n)]
        inner = f"SELECT {kept}, {', '.join(a + right)} FROM ({inner})"
    for i in range(n - 1, -1, -1):
        later = "".join(f" - a{i}_{j} * x{j}" for j in range(i + 1, n))
        inner = f"SELECT *, (r{i}{later}) / a{i}_{i} AS x{i} FROM ({inner})"
    return inner


def irls_sql(source: str, features: Sequence[str], penalty: float = 1.0, steps: int = SQL_STEPS) -> str:
    """CTEs ``scale_``, ``z_`` and ``irls`` (step, b0, b1, ...) that fit ``source`` (y and the features). To be put behind WITH RECURSIVE."""
    k = len(features)
    b = [f"b{i}" for i in range(k + 1)]
    ones = ["1.0", *[f"z{i}" for i in range(1, k + 1)]]
    eta = " + ".join(["b0", *[f"b{i} * z{i}" for i in range(1, k + 1)]])
    ridge = lambda i: penalty if i else 0.0
    gram = [f"sum(w * {ones[i]} * {ones[j]}) + {ridge(i) if i == j else 0.0} AS a{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)]
    right = [f"sum(c * (y - p) * {ones[i]}) - {ridge(i)} * b{i} AS r{i}" for i in range(k + 1)]
    sums = f"""SELECT step, {', '.join(b)}, {', '.join(gram + right)} FROM (
        SELECT *, c * p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM irls, z_ WHERE step < {steps})) GROUP BY step, {', '.join(b)}"""
    scale = ", ".join(f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s{i}" for i, c in enumerate(features, 1))
    zs = ", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(features, 1))
    return f"""scale_ AS (SELECT {scale}, count(*) AS n, sum(y) AS pos FROM {source}),
      z_ AS (SELECT CAST(y AS DOUBLE) AS y, CASE WHEN y = 1 THEN n / (2.0 * pos) ELSE n / (2.0 * (n - pos)) END AS c, {zs} FROM {source}, scale_),
      irls AS (SELECT 0 AS step, {', '.join(f'CAST(0 AS DOUBLE) AS {x}' for x in b)} UNION ALL
        SELECT step + 1, {', '.join(f'b{i} + x{i}' for i in range(k + 1))} FROM ({solved(k + 1, sums, ['step', *b])}))"""


EVENT_FEATURES = ("l_quantity", "l_discount", "l_tax")
EVENTS_SQL = f"e AS (SELECT CAST(l_linestatus = 'F' AS INTEGER) AS y, {', '.join(EVENT_FEATURES)} FROM lineitem WHERE l_returnflag IN ('A', 'R'))"


def events(spark, sf):
    return roles.table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).select(
        "l_orderkey", "l_linenumber", (F.col("l_linestatus") == "F").cast("int").alias("y"), *EVENT_FEATURES)


@query(
    "logreg_irls",
    f"""WITH RECURSIVE {EVENTS_SQL}, {irls_sql('e', EVENT_FEATURES)}
        SELECT t.term, {r('t.coef')} AS coef, {r('t.raw_coef')} AS raw_coef FROM irls, scale_, LATERAL (VALUES
          ('intercept', b0, b0 - {' - '.join(f'b{i} * m{i} / s{i}' for i in range(1, 4))}),
          {', '.join(f"('{c}', b{i}, b{i} / s{i})" for i, c in enumerate(EVENT_FEATURES, 1))}) t(term, coef, raw_coef) WHERE step = {SQL_STEPS}""",
)
def logreg_irls(spark, sf):
    """Coefficients with balanced class weights, on standardised features and on the features as they are."""
    model = G.fit_logistic(events(spark, sf), EVENT_FEATURES, "y")[None]
    rows = [(t, float(b), float(x)) for t, b, x in zip(("intercept", *EVENT_FEATURES), model.beta, model.raw(), strict=True)]
    return rounded(spark.createDataFrame(rows, "term string, coef double, raw_coef double"))


@query(
    "logreg_confusion",
    f"""WITH RECURSIVE {EVENTS_SQL}, {irls_sql('e', EVENT_FEATURES)},
        p AS (SELECT y, b0 + {' + '.join(f'b{i} * ({c} - m{i}) / s{i}' for i, c in enumerate(EVENT_FEATURES, 1))} > 0 AS yes FROM e, scale_, irls WHERE step = {SQL_STEPS})
        SELECT count(*) FILTER (WHERE yes AND y = 1) AS tp, count(*) FILTER (WHERE yes AND y = 0) AS fp,
          count(*) FILTER (WHERE NOT yes AND y = 1) AS fn, count(*) FILTER (WHERE NOT yes AND y = 0) AS tn FROM p""",
)
def logreg_confusion(spark, sf):
    """Every event scored by the fitted model, and the counts of right and wrong at one half."""
    rows = events(spark, sf)
    out = G.scored(rows, G.fit_logistic(rows, EVENT_FEATURES, "y"), "score")
    yes, y = F.col("score") > 0.5, F.col("y") == 1
    return out.agg(
        F.count_if(yes & y).alias("tp"), F.count_if(yes & ~y).alias("fp"), F.count_if(~yes & y).alias("fn"), F.count_if(~yes & ~y).alias("tn"))


def folded_matrix(spark, sf):
    """The feature matrix of all clips with a label, and a fold for each."""
    matrix = checkpointed(keypoints.matrix(spark, sf).drop("fold").filter("label >= 0"))
    fold = L.stratified_kfold(matrix.select("clip", "label"), "clip", "label", FOLDS, SEED).select("clip", "fold")
    return checkpointed(matrix.join(fold, "clip"))


def tree_inputs(matrix):
    return C.assemble(matrix, T.LEARNED)


@query("gbt_oof")
def gbt_oof(spark, sf):
    out = C.boosted_out_of_fold(tree_inputs(folded_matrix(spark, sf)), "label", "fold", FOLDS, seed=SEED)
    return rounded(out.select("clip", "label", "fold", "score"))


@query("gbt_importances")
def gbt_importances(spark, sf):
    """What each feature gains in the trees of each fold."""
    models = C.boosted_models(tree_inputs(folded_matrix(spark, sf)), "label", "fold", range(FOLDS), seed=SEED)
    return rounded(C.gain_importances(checkpointed(C.tree_splits(spark, models, T.LEARNED)), T.LEARNED))


def first_level(matrix, rounds=C.GBT_ROUNDS):
    """Out-of-fold scores of rules, trees and linear model for every clip."""
    folds = range(FOLDS)
    inputs = tree_inputs(matrix)
    trees = C.boosted_scores(inputs, C.boosted_models(inputs, "label", "fold", folds, rounds, SEED), "fold").select("clip", F.col("score").alias("trees"))
    ruled = G.rules_out_of_fold(
        matrix, "label", "fold", folds, "defender_ankle_in_zone_frac", "overlap_duration_frames", "min_ankle_distance", "contact_height", "rules")
    both = G.out_of_fold(ruled, T.LEARNED, "label", "fold", folds, "linear")
    return checkpointed(both.select("clip", "label", "fold", "rules", "linear").join(trees, "clip"))


@query("stacked_vote")
def stacked_vote(spark, sf):
    """The upper model's score next to the three it is fitted on."""
    scores = first_level(folded_matrix(spark, sf))
    return rounded(G.stacked(scores, SCORES, "label", "fold", range(FOLDS)).select("clip", "fold", "label", *SCORES, "stacked"))
