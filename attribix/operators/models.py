"""Linear models from one aggregation, with a k x k solve on the driver.

Only the means and the covariance of k features reach the driver; rows never
do. The fitted coefficients go back into the plan as literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attribix.functions.numeric import add, col, complete, pearson, ratio
from attribix.operators.keyed import spread_join

# Penalties tried for ridge.
RIDGE_ALPHAS = (1.0, 10.0, 100.0)


@dataclass(frozen=True)
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def of(self, features: Sequence[str], some: Sequence[str]) -> "Moments":
        """Those of some of the features and the target."""
        at = [*(list(features).index(c) for c in some), len(self.mean) - 1]
        return Moments(self.n, self.mean[at], self.cov[np.ix_(at, at)])


@dataclass(frozen=True)
class LinearModel:
    intercept: float
    coef: Mapping[str, float]

    def column(self) -> Column:
        return add([F.lit(self.intercept), *[F.lit(float(b)) * F.col(c) for c, b in self.coef.items()]])


def moments(df: DataFrame, features: Sequence[str], target: str) -> Moments:
    """Means and population covariance of features and target, over rows where all are present."""
    names = [*features, target]
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = complete(df.select(*[col(c).cast("double").alias(c) for c in names]), names)
    row = rows.agg(
        F.count(F.lit(1)),
        *[F.avg(c) for c in names],
        *[F.covar_pop(names[i], names[j]) for i, j in pairs],
    ).first()
    if not row[0]:
        raise ValueError("no complete rows to fit on")
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1 + k :]):
        cov[i, j] = cov[j, i] = v
    return Moments(row[0], np.array(row[1 : 1 + k], dtype=float), cov)


def solve_ols(m: Moments, features: Sequence[str]) -> LinearModel:
    """Minimum-norm least squares with intercept; collinear features are allowed."""
    beta = np.linalg.pinv(m.cov[:-1, :-1], rcond=1e-12, hermitian=True) @ m.cov[:-1, -1]
    return LinearModel(float(m.mean[-1] - m.mean[:-1] @ beta), dict(zip(features, beta.tolist())))


def solve_ridge(m: Moments, features: Sequence[str], alpha: float) -> LinearModel:
    """Closed-form ridge on z-scored features (population std, 0 counts as 1), free intercept."""
    std = np.sqrt(np.diag(m.cov)[:-1])
    std[std == 0] = 1.0
    gram = m.n * m.cov[:-1, :-1] / np.outer(std, std)
    rhs = m.n * m.cov[:-1, -1] / std
    beta = np.linalg.solve(gram + alpha * np.eye(len(features)), rhs) / std
    return LinearModel(float(m.mean[-1] - m.mean[:-1] @ beta), dict(zip(features, beta.tolist())))


def fit_ols(df: DataFrame, features: Sequence[str], target: str) -> LinearModel:
    return solve_ols(moments(df, features, target), features)


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float] = RIDGE_ALPHAS) -> dict[float, LinearModel]:
    """All penalties from one pass over the data."""
    m = moments(df, features, target)
    return {a: solve_ridge(m, features, a) for a in alphas}


def line_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def impute(df: DataFrame, medians: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fill nulls with the one-row training medians, read as a scalar subquery."""
    m = medians.select(F.struct(*features)).scalar()
    out = df.withColumn("__m", m)
    for f in features:
        out = out.withColumn(f, F.coalesce(F.col(f), F.col("__m")[f]))
    return out.drop("__m")


def group_mean_predictor(rows: DataFrame, train: DataFrame, key: str, target: str, out: str) -> DataFrame:
    """Training mean of the row's key, the overall training mean for an unseen key."""
    means = train.groupBy(key).agg(F.avg(target).alias("__mean"))
    overall = train.agg(F.avg(target)).scalar()
    return spread_join(rows, means, [key]).withColumn(out, F.coalesce(F.col("__mean"), overall)).drop("__mean")


def regression_metrics(scored: DataFrame, y: str, predictions: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, R2 and correlation of each prediction column, in one pass."""
    long = scored.select(
        *by,
        F.col(y).cast("double").alias("__y"),
        F.explode(F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).cast("double").alias("p")) for p in predictions])).alias("s"),
    ).select(*by, "s.model", "__y", F.col("s.p").alias("__p")).filter("__y IS NOT NULL AND __p IS NOT NULL")
    e = F.col("__y") - F.col("__p")
    return long.groupBy(*by, "model").agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.coalesce(1 - ratio(F.sum(e * e), F.var_pop("__y") * F.count("__y")), F.lit(0.0)).alias("r2"),
        pearson("__y", "__p").alias("corr"),
        F.count(F.lit(1)).alias("n_test"),
    )


def best_model(metrics: DataFrame, excluded: Column, model: str = "model", score: str = "rmse") -> DataFrame:
    """Model with the lowest score outside the excluded family; ties go to the first name."""
    return metrics.filter(~excluded).agg(
        F.min_by(model, F.struct(score, model)).alias(model), F.min(score).alias(score)
    )


def holdout(season: str, train: tuple[int, int], test: tuple[int, int]) -> Column:
    return F.when(F.col(season).between(*train), "train").when(F.col(season).between(*test), "test")


def with_holdout(df: DataFrame, season: str, train: tuple[int, int], test: tuple[int, int] | None) -> DataFrame:
    """Add ``fold``. Where no row lies in the test seasons, or none are given, all seasons outside the training ones are the test."""
    inside = F.col(season).between(*train)
    if test is None:
        return df.withColumn("fold", F.when(inside, "train").otherwise("test"))
    held = F.col(season).between(*test)
    some = df.agg(F.coalesce(F.bool_or(held), F.lit(False))).scalar()
    return df.withColumn("fold", F.when(inside, "train").when(held | ~some, "test"))
