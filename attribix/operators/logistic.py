"""Logistic regression by iteratively reweighted least squares, and stacking on out-of-fold scores.

Every step is one aggregation over the standardised rows; only the k x k weighted Gram matrix and k sums of a group
reach the driver. Several groups, such as the training parts of a cross-validation, are fitted in the same passes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attribix.functions.numeric import add, col, complete
from attribix.operators.evaluate import RULE_GRID, best_grid_point, rule_grid
from attribix.operators.keyed import value_map
from attribix.session import checkpointed

#: Steps at most, and the largest change of a coefficient at which the fit stands.
STEPS, SETTLED = 30, 1e-10
#: Intercept where all rows have one class: the loss has no minimum there.
CERTAIN = 30.0


@dataclass(frozen=True)
class LogisticModel:
    """Intercept and coefficients on standardised features, with the mean and spread of each feature."""

    features: tuple[str, ...]
    mean: np.ndarray
    std: np.ndarray
    beta: np.ndarray

    def raw(self) -> np.ndarray:
        """Intercept and coefficients on the features as they are."""
        slope = self.beta[1:] / self.std
        return np.concatenate([[self.beta[0] - float(self.mean @ slope)], slope])


def _by_group(models: Mapping[object, Sequence[float]], group: Column) -> Column:
    """The group's array of numbers, as a literal map; groups are few by design."""
    entries = chain.from_iterable((F.lit(g), F.array(*[F.lit(float(v)) for v in values])) for g, values in models.items())
    return F.create_map(*entries)[group]


def _probability(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def fit_logistic(
    df: DataFrame, features: Sequence[str], label: str, by: str | None = None, penalty: float = 1.0, balanced: bool = True,
    steps: int = STEPS,
) -> dict[object, LogisticModel]:
    """One model for each value of ``by`` (under None without it), over rows in which nothing is missing.

    The loss is the weighted sum of log losses plus half of ``penalty`` times the squared coefficients on standardised
    features (population spread; 0 counts as 1); the intercept is free. Balanced weights are n / (2 * class size). Newton
    steps are halved where the loss would rise.
    """
    k, zs = len(features), [f"__z{i}" for i in range(len(features))]
    group = F.col(by) if by else F.lit(0)
    rows = df.select(group.alias("__g"), F.col(label).cast("double").alias("__y"), *[col(c).cast("double").alias(z) for c, z in zip(features, zs)])
    rows = checkpointed(complete(rows.filter("__g IS NOT NULL"), ["__y", *zs]))
    stats = rows.groupBy("__g").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__y").alias("pos"), F.array(*[F.avg(z) for z in zs]).alias("mean"),
        F.array(*[F.stddev_pop(z) for z in zs]).alias("std")).collect()
    found = {r["__g"]: r for r in stats}
    mean = {g: np.array(r.mean, float) for g, r in found.items()}
    std = {g: np.where(np.array(r.std, float) > 0, np.array(r.std, float), 1.0) for g, r in found.items()}
    share = {g: (r.n / (2 * (r.n - r.pos)), r.n / (2 * r.pos)) if balanced and 0 < r.pos < r.n else (1.0, 1.0) for g, r in found.items()}
    beta = {g: np.zeros(k + 1) for g in found}
    open_groups = {g for g, r in found.items() if 0 < r.pos < r.n}
    for g in set(found) - open_groups:
        beta[g][0] = CERTAIN if found[g].pos else -CERTAIN
    if open_groups:
        fixed = {g: [*mean[g], *std[g], *share[g]] for g in open_groups}
        staged = rows.filter(F.col("__g").isin(list(open_groups))).withColumn("__f", _by_group(fixed, F.col("__g")))
        rows = checkpointed(staged.select(
            "__g", "__y", F.when(F.col("__y") > 0, F.col("__f")[2 * k + 1]).otherwise(F.col("__f")[2 * k]).alias("__c"),
            *[((F.col(z) - F.col("__f")[i]) / F.col("__f")[k + i]).alias(z) for i, z in enumerate(zs)]))
    ridge = penalty * np.diag([0.0, *[1.0] * k])
    last: dict[object, tuple[float, np.ndarray]] = {}
    for _ in range(steps):
        if not open_groups:
            break
        sums = _newton_sums(rows.filter(F.col("__g").isin(list(open_groups))), {g: beta[g] for g in open_groups}, zs)
        for g, (loss, gradient, gram) in sums.items():
            loss += penalty / 2 * float(beta[g][1:] @ beta[g][1:])
            if g in last and loss > last[g][0] * (1 + 1e-12) + 1e-12:
                beta[g] = (beta[g] + last[g][1]) / 2
                continue
            step = np.linalg.lstsq(gram + ridge, gradient - ridge @ beta[g], rcond=None)[0]
            last[g] = (loss, beta[g])
            beta[g] = beta[g] + step
            if np.abs(step).max() < SETTLED:
                open_groups.discard(g)
    models = {g: LogisticModel(tuple(features), mean[g], std[g], beta[g]) for g in found}
    return models if by else {None: m for m in models.values()}


def _newton_sums(rows: DataFrame, beta: Mapping[object, np.ndarray], zs: Sequence[str]) -> dict[object, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Gram matrix of each group at its coefficients, from one aggregation."""
    k = len(zs)
    at = rows.withColumn("__b", _by_group({g: b.tolist() for g, b in beta.items()}, F.col("__g")))
    at = at.withColumn("__e", add([F.col("__b")[0], *[F.col("__b")[i + 1] * F.col(z) for i, z in enumerate(zs)]]))
    at = at.withColumn("__p", _probability(F.col("__e")))
    off, w = F.col("__c") * (F.col("__y") - F.col("__p")), F.col("__c") * F.col("__p") * (1 - F.col("__p"))
    signed = F.when(F.col("__y") > 0, F.col("__e")).otherwise(-F.col("__e"))
    loss = F.col("__c") * (F.log1p(F.exp(-F.abs(signed))) + F.greatest(-signed, F.lit(0.0)))
    ones = [F.lit(1.0), *[F.col(z) for z in zs]]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = at.groupBy("__g").agg(
        F.sum(loss), F.array(*[F.sum(off * x) for x in ones]), F.array(*[F.sum(w * ones[i] * ones[j]) for i, j in pairs])).collect()
    out = {}
    for g, total, gradient, upper in sums:
        gram = np.zeros((k + 1, k + 1))
        for (i, j), v in zip(pairs, upper, strict=True):
            gram[i, j] = gram[j, i] = v
        out[g] = total, np.array(gradient, float), gram
    return out


def scored(df: DataFrame, models: Mapping[object, LogisticModel], out: str, by: str | None = None) -> DataFrame:
    """``df`` with each row's probability by the model of its group; null where a feature or the model is missing."""
    if not models:
        return df.withColumn(out, F.lit(None).cast("double"))
    features = next(iter(models.values())).features
    raw = {(0 if by is None else g): m.raw().tolist() for g, m in models.items()}
    named = df.withColumn("__b", _by_group(raw, F.col(by) if by else F.lit(0)))
    eta = add([F.col("__b")[0], *[F.col("__b")[i + 1] * col(c).cast("double") for i, c in enumerate(features)]])
    return named.withColumn(out, _probability(eta)).drop("__b")


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: Sequence[int], out: str, **how) -> DataFrame:
    """``df`` with the probability of each row by the model of all other folds. The folds are fitted in the same passes."""
    parts = F.explode(F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col(fold)))
    train = df.select(parts.alias("__for"), F.col(label).alias("__label"), *features)
    return scored(df, fit_logistic(train, features, "__label", by="__for", **how), out, by=fold)


def rules_out_of_fold(
    df: DataFrame, label: str, fold: str, folds: Sequence[int], zone: str, overlap: str, min_dist: str, contact_h: str, out: str,
    grid: Mapping[str, Sequence[float]] = RULE_GRID,
) -> DataFrame:
    """``df`` with the vote (0 or 1) of the rule whose thresholds are the best grid point on all other folds."""
    truth, best = F.col(label) == 1, None
    for f in folds:
        point = best_grid_point(rule_grid(df.filter(F.col(fold) != f), truth, zone, overlap, min_dist, contact_h, grid)).withColumn("__for", F.lit(f))
        best = point if best is None else best.unionByName(point)
    names = ["zone", "overlap", "min_dist", "contact_h"]
    p = F.col("__p")[F.col(fold)]
    near = (F.col(min_dist) < p["min_dist"]) & (F.col(contact_h) < p["contact_h"])
    hit = (F.col(zone) > p["zone"]) | (F.col(overlap) >= p["overlap"]) | near
    return df.withColumn("__p", value_map(checkpointed(best), "__for", *names)).withColumn(out, F.coalesce(hit, F.lit(False)).cast("double")).drop("__p")


def stacked(df: DataFrame, scores: Sequence[str], label: str, fold: str, folds: Sequence[int], out: str = "stacked") -> DataFrame:
    """``df`` with the score of the upper model. It is fitted on out-of-fold scores, and on those of other folds only."""
    return out_of_fold(df, scores, label, fold, folds, out)
