"""Class weights, and logistic regression against a direct Newton solve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attribix.operators import classifiers as C


def test_logistic_matches_newton(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(80, 2))
    y = (x[:, 0] + 0.5 * g.normal(size=80) > 0.6).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))], "i int, e array<float>, t int")
    data = C.vectors(df, "e")
    weights = {r.t: r.weight for r in C.balanced_weights(df, "t").select("t", "weight").distinct().collect()}
    assert weights == {k: pytest.approx(80 / (2 * (y == k).sum())) for k in (0, 1)}
    got = np.array([r.score for r in C.logistic(data, data, "t").orderBy("i").collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    a, w, b = np.c_[np.ones(80), z], np.where(y == 1, weights[1], weights[0]), np.zeros(3)
    ridge = np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        b = b - np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + ridge, a.T @ (w * (p - y)) + ridge @ b)
    assert np.allclose(got, 1 / (1 + np.exp(-a @ b)), atol=1e-3)


def test_every_row_gets_an_out_of_fold_score(spark):
    rows = [(i, [float(i % 7), float(i % 3)], int(i % 7 > 3), i % 3) for i in range(60)]
    data = C.vectors(spark.createDataFrame(rows, "i int, e array<float>, t int, fold int"), "e")
    got = C.boosted_out_of_fold(data, "t", "fold", 3, rounds=3)
    assert got.count() == 60 and got.select("i").distinct().count() == 60
    right = got.filter((F.col("score") >= 0.5).cast("int") == F.col("t")).count()
    assert right == 60


def test_rows_of_one_file_are_fitted_by_all_cores(spark):
    """Rows that lie in one partition, half of them copies of one vector, are dealt evenly; few rows take few tasks."""
    rows = spark.range(20_000).select(F.col("id"), F.array(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") * 0.5)).alias("e")).coalesce(1)
    got = C.dealt(C.vectors(rows, "e"))
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).select("count(1)").collect()]
    cores = spark.sparkContext.defaultParallelism
    assert len(sizes) == cores and sum(sizes) == 20_000 and max(sizes) < 1.2 * 20_000 / cores
    assert got.agg(F.sum("id")).first()[0] == 20_000 * 19_999 // 2
    assert C.dealt(rows.limit(10)).rdd.getNumPartitions() == 1
