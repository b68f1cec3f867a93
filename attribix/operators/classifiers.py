"""Classifiers on vector columns, with balanced class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attribix.functions.numeric import ratio
from attribix.operators.keyed import value_map
from attribix.session import checkpoint_root, checkpointed, shared_folder

# Hyperparameters of the published classifiers.
LOGISTIC_ROUNDS = 1000
MLP_HIDDEN = (256, 64)
MLP_ROUNDS = 500
MLP_HELD_OUT = 0.15
MLP_PATIENCE = 10
GBT = {"maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 5}
GBT_ROUNDS = 200

#: Rounds of the perceptron between two looks at the held-out rows.
MLP_STEP = 10

#: Rows of a task of a fit: fewer do not pay for a task, and more are dealt over more tasks than there are cores.
LEAST_ROWS, MOST_ROWS = 1_000, 100_000


def vectors(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array)))


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (classes * class size), from a map of the classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.struct(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weights = counts.withColumn("__t", total).select(label, (F.col("__t.n") / (F.col("__t.k") * F.col("__c"))).alias(out))
    return df.withColumn("__w", value_map(weights, label, out)).withColumn(out, F.col("__w")[F.col(label)][out]).drop("__w")


def dealt(df: DataFrame) -> DataFrame:
    """Written rows dealt evenly over all cores. A fit reads them once a round, and a file may give all of them to one task."""
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = min(max(cores, ceil(n / MOST_ROWS)), max(ceil(n / LEAST_ROWS), 1))
    return df.repartition(parts, F.xxhash64(*df.columns))


def _positive(df: DataFrame) -> DataFrame:
    return df.withColumn("score", vector_to_array("probability")[1])


def scaled(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Standardise with the training mean and spread."""
    model = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(train)
    return [model.transform(d).drop("features").withColumnRenamed("scaled", "features") for d in (train, *others)]


def logistic(train: DataFrame, test: DataFrame, label: str, c: float = 1.0) -> DataFrame:
    """Logistic regression; the penalty ``1 / (c * sum of weights)`` matches a per-row loss sum with strength c."""
    fit_on, apply_to = scaled(checkpointed(dealt(checkpointed(balanced_weights(train, label)))), test)
    total = fit_on.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(
        labelCol=label, weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=LOGISTIC_ROUNDS
    )
    return _positive(lr.fit(fit_on).transform(apply_to))


def perceptron(
    train: DataFrame, test: DataFrame, label: str, width: int, hidden: Sequence[int] = MLP_HIDDEN, rounds: int = MLP_ROUNDS, seed: int = 42,
    held_out: float = MLP_HELD_OUT, patience: int = MLP_PATIENCE,
) -> DataFrame:
    """Multilayer perceptron with early stopping: training goes on in steps from the weights so far until the accuracy on
    ``held_out`` of the training rows has not risen for ``patience`` steps, and the best weights count."""
    fit_on, apply_to = scaled(dealt(checkpointed(train)), test)
    side = F.pmod(F.xxhash64("features", F.lit(seed)), F.lit(1000)) < int(1000 * held_out)
    fit_on = checkpointed(fit_on.withColumn("__held", side))
    learn, watch = fit_on.filter("not __held"), fit_on.filter("__held")
    right = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    best, best_model, weights, waited = -1.0, None, None, 0
    for _ in range(0, rounds, MLP_STEP):
        mlp = MultilayerPerceptronClassifier(labelCol=label, layers=[width, *hidden, 2], maxIter=MLP_STEP, seed=seed)
        if weights is not None:
            mlp.setInitialWeights(weights)
        model = mlp.fit(learn)
        weights = model.weights
        score = model.transform(watch).agg(right).first()[0] or 0.0
        waited = 0 if score > best else waited + 1
        if score > best:
            best, best_model = score, model
        if waited >= patience:
            break
    return _positive(best_model.transform(apply_to)).drop("__held")


def boosted_models(df: DataFrame, label: str, fold: str, folds: Sequence[int], rounds: int = GBT_ROUNDS, seed: int = 42) -> dict[int, GBTClassificationModel]:
    """Trees of each fold, fitted on the rows of all others with class weights of those rows.

    The folds are fitted side by side, as each keeps only a part of the cluster busy.
    """
    checkpoint_root(df.sparkSession)
    rows = checkpointed(df)
    gbt = GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, seed=seed, checkpointInterval=10, **GBT)

    def one(i: int) -> GBTClassificationModel:
        return gbt.fit(checkpointed(balanced_weights(rows.filter(F.col(fold) != i), label)))

    with ThreadPool(len(folds)) as pool:
        return dict(zip(folds, pool.map(inheritable_thread_target(df.sparkSession)(one), folds)))


def boosted_scores(df: DataFrame, models: Mapping[int, GBTClassificationModel], fold: str) -> DataFrame:
    """Score of every row from the trees that did not see its fold."""
    out = None
    for i, model in models.items():
        part = _positive(model.transform(df.filter(F.col(fold) == i)))
        out = part if out is None else out.unionByName(part)
    return out


def boosted_out_of_fold(df: DataFrame, label: str, fold: str, k: int, rounds: int = GBT_ROUNDS, seed: int = 42) -> DataFrame:
    rows = checkpointed(df)
    return boosted_scores(rows, boosted_models(rows, label, fold, range(k), rounds, seed), fold)


def tree_splits(spark: SparkSession, models: Mapping[int, GBTClassificationModel], names: Sequence[str]) -> DataFrame:
    """Every split of every tree as a row: fold, tree, node, feature, threshold, gain, and gain times the weight of its rows.

    A fitted model is written to the shared folder and its node table read back, so any number of nodes can be aggregated.
    """
    name = F.array(*[F.lit(n) for n in names])
    out = None
    for fold, model in models.items():
        path = shared_folder(spark, "trees")
        model.write().save(path)
        nodes = spark.read.parquet(f"{path}/data")
        node = F.col("nodeData")
        part = nodes.filter(node["leftChild"] >= 0).select(
            F.lit(fold).alias("fold"), F.col("treeID").alias("tree"), node["id"].alias("node"),
            name[node["split"]["featureIndex"]].alias("feature"), node["split"]["leftCategoriesOrThreshold"][0].alias("threshold"),
            node["gain"].alias("gain"), (node["gain"] * node["impurityStats"][0]).alias("weighted_gain"))
        out = part if out is None else out.unionByName(part)
    return out


def gain_importances(splits: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per fold and feature: splits, mean gain of a split, and the share of the fold's weighted gain; unused features have 0."""
    found = splits.groupBy("fold", "feature").agg(
        F.count(F.lit(1)).alias("n_splits"), F.avg("gain").alias("mean_gain"), F.sum("weighted_gain").alias("total_gain"))
    every = found.select("fold").distinct().select("fold", F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"))
    whole = found.groupBy("fold").agg(F.sum("total_gain").alias("__all"))
    return (
        every.join(found, ["fold", "feature"], "left").join(whole, "fold")
        .select("fold", "feature", F.coalesce("n_splits", F.lit(0)).alias("n_splits"), F.coalesce("mean_gain", F.lit(0.0)).alias("mean_gain"),
                F.coalesce(ratio("total_gain", "__all"), F.lit(0.0)).alias("share")))
