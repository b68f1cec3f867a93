"""Classification metrics, threshold search and error reports, each in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attribix.functions.numeric import col, ratio

# Threshold lists and the rule grid.
SHORT_SWEEP = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
LONG_SWEEP = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)
RULE_GRID = {
    "zone": (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40),
    "overlap": (1, 2, 3, 4),
    "min_dist": (0.20, 0.30, 0.40, 0.50),
    "contact_h": (0.5, 0.7, 0.9, 1.1),
}
PRECISION_FLOOR, PRECISION_WEIGHT = 0.6, 0.1


def with_rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy from tp / fp / fn / tn; empty denominators give 0."""
    zero = F.lit(0.0)
    p = F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), zero)
    q = F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), zero)
    return (
        df.withColumn("precision", p)
        .withColumn("recall", q)
        .withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero))
        .withColumn("accuracy", F.coalesce(ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), zero))
    )


def confusion(df: DataFrame, truth: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates; rows with a null prediction are held out and counted apart."""
    t = F.coalesce(truth, F.lit(False))
    counts = df.filter(truth.isNotNull()).groupBy(*by).agg(
        F.count_if(predicted & t).alias("tp"),
        F.count_if(predicted & ~t).alias("fp"),
        F.count_if(~predicted & t).alias("fn"),
        F.count_if(~predicted & ~t).alias("tn"),
        F.count_if(predicted.isNull()).alias("n_undecided"),
    )
    return with_rates(counts)


def threshold_sweep(df: DataFrame, truth: Column, score: str, thresholds: Sequence[float] = SHORT_SWEEP) -> DataFrame:
    """Metrics at every threshold. The counts of all thresholds come from one aggregation."""
    s = F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = s >= F.lit(float(t))
        aggs += [
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.count_if(hit & truth).alias("tp"),
                F.count_if(hit & ~truth).alias("fp"),
                F.count_if(~hit & truth).alias("fn"),
                F.count_if(~hit & ~truth).alias("tn"),
            ).alias(f"t{i}")
        ]
    wide = df.filter(s.isNotNull() & truth.isNotNull()).agg(*aggs)
    return with_rates(wide.select(F.inline(F.array(*[f"t{i}" for i in range(len(thresholds))]))))


def _above(value: Column, cuts: Sequence[float], strict: bool) -> Column:
    """How many cuts the value passes; a null passes none."""
    out = F.lit(0)
    for c in cuts:
        passed = (value > c) if strict else (value >= c)
        out = out + F.coalesce(passed, F.lit(False)).cast("int")
    return out


def _below(value: Column, cuts: Sequence[float]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.coalesce(value < c, F.lit(False)).cast("int")
    return out


def rule_grid(
    df: DataFrame, truth: Column, zone: str, overlap: str, min_dist: str, contact_h: str,
    grid: Mapping[str, Sequence[float]] = RULE_GRID,
) -> DataFrame:
    """Every grid point's metrics and score.

    Rows first collapse to how many cuts each value passes, which is at most a
    few hundred cells whatever the row count; only cells meet the grid.
    """
    z, o, d, h = (grid[k] for k in ("zone", "overlap", "min_dist", "contact_h"))
    cells = df.filter(truth.isNotNull()).groupBy(
        _above(col(zone), z, True).alias("cz"), _above(col(overlap), o, False).alias("co"),
        _below(col(min_dist), d).alias("cd"), _below(col(contact_h), h).alias("ch"), truth.alias("t"),
    ).agg(F.count(F.lit(1)).alias("n"))

    def axis(values: Sequence[float], name: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("v")) for i, v in enumerate(values)])).alias(name)

    points = cells
    for values, name in ((z, "gz"), (o, "go"), (d, "gd"), (h, "gh")):
        points = points.select("*", axis(values, name))
    # Passing k ascending cuts from above means passing the first k of them; from below, the last k.
    hit = (
        (F.col("cz") > F.col("gz.i")) | (F.col("co") > F.col("go.i"))
        | ((F.col("cd") >= len(d) - F.col("gd.i")) & (F.col("ch") >= len(h) - F.col("gh.i")))
    )
    n = F.col("n")
    zero = F.lit(0)
    counts = points.groupBy(
        F.col("gz.v").alias("zone"), F.col("go.v").alias("overlap"), F.col("gd.v").alias("min_dist"), F.col("gh.v").alias("contact_h")
    ).agg(
        F.sum(F.when(hit & F.col("t"), n).otherwise(zero)).alias("tp"),
        F.sum(F.when(hit & ~F.col("t"), n).otherwise(zero)).alias("fp"),
        F.sum(F.when(~hit & F.col("t"), n).otherwise(zero)).alias("fn"),
        F.sum(F.when(~hit & ~F.col("t"), n).otherwise(zero)).alias("tn"),
    )
    score = F.col("f1") - PRECISION_WEIGHT * F.greatest(F.lit(0.0), PRECISION_FLOOR - F.col("precision"))
    return with_rates(counts).withColumn("score", score)


def best_grid_point(points: DataFrame) -> DataFrame:
    """Highest score; ties go to the lowest thresholds in grid order."""
    order = F.struct(-F.round("score", 12), "zone", "overlap", "min_dist", "contact_h")
    row = F.struct("zone", "overlap", "min_dist", "contact_h", "score", "precision", "recall", "f1")
    return points.agg(F.min_by(row, order).alias("b")).select("b.*")


def error_listing(scored: DataFrame, notes: DataFrame, keys: Sequence[str], truth: Column, predicted: Column) -> DataFrame:
    """False positives and false negatives with the annotator's note."""
    wrong = scored.filter(truth.isNotNull() & predicted.isNotNull() & (truth != predicted)).withColumn(
        "error", F.when(predicted, "false_positive").otherwise("false_negative")
    )
    return wrong.join(notes, list(keys), "left")


def class_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows and correct rows per true class."""
    return (
        df.filter(F.col(truth).isNotNull())
        .groupBy(truth)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(predicted)).alias("n_correct"))
        .withColumn("accuracy", ratio("n_correct", "n"))
    )


def ensemble(rules: Column, trees: Column, model: Column, low: float = 0.3, high: float = 0.7) -> dict[str, Column]:
    """Three ways to combine a rule vote and two scores.

    intersection  YES only when all three agree
    majority      YES when two of three agree
    cascade       the trees decide when sure, the model in between
    """
    votes = rules.cast("int") + (trees >= 0.5).cast("int") + (model >= 0.5).cast("int")
    return {
        "intersection": votes == 3,
        "majority": votes >= 2,
        "cascade": F.when(trees >= high, True).when(trees < low, False).otherwise(model >= 0.5),
    }
