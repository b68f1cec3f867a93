"""Label tables: harmonising, merging, sampling, splitting and counting.

Random order is a digest of the key and a seed, so a retried task draws the
same sample and no random state is shared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attribix.functions.numeric import col
from attribix.operators.keyed import value_map
from attribix.operators.ordered import row_numbers
from attribix.operators.profiles import first_per_key

# The positive class of the taxonomy, source names with their priority.
POSITIVE_CLASS = "LANDING"
SOURCE_PRIORITY = {"landing_classifier": 2, "v3_foul_type": 1}
TAGS = ("mechanism", "body_part", "severity", "location")
TIMED_CLASSES = ("DRV-FINISH", "DRV-INIT", "ARM-HOOK")
MANUFACTURED = ("ARM-HOOK", "PUMP-JUMP", "RIP-THRU", "DRV-INIT")
GENUINE = ("DRV-FINISH", "CONTEST", "LANDING", "PUTBACK")
BUCKET_CHARS = 3


def taxonomy_to_binary(cls: str | Column, positive: str = POSITIVE_CLASS) -> Column:
    return F.when(col(cls) == positive, "YES").otherwise("NO")


def taxonomy_note(cls: str | Column, prefix: str = "v3 mechanism=") -> Column:
    return F.coalesce(F.concat(F.lit(prefix), col(cls)), F.lit(""))


def class_group(cls: str | Column) -> Column:
    return F.when(col(cls).isin(*MANUFACTURED), "manufactured").when(col(cls).isin(*GENUINE), "genuine")


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_by_priority(df: DataFrame, keys: Sequence[str], source: str, priority: dict[str, int], tie: Sequence[Column]) -> DataFrame:
    """One row per key from the source with the highest priority; unknown sources come last."""
    rank = F.lit(0)
    for name, p in priority.items():
        rank = F.when(F.col(source) == name, F.lit(p)).otherwise(rank)
    return first_per_key(df, keys, [-rank, *tie])


def shuffle_key(key: str | Column, seed: int) -> Column:
    """Seeded random-looking order: hex digest of the key and the seed."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f"#{seed}")).cast("binary"))


def shuffle_bucket(name: str) -> Column:
    return F.substring(F.col(name), 1, BUCKET_CHARS)


def quota_sample(
    df: DataFrame, key: str, session: str, season: str, n: int, seed: int, cap: int = 2, all_if_few: bool = False
) -> DataFrame:
    """Seeded sample of ``n`` rows: at most ``cap`` per session, an equal quota per season, then a top-up.

    ``all_if_few`` returns all candidates, without the caps, when there are no more than asked for. Every ranking keeps
    a bounded number of rows per group, which Spark limits before the shuffle.
    """
    drawn = df.withColumn("__r", shuffle_key(key, seed))
    order = [F.col("__r"), F.col(key)]
    in_session = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    eligible = drawn.withColumn("__s", in_session).filter(F.col("__s") <= cap)
    seasons = df.agg(F.greatest(F.count_distinct(season), F.lit(1))).scalar()
    in_season = F.row_number().over(Window.partitionBy(season).orderBy(*order))
    # No quota exceeds n, so the ranking is limited before the shuffle; the exact quota follows.
    ranked = eligible.withColumn("__q", in_season).filter(F.col("__q") <= n)
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / seasons))
    first = ranked.filter(F.col("__q") <= quota).select(*df.columns, "__r", F.lit(0).alias("__pass"))
    # The top-up is always among the n first eligible rows, whatever the first pass took.
    rest = (
        eligible.orderBy(*order).limit(n)
        .join(first.select(key), key, "left_anti")
        .select(*df.columns, "__r", F.lit(1).alias("__pass"))
    )
    sample = first.unionByName(rest).orderBy("__pass", *order).limit(n).select(*df.columns)
    if not all_if_few:
        return sample
    total = df.agg(F.count(F.lit(1))).scalar()
    few = df.withColumn("__t", total).filter(F.col("__t") <= n).select(*df.columns)
    return sample.withColumn("__t", total).filter(F.col("__t") > n).select(*df.columns).unionByName(few)


def held_out_quotas(df: DataFrame, label: str, test_size: float) -> DataFrame:
    """Rows of each class that go to the held-out part; largest remainders take the odd rows.

    The window runs over one row per class.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy(F.lit(0))
    n_all = F.sum("n_class").over(everything)
    n_test = F.ceil(n_all * F.lit(test_size))
    share = F.col("n_class") * n_test / n_all
    staged = counts.select(label, "n_class", n_test.alias("__nt"), share.alias("__share"), F.floor(share).alias("__base"))
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("__share") - F.col("__base")).desc(), F.col(label))
    left = F.col("__nt") - F.sum("__base").over(everything)
    return staged.select(label, "n_class", (F.col("__base") + (F.row_number().over(order) <= left).cast("int")).alias("n_val"))


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``fold`` with exact class counts. Ranks within a class are taken in digest buckets."""
    drawn = df.withColumn("__r", shuffle_key(key, seed))
    ranked = row_numbers(drawn, [label], ["__r", key], shuffle_bucket("__r"), "__rn")
    quotas = value_map(held_out_quotas(df, label, test_size), label, "n_val")
    return (
        ranked.withColumn("__q", quotas).filter(F.map_contains_key("__q", F.col(label)))
        .withColumn("fold", F.when(F.col("__rn") <= F.col("__q")[F.col(label)]["n_val"], "val").otherwise("train"))
        .select(*df.columns, "fold")
    )


def stratified_kfold(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1, dealt out in turn within each class."""
    drawn = df.withColumn("__r", shuffle_key(key, seed))
    ranked = row_numbers(drawn, [label], ["__r", key], shuffle_bucket("__r"), "__rn")
    return ranked.withColumn("fold", F.pmod(F.col("__rn") - 1, F.lit(k)).cast("int")).select(*df.columns, "fold")


def label_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every (a, b) cell with row, column and grand totals as 'All'."""
    cube = df.select(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b)).cube(a, b)
    counted = cube.agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("__ga"), F.grouping(b).alias("__gb"))
    return counted.select(
        F.when(F.col("__ga") == 1, "All").otherwise(F.col(a)).alias(a),
        F.when(F.col("__gb") == 1, "All").otherwise(F.col(b)).alias(b),
        "n",
    )


def tags_complete(tags: Sequence[str | Column], cls: str | Column, timing: str | Column, timed: Sequence[str] = TIMED_CLASSES) -> Column:
    """All tags filled, and the timing too for the classes that need one."""
    filled = F.lit(True)
    for t in tags:
        filled = filled & (F.coalesce(col(t), F.lit("")) != "")
    needs = F.coalesce(col(cls).isin(*timed), F.lit(False))
    return filled & (~needs | (F.coalesce(col(timing), F.lit("")) != ""))

