"""Ordered operators that never hold one group in one task.

A plain window sends a whole group to one task. Here a group is cut into
buckets by an order-preserving expression; each bucket is worked on its own and
one small summary row per bucket carries the state across bucket borders. The
results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attribix.functions.numeric import col, order_bucket
from attribix.operators.keyed import spread_join
from attribix.session import checkpointed

CELL = "__cell"


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [col(c) for c in names]


def _cell(keys: Sequence[str], bucket: Column) -> Column:
    """Group and bucket as one value.

    A struct is never null itself, so groups with a null key take part in plain
    equality joins, and windows and joins share one partitioning.
    """
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("b"))


def _over_cells(keys: Sequence[str]) -> Window:
    """The cells of one group in order: one summary row per bucket."""
    group = [F.col(f"{CELL}.k{i}") for i in range(len(keys))]
    return Window.partitionBy(*(group or [F.lit(0)])).orderBy(f"{CELL}.b")


#: Rows of a bucket beyond which it is cut at its next level.
BUCKET_ROWS = 1_000_000


def with_split_buckets(
    df: DataFrame, keys: Sequence[str], levels: Sequence[Column], bound: int = BUCKET_ROWS, name: str = "bucket"
) -> DataFrame:
    """Add a bucket that is as fine as the rows need: a group's stretch of more than ``bound`` rows is cut at the next level.

    ``levels`` go from coarse to fine and each must not decrease along the order among rows with equal earlier levels. The
    rows are counted by the first level; only stretches that are too long are counted by the next one, so a table without
    any costs one aggregation. The bucket is a struct of the levels, null below the level a row needs. At most one row in
    ``bound`` is a long stretch, so the tables joined here stay small; the rows are dealt over parts in these joins.
    """
    out = df.withColumn("__open", F.lit(True))
    used: list[Column] = []
    for i, level in enumerate(levels):
        out = out.withColumn(f"__l{i}", F.when(F.col("__open"), level))
        used.append(F.col(f"__l{i}"))
        if i + 1 == len(levels):
            break
        prefix = F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)], *[u.alias(f"l{n}") for n, u in enumerate(used)])
        marked = out.withColumn("__prefix", prefix)
        long = checkpointed(
            marked.filter("__open").groupBy("__prefix").agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") > bound)
            .select("__prefix", F.lit(True).alias("__long")))
        if long.isEmpty():
            break
        out = spread_join(marked, long, ["__prefix"]).withColumn("__open", F.col("__open") & F.coalesce("__long", F.lit(False))).drop("__prefix", "__long")
    return out.withColumn(name, F.struct(*[u.alias(f"l{n}") for n, u in enumerate(used)])).select(*df.columns, name)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    sums: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums over ``order`` within ``keys``.

    ``bucket`` must not decrease along ``order``. ``totals`` maps a running sum
    to the name under which the group's grand total is added.
    """
    staged = df.withColumn(CELL, _cell(keys, bucket))
    local = Window.partitionBy(CELL).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_cell = staged.groupBy(CELL).agg(*[F.sum(c).alias(f"__b_{n}") for n, c in sums.items()])
    before = _over_cells(keys).rowsBetween(Window.unboundedPreceding, -1)
    everything = _over_cells(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = per_cell.select(
        CELL,
        *[F.coalesce(F.sum(f"__b_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.sum(f"__b_{n}").over(everything).alias(t) for n, t in (totals or {}).items()],
    )
    rows = staged.select("*", *[F.sum(c).over(local).alias(f"__l_{n}") for n, c in sums.items()])
    return rows.join(carried, CELL).select(
        *df.columns,
        *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums],
        *(totals or {}).values(),
    )


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """``row_number`` within ``keys``; optionally the group size as well."""
    return running_totals(
        df, keys, order, bucket, {name: F.lit(1).cast("bigint")}, {name: total} if total else None
    )


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, value: str, name: str, before: str
) -> DataFrame:
    """Add the best value so far, and the best before this row (null on the first)."""
    staged = df.withColumn(CELL, _cell(keys, bucket))
    w = Window.partitionBy(CELL).orderBy(*_cols(order))
    rows = staged.select(
        "*",
        F.max(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__here"),
        F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__prior"),
    )
    tops = staged.groupBy(CELL).agg(F.max(value).alias("__top"))
    earlier = _over_cells(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(CELL, F.max("__top").over(earlier).alias("__carry"))
    return rows.join(carried, CELL).select(
        *df.columns, F.greatest("__here", "__carry").alias(name), F.greatest("__prior", "__carry").alias(before)
    )


def lookahead(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    fields: Sequence[str],
    k: int,
    name: str = "ahead",
) -> DataFrame:
    """Add an array with ``fields`` of the next ``k`` rows in ``order`` (shorter at the end)."""
    item = F.struct(*[F.col(f) for f in fields])
    staged = df.withColumn(CELL, _cell(keys, bucket))
    w = Window.partitionBy(CELL).orderBy(*_cols(order))
    local = F.filter(F.array(*[F.lead(item, i).over(w) for i in range(1, k + 1)]), lambda x: x.isNotNull())
    # Only k rows per cell leave a task here: the row-number limit runs before the shuffle.
    first_rows = staged.select(CELL, item.alias("__item"), F.row_number().over(w).alias("__rn")).filter(F.col("__rn") <= k)
    in_order = F.array_sort(F.collect_list(F.struct("__rn", "__item")))
    heads = first_rows.groupBy(CELL).agg(F.transform(in_order, lambda x: x["__item"]).alias("__head"))
    later = _over_cells(keys).rowsBetween(1, k)
    heads = heads.select(CELL, F.flatten(F.collect_list("__head").over(later)).alias("__next"))
    return (
        staged.withColumn("__local", local)
        .join(heads, CELL)
        .select(*df.columns, F.slice(F.concat("__local", "__next"), 1, k).alias(name))
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """One row per distinct ``value`` within ``keys``: its count, its average-tie rank, the group size.

    Equal values collapse into one counted row before the shuffle, so a value
    held by a third of all rows costs one row.
    """
    counted = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_tied"))
    )
    cum = running_totals(
        counted, keys, [value], order_bucket(value), {"__cum": F.col("n_tied")}, {"__cum": "n_group"}
    )
    return cum.select(
        *keys,
        value,
        "n_tied",
        "n_group",
        (F.col("__cum") - (F.col("n_tied") - 1) / F.lit(2.0)).alias(name),
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Interpolated quantiles per group, from counted distinct values and running counts."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    cum = running_totals(counted, keys, [value], order_bucket(value), {"__cum": F.col("__n")}, {"__cum": "__total"})
    aggs = []
    for name, p in probs.items():
        at = (F.col("__total") - 1) * F.lit(float(p))
        aggs += [
            F.min(F.when(F.col("__cum") > F.floor(at), F.col(value))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("__cum") > F.ceil(at), F.col(value))).alias(f"__hi_{name}"),
            F.max(at - F.floor(at)).alias(f"__w_{name}"),
        ]
    out = cum.groupBy(*keys).agg(*aggs) if keys else cum.agg(*aggs)
    return out.select(
        *keys,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")).alias(n)
            for n in probs
        ],
    )


def longest_run(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, flag: Column, name: str = "longest"
) -> DataFrame:
    """Longest stretch of consecutive rows with ``flag``; 0 for a group without any."""
    marked = df.withColumn("__flag", F.coalesce(flag.cast("int"), F.lit(0)).cast("bigint"))
    cum = running_totals(
        marked, keys, order, bucket, {"__pos": F.lit(1).cast("bigint"), "__hits": F.col("__flag")}
    )
    runs = cum.groupBy(*keys, (F.col("__pos") - F.col("__hits")).alias("__island")).agg(F.sum("__flag").alias("__len"))
    return runs.groupBy(*keys).agg(F.max("__len").alias(name))
