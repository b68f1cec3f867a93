"""Ordered event patterns and track operators.

Look-ahead is bounded, so buckets of one session are worked apart and only a
few head rows per bucket cross the border (see ``ordered.lookahead``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attribix.functions.numeric import col
from attribix.operators.keyed import spread_join
from attribix.operators.ordered import lookahead, order_bucket


def followed_by_exactly(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, kind: str, first: str, then: str, n: int,
    fields: Sequence[str],
) -> DataFrame:
    """Rows of kind ``first`` followed at once by exactly ``n`` rows of kind ``then``.

    ``next_<field>`` comes from the first following row. An n+1st row of the
    same kind rules the match out; the end of the group does not.
    """
    names = list(dict.fromkeys([kind, *fields]))
    rows = lookahead(df, keys, order, bucket, names, n + 1, "__ahead")
    ahead = F.col("__ahead")
    run = F.size(ahead) >= n
    for i in range(n):
        run = run & (F.get(ahead, F.lit(i))[kind] == then)
    after = F.get(ahead, F.lit(n))
    hit = (F.col(kind) == first) & run & (after.isNull() | (after[kind] != then))
    return rows.filter(hit).select(*df.columns, *[F.get(ahead, F.lit(0))[f].alias(f"next_{f}") for f in fields])


def followed_by(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, kind: str, first: str, then: str,
    same: str, wanted: Column,
) -> DataFrame:
    """Rows of kind ``first`` whose very next row is of kind ``then`` with ``same`` equal to ``wanted``."""
    rows = lookahead(df, keys, order, bucket, [kind, same], 1, "__ahead")
    nxt = F.get(F.col("__ahead"), F.lit(0))
    return rows.filter((F.col(kind) == first) & (nxt[kind] == then) & (nxt[same] == wanted)).drop("__ahead")


def first_match(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, predicate: Column) -> DataFrame:
    """First value in order that satisfies the predicate."""
    return df.filter(predicate).groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def tail_slope(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, tail: int) -> DataFrame:
    """Mean step over the last ``tail`` rows, and over all rows.

    Successive differences telescope, so only the ends are needed; the last rows
    are kept by a row-number limit that Spark also applies before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    at = F.struct(*order)
    last = (
        df.withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= tail)
        .groupBy(*keys)
        .agg(F.max_by(value, at).alias("__e"), F.min_by(value, at).alias("__s"), F.count(F.lit(1)).alias("__n"))
    )
    whole = df.groupBy(*keys).agg(
        F.max_by(value, at).alias("__we"), F.min_by(value, at).alias("__ws"), F.count(F.lit(1)).alias("n_rows")
    )
    return last.join(whole, list(keys)).select(
        *keys,
        "n_rows",
        ((F.col("__e") - F.col("__s")) / F.nullif(F.col("__n") - 1, F.lit(0))).alias("tail_step"),
        ((F.col("__we") - F.col("__ws")) / F.nullif(F.col("n_rows") - 1, F.lit(0))).alias("mean_step"),
    )


def distance(x1: str | Column, y1: str | Column, x2: str | Column, y2: str | Column) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def nearest_to_anchor(
    df: DataFrame, keys: Sequence[str], ident: str, x: str, y: str, anchor: tuple[Column, Column],
    exclude: tuple[Column, Column] | None = None, radius: float = 20.0, max_distance: float | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Nearest point to the group's anchor, skipping points close to ``exclude``; a plain aggregate."""
    rows = df.withColumn("__d", distance(x, y, *anchor))
    if exclude is not None:
        near = distance(x, y, *exclude) < radius
        rows = rows.filter(~F.coalesce(near, F.lit(False)))
    if max_distance is not None:
        rows = rows.filter(F.col("__d") <= max_distance)
    best = rows.filter(F.col("__d").isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(ident, "__d", x, y, *carry), F.struct("__d", ident)).alias("__b")
    )
    return best.select(*keys, F.col("__b")[ident].alias(ident), F.col("__b.__d").alias("dist"), *[F.col("__b")[c].alias(c) for c in (x, y, *carry)])


#: Bits of a coordinate in the places' common order.
DEPTH = 31
#: Shifts and masks that put a zero between each two bits of a coordinate.
GAPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _gapped(v: Column) -> Column:
    for shift, mask in GAPS:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def with_cells(places: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``places`` with a grid cell (__cx, __cy) whose side __side is at least their smallest distance.

    Cells of halved sides form a tree over a group's square. In the order of the interleaved coordinates two places
    that share a deep cell stand next to each other, so the deepest cell that still holds two shows between neighbours.
    Its diagonal bounds the answer, and as no cell of half its side holds two places, a cell of the bound's size holds
    at most 16 (unless places are closer than 2^-31 of the square).
    """
    box = places.groupBy(*keys).agg(
        F.min(x).alias("__x0"), F.min(y).alias("__y0"), F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("__span")
    ).filter("__span > 0")
    boxed = spread_join(places, box, keys, [x, y], "inner")
    top = (1 << DEPTH) - 1

    def steps(v, low):
        return F.least(F.floor((F.col(v) - F.col(low)) / F.col("__span") * float(1 << DEPTH)), F.lit(top))

    coded = boxed.withColumn("__z", _gapped(steps(x, "__x0")).bitwiseOR(F.shiftleft(_gapped(steps(y, "__y0")), 1)))
    ahead = lookahead(coded.select(*keys, "__z", "__span", x, y), keys, ["__z", x, y], F.shiftright("__z", 34), ["__z"], 1, "__ahead")
    apart = F.get(F.col("__ahead"), F.lit(0))["__z"].bitwiseXOR(F.col("__z"))
    shared = F.when(apart == 0, F.lit(2 * DEPTH)).otherwise(2 * DEPTH - F.length(F.bin(apart)))
    bound = ahead.groupBy(*keys).agg(F.max(F.floor(shared / 2)).alias("__depth")).filter("__depth IS NOT NULL")
    side = F.col("__span") / F.pow(F.lit(2.0), F.col("__depth")) * (2 ** 0.5 * (1 + 1e-9))
    cells = spread_join(boxed, bound, keys, [x, y], "inner").withColumn("__side", side)
    return cells.withColumns({
        "__cx": F.floor((F.col(x) - F.col("__x0")) / F.col("__side")), "__cy": F.floor((F.col(y) - F.col("__y0")) / F.col("__side"))})


def near_pairs(cells: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, dist, a, b) of places in one cell or two that touch, not further apart than the side."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = cells.select(*keys, "a", F.col(x).alias("__x"), F.col(y).alias("__y"), "__side", "__cx", "__cy", F.explode(around).alias("o")).select(
        *keys, "a", "__x", "__y", "__side", (F.col("__cx") + F.col("o.i")).alias("__cx"), (F.col("__cy") + F.col("o.j")).alias("__cy")
    )
    right = cells.select(*keys, F.col("a").alias("b"), x, y, "__cx", "__cy")
    return (
        left.join(right, [*keys, "__cx", "__cy"])
        .filter(F.col("a") < F.col("b"))
        .withColumn("dist", distance("__x", "__y", x, y))
        .filter(F.col("dist") <= F.col("__side"))
        .select(*keys, "dist", "a", "b")
    )


def closest_pair(df: DataFrame, keys: Sequence[str], ident: str, x: str, y: str) -> DataFrame:
    """The two closest points of each group, without pairing all points.

    Points at one place are counted once and answered on their own; the places meet on a grid (:func:`with_cells`).
    """
    keys = list(keys)
    rows = df.select(*keys, ident, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    places = rows.groupBy(*keys, x, y).agg(F.min(ident).alias("a"), F.count(F.lit(1)).alias("__n"))
    shared = places.filter("__n > 1").select(*keys, x, y, "a")
    twins = (
        rows.join(shared, [*keys, x, y]).filter(F.col(ident) > F.col("a"))
        .groupBy(*keys, "a").agg(F.min(ident).alias("b"))
        .select(*keys, F.lit(0.0).alias("dist"), "a", "b")
    )
    near = near_pairs(with_cells(places, keys, x, y), keys, x, y)
    return near.unionByName(twins).groupBy(*keys).agg(F.min(F.struct("dist", "a", "b")).alias("p")).select(
        *keys, F.col("p.a").alias(f"{ident}_a"), F.col("p.b").alias(f"{ident}_b"), F.col("p.dist").alias("dist")
    )
