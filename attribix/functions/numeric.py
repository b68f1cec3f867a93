"""Null-safe arithmetic. Division by zero raises under ANSI, so no bare ``/`` on data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: str | Column, default: float | None = 0.0) -> Column:
    """Text to double; unparsable text, blanks and NaN all become ``default``."""
    value = F.nanvl(col(c).try_cast("double"), F.lit(None).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def ratio(num: str | Column, den: str | Column, zero: str = "null") -> Column:
    """``num / den`` with a declared treatment of a zero denominator.

    null   the result is null
    one    a zero denominator counts as 1
    floor1 the denominator is at least 1
    """
    n, d = col(num).cast("double"), col(den).cast("double")
    if zero == "null":
        return n / F.nullif(d, F.lit(0.0))
    if zero == "one":
        return n / F.when(d == 0, F.lit(1.0)).otherwise(d)
    if zero == "floor1":
        return n / F.greatest(d, F.lit(1.0))
    raise ValueError(f"unknown zero mode {zero!r}")


def per_unit(y: str | Column, exposure: str | Column, scale: float = 36.0, zero: str = "floor1") -> Column:
    """Outcome per ``scale`` units of exposure."""
    return ratio(F.lit(float(scale)) * col(y), exposure, zero)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate correlation over rows where both sides are present; null on a constant side.

    ``corr`` raises on a constant column under ANSI, so it is not used.
    """
    both = col(x).isNotNull() & col(y).isNotNull()
    a = F.when(both, col(x).cast("double"))
    b = F.when(both, col(y).cast("double"))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of the numbers is null or NaN.

    One condition a column: ``dropna`` holds all columns in one, of which the optimizer derives a copy for every choice of
    renamed columns.
    """
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in columns]))


def add(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def order_bucket(value: str | Column, per_octave: int = 1024) -> Column:
    """Order-preserving bucket of a number: sign, power of two, and a slice of that octave.

    It depends on the value alone, so every branch of a plan and every retried
    task agrees on it, and no job is needed to find the cut points.
    """
    v = col(value).cast("double")
    mag = F.abs(v)
    power = F.floor(F.log2(mag))
    slot = power * per_octave + F.floor(mag / F.pow(F.lit(2.0), power.cast("double")) * per_octave)
    shifted = slot + F.lit(1200 * per_octave)
    return (
        F.when(v > 0, shifted).when(v < 0, -shifted).when(v == 0, F.lit(0).cast("bigint")).cast("bigint")
    )
