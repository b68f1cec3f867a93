"""Small tables brought to many rows without shuffling the rows on a key of few values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which the rows of one key are dealt by ``spread_join``.
SPREAD = 32


def value_map(small: DataFrame, key: str, *values: str) -> Column:
    """Scalar map from key to a struct of the values. For keys that are few by design, such as seasons or classes."""
    entries = F.collect_list(F.struct(F.col(key), F.struct(*values).alias("v")))
    return small.filter(F.col(key).isNotNull()).agg(F.map_from_entries(entries)).scalar()


def spread_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str] | None = None, how: str = "left", parts: int = SPREAD
) -> DataFrame:
    """Join a table with one row per key to a large one whose keys may hold any share of the rows.

    The rows of a key are dealt over ``parts`` by a hash of ``spread_by`` (all columns if not given), and the small side
    has each row that often.
    """
    part = F.pmod(F.xxhash64(*(spread_by or big.columns)), F.lit(parts)).cast("int")
    copies = small.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return big.withColumn("__part", part).join(copies, [*on, "__part"], how).drop("__part")
