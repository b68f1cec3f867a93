"""CSV and Parquet tables with declared schemas, and the sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attribix.functions import derive
from attribix.functions.numeric import to_number
from attribix.operators.profiles import first_per_key


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail before any job runs when an input lacks a needed column."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def with_optional(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add absent optional columns as typed nulls."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def read_csv(spark: SparkSession, path: str, schema: str, id_column: str | None = "game_id") -> DataFrame:
    """CSV by header name with a declared schema; ids stay text and are padded again."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    fields = spark.createDataFrame([], schema).schema.fields
    out = header.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in header.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in fields
        ]
    )
    return out.withColumn(id_column, derive.pad_id(id_column)) if id_column else out


def coerce_numbers(df: DataFrame, columns: Sequence[str], default: float | None = 0.0) -> DataFrame:
    return df.withColumns({c: to_number(c, default) for c in columns})


def coverage_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled share per column, one row per column."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)).alias(c) for c in columns],
    )
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled_share")) for c in columns])
    return row.select("n", F.inline(items))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def placeholders(df: DataFrame, content: str, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose content equals a known placeholder, given as (n_bytes, md5).

    The byte length is compared first; the digest is taken only of rows that pass.
    """
    sized = df.select(*keys, F.octet_length(content).alias("n_bytes"), content)
    survivors = sized.join(known.select("n_bytes"), "n_bytes", "left_semi")
    return (
        survivors.withColumn("md5", F.md5(F.col(content).cast("binary")))
        .join(known.select("n_bytes", "md5"), ["n_bytes", "md5"], "left_semi")
        .drop(content)
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """One table; partition columns let later reads prune by season and type."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str], files: int = 1) -> None:
    """Write the partitions that ``df`` has rows of and leave all others as they are; the first run creates the table.

    The rows of a partition are dealt over ``files`` tasks, and adaptive execution splits those that are large by measured
    size, so what one task writes does not grow with the table. A repeated write of the same rows gives the same table.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    dealt = df.withColumn("__part", part).hint("rebalance", *partition_by, "__part").drop("__part")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def read_partitions(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of :func:`replace_partitions` with a declared schema, partition columns included.

    Filters on partition columns, also those that come from a joined table, decide which folders are read.
    """
    return spark.read.schema(schema).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and doubled quotes, as :func:`read_csv` expects it."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def only_new(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the table yet."""
    return incoming.join(existing.select(*keys), list(keys), "left_anti")


def append_new(incoming: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Resumable append: what is already written is skipped. The first run creates the table."""
    spark = incoming.sparkSession
    try:
        existing = spark.read.schema(incoming.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = None
    fresh = incoming if existing is None else only_new(incoming, existing, keys)
    fresh.write.mode("append").parquet(path)


def first_wins(sources: Sequence[tuple[DataFrame, int]], keys: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """Union of sources with missing columns as nulls; the highest priority keeps the key."""
    tagged = [df.withColumn("priority", F.lit(p)) for df, p in sources]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return first_per_key(out, keys, [-F.col("priority"), *tie])
