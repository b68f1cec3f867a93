"""Incremental forms of the session ingest and of the actor profile.

Both write one folder for each micro-batch, named by its id. A batch that runs again after a failure overwrites its own
folder and looks at those of earlier batches only, so the table is the same however often a batch is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attribix.session import checkpointed
from attribix.sources import schemas
from attribix.sources.documents import flatten_sessions

BATCH = "batch_id"


def session_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, multi_line: bool = True) -> DataFrame:
    """Event rows from session files as they arrive, of whatever age. ``multi_line`` files hold one session each."""
    raw = (
        spark.readStream.schema(schemas.SESSION)
        .option("multiLine", multi_line)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return flatten_sessions(raw.select(F.struct("game").alias("doc"), stem.alias("stem")), fallback_id="stem")


def read_batches(spark: SparkSession, path: str, schema, before: int | None = None) -> DataFrame:
    """Rows of all batches, or of those before one, with their batch id."""
    full = f"{schema}, {BATCH} long" if isinstance(schema, str) else schema.add(BATCH, "long")
    rows = spark.read.schema(full).parquet(path)
    return rows if before is None else rows.filter(F.col(BATCH) < before)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


#: Buckets of the key index, fixed for a table's life. A batch reads and writes those that its own keys fall in: many
#: suit a long history that arrives in small batches, few suit large batches.
KEY_BUCKETS = 32
BUCKET = "key_bucket"
#: Below the table: the index of written keys, and batches merged into one folder.
KEYS, MERGED = "_keys", "_merged"


def _bucket(by: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def _written(spark: SparkSession, path: str, shape: str, touched: Sequence[int], before: int) -> DataFrame | None:
    """Keys of earlier batches in these buckets; None where no folder of them exists yet."""
    if not touched:
        return None
    try:
        rows = spark.read.option("basePath", path).schema(f"{shape}, {BUCKET} int, {BATCH} long").parquet(
            f"{path}/{BUCKET}={{{','.join(map(str, touched))}}}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.filter(F.col(BATCH) < before)


def ingest_available(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], bucket_by: Sequence[str] | None = None, buckets: int = KEY_BUCKETS
) -> StreamingQuery:
    """Append what has arrived and is not written yet, and stop.

    A key counts as written whenever it came, as there is no age limit; within a batch one row of a key is taken. The
    written keys are also kept below the table in folders by a hash of ``bucket_by`` (all keys if not given), and a batch
    looks only into the folders its own keys fall in, so what it reads does not grow with the table's history.
    """
    shape, index = _ddl(stream), f"{path}/{KEYS}"
    key_shape = _ddl(stream.select(*keys))

    def write(batch: DataFrame, number: int) -> None:
        arrived = checkpointed(batch.withColumn(BUCKET, _bucket(bucket_by or keys, buckets)))
        touched = sorted(r[0] for r in arrived.select(BUCKET).distinct().collect())  # at most ``buckets``
        known = _written(batch.sparkSession, index, key_shape, touched, number)
        fresh = arrived if known is None else arrived.join(known.select(BUCKET, *keys), [BUCKET, *keys], "left_anti")
        fresh = checkpointed(fresh.dropDuplicates([BUCKET, *keys]))  # dealt by these columns already where something is known
        by_bucket = fresh.select(*keys, BUCKET, F.lit(number).cast("long").alias(BATCH)).repartition(BUCKET)
        by_bucket.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, BATCH).parquet(index)
        fresh.drop(BUCKET).write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batches(spark: SparkSession, path: str, schema, before: int) -> None:
    """Write the rows of all batches before one into one folder, which :func:`read_merged` takes in place of theirs.

    The batch folders stay until someone removes them; a merge that fails half-way is not looked at.
    """
    rows = read_merged(spark, path, schema).filter(F.col(BATCH) < before)
    rows.write.mode("overwrite").parquet(f"{path}/{MERGED}/upto={before}")


def read_merged(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of all batches with their batch id, from the latest finished merge and the batch folders after it."""
    full = f"{schema}, {BATCH} long" if isinstance(schema, str) else schema.add(BATCH, "long")
    try:
        done = spark.read.format("binaryFile").option("pathGlobFilter", "_SUCCESS").load(f"{path}/{MERGED}/upto=*").select("path")
        upto = done.agg(F.max(F.regexp_extract("path", r"/upto=(\d+)/_SUCCESS$", 1).cast("long"))).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        upto = None
    if upto is None:
        return read_batches(spark, path, schema)
    merged = spark.read.schema(full).parquet(f"{path}/{MERGED}/upto={upto}")
    return merged.unionByName(read_batches(spark, path, schema).filter(F.col(BATCH) >= upto))


def windowed_profile(
    events: DataFrame, ts: str, keys: Sequence[str], aggs: Sequence[Column], width: str = "1 day", late: str = "1 day"
) -> DataFrame:
    """Counts per key and tumbling window. State older than ``late`` is dropped once its last counts are out."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(F.window(ts, width).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def upsert_available(profile: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the windows each batch has changed, open ones too, and stop. :func:`latest` gives the present table."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    writer = profile.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The last written row of each key."""
    rows = read_batches(spark, path, schema)
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("v"))
    return newest.select(*keys, "v.*")
