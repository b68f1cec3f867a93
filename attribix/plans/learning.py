"""Classifier queries on the embeddings, and the streaming profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from attribix.operators import classifiers as C
from attribix.operators import labels as L
from attribix.plans import roles, scans
from attribix.plans.registry import query
from attribix.plans.shape import rounded
from attribix.session import shared_folder
from attribix.streaming import ingest

SEED = 42


def examples(spark, sf):
    e = roles.table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("target"))
    return C.vectors(e, "embedding").drop("embedding")


def split(spark, sf):
    rows = examples(spark, sf)
    fold = L.stratified_split(rows.select("vec_id", "target"), "vec_id", "target", 0.2, SEED).select("vec_id", "fold")
    both = rows.join(fold, "vec_id")
    return both.filter("fold = 'train'").drop("fold"), both.filter("fold = 'val'").drop("fold")


@query("embed_logreg")
def embed_logreg(spark, sf):
    train, val = split(spark, sf)
    return rounded(C.logistic(train, val, "target").select("vec_id", "target", "score"))


@query("embed_mlp")
def embed_mlp(spark, sf):
    train, val = split(spark, sf)
    return rounded(C.perceptron(train, val, "target", 64).select("vec_id", "target", "score"))


@query(
    "stream_profile",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n_events,
         (round(sum(value) + 0.0000001, 4) + 0.0) AS total FROM events GROUP BY ALL""",
)
def stream_profile(spark, sf):
    """The events table is read as a stream; open windows are in the result as well as closed ones."""
    schema = roles.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select("ts", "event_type", "value")
    profile = ingest.windowed_profile(
        stream, "ts", ["event_type"], [F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")]
    )
    folder = shared_folder(spark, "stream-profile")
    ingest.upsert_available(profile, f"{folder}/out", f"{folder}/state").awaitTermination()
    shape = "window_start timestamp, event_type string, n_events long, total double"
    out = ingest.latest(spark, f"{folder}/out", shape, ["window_start", "event_type"])
    return rounded(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")))


@query(
    "stream_ingest",
    """WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, unnest([0, 1]) AS pos FROM orders)
       SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS game_id, CAST(pos + 1 AS BIGINT) AS event_num, o_orderpriority AS location
       FROM a WHERE pos = 0 OR o_orderstatus = 'P'""",
)
def stream_ingest(spark, sf):
    """Session files in three deliveries: two thirds of the sessions, all of them again, and the finished ones once more."""
    docs = scans.session_documents(spark, sf)
    folder = shared_folder(spark, "stream-ingest")
    deliveries = [docs.filter("o_orderstatus <> 'F'"), docs, docs.filter("o_orderstatus = 'F'")]
    for i, part in enumerate(deliveries):
        part.select("text").write.option("compression", "gzip").text(f"{folder}/in/delivery={i}")
        stream = ingest.session_stream(spark, f"{folder}/in", multi_line=False).select("game_id", "event_num", "location")
        ingest.ingest_available(stream, f"{folder}/out", f"{folder}/state", ["game_id", "event_num"], ["game_id"]).awaitTermination()
    return ingest.read_merged(spark, f"{folder}/out", "game_id string, event_num long, location string").drop(ingest.BATCH)
