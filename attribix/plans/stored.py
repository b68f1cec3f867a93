"""Queries over tables that are written and read back: by season, as CSV, and from split and manifest documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attribix.plans import roles
from attribix.plans.registry import query
from attribix.plans.shape import r, rounded
from attribix.session import checkpointed, shared_folder
from attribix.sources import documents as D
from attribix.sources import schemas
from attribix.sources import tables as S

REWRITTEN, OTHER = 1995, 1996
FILES = 8
SHAPE = "session_id long, pos int, event_type string, season_type string, revision int, season int"
BY_SEASON = ["season"]
FACT_SQL = f"""WITH {roles.SESSION_SQL}, {roles.EVENT_SQL},
  fact AS (SELECT s.season, s.season_type, s.session_id, e.event_type, CASE WHEN s.season = {REWRITTEN} THEN 2 ELSE 0 END AS revision FROM session s JOIN event e USING (session_id))"""


def facts(spark, sf):
    sessions = roles.sessions(spark, sf).select("session_id", "season", "season_type")
    return roles.events(spark, sf).select("session_id", "pos", "event_type").join(sessions, "session_id").withColumn("revision", F.lit(0)).select(
        "session_id", "pos", "event_type", "season_type", "revision", "season")


def season_folder(spark, sf):
    """The events of all sessions by season, one season written anew twice: a part of it first, then all of it."""
    folder = shared_folder(spark, "seasons")
    rows = facts(spark, sf)
    S.replace_partitions(rows, folder, BY_SEASON, FILES)
    again = rows.filter(F.col("season") == REWRITTEN)
    S.replace_partitions(again.filter("pos % 2 = 1").withColumn("revision", F.lit(1)), folder, BY_SEASON, FILES)
    S.replace_partitions(again.withColumn("revision", F.lit(2)), folder, BY_SEASON, FILES)
    return folder


@query(
    "season_table",
    f"""{FACT_SQL} SELECT season, season_type, event_type, revision, count(*) AS n_events, count(DISTINCT session_id) AS n_sessions
        FROM fact WHERE season IN ({REWRITTEN}, {OTHER}) GROUP BY ALL""",
)
def season_table(spark, sf):
    """The rewritten season and another; the filter on the season decides which folders are read."""
    rows = S.read_partitions(spark, season_folder(spark, sf), SHAPE).filter(F.col("season").isin(REWRITTEN, OTHER))
    return rows.groupBy("season", "season_type", "event_type", "revision").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("session_id").alias("n_sessions"))


@query(
    "season_of_most",
    f"""{FACT_SQL}, top AS (SELECT season FROM session WHERE season_type = 'PO' GROUP BY 1 ORDER BY count(*) DESC, season LIMIT 1)
        SELECT season, event_type, count(*) AS n_events FROM fact JOIN top USING (season) GROUP BY ALL""",
)
def season_of_most(spark, sf):
    """Events of the season with most playoff sessions; the season comes from a joined table and still prunes the read."""
    ranked = roles.sessions(spark, sf).filter("season_type = 'PO'").groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    ranked = checkpointed(ranked.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "season"))))
    rows = S.read_partitions(spark, season_folder(spark, sf), SHAPE).select("season", "event_type")
    return rows.join(ranked.filter("place = 1").select("season"), "season").groupBy("season", "event_type").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "csv_round_trip",
    f"""SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS game_id, s_name || ', "the ' || s_suppkey || '"' AS name, {r('s_acctbal', 2)} AS balance,
        CAST(NULL AS INTEGER) AS extra FROM supplier""",
)
def csv_round_trip(spark, sf):
    """Every supplier written as CSV and read back with a declared schema; a column the file lacks is null."""
    path = shared_folder(spark, "csv")
    rows = roles.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("game_id"),
        F.concat("s_name", F.lit(', "the '), "s_suppkey", F.lit('"')).alias("name"), F.col("s_acctbal").alias("balance"))
    S.write_csv(rows, path)
    return rounded(S.read_csv(spark, path, "game_id string, name string, balance double, extra int"), balance=2)


ORDER_KEY = "lpad(CAST(o_orderkey AS VARCHAR), 10, '0')"


def order_events(spark, sf):
    return roles.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").cast("string").alias("game_id"), F.col("o_orderkey").cast("int").alias("event_id"),
        F.col("o_orderstatus").alias("status"))


@query(
    "split_scan",
    f"SELECT {ORDER_KEY} AS game_id, CAST(o_orderkey AS INTEGER) AS event_id, CASE WHEN o_orderstatus = 'F' THEN 'val' ELSE 'train' END AS fold FROM orders",
)
def split_scan(spark, sf):
    """Keys and folds out of split documents, one for each customer."""
    key = F.struct("game_id", "event_id")

    def side(keys):
        return F.struct(F.size(keys).alias("n"), keys.alias("keys"))

    docs = order_events(spark, sf).groupBy("doc").agg(
        F.collect_list(F.when(F.col("status") != "F", key)).alias("train"), F.collect_list(F.when(F.col("status") == "F", key)).alias("val"))
    text = F.to_json(F.struct(F.lit(42).alias("seed"), side(F.col("train")).alias("train"), side(F.col("val")).alias("val")))
    return D.split_rows(D.from_text(docs.select(text.alias("text")), "text", schemas.SPLIT))


@query(
    "manifest_first",
    f"""SELECT {ORDER_KEY} AS game_id, CAST(o_orderkey AS INTEGER) AS event_id, CASE WHEN o_orderstatus = 'F' THEN 'small/' ELSE 'large/' END || o_orderkey AS video_url,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS priority FROM orders""",
)
def manifest_first(spark, sf):
    """Clips of two manifests a customer; where both hold a key, the one of higher priority stays."""
    rows = order_events(spark, sf)

    def clips(df, url, priority):
        clip = F.struct("game_id", "event_id", F.concat(F.lit(f"{url}/"), "game_id").alias("video_url_960" if priority == 2 else "video_url_320"))
        docs = df.groupBy("doc").agg(F.to_json(F.struct(F.collect_list(clip).alias("clips"))).alias("text"))
        return D.manifest_clips(D.from_text(docs, "text", schemas.MANIFEST), priority).select("game_id", "event_id", "video_url"), priority

    sources = [clips(rows.filter("status <> 'F'"), "large", 2), clips(rows, "small", 1)]
    return S.first_wins(sources, ["game_id", "event_id"], [F.col("video_url")]).select("game_id", "event_id", "video_url", "priority")
