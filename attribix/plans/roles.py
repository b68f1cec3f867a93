"""The given tables read in the roles of the engine, as DataFrames and as SQL.

orders = sessions, lineitem = events, suppliers = actors, nations = subjects,
the suppliers of one order = its team. Every read is a column-pruned Parquet
scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("cust_id"),
        F.year("o_orderdate").alias("season"),
        F.when(F.col("o_orderstatus") == "P", "PO").otherwise("RS").alias("season_type"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_suppkey").alias("actor_id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_returnflag").alias("event_type"),
        F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("outcome"),
        F.col("l_quantity").alias("exposure"),
    )


def team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team assignment: one row per (session, actor).

    The rows are dealt by session before they are made distinct, so a join on the session needs no second shuffle.
    """
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("actor_id"))
        .repartition("session_id")
        .distinct()
    )


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("actor_name")
    )


def subject_sessions(spark: SparkSession, sf_dir: str, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (subject, session): outcome, exposure, covariate, and ``counts`` of the session's events by name.

    Events are summed per session before the joins, so the joins carry one row
    per session and not one per event.
    """
    counts = counts or {}
    per_session = (
        events(spark, sf_dir)
        .groupBy("session_id")
        .agg(
            F.sum("outcome").alias("y"),
            F.sum("exposure").alias("m"),
            F.count_if(F.col("event_type") == "R").cast("bigint").alias("n_target"),
            *[F.count_if(c).alias(n) for n, c in counts.items()],
        )
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cust_id"),
        F.col("c_nationkey").alias("subject_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("cov"),
    )
    return (
        sessions(spark, sf_dir)
        .join(per_session, "session_id")
        .join(customer, "cust_id")
        .select("subject_id", "session_id", "season", "season_type", "y", "m", "cov", "n_target", *counts)
    )


# The same roles as SQL, to build the counterpart queries from.
SESSION_SQL = """session AS (
  SELECT o_orderkey AS session_id, o_custkey AS cust_id, CAST(year(o_orderdate) AS INTEGER) AS season,
         CASE WHEN o_orderstatus = 'P' THEN 'PO' ELSE 'RS' END AS season_type
  FROM orders)"""
EVENT_SQL = """event AS (
  SELECT l_orderkey AS session_id, l_suppkey AS actor_id, l_linenumber AS pos, l_partkey AS part_id,
         l_returnflag AS event_type, l_linestatus AS status, l_extendedprice AS outcome, l_quantity AS exposure
  FROM lineitem)"""
TEAM_SQL = "team AS (SELECT DISTINCT l_orderkey AS session_id, l_suppkey AS actor_id FROM lineitem)"
SUBJECT_SQL = """subject_session AS (
  SELECT c.c_nationkey AS subject_id, s.session_id, s.season, s.season_type, e.y, e.m,
         CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal END AS cov, e.n_target
  FROM session s
  JOIN (SELECT session_id, sum(outcome) AS y, sum(exposure) AS m,
               CAST(count(*) FILTER (WHERE event_type = 'R') AS BIGINT) AS n_target
        FROM event GROUP BY session_id) e USING (session_id)
  JOIN customer c ON c.c_custkey = s.cust_id)"""
BASE_SQL = f"WITH {SESSION_SQL}, {EVENT_SQL}, {TEAM_SQL}, {SUBJECT_SQL}"
