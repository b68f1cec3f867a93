"""Queries over ordered events and point tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from attribix.operators import ordered as O
from attribix.operators import sequence as Q
from attribix.plans import roles
from attribix.plans.registry import query
from attribix.plans.shape import r, rounded

POSITION_BLOCK = 4096


def event_levels():
    """Ever shorter stretches of the event order: day, hour, second, instant, and leading bits of the id among events of one instant."""
    at = F.col("ts").cast("timestamp")
    return [F.date_trunc("DAY", at), F.date_trunc("HOUR", at), F.date_trunc("SECOND", at), at, *[F.shiftright("event_id", n) for n in (40, 30, 20, 10)]]


def line_bucket():
    return F.floor(F.col("pos") / POSITION_BLOCK)


def stream_events(spark, sf):
    return roles.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")


def bucketed(rows, bound=O.BUCKET_ROWS):
    """Events with a bucket within their user; a user's busy day, hour or second is cut further."""
    return O.with_split_buckets(rows, ["user_id"], event_levels(), bound)


def lines(spark, sf):
    return roles.events(spark, sf).select("session_id", "pos", "part_id", "actor_id", "event_type", "status")


LINE_ORDER = ["pos", "part_id", "actor_id"]


@query(
    "seq_exact_n",
    """WITH e AS (SELECT *, lead(event_type, 1) OVER w AS t1, lead(event_type, 2) OVER w AS t2, lead(event_type, 3) OVER w AS t3, lead(event_type, 4) OVER w AS t4,
                 lead(event_id, 1) OVER w AS n1, lead(value, 1) OVER w AS v1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT user_id, event_id, n1 AS next_event_id, v1 AS next_value FROM e
       WHERE event_type = 'purchase' AND t1 = 'view' AND t2 = 'view' AND t3 = 'view' AND (t4 IS NULL OR t4 <> 'view')""",
)
def seq_exact_n(spark, sf):
    out = Q.followed_by_exactly(
        bucketed(stream_events(spark, sf)), ["user_id"], ["ts", "event_id"], F.col("bucket"), "event_type", "purchase", "view", 3, ["event_id", "value"]
    )
    return out.select("user_id", "event_id", "next_event_id", "next_value")


@query(
    "seq_next_by",
    """WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, lead(l_returnflag) OVER w AS t1, lead(l_linestatus) OVER w AS s1
                  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
       SELECT l_orderkey AS session_id, l_linenumber AS pos, l_partkey AS part_id, l_suppkey AS actor_id FROM e
       WHERE l_returnflag = 'R' AND t1 = 'A' AND s1 = 'F'""",
)
def seq_next_by(spark, sf):
    out = Q.followed_by(lines(spark, sf), ["session_id"], LINE_ORDER, line_bucket(), "event_type", "R", "A", "status", F.lit("F"))
    return out.select("session_id", "pos", "part_id", "actor_id")


@query(
    "first_match",
    "SELECT user_id, arg_min(value, (ts, event_id)) AS value FROM events WHERE event_type = 'purchase' AND value > 10 GROUP BY 1",
)
def first_match(spark, sf):
    hit = (F.col("event_type") == "purchase") & (F.col("value") > 10)
    return Q.first_match(stream_events(spark, sf), ["user_id"], [F.col("ts"), F.col("event_id")], "value", hit)


@query(
    "longest_run",
    """WITH e AS (SELECT user_id, CASE WHEN value > 20 THEN 1 ELSE 0 END AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
       g AS (SELECT *, pos - sum(flag) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM e),
       c AS (SELECT user_id, island, sum(flag) AS len FROM g GROUP BY ALL)
       SELECT user_id, CAST(max(len) AS BIGINT) AS longest, CAST(least(max(len), 2) AS BIGINT) AS longest_parity FROM c GROUP BY 1""",
)
def longest_run(spark, sf):
    rows = bucketed(stream_events(spark, sf).select("user_id", "ts", "event_id", "value"))
    out = O.longest_run(rows, ["user_id"], ["ts", "event_id"], F.col("bucket"), F.col("value") > 20)
    return out.withColumn("longest_parity", F.least("longest", F.lit(2).cast("bigint")))


@query(
    "running_best",
    """WITH e AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best,
                    max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events)
       SELECT user_id, event_id, best, prev IS NULL OR value > prev AS is_best FROM e""",
)
def running_best(spark, sf):
    rows = bucketed(stream_events(spark, sf).select("user_id", "event_id", "ts", "value"))
    out = O.running_max(rows, ["user_id"], ["ts", "event_id"], F.col("bucket"), "value", "best", "prev")
    return out.select("user_id", "event_id", "best", (F.col("prev").isNull() | (F.col("value") > F.col("prev"))).alias("is_best"))


@query(
    "tail_velocity",
    f"""WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
        d AS (SELECT user_id, value, back, value - lead(value) OVER (PARTITION BY user_id ORDER BY back) AS step FROM e)
        SELECT user_id, count(*) AS n_rows, {r('avg(step) FILTER (WHERE back <= 4)')} AS tail_step, {r('avg(step)')} AS mean_step FROM d GROUP BY 1""",
)
def tail_velocity(spark, sf):
    rows = stream_events(spark, sf).select("user_id", "ts", "event_id", "value")
    return rounded(Q.tail_slope(rows, ["user_id"], ["ts", "event_id"], "value", 5))


def points(spark, sf):
    """Each two values of a vector in a row are a point; the label is its frame."""
    e = roles.table(spark, sf, "embeddings")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda i: F.struct(
        (F.col("vec_id") * 32 + i).alias("person"), F.get("embedding", 2 * i).cast("double").alias("x"),
        F.get("embedding", 2 * i + 1).cast("double").alias("y")))
    return e.select(F.col("label").alias("frame"), F.inline(pairs))


POINT_SQL = """pt AS (SELECT label AS frame, vec_id * 32 + i AS person, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y
  FROM (SELECT *, unnest(range(len(embedding) // 2)) AS i FROM embeddings))"""


@query(
    "nn_track",
    f"""WITH {POINT_SQL}, d AS (SELECT *, sqrt((x - 0.05) * (x - 0.05) + (y + 0.05) * (y + 0.05)) AS dist, sqrt(x * x + y * y) AS away FROM pt)
        SELECT frame, person, {r('dist', 6)} AS dist FROM d WHERE away >= 0.08 AND dist <= 0.5
        QUALIFY row_number() OVER (PARTITION BY frame ORDER BY d.dist, person) = 1""",
)
def nn_track(spark, sf):
    out = Q.nearest_to_anchor(
        points(spark, sf), ["frame"], "person", "x", "y", (F.lit(0.05), F.lit(-0.05)), (F.lit(0.0), F.lit(0.0)), 0.08, 0.5
    )
    return rounded(out.select("frame", "person", "dist"), 6)


@query(
    "closest_pair",
    f"""WITH {POINT_SQL}
        SELECT a.frame, a.person AS person_a, b.person AS person_b, {r('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))', 6)} AS dist
        FROM pt a JOIN pt b ON a.frame = b.frame AND a.person < b.person
        QUALIFY row_number() OVER (PARTITION BY a.frame ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), a.person, b.person) = 1""",
)
def closest_pair(spark, sf):
    return rounded(Q.closest_pair(points(spark, sf), ["frame"], "person", "x", "y"), 6)
