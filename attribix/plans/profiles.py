"""Queries over actor profiles, joins, set operations and top-k reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from attribix.functions import derive
from attribix.operators import profiles as P
from attribix.plans import roles
from attribix.plans.registry import query
from attribix.plans.roles import BASE_SQL
from attribix.plans.shape import r, rounded


def target():
    return F.col("event_type") == "R"


PROFILE_SQL = f"""{BASE_SQL},
calls AS (
  SELECT e.actor_id, s.season_type, count(*) AS n_events, count(DISTINCT e.session_id) AS n_called
  FROM event e JOIN session s USING (session_id)
  WHERE e.event_type = 'R' AND e.actor_id IS NOT NULL GROUP BY ALL),
assigned AS (
  SELECT t.actor_id, s.season_type, count(DISTINCT t.session_id) AS n_assigned
  FROM team t JOIN session s USING (session_id) GROUP BY ALL),
profile AS (
  SELECT c.actor_id, c.season_type, c.n_events, c.n_called,
         coalesce(a.n_assigned, c.n_called) AS n_assigned,
         c.n_events / CAST(coalesce(a.n_assigned, c.n_called) AS DOUBLE) AS per_session
  FROM calls c LEFT JOIN assigned a USING (actor_id, season_type)),
wide AS (
  SELECT actor_id,
         coalesce(max(n_events) FILTER (WHERE season_type = 'RS'), 0) AS n_events_RS,
         coalesce(max(n_assigned) FILTER (WHERE season_type = 'RS'), 0) AS n_assigned_RS,
         coalesce(max(per_session) FILTER (WHERE season_type = 'RS'), 0) AS per_session_RS,
         coalesce(max(n_events) FILTER (WHERE season_type = 'PO'), 0) AS n_events_PO,
         coalesce(max(n_assigned) FILTER (WHERE season_type = 'PO'), 0) AS n_assigned_PO,
         coalesce(max(per_session) FILTER (WHERE season_type = 'PO'), 0) AS per_session_PO
  FROM profile GROUP BY actor_id)"""


def profile(spark, sf):
    return P.actor_profile(
        roles.events(spark, sf), roles.sessions(spark, sf), roles.team(spark, sf),
        "actor_id", "session_id", "season_type", target(),
    )


def wide_profile(spark, sf):
    return P.pivot_profile(profile(spark, sf), "actor_id", "season_type")


@query(
    "actor_profile",
    f"{PROFILE_SQL} SELECT actor_id, season_type, n_events, n_called, n_assigned, {r('per_session')} AS per_session FROM profile",
)
def actor_profile(spark, sf):
    return rounded(profile(spark, sf))


@query(
    "actor_exposure",
    f"{BASE_SQL} SELECT t.actor_id, s.season_type, count(DISTINCT t.session_id) AS n_assigned "
    "FROM team t JOIN session s USING (session_id) GROUP BY ALL",
)
def actor_exposure(spark, sf):
    return P.exposure(roles.team(spark, sf), roles.sessions(spark, sf), "actor_id", "session_id", "season_type")


@query(
    "actor_pivot",
    f"""{PROFILE_SQL} SELECT actor_id, n_events_RS, n_assigned_RS, {r('per_session_RS')} AS per_session_RS,
      n_events_PO, n_assigned_PO, {r('per_session_PO')} AS per_session_PO,
      {r('per_session_PO - per_session_RS')} AS per_session_delta,
      n_events_RS + n_events_PO AS total_events, n_assigned_RS + n_assigned_PO AS total_sessions FROM wide""",
)
def actor_pivot(spark, sf):
    return rounded(wide_profile(spark, sf))


@query(
    "name_conflicts",
    """SELECT left(s_name, 1) || '.' || right(s_name, 2) AS short_name, count(DISTINCT s_suppkey) AS n_ids
       FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) > 1
       UNION ALL
       SELECT left(p_name, 1) || '.' || split_part(p_name, ' ', 2), count(DISTINCT p_partkey)
       FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1""",
)
def name_conflicts(spark, sf):
    supplier = roles.table(spark, sf, "supplier").select(
        derive.short_name("s_name", F.expr("right(s_name, 2)")).alias("short_name"), F.col("s_suppkey").alias("id")
    )
    part = roles.table(spark, sf, "part").select(
        derive.short_name("p_name", F.split_part("p_name", F.lit(" "), F.lit(2))).alias("short_name"),
        F.col("p_partkey").alias("id"),
    )
    return P.name_conflicts(supplier, "short_name", "id").unionByName(P.name_conflicts(part, "short_name", "id"))


@query(
    "dim_first",
    "SELECT p_name, p_partkey, p_brand, p_size FROM part "
    "QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) = 1",
)
def dim_first(spark, sf):
    dim = roles.table(spark, sf, "part").select("p_name", "p_partkey", "p_brand", "p_size")
    return P.first_per_key(dim, ["p_name"], [F.col("p_brand"), F.col("p_partkey")])


@query(
    "join_dim",
    f"""{BASE_SQL} SELECT e.session_id, e.pos, e.part_id, e.actor_id, d.actor_name
        FROM event e LEFT JOIN (SELECT s_suppkey AS actor_id, s_name AS actor_name FROM supplier WHERE s_acctbal >= 0) d
        USING (actor_id) WHERE e.event_type = 'R'""",
)
def join_dim(spark, sf):
    dim = (
        roles.table(spark, sf, "supplier").filter("s_acctbal >= 0")
        .select(F.col("s_suppkey").alias("actor_id"), F.col("s_name").alias("actor_name"))
    )
    events = roles.events(spark, sf).filter(target()).select("session_id", "pos", "part_id", "actor_id")
    return P.attach_dim(events, dim, "actor_id", [F.col("actor_name")])


@query(
    "session_counts",
    f"""{BASE_SQL} SELECT session_id, count(*) FILTER (WHERE event_type = 'R') AS n_target, count(*) AS n_events,
        {r("count(*) FILTER (WHERE event_type = 'R') / CAST(count(*) AS DOUBLE)")} AS target_rate FROM event GROUP BY 1""",
)
def session_counts(spark, sf):
    return rounded(P.session_counts(roles.events(spark, sf), "session_id", target()))


@query(
    "event_share",
    f"""{BASE_SQL}, c AS (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'R') AS t FROM event GROUP BY 1)
        SELECT actor_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events, CAST(sum(t) AS BIGINT) AS n_target,
               {r('sum(t) / CAST(sum(n) AS DOUBLE)')} AS target_share
        FROM team JOIN c USING (session_id) GROUP BY 1""",
)
def event_share(spark, sf):
    return rounded(P.event_share(roles.events(spark, sf), roles.team(spark, sf), "actor_id", "session_id", target()))


@query(
    "context_share",
    f"""SELECT l_suppkey AS actor_id, count(*) AS n_events,
          {r("count(*) FILTER (WHERE margin > 0) / CAST(count(*) AS DOUBLE)")} AS leading_share,
          {r("count(*) FILTER (WHERE margin < 0) / CAST(count(*) AS DOUBLE)")} AS trailing_share,
          {r("count(*) FILTER (WHERE margin = 0) / CAST(count(*) AS DOUBLE)")} AS level_share
        FROM (SELECT l_suppkey, CAST(l_quantity AS INTEGER) - 25 AS margin FROM lineitem) GROUP BY 1""",
)
def context_share(spark, sf):
    lines = roles.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("actor_id"), (F.col("l_quantity").cast("int") - 25).alias("margin")
    )
    return rounded(P.context_share(lines, "actor_id", "margin"))


@query(
    "topk_desc",
    f"""{PROFILE_SQL} SELECT actor_id, n_events_RS + n_events_PO AS total_events, n_assigned_RS + n_assigned_PO AS total_sessions
        FROM wide ORDER BY total_events DESC, actor_id LIMIT 20""",
)
def topk_desc(spark, sf):
    out = wide_profile(spark, sf).select("actor_id", "total_events", "total_sessions")
    return P.top_k(out, [F.desc("total_events"), F.asc("actor_id")], 20)


@query(
    "top_bottom",
    f"""{PROFILE_SQL}, f AS (SELECT actor_id, per_session, n_assigned FROM profile WHERE season_type = 'RS' AND n_assigned >= 50)
        SELECT actor_id, {r('per_session')} AS per_session, n_assigned, 'top' AS side
        FROM (SELECT * FROM f ORDER BY per_session DESC, actor_id LIMIT 5)
        UNION ALL
        SELECT actor_id, {r('per_session')}, n_assigned, 'bottom'
        FROM (SELECT * FROM f ORDER BY per_session ASC, actor_id LIMIT 5)""",
)
def top_bottom(spark, sf):
    rows = profile(spark, sf).filter("season_type = 'RS'").select("actor_id", "per_session", "n_assigned")
    return rounded(P.top_and_bottom(rows, "per_session", ["actor_id"], 5, "n_assigned", 50))


@query(
    "join_semi",
    "SELECT o_orderkey AS session_id, o_custkey AS cust_id FROM orders o "
    "WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
)
def join_semi(spark, sf):
    hits = roles.events(spark, sf).filter(target()).select("session_id")
    return roles.sessions(spark, sf).select("session_id", "cust_id").join(hits, "session_id", "left_semi")


@query(
    "join_anti",
    "SELECT o_orderkey AS session_id, o_custkey AS cust_id FROM orders o "
    "WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
)
def join_anti(spark, sf):
    seen = roles.events(spark, sf).select("session_id")
    return roles.sessions(spark, sf).select("session_id", "cust_id").join(seen, "session_id", "left_anti")


@query(
    "set_except",
    "SELECT DISTINCT l_suppkey AS actor_id, l_partkey AS part_id FROM lineitem WHERE l_returnflag = 'R' "
    "EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R'",
)
def set_except(spark, sf):
    ev = roles.events(spark, sf).select("actor_id", "part_id", "event_type")
    return ev.filter(target()).drop("event_type").distinct().join(
        ev.filter(~target()).drop("event_type"), ["actor_id", "part_id"], "left_anti"
    )


@query(
    "distinct_pairs",
    f"{BASE_SQL} SELECT DISTINCT s.subject_id, t.actor_id FROM subject_session s JOIN team t USING (session_id)",
)
def distinct_pairs(spark, sf):
    subject = roles.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cust_id"), F.col("c_nationkey").alias("subject_id")
    )
    by_session = roles.sessions(spark, sf).select("session_id", "cust_id").join(subject, "cust_id")
    return by_session.join(roles.team(spark, sf), "session_id").select("subject_id", "actor_id").distinct()
