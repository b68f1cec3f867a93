"""Queries over document scans, scalar derivations and set-based loading.

The raw documents are text that Spark writes from every row of the given
tables and then parses back with the declared schemas.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attribix.functions import derive
from attribix.functions.numeric import per_unit, ratio, to_number
from attribix.plans import roles
from attribix.plans.registry import query
from attribix.plans.shape import r, rounded
from attribix.sources import documents as D
from attribix.sources import schemas
from attribix.sources import tables as S

DATE_YY = "lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0')"
ORDER_ID_SQL = f"""(CASE o_orderstatus WHEN 'P' THEN '004' WHEN 'F' THEN '002' ELSE '001' END || {DATE_YY}
  || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(5, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0'))"""


def order_id():
    """Session id text: type code, two-digit year, order key padded to at least five digits."""
    key = F.col("o_orderkey").cast("string")
    return F.concat(
        F.when(F.col("o_orderstatus") == "P", "004").when(F.col("o_orderstatus") == "F", "002").otherwise("001"),
        F.date_format("o_orderdate", "yy"),
        F.when(F.length(key) < 5, F.lpad(key, 5, "0")).otherwise(key),
    )


SHORT = "left(s_name, 1) || '.' || right(s_name, 4)"


@query(
    "nested_flatten",
    f"""WITH a AS (
      SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice, unnest([0, 1, 2]) AS pos FROM orders),
    t AS (SELECT *, CASE WHEN pos = 0 THEN 'Foul' WHEN pos = 1 THEN CASE o_orderstatus WHEN 'P' THEN 'Foul' ELSE 'Free Throw' END ELSE 'Rebound' END AS event_type FROM a)
    SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS game_id, CAST(pos AS INTEGER) AS pos, CAST(pos + 1 AS BIGINT) AS event_num,
      CASE WHEN pos = 1 THEN '' ELSE 'O.Clerk' || left(o_orderpriority, 1) END AS actor_name,
      CASE WHEN pos = 0 THEN CAST(floor(o_totalprice / 1000) AS INTEGER) - CAST(o_custkey AS INTEGER) ELSE 0 END AS margin,
      o_orderpriority AS location, 1 AS video_available
    FROM t WHERE event_type = 'Foul'""",
)
def nested_flatten(spark, sf):
    parsed = D.from_text(session_documents(spark, sf), "text", schemas.SESSION)
    return D.flatten_sessions(parsed).select("game_id", "pos", "event_num", "actor_name", "margin", "location", "video_available")


def session_documents(spark, sf):
    """One JSON text per order, with its status."""
    orders = roles.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    actor = F.concat(F.lit("Smith S.FOUL (P1.T1) (O.Clerk"), F.substring("o_orderpriority", 1, 1), F.lit(")"))

    def action(n, kind, description, home, away):
        return F.struct(
            F.lit(n).alias("actionNumber"), kind.alias("actionType"), F.lit("Shooting").alias("subType"),
            description.alias("description"), home.alias("scoreHome"), away.alias("scoreAway"),
            F.col("o_orderpriority").alias("location"), F.lit(1).alias("videoAvailable"),
        )

    home = F.floor(F.col("o_totalprice") / 1000).cast("string")
    away = F.col("o_custkey").cast("string")
    second = F.when(F.col("o_orderstatus") == "P", "Foul").otherwise("Free Throw")
    doc = F.struct(
        F.struct(
            F.col("o_orderkey").cast("string").alias("gameId"),
            F.array(
                action(1, F.lit("Foul"), actor, home, away),
                action(2, second, F.lit("Smith FOUL (P1.T1)"), F.lit(""), F.lit("x")),
                action(3, F.lit("Rebound"), F.lit("Smith REBOUND"), F.lit("0"), F.lit("0")),
            ).alias("actions"),
        ).alias("game")
    )
    return orders.select("o_orderstatus", F.to_json(doc).alias("text"))


@query(
    "envelope_rows",
    f"""SELECT c_custkey, 0 AS row_pos, c_name AS player_name, {r('c_acctbal')} AS fta, CAST(c_nationkey AS BIGINT) AS team_id FROM customer
        UNION ALL SELECT c_custkey, 1, c_mktsegment, 0.0, CAST(c_nationkey AS BIGINT) FROM customer""",
)
def envelope_rows(spark, sf):
    """Half of the envelopes hold one object under the singular key, half a list."""
    c = roles.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment")
    result = F.struct(
        F.array(F.lit("PLAYER_NAME"), F.lit("FTA"), F.lit("TEAM_ID")).alias("headers"),
        F.array(
            F.array("c_name", F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string")),
            F.array("c_mktsegment", F.lit("DNP"), F.col("c_nationkey").cast("string")),
        ).alias("rowSet"),
    )
    text = F.when(F.col("c_acctbal") >= 5000, F.to_json(F.struct(F.array(result).alias("resultSets")))).otherwise(
        F.to_json(F.struct(result.alias("resultSet")))
    )
    rows = D.envelope_rows(c.select("c_custkey", text.alias("text")), "text", ["c_custkey"])
    return rounded(
        rows.select(
            "c_custkey", "row_pos", F.col("row")["PLAYER_NAME"].alias("player_name"),
            to_number(F.col("row")["FTA"]).alias("fta"), F.col("row")["TEAM_ID"].try_cast("bigint").alias("team_id"),
        )
    )


@query(
    "coerce_numeric",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_quantity,
          CASE WHEN l_linestatus = 'O' THEN CASE l_returnflag WHEN 'A' THEN 'DNP' WHEN 'N' THEN '' ELSE 'NaN' END
               ELSE CAST(l_quantity AS VARCHAR) END AS text FROM lineitem)
        SELECT text, count(*) AS n_rows,
          {r("sum(CASE WHEN isnan(coalesce(TRY_CAST(text AS DOUBLE), 0)) THEN 0 ELSE coalesce(TRY_CAST(text AS DOUBLE), 0) END)")} AS total,
          count(CASE WHEN NOT isnan(TRY_CAST(text AS DOUBLE)) THEN 1 END) AS n_numbers,
          CAST(sum(coalesce(TRY_CAST(text AS INTEGER), 0)) AS BIGINT) AS score_total
        FROM t GROUP BY 1""",
)
def coerce_numeric(spark, sf):
    text = F.when(
        F.col("l_linestatus") == "O",
        F.when(F.col("l_returnflag") == "A", "DNP").when(F.col("l_returnflag") == "N", "").otherwise("NaN"),
    ).otherwise(F.col("l_quantity").cast("string"))
    rows = roles.table(spark, sf, "lineitem").select(text.alias("text"))
    out = rows.groupBy("text").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(to_number("text")).alias("total"),
        F.count(to_number("text", None)).alias("n_numbers"),
        F.sum(F.coalesce(F.col("text").try_cast("double").try_cast("int"), F.lit(0))).alias("score_total"),
    )
    return rounded(out)


@query(
    "coverage_report",
    f"""WITH c AS (SELECT count(*) AS n, avg(CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0.0 END) AS cov,
          avg(CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NOT NULL THEN 1.0 ELSE 0.0 END) AS seg,
          avg(CASE WHEN c_name IS NOT NULL THEN 1.0 ELSE 0.0 END) AS nm FROM customer)
        SELECT n, 'cov' AS column_name, {r('cov')} AS filled_share FROM c UNION ALL
        SELECT n, 'segment', {r('seg')} FROM c UNION ALL SELECT n, 'name', {r('nm')} FROM c""",
)
def coverage_report(spark, sf):
    c = roles.table(spark, sf, "customer").select(
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("cov"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"), F.col("c_name").alias("name"),
    )
    return rounded(S.coverage_report(c, ["cov", "segment", "name"]))


AUDIT_DOC = """(SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS d, o_custkey FROM orders)"""


def audit_documents(spark, sf):
    o = roles.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", "o_orderdate")

    def event(decision, player):
        return F.struct(
            F.lit("Q4").alias("PeriodName"), F.col("o_orderpriority").alias("CallType"), decision.alias("CallRatingName"),
            player.alias("CP"), F.lit("D&#39;A &amp; Jos&eacute;").alias("DP"),
        )

    first = F.when(F.col("o_orderstatus") == "F", " inc ").when(F.col("o_orderstatus") == "P", "CC").otherwise("cnc")
    second = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("ic")).otherwise(F.lit(None).cast("string"))
    events = F.when(
        F.col("o_orderpriority") == "5-LOW", F.array().cast("array<struct<PeriodName:string,CallType:string,CallRatingName:string,CP:string,DP:string>>")
    ).otherwise(F.array(event(first, F.concat(F.lit("&quot;C"), F.col("o_custkey").cast("string"), F.lit("&quot;"))), event(second, F.lit("x"))))
    game = F.array(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("GameDate"), F.lit("H").alias("Home_team")))
    text = F.to_json(F.struct(game.alias("game"), events.alias("l2m")))
    return D.from_text(o.select(F.col("o_orderkey").alias("game_id"), text.alias("text")), "text", schemas.AUDIT)


@query(
    "audit_flatten",
    """WITH e AS (SELECT o_orderkey AS game_id, o_orderpriority AS call_type, unnest([0, 1]) AS event_index, o_orderstatus, o_custkey
                  FROM orders WHERE o_orderpriority <> '5-LOW')
       SELECT game_id, CAST(event_index AS INTEGER) AS event_index, call_type,
         CASE WHEN event_index = 1 THEN CASE WHEN call_type = '1-URGENT' THEN 'IC' ELSE '' END
              ELSE CASE o_orderstatus WHEN 'F' THEN 'INC' WHEN 'P' THEN 'CC' ELSE 'CNC' END END AS review_decision,
         CASE WHEN event_index = 1 THEN CAST(call_type = '1-URGENT' AS INTEGER) ELSE CAST(o_orderstatus = 'F' AS INTEGER) END AS incorrect,
         CASE WHEN event_index = 1 THEN 'x' ELSE '"C' || o_custkey || '"' END AS committing_player, 'D''A & José' AS disadvantaged_player
       FROM e""",
)
def audit_flatten(spark, sf):
    out = D.audit_events(audit_documents(spark, sf), ["game_id"])
    return out.select("game_id", "event_index", "call_type", "review_decision", "incorrect", "committing_player", "disadvantaged_player")


@query(
    "audit_report",
    """SELECT o_orderkey AS game_id, strftime(o_orderdate, '%Y-%m-%d') AS game_date, 'H' AS home_team,
         CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 2 END AS event_count,
         CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE CAST(o_orderstatus = 'F' AS INTEGER) + CAST(o_orderpriority = '1-URGENT' AS INTEGER) END AS incorrect_count,
         CAST(o_orderpriority <> '5-LOW' AS INTEGER) AS has_report FROM orders""",
)
def audit_report(spark, sf):
    return D.audit_reports(audit_documents(spark, sf), ["game_id"]).drop("away_team")


@query(
    "html_ids",
    """WITH f AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS ids FROM pages),
       u AS (SELECT page_id, unnest(ids) AS found_id, generate_subscripts(ids, 1) - 1 AS pos FROM f)
       SELECT page_id, found_id, CAST(min(pos) AS INTEGER) AS first_pos FROM u GROUP BY ALL""",
)
def html_ids(spark, sf):
    pages = roles.table(spark, sf, "pages").select("page_id", "html")
    return D.link_ids(pages, ["page_id"], "html", 'href="([^"]*)"')


@query(
    "html_embedded",
    """WITH p AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, unnest([0, 1, 2]) AS pos FROM pages)
       SELECT page_id, page_id * 10 + pos AS official_id, CASE WHEN pos = 2 THEN '' ELSE 'N ' || lang END AS official_name,
         CASE pos WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE '' END AS first_name, lang AS last_name, CAST(pos AS VARCHAR) AS jersey_num,
         CASE pos WHEN 0 THEN 'crew_chief' WHEN 1 THEN 'official_2' ELSE 'official_3' END AS role FROM p""",
)
def html_embedded(spark, sf):
    """A JSON block is written into each whole page and found again."""
    pages = roles.table(spark, sf, "pages").select("page_id", "html", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))

    def person(pos, first, named):
        return F.struct(
            (F.col("page_id") * 10 + pos).alias("personId"),
            (F.concat(F.lit("N "), F.col("lang")) if named else F.lit(None).cast("string")).alias("name"),
            F.lit(first).cast("string").alias("firstName"), F.col("lang").alias("familyName"), F.lit(f" {pos} ").alias("jerseyNum"),
        )

    team = F.array(person(0, "A", True), person(1, "B", True), person(2, None, False))
    data = F.to_json(F.struct(F.struct(F.struct(F.struct(team.alias("officials")).alias("game")).alias("pageProps")).alias("props")))
    html = F.concat("html", F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>"))
    return D.page_team(pages.select("page_id", html.alias("html")), ["page_id"], "html")


@query(
    "incremental_new",
    """SELECT o_orderkey AS session_id, o_orderstatus AS status FROM orders n
       WHERE NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_orderdate < TIMESTAMP '1999-01-01' AND e.o_orderkey = n.o_orderkey)""",
)
def incremental_new(spark, sf):
    """What an append would add to a table that holds the sessions before 1999."""
    orders = roles.table(spark, sf, "orders")
    incoming = orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("status"))
    existing = orders.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("session_id"))
    return S.only_new(incoming, existing, ["session_id"])


@query(
    "map_explode",
    "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS INTEGER) AS value FROM events",
)
def map_explode(spark, sf):
    return D.keyed_map(roles.table(spark, sf, "events").select("event_id", "props"), ["event_id"], "props", "int")


@query(
    "parse_actor",
    f"""WITH t AS (SELECT l.l_returnflag AS event_type, CASE WHEN l_linestatus = 'F' THEN {SHORT} ELSE '' END AS actor
          FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
        SELECT event_type, count(*) AS n_events, count(DISTINCT nullif(actor, '')) AS n_actors,
               {r("avg(CASE WHEN actor <> '' THEN 1.0 ELSE 0.0 END)")} AS coverage, min(nullif(actor, '')) AS first_actor FROM t GROUP BY 1""",
)
def parse_actor(spark, sf):
    """Actor names parsed out of free text; half of the texts end in another kind of note."""
    part = roles.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    supplier = roles.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    lines = roles.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    name = derive.short_name("s_name", F.expr("right(s_name, 4)"))
    tail = F.when(F.col("l_linestatus") == "F", F.concat(F.lit(" ("), name, F.lit(") "))).otherwise(F.lit(" (no call)"))
    text = lines.join(part, "l_partkey").join(supplier, "l_suppkey").select(
        F.col("l_returnflag").alias("event_type"), F.concat("p_name", F.lit(" S.EVT (P1.T2)"), tail).alias("text")
    )
    actor = text.select("event_type", derive.parse_actor("text").alias("actor"))
    named = F.nullif(F.col("actor"), F.lit(""))
    out = actor.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct(named).alias("n_actors"),
        derive.filled_share("actor").alias("coverage"), F.min(named).alias("first_actor"),
    )
    return rounded(out)


@query(
    "season_derive",
    f"""WITH t AS (SELECT o_orderkey, {ORDER_ID_SQL} AS id FROM orders)
        SELECT o_orderkey, id, CASE substr(id, 1, 3) WHEN '002' THEN 'RS' WHEN '004' THEN 'PO' END AS season_type,
          CASE substr(id, 1, 3) WHEN '004' THEN 'PO' ELSE 'RS' END AS season_type_lenient,
          2000 + CAST(substr(id, 4, 2) AS INTEGER) AS season_year,
          (2000 + CAST(substr(id, 4, 2) AS INTEGER)) || '-' || lpad(CAST((2001 + CAST(substr(id, 4, 2) AS INTEGER)) % 100 AS VARCHAR), 2, '0') AS season,
          2000 + CAST(substr(id, 4, 2) AS INTEGER) AS season_start,
          (2000 + CAST(substr(id, 4, 2) AS INTEGER)) || '-' || lpad(CAST((2001 + CAST(substr(id, 4, 2) AS INTEGER)) % 100 AS VARCHAR), 2, '0') >= '2014-15' AS covered,
          lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(10, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS padded,
          lpad(ltrim(id, '0'), 10, '0') = id OR length(id) > 10 AS round_trip
        FROM t""",
)
def season_derive(spark, sf):
    o = roles.table(spark, sf, "orders").select("o_orderkey", order_id().alias("id"))
    out = o.select(
        "o_orderkey", "id",
        derive.season_type("id").alias("season_type"),
        derive.season_type("id", "RS").alias("season_type_lenient"),
        derive.season_year("id").alias("season_year"),
        derive.season_label(derive.season_year("id")).alias("season"),
        derive.pad_id("o_orderkey").alias("padded"),
        ((derive.pad_id(F.ltrim(F.col("id"), F.lit("0"))) == F.col("id")) | (F.length("id") > 10)).alias("round_trip"),
    )
    return out.withColumn("season_start", derive.season_start("season")).withColumn("covered", F.col("season") >= "2014-15")


@query(
    "rate_variants",
    f"""SELECT l_orderkey, {r('36 * sum(l_extendedprice) / greatest(sum(m), 1)')} AS rate_floor,
          {r('36 * sum(l_extendedprice) / nullif(sum(m), 0)')} AS rate_null,
          {r('36 * sum(l_extendedprice) / CASE WHEN sum(m) = 0 THEN 1 ELSE sum(m) END')} AS rate_one
        FROM (SELECT l_orderkey, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN l_quantity * l_discount ELSE 0 END AS m FROM lineitem) GROUP BY 1""",
)
def rate_variants(spark, sf):
    """Exposure is often zero or below one unit here, so the three clamps differ."""
    m = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * F.col("l_discount")).otherwise(0.0)
    s = roles.table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", m.alias("m")).groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("y"), F.sum("m").alias("m")
    )
    return rounded(
        s.select(
            "l_orderkey", per_unit("y", "m").alias("rate_floor"), per_unit("y", "m", zero="null").alias("rate_null"),
            per_unit("y", "m", zero="one").alias("rate_one"),
        )
    )


@query(
    "safe_ratio",
    f"""WITH s AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'A') AS a FROM lineitem GROUP BY 1)
        SELECT l_orderkey, {r('CAST(r AS DOUBLE) / nullif(a, 0)')} AS ratio_null, {r('CAST(r AS DOUBLE) / greatest(a, 1)')} AS ratio_floor,
               {r('CAST(r AS DOUBLE) / CASE WHEN a = 0 THEN 1 ELSE a END')} AS ratio_one,
               {r('CAST(r AS DOUBLE) / greatest(a, 1) - CAST(a AS DOUBLE) / greatest(r, 1)')} AS delta FROM s""",
)
def safe_ratio(spark, sf):
    s = roles.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a")
    )
    return rounded(
        s.select(
            "l_orderkey", ratio("r", "a").alias("ratio_null"), ratio("r", "a", "floor1").alias("ratio_floor"),
            ratio("r", "a", "one").alias("ratio_one"), (ratio("r", "a", "floor1") - ratio("a", "r", "floor1")).alias("delta"),
        )
    )


@query(
    "decision_clean",
    """WITH t AS (SELECT CASE l_returnflag WHEN 'R' THEN ' inc ' WHEN 'A' THEN 'Ic' ELSE NULL END AS raw,
          lower(p_type) || CASE l_linestatus WHEN 'F' THEN '-fore arm ' ELSE ' knee' END AS part
        FROM lineitem JOIN part ON p_partkey = l_partkey)
       SELECT raw, part, coalesce(upper(trim(raw)), '') AS decision, CAST(coalesce(upper(trim(raw)), '') IN ('IC', 'INC') AS INTEGER) AS incorrect,
         replace(replace(upper(trim(part)), '-', '_'), ' ', '_') AS token, part LIKE '%arm%' AS is_arm, count(*) AS n FROM t GROUP BY ALL""",
)
def decision_clean(spark, sf):
    part = roles.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    lines = roles.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus").join(part, "l_partkey")
    raw = F.when(F.col("l_returnflag") == "R", " inc ").when(F.col("l_returnflag") == "A", "Ic")
    body = F.concat(F.lower("p_type"), F.when(F.col("l_linestatus") == "F", "-fore arm ").otherwise(" knee"))
    cleaned = lines.select(raw.alias("raw"), body.alias("part")).select(
        "raw", "part", derive.decision_code("raw").alias("decision"), derive.is_error_decision("raw").alias("incorrect"),
        derive.token("part").alias("token"), derive.is_arm_token("part").alias("is_arm"),
    )
    return cleaned.groupBy(*cleaned.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "html_unescape",
    """WITH t AS (SELECT page_id, html, regexp_replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS clean FROM pages)
       SELECT page_id, CAST(length(html) AS INTEGER) AS n_raw, CAST(length(clean) AS INTEGER) AS n_clean, md5(clean) AS digest FROM t""",
)
def html_unescape(spark, sf):
    pages = roles.table(spark, sf, "pages").select("page_id", "html", derive.html_unescape("html").alias("clean"))
    return pages.select(
        "page_id", F.char_length("html").alias("n_raw"), F.char_length("clean").alias("n_clean"), F.md5(F.col("clean").cast("binary")).alias("digest")
    )


@query(
    "key_slug",
    """SELECT l_orderkey || '_' || l_linenumber AS key, CAST(l_orderkey AS VARCHAR) AS session_part, CAST(l_linenumber AS VARCHAR) AS event_part,
         lower(replace(replace(p_name || ' O''' || p_type || '-' || p_brand, ' ', '_'), '''', '')) AS slug,
         lower(replace(replace(replace(p_name || ' O''' || p_type || '-' || p_brand, ' ', '_'), '''', ''), '-', '')) AS slug_plain, count(*) AS n
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
)
def key_slug(spark, sf):
    part = roles.table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat("p_name", F.lit(" O'"), "p_type", F.lit("-"), "p_brand").alias("name")
    )
    rows = roles.table(spark, sf, "lineitem").select("l_partkey", derive.composite_key("l_orderkey", "l_linenumber").alias("key")).join(part, "l_partkey")
    session, event = derive.split_key("key")
    out = rows.select(
        "key", session.alias("session_part"), event.alias("event_part"), derive.slug("name").alias("slug"), derive.slug("name", True).alias("slug_plain")
    )
    return out.groupBy("key", "session_part", "event_part", "slug", "slug_plain").agg(F.count(F.lit(1)).alias("n"))


@query(
    "anchor_window",
    f"""WITH a AS (SELECT event_id, value / 400.0 AS frac, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 0.02 ELSE 0.15 END AS half,
            60 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS total FROM events),
      w AS (SELECT *, greatest(0.0, frac - half) AS lo0, least(1.0, frac + half) AS hi0 FROM a),
      v AS (SELECT *, half IS NOT NULL AND hi0 - lo0 >= 0.05 AS ok FROM w),
      c AS (SELECT event_id, total, CASE WHEN ok THEN lo0 ELSE 0.0 END AS lo, CASE WHEN ok THEN hi0 ELSE 1.0 END AS hi FROM v),
      f AS (SELECT *, greatest(0, CAST(round_even(lo * total, 0) AS INTEGER)) AS s0, least(total - 1, CAST(round_even(hi * total, 0) AS INTEGER)) AS e0 FROM c),
      g AS (SELECT *, CASE WHEN e0 <= s0 THEN least(total - 1, s0 + 1) ELSE e0 END AS e1 FROM f),
      n AS (SELECT *, least(60, e1 - s0 + 1) AS n FROM g),
      i AS (SELECT event_id, lo, hi, s0, e1, n, unnest(range(n)) AS i FROM n WHERE n > 0),
      x AS (SELECT event_id, lo, hi, s0 + CAST(round_even(i * (e1 - s0) / CAST(greatest(1, n - 1) AS DOUBLE), 0) AS INTEGER) AS frame FROM i)
      SELECT event_id, {r('any_value(lo)')} AS lo, {r('any_value(hi)')} AS hi, count(DISTINCT frame) AS n_frames,
             CAST(min(frame) AS INTEGER) AS first_frame, CAST(max(frame) AS INTEGER) AS last_frame, CAST(sum(DISTINCT frame) AS BIGINT) AS frame_sum
      FROM x GROUP BY 1""",
)
def anchor_window(spark, sf):
    """Anchors are read from a keyed JSON map; rows without one fall back to the whole clip."""
    ev = roles.table(spark, sf, "events").select("event_id", "event_type", "value", "props")
    half = F.when(F.col("event_type") == "error", 0.02).otherwise(0.15)
    text = F.when(
        F.col("event_type") != "view",
        F.to_json(F.create_map(F.lit("a"), F.struct((F.col("value") / 400.0).alias("foul_frac"), half.alias("half_width")))),
    )
    total = 60 + F.from_json("props", "k int")["k"]
    a = ev.select("event_id", total.alias("total"), F.from_json(text, schemas.ANCHORS)["a"].alias("anchor"))
    w = a.withColumn("w", derive.anchor_window("anchor.foul_frac", "anchor.half_width")).select(
        "event_id", "w.lo", "w.hi", derive.window_frames("w.lo", "w.hi", "total").alias("frames")
    )
    out = w.filter("frames IS NOT NULL").select(
        "event_id", "lo", "hi", F.size("frames").cast("bigint").alias("n_frames"),
        F.array_min("frames").alias("first_frame"), F.array_max("frames").alias("last_frame"),
        F.aggregate("frames", F.lit(0).cast("bigint"), lambda s, f: s + f).alias("frame_sum"),
    )
    return rounded(out)


@query(
    "placeholder_detect",
    """WITH first_doc AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1),
       known AS (SELECT DISTINCT strlen(text) AS n_bytes, md5(text) AS h FROM documents JOIN first_doc USING (doc_id))
       SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes, md5(text) AS md5 FROM documents d
       WHERE EXISTS (SELECT 1 FROM known k WHERE k.n_bytes = strlen(d.text) AND k.h = md5(d.text))""",
)
def placeholder_detect(spark, sf):
    """The first document of each source plays the known placeholder."""
    docs = roles.table(spark, sf, "documents").select("doc_id", "source", "text")
    known = docs.groupBy("source").agg(F.min_by(F.struct(F.octet_length("text").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("md5")), "doc_id").alias("k")).select("k.*").distinct()
    return S.placeholders(docs.select("doc_id", "text"), "text", known, ["doc_id"]).select("doc_id", "n_bytes", "md5")
