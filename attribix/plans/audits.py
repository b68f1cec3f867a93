"""Queries over the review log, correlations, rank tests and variance analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from attribix.operators import audit as A
from attribix.operators import ordered as O
from attribix.operators import stats as S
from attribix.operators.effects import baseline_delta
from attribix.operators.teams import team_sizes
from attribix.plans import effects as FX
from attribix.plans import roles
from attribix.plans.registry import query
from attribix.plans.roles import BASE_SQL
from attribix.plans.shape import correlation_p_sql, f_p_sql, normal_p_sql, r, rounded
from attribix.session import checkpointed

DECISION_SQL = """CASE WHEN event_type = 'R' AND status = 'F' THEN 'INC' WHEN event_type = 'R' THEN 'IC'
                       WHEN event_type = 'A' THEN 'CC' ELSE 'CNC' END"""
AUDIT_SQL = f"""decided AS (SELECT session_id, {DECISION_SQL} AS decision FROM event),
dcount AS (SELECT session_id, count(*) FILTER (WHERE decision = 'CC') AS cc, count(*) FILTER (WHERE decision = 'INC') AS inc,
             count(*) FILTER (WHERE decision = 'IC') AS ic, count(*) FILTER (WHERE decision = 'CNC') AS cnc,
             count(*) FILTER (WHERE decision <> 'CNC') AS n_adjudicated,
             count(*) FILTER (WHERE decision IN ('CC', 'INC')) AS n_cc_inc
           FROM decided GROUP BY 1),
arate AS (SELECT actor_id, count(*) AS n_sessions, CAST(sum(cc) AS BIGINT) AS cc, CAST(sum(inc) AS BIGINT) AS inc,
            CAST(sum(ic) AS BIGINT) AS ic, CAST(sum(cnc) AS BIGINT) AS cnc, CAST(sum(n_adjudicated) AS BIGINT) AS n_adjudicated,
            CAST(sum(n_cc_inc) AS BIGINT) AS n_cc_inc,
            sum(inc) / CAST(greatest(sum(n_cc_inc), 1) AS DOUBLE) AS inc_rate,
            sum(ic) / CAST(greatest(sum(ic) + sum(cc), 1) AS DOUBLE) AS ic_rate,
            sum(cc) / CAST(greatest(sum(n_cc_inc), 1) AS DOUBLE) AS cc_share,
            sum(cnc) / CAST(greatest(sum(cc) + sum(inc) + sum(ic) + sum(cnc), 1) AS DOUBLE) AS cnc_rate
          FROM team JOIN dcount USING (session_id) GROUP BY 1)"""


def decision():
    target = F.col("event_type") == "R"
    return (
        F.when(target & (F.col("status") == "F"), "INC").when(target, "IC")
        .when(F.col("event_type") == "A", "CC").otherwise("CNC")
    )


def decided(spark, sf):
    return roles.events(spark, sf).select("session_id", "actor_id", decision().alias("decision"))


def audit_counts(spark, sf):
    return A.decision_counts(decided(spark, sf), "session_id", "decision")


def audit_actor(spark, sf):
    return A.actor_audit_rates(audit_counts(spark, sf), roles.team(spark, sf), "session_id", "actor_id")


@query("audit_pivot", f"{BASE_SQL}, {AUDIT_SQL} SELECT session_id, cc, inc, ic, cnc, n_adjudicated, n_cc_inc FROM dcount")
def audit_pivot(spark, sf):
    return audit_counts(spark, sf)


@query(
    "audit_rates",
    f"""{BASE_SQL}, {AUDIT_SQL} SELECT actor_id, n_sessions, cc, inc, ic, cnc, n_adjudicated, n_cc_inc,
        {r('inc_rate')} AS inc_rate, {r('ic_rate')} AS ic_rate, {r('cc_share')} AS cc_share, {r('cnc_rate')} AS cnc_rate FROM arate""",
)
def audit_rates(spark, sf):
    return rounded(audit_actor(spark, sf))


@query(
    "audit_pair_rate",
    f"""{BASE_SQL}, e AS (SELECT c.c_nationkey AS subject_id, d.session_id, {DECISION_SQL} AS decision
          FROM event d JOIN session s USING (session_id) JOIN customer c ON c.c_custkey = s.cust_id)
        SELECT subject_id, actor_id, count(*) AS n_adjudicated, {r("avg(CASE WHEN decision = 'INC' THEN 1.0 ELSE 0.0 END)")} AS inc_rate
        FROM e JOIN team USING (session_id) WHERE decision IN ('CC', 'INC') GROUP BY ALL HAVING count(*) >= 5""",
)
def audit_pair_rate(spark, sf):
    subject = (
        roles.sessions(spark, sf).select("session_id", "cust_id")
        .join(roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("cust_id"), F.col("c_nationkey").alias("subject_id")), "cust_id")
        .select("session_id", "subject_id")
    )
    ev = decided(spark, sf).join(subject, "session_id")
    return rounded(A.pair_audit_rate(ev, roles.team(spark, sf), "subject_id", "session_id", "actor_id", "decision"))


@query(
    "flag_filters",
    f"""{BASE_SQL}, d AS (SELECT session_id, pos, part_id, actor_id, exposure, {DECISION_SQL} AS decision FROM event)
        SELECT session_id, pos, part_id, actor_id, decision, CAST(decision = 'INC' AS INTEGER) AS is_inc, CAST(decision = 'CC' AS INTEGER) AS is_cc,
          CAST(decision = 'IC' AS INTEGER) AS is_ic, CAST(decision IN ('CC', 'INC') AS INTEGER) AS is_adjudicated
        FROM d JOIN (SELECT session_id FROM team GROUP BY 1 HAVING count(*) = 3) USING (session_id)
        WHERE exposure >= 10 AND actor_id IS NOT NULL""",
)
def flag_filters(spark, sf):
    three = team_sizes(roles.team(spark, sf), "session_id").filter("n_actors = 3")
    ev = roles.events(spark, sf).filter("exposure >= 10 AND actor_id IS NOT NULL").withColumn("decision", decision())
    return ev.join(three, "session_id", "left_semi").select(
        "session_id", "pos", "part_id", "actor_id", "decision", *A.decision_flags("decision")
    )


NAMES_SQL = "nm AS (SELECT DISTINCT p_brand || ' ' || p_name || ' ' || p_type AS name FROM part)"
TARGET_SQL = "tg AS (SELECT DISTINCT p_name AS target, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last FROM part)"


def _names(spark, sf):
    part = roles.table(spark, sf, "part")
    targets = part.select(F.col("p_name").alias("target")).distinct().select(
        "target", F.split_part("target", F.lit(" "), F.lit(1)).alias("first"), F.split_part("target", F.lit(" "), F.lit(2)).alias("last")
    )
    return part, targets


@query(
    "fuzzy_prefix",
    f"""WITH nm AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part), {TARGET_SQL}
        SELECT name, min(target) AS target FROM nm JOIN tg
        ON contains(name, last) AND contains(substr(name, 1, 10), substr(first, 1, 3)) GROUP BY 1""",
)
def fuzzy_prefix(spark, sf):
    part, targets = _names(spark, sf)
    names = part.select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return A.match_prefix(names, "name", targets, "first", "last", "target", "target")


@query(
    "fuzzy_contains",
    f"""WITH {NAMES_SQL}, {TARGET_SQL}
        SELECT upper(name) AS name, min(target) AS target FROM nm JOIN tg
        ON contains(lower(name), lower(last)) AND contains(lower(name), lower(first)) GROUP BY 1""",
)
def fuzzy_contains(spark, sf):
    part, targets = _names(spark, sf)
    names = part.select(F.upper(F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("name"))
    return A.match_contains(names, "name", targets, "last", "target", "target", "first")


@query(
    "fuzzy_surname",
    f"""WITH {NAMES_SQL}, {TARGET_SQL}
        SELECT upper(name) AS name, min(target) AS target FROM nm JOIN tg ON contains(lower(name), lower(last)) GROUP BY 1""",
)
def fuzzy_surname(spark, sf):
    part, targets = _names(spark, sf)
    names = part.select(F.upper(F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("name"))
    return A.match_contains(names, "name", targets, "last", "target", "target")


PAIRS = [
    ("suppressor_score", "inc_rate"), ("mean_delta", "inc_rate"), ("suppressor_score", "ic_rate"),
    ("suppressor_score", "cnc_rate"), ("mean_delta", "cc_share"),
]
MIN_CC_INC = 200
RANK_SQL = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"


def validation(spark, sf):
    """Actor roll-up joined to the audit rates. It has two readers, so it is written once."""
    merged = FX.rollup(spark, sf).join(audit_actor(spark, sf).drop("n_sessions"), "actor_id")
    return checkpointed(merged.select("actor_id", "n_cc_inc", "suppressor_score", "mean_delta", "inc_rate", "ic_rate", "cnc_rate", "cc_share"))


PEARSON_SQL = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"
Z_SQL = """zed AS (SELECT *, greatest(abs(u - na * CAST(nb AS DOUBLE) / 2) - 0.5, 0) / sqrt(na * CAST(nb AS DOUBLE) / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)"""


@query(
    "corr_matrix",
    f"""{FX.ROLLUP_SQL}, {AUDIT_SQL}, merged AS (SELECT k.*, a.n_cc_inc, a.inc_rate, a.ic_rate, a.cc_share, a.cnc_rate FROM rolled k JOIN arate a USING (actor_id)),
      scoped AS (SELECT *, false AS qualified_only FROM merged UNION ALL SELECT *, true FROM merged WHERE n_cc_inc >= {MIN_CC_INC}),
      st AS ({' UNION ALL '.join(f"SELECT qualified_only, '{x}' AS x, '{y}' AS y, CAST({x} AS DOUBLE) AS vx, CAST({y} AS DOUBLE) AS vy FROM scoped WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in PAIRS)}),
      rk AS (SELECT *, {RANK_SQL.format(by='qualified_only, x, y', v='round(vx, 9)')} AS rx, {RANK_SQL.format(by='qualified_only, x, y', v='round(vy, 9)')} AS ry FROM st),
      c AS (SELECT qualified_only, x, y, count(*) AS n, {PEARSON_SQL.format(x='vx', y='vy')} AS pearson_r, {PEARSON_SQL.format(x='rx', y='ry')} AS spearman_rho
      FROM rk GROUP BY ALL HAVING count(*) >= 10)
      SELECT qualified_only, x, y, n, {r('pearson_r')} AS pearson_r, {r('spearman_rho')} AS spearman_rho, {r(correlation_p_sql('pearson_r', 'n'))} AS pearson_p,
        {r(correlation_p_sql('spearman_rho', 'n'))} AS spearman_p FROM c""",
)
def corr_matrix(spark, sf):
    scoped = S.with_scopes(validation(spark, sf), F.col("n_cc_inc") >= MIN_CC_INC)
    stacked = S.stack_pairs(scoped, PAIRS, ["qualified_only"])
    # Ranks on values cut at nine digits: summation noise must not break a tie.
    lin = S.correlations(stacked.withColumns({"vx": F.round("vx", 9), "vy": F.round("vy", 9)}), ["qualified_only"], 10)
    return rounded(lin)


@query(
    "spearman",
    f"""{BASE_SQL}, s AS (SELECT subject_id, m, n_target FROM subject_session),
        rk AS (SELECT *, {RANK_SQL.format(by='subject_id', v='m')} AS rx, {RANK_SQL.format(by='subject_id', v='n_target')} AS ry FROM s),
        ra AS (SELECT *, {RANK_SQL.format(by='1', v='m')} AS rx, {RANK_SQL.format(by='1', v='n_target')} AS ry FROM s),
        c AS (SELECT subject_id, CAST(count(*) AS BIGINT) AS n, {PEARSON_SQL.format(x='rx', y='ry')} AS rho FROM rk GROUP BY 1 HAVING count(*) >= 5
        UNION ALL SELECT NULL, count(*), {PEARSON_SQL.format(x='rx', y='ry')} FROM ra)
        SELECT subject_id, n, {r('rho')} AS spearman_rho, {r(correlation_p_sql('rho', 'n'))} AS spearman_p FROM c""",
)
def spearman(spark, sf):
    rows = roles.subject_sessions(spark, sf).select("subject_id", "m", "n_target")
    per_subject = S.spearman(rows, "m", "n_target", ["subject_id"], 5)
    overall = S.spearman(rows, "m", "n_target").select(F.lit(None).cast("int").alias("subject_id"), "n", "spearman_rho", "spearman_p")
    return rounded(per_subject.unionByName(overall))


@query(
    "avg_rank",
    f"""SELECT DISTINCT l_returnflag AS event_type, l_quantity AS quantity, count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS n_tied,
          count(*) OVER (PARTITION BY l_returnflag) AS n_group,
          CAST({RANK_SQL.format(by='l_returnflag', v='l_quantity')} AS DOUBLE) AS avg_rank FROM lineitem""",
)
def avg_rank(spark, sf):
    rows = roles.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("event_type"), F.col("l_quantity").alias("quantity"))
    return S.average_ranks(rows, ["event_type"], "quantity")


@query(
    "mann_whitney",
    f"""{FX.RATE_SQL}, v AS (SELECT round(rate - base_rate, 6) AS v, season_type = 'PO' AS a FROM rated JOIN base USING (subject_id)),
      rk AS (SELECT v, a, {RANK_SQL.format(by='1', v='v')} AS rk, count(*) OVER (PARTITION BY v) AS t FROM v),
      s AS (SELECT count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE NOT a) AS nb, avg(v) FILTER (WHERE a) AS ma, avg(v) FILTER (WHERE NOT a) AS mb,
              median(v) FILTER (WHERE a) AS meda, median(v) FILTER (WHERE NOT a) AS medb, sum(rk) FILTER (WHERE a) AS ra, sum(t * t - 1.0) AS ties FROM rk),
      u AS (SELECT *, CASE WHEN na > 0 AND nb > 0 THEN CAST(ra AS DOUBLE) - na * (na + 1.0) / 2 END AS u, CAST(na + nb AS DOUBLE) AS n FROM s), {Z_SQL}
      SELECT na AS n_a, nb AS n_b, {r('ma')} AS mean_a, {r('mb')} AS mean_b, {r('meda')} AS median_a, {r('medb')} AS median_b, {r('u')} AS u,
        {r('z')} AS z, {r(normal_p_sql('z'))} AS p_value, false AS exact FROM zed""",
)
def mann_whitney(spark, sf):
    rates = checkpointed(FX.rated(spark, sf).select("subject_id", "season_type", "rate"))
    rows = baseline_delta(rates, "subject_id", "rate", F.col("season_type") == "RS")
    rows = checkpointed(rows.select(F.round("rate_delta", 6).alias("v"), "season_type"))
    return rounded(S.mann_whitney(rows, "v", F.col("season_type") == "PO"))


#: Both samples of a test on suppliers: those of a nation, and those of the other nations of its region.
NATION_SQL = """pairs AS (SELECT n.n_nationkey AS nation_id, s.s_acctbal AS v, s.s_nationkey = n.n_nationkey AS a
  FROM supplier s JOIN nation h ON h.n_nationkey = s.s_nationkey JOIN nation n ON n.n_regionkey = h.n_regionkey)"""


@query(
    "mann_whitney_exact",
    f"""WITH RECURSIVE {NATION_SQL},
      rk AS (SELECT nation_id, v, a, {RANK_SQL.format(by='nation_id', v='v')} AS rk, count(*) OVER (PARTITION BY nation_id, v) AS t FROM pairs),
      s AS (SELECT nation_id, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE NOT a) AS nb, avg(v) FILTER (WHERE a) AS ma, avg(v) FILTER (WHERE NOT a) AS mb,
              median(v) FILTER (WHERE a) AS meda, median(v) FILTER (WHERE NOT a) AS medb, sum(rk) FILTER (WHERE a) AS ra, sum(t * t - 1.0) AS ties FROM rk GROUP BY 1),
      u AS (SELECT *, CASE WHEN na > 0 AND nb > 0 THEN CAST(ra AS DOUBLE) - na * (na + 1.0) / 2 END AS u, CAST(na + nb AS DOUBLE) AS n,
              ties = 0 AND na BETWEEN 1 AND {S.EXACT_BELOW - 1} AND nb BETWEEN 1 AND {S.EXACT_BELOW - 1} AS exact FROM s), {Z_SQL},
      tops AS (SELECT coalesce(max(na), 0) AS most_a, coalesce(max(nb), 0) AS most_b FROM u WHERE exact),
      ways(s, i, j, w, c) AS (SELECT 0, 0, 0, 0, CAST(1 AS DOUBLE) UNION ALL
        SELECT s + 1, i, j, w, sum(c) FROM (
          SELECT s, i + 1 AS i, j, w + j AS w, c FROM ways, tops WHERE i < most_a UNION ALL SELECT s, i, j + 1, w, c FROM ways, tops WHERE j < most_b)
        GROUP BY ALL),
      every AS (SELECT i, j, sum(c) AS total FROM ways GROUP BY i, j),
      tail AS (SELECT nation_id, sum(c) / any_value(total) AS p FROM u JOIN ways ON i = na AND j = nb AND w >= greatest(u, na * nb - u) JOIN every USING (i, j)
               WHERE exact GROUP BY 1)
      SELECT nation_id, na AS n_a, nb AS n_b, {r('ma')} AS mean_a, {r('mb')} AS mean_b, {r('meda')} AS median_a, {r('medb')} AS median_b, {r('u')} AS u, {r('z')} AS z,
        {r(f"CASE WHEN exact THEN least(1, 2 * p) ELSE {normal_p_sql('z')} END")} AS p_value, exact FROM zed LEFT JOIN tail USING (nation_id)""",
)
def mann_whitney_exact(spark, sf):
    """Balances of each nation's suppliers against those of its region's other nations; small samples have exact p values."""
    nation = roles.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    home = roles.table(spark, sf, "supplier").select("s_acctbal", F.col("s_nationkey").alias("home")).join(
        nation.withColumnRenamed("n_nationkey", "home"), "home")
    pairs = home.join(nation, "n_regionkey").select(
        F.col("n_nationkey").alias("nation_id"), "s_acctbal", (F.col("home") == F.col("n_nationkey")).alias("a"))
    return rounded(S.mann_whitney(pairs, "s_acctbal", F.col("a"), ["nation_id"]))


F_SQL = "(ss_between / (n_actors - 1)) / (ss_within / (n_rows - n_actors))"
ANOVA_P = r(f_p_sql(f"({F_SQL})", "(n_actors - 1)", "(n_rows - n_actors)"))
ANOVA_OUT = f"{ANOVA_P} AS p_value, n_actors, n_rows, {r('ss_between')} AS ss_between, {r('ss_within')} AS ss_within, {r('cv')} AS cv_of_means, n_actors - 1 AS df_between, n_rows - n_actors AS df_within, {r('(ss_between / (n_actors - 1)) / (ss_within / (n_rows - n_actors))')} AS f, {r('ss_between / (ss_between + ss_within)', 6)} AS eta2"


def anova_sql(src: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""cell AS (SELECT {b}actor_id, count(*) AS n, avg(v) AS mean, var_pop(v) AS var FROM {src} GROUP BY ALL HAVING count(*) >= 30),
      grand AS (SELECT {b}sum(n * mean) / sum(n) AS g FROM cell {'GROUP BY ' + by if by else ''}),
      ss AS (SELECT {'cell.' + by + ', ' if by else ''}count(*) AS n_actors, CAST(sum(n) AS BIGINT) AS n_rows, sum(n * (mean - g) * (mean - g)) AS ss_between,
               sum(n * var) AS ss_within, stddev_samp(mean) / avg(mean) AS cv
             FROM cell {'JOIN grand USING (' + by + ')' if by else 'CROSS JOIN grand'} {'GROUP BY ' + by if by else ''})"""


def _session_types(spark, sf):
    """One row per (actor, session worked, event type) with the session's count of that type."""
    counts = roles.events(spark, sf).groupBy("session_id").agg(
        *[F.count_if(F.col("event_type") == t).cast("double").alias(t) for t in ("A", "N", "R")]
    )
    return roles.team(spark, sf).join(counts, "session_id")


@query(
    "anova_actor",
    f"""{BASE_SQL}, c AS (SELECT session_id, count(*) FILTER (WHERE event_type = 'A') AS a, count(*) FILTER (WHERE event_type = 'N') AS n,
          count(*) FILTER (WHERE event_type = 'R') AS r FROM event GROUP BY 1),
        v AS (SELECT actor_id, 'A' AS event_type, CAST(a AS DOUBLE) AS v FROM team JOIN c USING (session_id)
              UNION ALL SELECT actor_id, 'N', CAST(n AS DOUBLE) FROM team JOIN c USING (session_id)
              UNION ALL SELECT actor_id, 'R', CAST(r AS DOUBLE) FROM team JOIN c USING (session_id)),
        {anova_sql('v', 'event_type')} SELECT event_type, {ANOVA_OUT} FROM ss""",
)
def anova_actor(spark, sf):
    wide = _session_types(spark, sf)
    long = wide.select("actor_id", F.inline(F.array(*[F.struct(F.lit(t).alias("event_type"), F.col(t).alias("v")) for t in ("A", "N", "R")])))
    return rounded(S.anova(long, "actor_id", "v", ["event_type"]), eta2=6)


@query(
    "residualised_anova",
    f"""{BASE_SQL}, c AS (SELECT session_id, count(*) FILTER (WHERE event_type = 'A') AS a, count(*) FILTER (WHERE event_type = 'R') AS r FROM event GROUP BY 1),
        w AS (SELECT actor_id, CAST(r AS DOUBLE) AS y, CAST(a AS DOUBLE) AS x FROM team JOIN c USING (session_id)),
        l AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM w),
        v AS (SELECT actor_id, y - a - b * x AS v FROM w CROSS JOIN l),
        {anova_sql('v')} SELECT {ANOVA_P} AS p_value, n_actors, n_rows, {r('ss_between')} AS ss_between, {r('ss_within')} AS ss_within, n_actors - 1 AS df_between,
          n_rows - n_actors AS df_within, {r('(ss_between / (n_actors - 1)) / (ss_within / (n_rows - n_actors))')} AS f, {r('ss_between / (ss_between + ss_within)', 6)} AS eta2 FROM ss""",
)
def residualised_anova(spark, sf):
    rows = _session_types(spark, sf).select("actor_id", F.col("R").alias("y"), F.col("A").alias("x"))
    out = S.anova(S.residualise(rows, "y", "x", "v"), "actor_id", "v")
    return rounded(out.drop("cv_of_means"), eta2=6)


@query(
    "pct_range",
    f"""SELECT user_id, {r('quantile_cont(value, 0.1)')} AS p10, {r('quantile_cont(value, 0.9)')} AS p90,
        {r('quantile_cont(value, 0.9) - quantile_cont(value, 0.1)')} AS pct_range FROM events WHERE value IS NOT NULL GROUP BY 1""",
)
def pct_range(spark, sf):
    rows = roles.table(spark, sf, "events").select("user_id", "value")
    q = O.exact_quantiles(rows, ["user_id"], "value", {"p10": 0.1, "p90": 0.9})
    return rounded(q.withColumn("pct_range", F.col("p90") - F.col("p10")))


EVENT_PAIRS = [("team_mean_delta", "is_inc"), ("team_min_delta", "is_inc"), ("team_mean_delta", "is_cc")]
EVENT_SQL = f"""{FX.ADJUSTED_SQL}, lm AS (SELECT median(adj_delta) AS d FROM adjusted),
td AS (SELECT s.subject_id, s.session_id, avg(coalesce(a.adj_delta, lm.d)) AS team_mean_delta, min(coalesce(a.adj_delta, lm.d)) AS team_min_delta,
         max(coalesce(a.adj_delta, lm.d)) AS team_max_delta
       FROM subject_session s JOIN team t USING (session_id) CROSS JOIN lm
       LEFT JOIN adjusted a ON a.subject_id = s.subject_id AND a.actor_id = t.actor_id GROUP BY ALL),
ev AS (SELECT session_id, pos, part_id, actor_id, {DECISION_SQL} AS decision FROM event),
ed AS (SELECT ev.*, subject_id, round(team_mean_delta, 6) AS team_mean_delta, round(team_min_delta, 6) AS team_min_delta, round(team_max_delta, 6) AS team_max_delta,
         CAST(decision = 'INC' AS INTEGER) AS is_inc, CAST(decision = 'CC' AS INTEGER) AS is_cc, CAST(decision IN ('CC', 'INC') AS INTEGER) AS is_adjudicated
       FROM ev JOIN td USING (session_id))"""


TEAM_DELTAS = {"team_mean_delta": F.avg, "team_min_delta": F.min, "team_max_delta": F.max}


def team_deltas(spark, sf, names, counts=None):
    """The team's pair deltas of each subject session; a pair without one takes the overall median.

    The subject sessions have two readers and are written once. With ``counts`` of their events, those without any of
    them are left out.
    """
    counts = counts or {}
    rows = checkpointed(roles.subject_sessions(spark, sf, counts).select("subject_id", "session_id", "y", "m", "cov", *counts))
    team = roles.team(spark, sf)
    deltas = checkpointed(FX.adjusted(spark, sf, rows=rows, team=team).select("subject_id", "actor_id", "adj_delta"))
    league = O.exact_quantiles(deltas, [], "adj_delta", {"d": 0.5}).scalar()
    if counts:
        rows = rows.filter(reduce(lambda a, b: a | b, [F.col(n) > 0 for n in counts]))
    # The few pairs are hashed, so the many members need no sort.
    members = rows.select("subject_id", "session_id", *counts).join(team, "session_id").join(
        deltas.hint("shuffle_hash"), ["subject_id", "actor_id"], "left")
    value = F.coalesce(F.col("adj_delta"), F.col("league"))
    per_team = members.withColumn("league", league).groupBy("subject_id", "session_id").agg(
        *[TEAM_DELTAS[n](value).alias(n) for n in names], *[F.max(n).alias(n) for n in counts])
    return per_team.withColumns({n: F.round(n, 6) for n in names})


def event_deltas(spark, sf):
    """Reviewed events with their team's pair deltas. The team is summed up once per subject session, before the events are joined."""
    ev = roles.events(spark, sf).withColumn("decision", decision())
    return ev.join(team_deltas(spark, sf, list(TEAM_DELTAS)), "session_id").select(
        "subject_id", "session_id", "pos", "part_id", "actor_id", *TEAM_DELTAS, *A.decision_flags("decision")
    )


@query(
    "audit_event_deltas",
    f"""{EVENT_SQL} SELECT subject_id, session_id, pos, part_id, actor_id, {r('team_mean_delta', 3)} AS team_mean_delta, {r('team_min_delta', 3)} AS team_min_delta,
        {r('team_max_delta', 3)} AS team_max_delta, is_inc, is_cc, is_adjudicated FROM ed""",
)
def audit_event_deltas(spark, sf):
    return rounded(event_deltas(spark, sf).drop("is_ic"), 3)


@query(
    "audit_event_corr",
    f"""{EVENT_SQL}, st AS ({' UNION ALL '.join(f"SELECT '{x}' AS x, '{y}' AS y, CAST({x} AS DOUBLE) AS vx, CAST({y} AS DOUBLE) AS vy FROM ed WHERE is_adjudicated = 1" for x, y in EVENT_PAIRS)}),
      rk AS (SELECT *, {RANK_SQL.format(by='x, y', v='vx')} AS rx, {RANK_SQL.format(by='x, y', v='vy')} AS ry FROM st),
      c AS (SELECT x, y, count(*) AS n, {PEARSON_SQL.format(x='vx', y='vy')} AS pearson_r, {PEARSON_SQL.format(x='rx', y='ry')} AS spearman_rho
      FROM rk GROUP BY ALL HAVING count(*) >= 30)
      SELECT x, y, n, {r('pearson_r')} AS pearson_r, {r('spearman_rho')} AS spearman_rho, {r(correlation_p_sql('pearson_r', 'n'))} AS pearson_p,
        {r(correlation_p_sql('spearman_rho', 'n'))} AS spearman_p FROM c""",
)
def audit_event_corr(spark, sf):
    """Adjudicated events are counted per session, so that none is joined: each session gives its value and the events of either kind."""
    rows = team_deltas(spark, sf, ["team_mean_delta", "team_min_delta"], {"is_inc": decision() == "INC", "is_cc": decision() == "CC"})
    return rounded(S.counted_correlations(checkpointed(S.stack_flag_counts(rows, EVENT_PAIRS, ["is_inc", "is_cc"])), 30))
