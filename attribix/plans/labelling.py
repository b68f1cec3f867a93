"""Queries over label tables, sampling, splits, rule tables and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from attribix.functions import derive
from attribix.operators import evaluate as E
from attribix.operators import labels as L
from attribix.operators import profiles as P
from attribix.operators import rules as R
from attribix.plans import roles
from attribix.plans.registry import query
from attribix.plans.shape import r, rounded
from attribix.sources import documents as D

SEED = 42
CLASS_SQL = "CASE lang WHEN 'en' THEN 'LANDING' WHEN 'fr' THEN 'CONTEST' WHEN 'de' THEN 'ARM-HOOK' END"
UNION_SQL = f"""src_a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'YES' ELSE 'NO' END AS label, NULL::VARCHAR AS note, 'landing_classifier' AS source FROM labels),
src_b AS (SELECT doc_id, CASE WHEN {CLASS_SQL} = 'LANDING' THEN 'YES' ELSE 'NO' END AS label,
            coalesce('v3 mechanism=' || {CLASS_SQL}, '') AS note, CASE WHEN source = 'src0' THEN 'other' ELSE 'v3_foul_type' END AS source FROM documents),
u AS (SELECT * FROM src_a UNION ALL SELECT * FROM src_b)"""


def doc_class():
    return F.when(F.col("lang") == "en", "LANDING").when(F.col("lang") == "fr", "CONTEST").when(F.col("lang") == "de", "ARM-HOOK")


def label_union(spark, sf):
    a = roles.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "YES").otherwise("NO").alias("label"), F.lit("landing_classifier").alias("source")
    )
    b = roles.table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("origin")).select(
        "doc_id", L.taxonomy_to_binary(doc_class()).alias("label"), L.taxonomy_note(doc_class()).alias("note"),
        F.when(F.col("origin") == "src0", "other").otherwise("v3_foul_type").alias("source"),
    )
    return L.union_sources([a, b])


@query("union_sources", f"WITH {UNION_SQL} SELECT doc_id, label, note, source FROM u")
def union_sources(spark, sf):
    return label_union(spark, sf)


@query(
    "priority_dedup",
    f"""WITH {UNION_SQL} SELECT doc_id, label, note, source FROM u QUALIFY row_number() OVER (PARTITION BY doc_id
        ORDER BY CASE source WHEN 'landing_classifier' THEN 2 WHEN 'v3_foul_type' THEN 1 ELSE 0 END DESC, label) = 1""",
)
def priority_dedup(spark, sf):
    return L.keep_by_priority(label_union(spark, sf), ["doc_id"], "source", L.SOURCE_PRIORITY, [F.col("label")])


@query("label_counts", f"WITH {UNION_SQL} SELECT source, label, count(*) AS n FROM u GROUP BY ALL")
def label_counts(spark, sf):
    return L.label_counts(label_union(spark, sf), ["source", "label"])


@query(
    "crosstab_margins",
    """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'All' ELSE l_returnflag END AS event_type,
         CASE WHEN grouping(l_linestatus) = 1 THEN 'All' ELSE l_linestatus END AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def crosstab_margins(spark, sf):
    return L.crosstab_margins(roles.events(spark, sf).select("event_type", "status"), "event_type", "status")


CANDIDATE_SQL = """c AS (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS key, l_orderkey AS session_id,
  CAST(year(o_orderdate) AS INTEGER) AS season FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')"""


def candidates(spark, sf):
    ev = roles.events(spark, sf).filter("event_type = 'R'")
    return ev.join(roles.sessions(spark, sf).select("session_id", "season"), "session_id").select(
        derive.composite_key("session_id", "pos", "part_id", "actor_id").alias("key"), "session_id", "season"
    )


@query(
    "quota_sample",
    f"""WITH {CANDIDATE_SQL}, k AS (SELECT count(DISTINCT season) AS n FROM c),
        d AS (SELECT *, md5(key || '#{SEED}') AS r FROM c),
        e AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY r, key) AS s FROM d QUALIFY s <= 2),
        q AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY r, key) AS qn FROM e)
        SELECT key, session_id, season FROM q CROSS JOIN k ORDER BY CASE WHEN qn <= 300 // k.n THEN 0 ELSE 1 END, r, key LIMIT 300""",
)
def quota_sample(spark, sf):
    return L.quota_sample(candidates(spark, sf), "key", "session_id", "season", 300, SEED)


@query(
    "stratified_split",
    f"""WITH d AS (SELECT doc_id, quality, md5(doc_id || '#{SEED}') AS r FROM labels),
        n AS (SELECT quality, count(*) AS nc FROM d GROUP BY 1),
        t AS (SELECT *, sum(nc) OVER () AS na, ceil(sum(nc) OVER () * 0.2) AS nt FROM n),
        s AS (SELECT *, nc * nt / na AS share, floor(nc * nt / na) AS base FROM t),
        q AS (SELECT quality, base + CASE WHEN row_number() OVER (ORDER BY share - base DESC, quality) <= nt - sum(base) OVER () THEN 1 ELSE 0 END AS n_val FROM s),
        k AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY r, doc_id) AS rn FROM d)
        SELECT doc_id, quality, CASE WHEN rn <= n_val THEN 'val' ELSE 'train' END AS fold FROM k JOIN q USING (quality)""",
)
def stratified_split(spark, sf):
    return L.stratified_split(roles.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.2, SEED)


@query(
    "stratified_kfold",
    f"""SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '#{SEED}'), doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents""",
)
def stratified_kfold(spark, sf):
    return L.stratified_kfold(roles.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 5, SEED)


@query(
    "set_intersect",
    f"""WITH m AS (SELECT doc_id, label FROM (WITH {UNION_SQL} SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id
          ORDER BY CASE source WHEN 'landing_classifier' THEN 2 WHEN 'v3_foul_type' THEN 1 ELSE 0 END DESC, label) = 1) WHERE source <> 'v3_foul_type'),
        v AS (SELECT doc_id FROM (SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '#{SEED}'), doc_id) - 1) % 5 AS fold FROM documents) WHERE fold = 0),
        t AS (SELECT doc_id FROM documents WHERE n_chars > 100)
        SELECT doc_id, label FROM m WHERE doc_id IN (SELECT doc_id FROM v) AND doc_id IN (SELECT doc_id FROM t)""",
)
def set_intersect(spark, sf):
    """Evaluation set: primary-source labels that are in the held-out fold and have their text."""
    merged = L.keep_by_priority(label_union(spark, sf), ["doc_id"], "source", L.SOURCE_PRIORITY, [F.col("label")])
    held = stratified_kfold(spark, sf).filter("fold = 0")
    text = roles.table(spark, sf, "documents").filter("n_chars > 100").select("doc_id")
    return (
        merged.filter("source <> 'v3_foul_type'")
        .join(held, "doc_id", "left_semi").join(text, "doc_id", "left_semi").select("doc_id", "label")
    )


@query(
    "label_complete",
    """WITH t AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'DRV-INIT' WHEN 'STANDARD' THEN 'ARM-HOOK' WHEN 'PROMO' THEN 'LANDING' ELSE 'AMB' END AS mechanism,
          CASE WHEN p_brand = 'Brand#1' THEN NULL ELSE p_brand END AS body_part, p_name AS severity, p_type AS location, CASE WHEN p_size > 25 THEN 'BEFORE' ELSE '' END AS timing FROM part)
       SELECT p_partkey, mechanism, coalesce(body_part, '') <> '' AND (mechanism NOT IN ('DRV-FINISH', 'DRV-INIT', 'ARM-HOOK') OR timing <> '') AS complete,
         CASE WHEN mechanism IN ('DRV-INIT', 'ARM-HOOK') THEN 'manufactured' WHEN mechanism = 'LANDING' THEN 'genuine' END AS class_group FROM t""",
)
def label_complete(spark, sf):
    p = roles.table(spark, sf, "part")
    t = p.select(
        "p_partkey",
        F.when(F.col("p_type") == "ECONOMY", "DRV-INIT").when(F.col("p_type") == "STANDARD", "ARM-HOOK").when(F.col("p_type") == "PROMO", "LANDING").otherwise("AMB").alias("mechanism"),
        F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("body_part"), F.col("p_name").alias("severity"),
        F.col("p_type").alias("location"), F.when(F.col("p_size") > 25, "BEFORE").otherwise("").alias("timing"),
    )
    return t.select("p_partkey", "mechanism", L.tags_complete(L.TAGS, "mechanism", "timing").alias("complete"), L.class_group("mechanism").alias("class_group"))


@query(
    "k_per_class",
    """WITH t AS (SELECT p_type, p_partkey, CASE WHEN p_size > 40 THEN p_name ELSE '' END AS note FROM part)
       SELECT p_type, p_partkey, note, CAST(row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN note = '' THEN 1 ELSE 0 END, p_partkey) AS INTEGER) AS pick FROM t QUALIFY pick <= 5""",
)
def k_per_class(spark, sf):
    rows = roles.table(spark, sf, "part").select("p_type", "p_partkey", F.when(F.col("p_size") > 40, F.col("p_name")).otherwise("").alias("note"))
    return P.top_k_per_class(rows, "p_type", [(F.col("note") == "").asc(), F.col("p_partkey").asc()], 5)


# Scored rows: every event, with a score in tenths and an undecided share.
SCORED_SQL = """scored AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS truth, l_discount * 10 AS score,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_discount * 10 >= 0.5 END AS pred, l_linestatus AS grp, l_tax AS tax FROM lineitem)"""


def scored(spark, sf):
    li = roles.table(spark, sf, "lineitem")
    score = F.col("l_discount") * 10
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("truth"), score.alias("score"),
        F.when(F.col("l_tax") != 0, score >= 0.5).alias("pred"), F.col("l_linestatus").alias("grp"), F.col("l_tax").alias("tax"),
    )


RATES_SQL = f"""{r('coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0)')} AS precision, {r('coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0)')} AS recall,
  {r('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {r('coalesce((tp + tn) / CAST(nullif(tp + fp + fn + tn, 0) AS DOUBLE), 0)')} AS accuracy"""
CONFUSION_SQL = """count(*) FILTER (WHERE pred AND truth) AS tp, count(*) FILTER (WHERE pred AND NOT truth) AS fp,
  count(*) FILTER (WHERE NOT pred AND truth) AS fn, count(*) FILTER (WHERE NOT pred AND NOT truth) AS tn, count(*) FILTER (WHERE pred IS NULL) AS n_undecided"""


@query("confusion_prf", f"WITH {SCORED_SQL}, k AS (SELECT grp, {CONFUSION_SQL} FROM scored GROUP BY 1) SELECT grp, tp, fp, fn, tn, n_undecided, {RATES_SQL} FROM k")
def confusion_prf(spark, sf):
    return rounded(E.confusion(scored(spark, sf), F.col("truth"), F.col("pred"), ["grp"]))


@query(
    "threshold_sweep",
    f"""WITH {SCORED_SQL}, th AS (SELECT unnest([{', '.join(str(t) for t in E.LONG_SWEEP)}])::DOUBLE AS threshold),
        k AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND truth) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT truth) AS fp,
              count(*) FILTER (WHERE score < threshold AND truth) AS fn, count(*) FILTER (WHERE score < threshold AND NOT truth) AS tn FROM scored CROSS JOIN th GROUP BY 1)
        SELECT threshold, tp, fp, fn, tn, {RATES_SQL} FROM k""",
)
def threshold_sweep(spark, sf):
    return E.threshold_sweep(scored(spark, sf), F.col("truth"), "score", E.LONG_SWEEP).transform(rounded)


@query(
    "gate_verdict",
    f"""WITH {SCORED_SQL}, k AS (SELECT l_suppkey AS actor_id, count(*) FILTER (WHERE pred AND truth) AS tp, count(*) FILTER (WHERE pred AND NOT truth) AS fp,
          count(*) FILTER (WHERE NOT pred AND truth) AS fn FROM scored GROUP BY 1),
        m AS (SELECT actor_id, least(1.0, 2 * coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0)) AS precision, least(1.0, 1.25 * coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0)) AS recall FROM k)
        SELECT actor_id, {r('precision')} AS precision, {r('recall')} AS recall,
          CASE WHEN precision >= 0.85 AND recall >= 0.7 THEN 'PASS' WHEN precision >= 0.7 THEN 'PROMISING' WHEN precision >= 0.55 THEN 'MARGINAL' ELSE 'BELOW_BASELINE' END AS verdict FROM m""",
)
def gate_verdict(spark, sf):
    """Rates per actor, stretched so that all four verdicts occur."""
    k = E.confusion(scored(spark, sf), F.col("truth"), F.col("pred"), ["l_suppkey"]).select(
        F.col("l_suppkey").alias("actor_id"), F.least(F.lit(1.0), 2 * F.col("precision")).alias("precision"),
        F.least(F.lit(1.0), 1.25 * F.col("recall")).alias("recall"),
    )
    return rounded(k.withColumn("verdict", R.gate_verdict("precision", "recall")))


@query(
    "error_listing",
    f"""WITH {SCORED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('score')} AS score, CASE WHEN pred THEN 'false_positive' ELSE 'false_negative' END AS error, p_name AS note
        FROM scored LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size > 10) ON p_partkey = l_partkey WHERE pred <> truth""",
)
def error_listing(spark, sf):
    notes = roles.table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("note"))
    out = E.error_listing(scored(spark, sf), notes, ["l_partkey"], F.col("truth"), F.col("pred"))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "score", "error", "note"))


@query(
    "class_accuracy",
    f"""WITH t AS (SELECT CASE l_returnflag WHEN 'A' THEN 'BEFORE' WHEN 'N' THEN 'DURING' ELSE 'AFTER' END AS gt,
            CASE WHEN l_discount < 0.03 THEN 'BEFORE' WHEN l_discount < 0.06 THEN 'DURING' ELSE 'AFTER' END AS pred FROM lineitem),
        b AS (SELECT 'three_way' AS axis, gt, pred FROM t UNION ALL
              SELECT 'binary', CASE gt WHEN 'BEFORE' THEN 'PRE_COMMIT' ELSE 'IN_ACT' END, CASE pred WHEN 'BEFORE' THEN 'PRE_COMMIT' ELSE 'IN_ACT' END FROM t)
        SELECT axis, gt, count(*) AS n, count(*) FILTER (WHERE gt = pred) AS n_correct, {r("count(*) FILTER (WHERE gt = pred) / CAST(count(*) AS DOUBLE)")} AS accuracy FROM b GROUP BY ALL""",
)
def class_accuracy(spark, sf):
    gt = F.when(F.col("l_returnflag") == "A", "BEFORE").when(F.col("l_returnflag") == "N", "DURING").otherwise("AFTER")
    pred = F.when(F.col("l_discount") < 0.03, "BEFORE").when(F.col("l_discount") < 0.06, "DURING").otherwise("AFTER")
    rows = roles.table(spark, sf, "lineitem").select(gt.alias("gt"), pred.alias("pred"))
    three = E.class_accuracy(rows, "gt", "pred").withColumn("axis", F.lit("three_way"))
    two = E.class_accuracy(rows.select(R.timing_to_phase("gt").alias("gt"), R.timing_to_phase("pred").alias("pred")), "gt", "pred")
    return rounded(three.unionByName(two.withColumn("axis", F.lit("binary"))))


GRID_SQL = """g AS (SELECT z.z AS zone, o.o AS overlap, d.d AS min_dist, h.h AS contact_h
  FROM (SELECT unnest([0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40])::DOUBLE AS z) z, (SELECT unnest([1, 2, 3, 4])::DOUBLE AS o) o,
       (SELECT unnest([0.20, 0.30, 0.40, 0.50])::DOUBLE AS d) d, (SELECT unnest([0.5, 0.7, 0.9, 1.1])::DOUBLE AS h) h)"""


@query(
    "rule_grid",
    f"""WITH t AS (SELECT l_returnflag = 'R' AS truth, l_discount * 5 AS zone, l_linenumber AS overlap, l_tax * 10 AS min_dist, l_quantity / 40 AS contact_h, count(*) AS n
          FROM lineitem GROUP BY ALL), {GRID_SQL},
        k AS (SELECT g.zone, g.overlap, g.min_dist, g.contact_h,
                coalesce(sum(n) FILTER (WHERE truth AND (t.zone > g.zone OR t.overlap - 4 >= g.overlap OR (t.min_dist < g.min_dist AND t.contact_h < g.contact_h))), 0) AS tp,
                coalesce(sum(n) FILTER (WHERE NOT truth AND (t.zone > g.zone OR t.overlap - 4 >= g.overlap OR (t.min_dist < g.min_dist AND t.contact_h < g.contact_h))), 0) AS fp,
                sum(n) FILTER (WHERE truth) AS pos FROM t CROSS JOIN g GROUP BY ALL),
        m AS (SELECT *, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, tp / CAST(pos AS DOUBLE) AS recall FROM k)
        SELECT zone, overlap, min_dist, contact_h, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {r('precision')} AS precision, {r('recall')} AS recall,
          {r('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) - 0.1 * greatest(0, 0.6 - precision)')} AS score FROM m""",
)
def rule_grid(spark, sf):
    li = roles.table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("truth"), (F.col("l_discount") * 5).alias("zone"), (F.col("l_linenumber") - 4).alias("overlap"),
        (F.col("l_tax") * 10).alias("min_dist"), (F.col("l_quantity") / 40).alias("contact_h"),
    )
    out = E.rule_grid(li, F.col("truth"), "zone", "overlap", "min_dist", "contact_h")
    return rounded(out.select("zone", "overlap", "min_dist", "contact_h", "tp", "fp", "precision", "recall", "score"))


GRID_HIT = "(t.zone > g.zone OR t.overlap - 4 >= g.overlap OR (t.min_dist < g.min_dist AND t.contact_h < g.contact_h))"


@query(
    "grid_holdout",
    f"""WITH t AS (SELECT l_returnflag = 'R' AS truth, l_discount * 5 AS zone, l_linenumber AS overlap, l_tax * 10 AS min_dist, l_quantity / 40 AS contact_h,
            CASE WHEN md5(l_orderkey || '#{SEED}') < '4' THEN 'val' ELSE 'train' END AS fold, count(*) AS n FROM lineitem GROUP BY ALL), {GRID_SQL},
        k AS (SELECT fold, g.zone, g.overlap, g.min_dist, g.contact_h, coalesce(sum(n) FILTER (WHERE truth AND {GRID_HIT}), 0) AS tp,
                coalesce(sum(n) FILTER (WHERE NOT truth AND {GRID_HIT}), 0) AS fp, sum(n) FILTER (WHERE truth) AS pos FROM t CROSS JOIN g GROUP BY ALL),
        m AS (SELECT *, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, tp / CAST(pos AS DOUBLE) AS recall FROM k),
        e AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m),
        b AS (SELECT zone, overlap, min_dist, contact_h FROM e WHERE fold = 'train'
              ORDER BY round(f1 - 0.1 * greatest(0, 0.6 - precision), 12) DESC, zone, overlap, min_dist, contact_h LIMIT 1)
        SELECT fold, zone, overlap, min_dist, contact_h, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {r('precision')} AS precision,
          {r('recall')} AS recall, {r('f1')} AS f1 FROM e JOIN b USING (zone, overlap, min_dist, contact_h)""",
)
def grid_holdout(spark, sf):
    """The best grid point of the training fold, and what it gives on either fold."""
    fold = F.when(F.md5(F.concat(F.col("l_orderkey").cast("string"), F.lit(f"#{SEED}")).cast("binary")) < "4", "val").otherwise("train")
    li = roles.table(spark, sf, "lineitem").select(
        fold.alias("fold"), (F.col("l_returnflag") == "R").alias("truth"), (F.col("l_discount") * 5).alias("zone"),
        (F.col("l_linenumber") - 4).alias("overlap"), (F.col("l_tax") * 10).alias("min_dist"), (F.col("l_quantity") / 40).alias("contact_h"),
    )
    grids = [
        E.rule_grid(li.filter(F.col("fold") == f), F.col("truth"), "zone", "overlap", "min_dist", "contact_h").withColumn("fold", F.lit(f))
        for f in ("train", "val")
    ]
    point = ["zone", "overlap", "min_dist", "contact_h"]
    best = E.best_grid_point(grids[0]).select(*point)
    both = grids[0].unionByName(grids[1]).join(best, point, "left_semi")
    return rounded(both.select("fold", *point, "tp", "fp", "precision", "recall", "f1"))


@query(
    "ensemble_vote",
    f"""WITH {SCORED_SQL}, v AS (SELECT truth, grp, tax >= 0.04 AS rules, score AS trees, tax * 12 AS model FROM scored),
        w AS (SELECT grp, truth, CAST(rules AS INT) + CAST(trees >= 0.5 AS INT) + CAST(model >= 0.5 AS INT) AS votes,
                CASE WHEN trees >= 0.7 THEN true WHEN trees < 0.3 THEN false ELSE model >= 0.5 END AS cascade_ FROM v),
        l AS (SELECT grp, truth, 'intersection' AS ensemble, votes = 3 AS pred FROM w UNION ALL SELECT grp, truth, 'majority', votes >= 2 FROM w
              UNION ALL SELECT grp, truth, 'cascade', cascade_ FROM w),
        k AS (SELECT grp, ensemble, {CONFUSION_SQL} FROM l GROUP BY ALL) SELECT grp, ensemble, tp, fp, fn, tn, n_undecided, {RATES_SQL} FROM k""",
)
def ensemble_vote(spark, sf):
    votes = E.ensemble(F.col("tax") >= 0.04, F.col("score"), F.col("tax") * 12)
    long = scored(spark, sf).select(
        "grp", "truth", F.inline(F.array(*[F.struct(F.lit(n).alias("ensemble"), c.alias("vote")) for n, c in votes.items()]))
    )
    return rounded(E.confusion(long, F.col("truth"), F.col("vote"), ["grp", "ensemble"]))


def coded(spark, sf, *columns):
    """One row per event: its session, and the categorical columns its answer is written from."""
    rows = roles.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"), F.col("l_linenumber").alias("ln"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tx"), F.round(F.col("l_discount") * 100).cast("int").alias("dc"),
    )
    return rows.select("ok", *columns)


CODED_SQL = """coded AS (SELECT l_orderkey AS ok, l_returnflag AS rf, l_linestatus AS ls, l_linenumber AS ln, CAST(round(l_tax * 100) AS INTEGER) AS tx,
  CAST(round(l_discount * 100) AS INTEGER) AS dc FROM lineitem)"""


def pick(name, *values, default=None):
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, text in values:
        chain = chain.when(F.col(name) == code, F.lit(text))
    return chain.otherwise(F.lit(default).cast("string"))


def pick_sql(name, *values, default=None):
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + name + " " + " ".join(f"WHEN {q(c)} THEN {q(t)}" for c, t in values) + f" ELSE {q(default) if default is not None else 'NULL'} END"


SHOT = (("A", "jump shot"), ("N", " Layup "), ("R", "JUMP-SHOT"))
MOTION = ((1, "ascent"), (2, "Descent"), (3, "at apex"), (4, "on-ground"), (5, "AFTER_RELEASE"), (6, "unknown"))
INDEX = ((0, "0"), (1, "1"), (2, "5"), (3, "-1"), (4, "x"))


@query(
    "rule_decide",
    f"""WITH {CODED_SQL}, o AS (SELECT ok, rf, ls, ln, tx FROM coded),
        p AS (SELECT *, CASE WHEN ln = 7 THEN NULL WHEN tx IN (1, 2, 3) THEN 'DESCENT' ELSE coalesce({pick_sql('ln', *MOTION)}, '') END AS motion0,
                CASE WHEN tx IN (1, 2, 3) THEN 'hip' ELSE CASE ls WHEN 'F' THEN 'fore-arm' ELSE 'feet' END END AS part FROM o),
        t AS (SELECT *, replace(replace(upper(motion0), ' ', '_'), '-', '_') AS motion FROM p),
        d AS (SELECT *, CASE WHEN rf = 'N' THEN 'NO|HIGH|drive' WHEN motion IS NULL THEN 'UNCLEAR|LOW|no_contacts'
                WHEN motion IN ('ASCENT', 'AT_APEX') THEN 'NO|HIGH|ascent_contact' WHEN part = 'fore-arm' THEN 'NO|HIGH|arm_contact'
                WHEN motion IN ('DESCENT', 'AFTER_RELEASE') THEN 'YES|HIGH|descent_body_contact' WHEN motion = 'ON_GROUND' THEN 'NO|MEDIUM|on_ground' ELSE 'UNCLEAR|LOW|unclear' END AS v FROM t)
        SELECT rf, ls, ln, tx, split_part(v, '|', 1) AS label, split_part(v, '|', 2) AS confidence, split_part(v, '|', 3) AS rule, ok FROM d""",
)
def rule_decide(spark, sf):
    """The primary contact index may be unreadable or out of range; both fall back."""
    def contact(motion, part):
        return F.struct(motion.alias("shooter_motion"), part.alias("defender_body_part"))

    contacts = F.when(F.col("ln") == 7, F.array().cast("array<struct<shooter_motion:string,defender_body_part:string>>")).otherwise(
        F.array(contact(pick("ln", *MOTION), pick("ls", ("F", "fore-arm"), default="feet")), contact(F.lit("DESCENT"), F.lit("hip")))
    )
    text = F.to_json(F.struct(pick("rf", *SHOT).alias("shot_type"), contacts.alias("contacts"), pick("tx", *INDEX).alias("primary_foul_contact_index")))
    rows = D.from_text(coded(spark, sf, "rf", "ls", "ln", "tx").withColumn("text", text), "text", R.DESCRIBE_SCHEMA, "obs")
    return R.add_describe_decision(rows, "obs", "d").select("rf", "ls", "ln", "tx", "d.*", "ok")


OBS = {
    "shot_type": ("rf", (("A", " drive"), ("N", "JUMP_SHOT"))),
    "shooter_airborne": ("ls", (("F", "yes"),)),
    "who_initiated": ("ln", ((1, "SHOOTER"), (2, "DEFENDER"), (3, "DEFENDER"), (4, "BOTH"))),
    "primary_contact_body_part": ("tx", ((0, "ARM_OR_HAND"), (1, "FEET_OR_LOWER_LEGS"), (2, "TORSO"))),
    "defender_feet_at_shooter_landing": ("dc", ((0, "DIRECTLY_UNDER"), (1, "DIRECTLY_UNDER"), (2, "NEAR_BUT_NOT_UNDER"), (3, "AWAY_FROM_LANDING"))),
    "contact_timing": ("dc", ((4, "BEFORE_RELEASE"), (5, "AT_RELEASE"), (6, "AFTER_RELEASE_DESCENDING"), (1, "AFTER_RELEASE_DESCENDING"))),
}


def observations(spark, sf, fields, keys, schema):
    text = F.to_json(F.struct(*[pick(src, *values).alias(name) for name, (src, values) in fields.items()]))
    return D.from_text(coded(spark, sf, *keys).withColumn("text", text), "text", schema, "obs")


def up_sql(fields, name):
    src, values = fields[name]
    return f"upper(trim(coalesce({pick_sql(src, *values)}, '')))"


OBS_COLS = ", ".join(f"{up_sql(OBS, n)} AS {a}" for n, a in zip(OBS, ("shot", "air", "who", "body", "feet", "timing")))


@query(
    "rule_observe",
    f"""WITH {CODED_SQL}, o AS (SELECT ok, rf, ls, ln, tx, dc FROM coded), f AS (SELECT *, {OBS_COLS} FROM o),
        d AS (SELECT *, CASE WHEN shot = 'DRIVE' OR air = 'NO' THEN 'NO|not_airborne' WHEN who = 'SHOOTER' THEN 'NO|shooter_initiated' WHEN body = 'ARM_OR_HAND' THEN 'NO|arm_contact'
           WHEN feet = 'DIRECTLY_UNDER' AND who = 'DEFENDER' AND air = 'YES' THEN 'YES|feet_under' WHEN feet IN ('NEAR_BUT_NOT_UNDER', 'AWAY_FROM_LANDING') THEN 'NO|feet_clear'
           WHEN timing IN ('BEFORE_RELEASE', 'AT_RELEASE') AND body <> 'FEET_OR_LOWER_LEGS' THEN 'NO|early_contact' ELSE 'UNCLEAR|unclear' END AS v FROM f)
        SELECT rf, ls, ln, tx, dc, ok, split_part(v, '|', 1) AS label, CASE WHEN v LIKE 'UNCLEAR%' THEN 'LOW' ELSE 'MEDIUM' END AS confidence, split_part(v, '|', 2) AS rule,
          CASE WHEN feet = 'DIRECTLY_UNDER' THEN 'YES' WHEN feet <> '' THEN 'NO' ELSE 'UNCLEAR' END AS in_zone,
          CASE WHEN timing = 'AFTER_RELEASE_DESCENDING' THEN 'DURING_DESCENT_OR_LANDING' WHEN timing <> '' THEN 'DURING_SHOT_MOTION' ELSE 'UNCLEAR' END AS vs_descent FROM d""",
)
def rule_observe(spark, sf):
    keys = ["rf", "ls", "ln", "tx", "dc"]
    rows = observations(spark, sf, OBS, keys, R.OBSERVE_SCHEMA).select(
        *keys, "ok", R.observe_decision().alias("d"), R.zone_from_feet("obs.defender_feet_at_shooter_landing").alias("in_zone"),
        R.descent_from_timing("obs.contact_timing").alias("vs_descent"),
    )
    return rows.select(*keys, "d.*", "in_zone", "vs_descent", "ok")


SPATIAL = {
    "landing_foul": ("rf", (("A", " yes "), ("N", "maybe"))),
    "shot_type": ("ls", (("F", "DRIVE"),)),
    "who_initiated_contact": ("ln", ((1, "SHOOTER_JUMPED_INTO_DEFENDER"),)),
    "whistle_timing": ("ln", ((2, "AT_OR_BEFORE_RELEASE"), (3, "DURING_DESCENT_OR_LANDING"))),
    "called_contact": ("tx", ((0, "ARM_HAND_ON_SHOOTER"), (1, "DEFENDER_FEET_BODY_UNDER_SHOOTER"))),
    "defender_position_at_landing": ("tx", ((2, "UNDER_SHOOTER"), (3, "NEAR_BUT_LEGAL"))),
    "contact_moment": ("dc", ((1, "DURING_DESCENT_OR_LANDING"),)),
    "contact_vs_descent": ("dc", ((2, "DURING_DESCENT_OR_LANDING"),)),
    "defender_in_landing_zone": ("tx", ((4, "YES"), (5, "NO"))),
    "confidence": ("ls", (("O", "high "),)),
}


@query(
    "rule_fallback",
    f"""WITH {CODED_SQL}, o AS (SELECT ok, rf, ls, ln, tx, dc FROM coded),
        d AS (SELECT *, CASE WHEN rf = 'A' THEN 'YES|stated' WHEN ln = 1 THEN 'NO|shooter_initiated' WHEN ln = 2 THEN 'NO|whistle_early' WHEN tx = 0 THEN 'NO|whistle_arm'
            WHEN tx = 1 AND ln = 3 THEN 'YES|whistle_feet' WHEN ls = 'F' THEN 'NO|shot_type' WHEN tx = 2 AND dc IN (1, 2) THEN 'YES|under_on_descent'
            WHEN tx = 4 AND dc IN (1, 2) THEN 'YES|in_zone_on_descent' WHEN tx IN (3, 5) THEN 'NO|clear_of_zone' ELSE 'UNCLEAR|unclear' END AS v FROM o)
        SELECT rf, ls, ln, tx, dc, ok, split_part(v, '|', 1) AS label, CASE ls WHEN 'O' THEN 'HIGH' ELSE 'LOW' END AS confidence, split_part(v, '|', 2) AS rule FROM d""",
)
def rule_fallback(spark, sf):
    keys = ["rf", "ls", "ln", "tx", "dc"]
    return observations(spark, sf, SPATIAL, keys, R.SPATIAL_SCHEMA).select(*keys, "ok", R.spatial_decision().alias("d")).select(*keys, "d.*", "ok")


@query(
    "rule_phase",
    f"""WITH {CODED_SQL}, o AS (SELECT ok, rf, ls, ln, tx, dc FROM coded),
        f AS (SELECT *, CASE ln WHEN 1 THEN 'SHOOTER' WHEN 2 THEN 'DEFENDER' END AS who, CASE tx WHEN 0 THEN 'RELEASED' WHEN 1 THEN 'ON_RELEASE_PATH' WHEN 2 THEN 'GATHERING' END AS ball,
                CASE dc WHEN 0 THEN 'HORIZONTAL_HOOK' WHEN 1 THEN 'VERTICAL_SHOT_ARC' END AS arm FROM o),
        p AS (SELECT *, CASE
            WHEN rf = 'A' THEN CASE WHEN who IS NULL AND ball IS NULL AND arm IS NULL THEN 'UNKNOWN'
               WHEN coalesce(who = 'SHOOTER', false) OR coalesce(arm = 'HORIZONTAL_HOOK', false) OR coalesce(ball = 'GATHERING', false) THEN 'PRE_COMMIT'
               WHEN ball = 'RELEASED' OR (ball = 'ON_RELEASE_PATH' AND arm = 'VERTICAL_SHOT_ARC') THEN 'IN_ACT' ELSE 'PRE_COMMIT' END
            WHEN rf = 'N' THEN CASE WHEN ln = 1 THEN 'PRE_COMMIT' WHEN tx = 1 THEN 'PRE_COMMIT' WHEN dc = 0 THEN 'PRE_COMMIT' WHEN ls = 'O' THEN 'IN_ACT' WHEN ln = 2 AND tx = 2 AND dc = 2 THEN 'IN_ACT' ELSE 'PRE_COMMIT' END
            ELSE CASE WHEN ln <= 2 THEN 'PRE_COMMIT' WHEN ln <= 4 THEN 'IN_ACT' ELSE 'UNKNOWN' END END AS phase FROM f)
        SELECT rf, ls, ln, tx, dc, ok, phase, CASE WHEN phase = 'PRE_COMMIT' THEN 'BEFORE' WHEN phase = 'UNKNOWN' THEN 'UNKNOWN'
          WHEN (rf = 'A' AND ball = 'RELEASED') OR (rf = 'N' AND ls = 'O') THEN 'AFTER' ELSE 'DURING' END AS timing FROM p""",
)
def rule_phase(spark, sf):
    """Three answer schemas side by side: short fields, long flag fields, and a stated timing only."""
    keys = ["rf", "ls", "ln", "tx", "dc"]

    def only(flag, value):
        return F.when(F.col("rf") == flag, value)

    def flag(name, at):
        return only("N", F.col(name) == at)

    good = (F.col("ln") == 2) & (F.col("tx") == 2) & (F.col("dc") == 2)
    text = F.to_json(
        F.struct(
            only("A", pick("ln", (1, "SHOOTER"), (2, "DEFENDER"))).alias("who_initiated"),
            only("A", pick("tx", (0, "RELEASED"), (1, "ON_RELEASE_PATH"), (2, "GATHERING"))).alias("ball_state_at_contact"),
            only("A", pick("dc", (0, "HORIZONTAL_HOOK"), (1, "VERTICAL_SHOT_ARC"))).alias("arm_geometry"),
            flag("ln", 1).alias("shooter_initiates_contact"),
            only("N", F.lit(False)).alias("hook_or_bar_arm"),
            only("N", F.lit(False)).alias("rising_without_release"),
            only("N", F.col("tx") != 1).alias("both_hands_on_vertical_arc"),
            only("N", F.lit(True)).alias("gather_complete_at_contact"),
            only("N", F.lit(False)).alias("could_still_abort"),
            only("N", pick("dc", (0, "hip"), default="above_shoulder")).alias("ball_location_at_contact"),
            only("N", F.when(good, "UPWARD_SHOT_ARC").otherwise("STRAIGHT")).alias("arm_direction_at_contact"),
            only("N", F.lit("SHOT_RELEASE")).alias("shooter_body_state"),
            only("N", F.col("ls") == "O").alias("ball_released_before_contact"),
            only("R", F.when(F.col("ln") <= 2, "before").when(F.col("ln") <= 4, "During").otherwise("late")).alias("timing"),
        )
    )
    rows = D.from_text(coded(spark, sf, *keys).withColumn("text", text), "text", R.PHASE_SCHEMA, "obs")
    return rows.select(*keys, "ok", R.normal_phase().alias("p")).select(*keys, "p.*", "ok")


@query(
    "rule_phase_direct",
    f"""WITH {CODED_SQL}, t AS (SELECT *, CASE ln WHEN 1 THEN 'BEFORE' WHEN 2 THEN 'DURING' WHEN 3 THEN 'AFTER' ELSE 'UNKNOWN' END AS timing FROM coded)
        SELECT ok, ln, mode, timing, CASE timing WHEN 'BEFORE' THEN 'PRE_COMMIT' WHEN 'UNKNOWN' THEN 'UNKNOWN' ELSE 'IN_ACT' END AS phase
        FROM t, (VALUES ('direct'), ('sequence')) m(mode)""",
)
def rule_phase_direct(spark, sf):
    """The modes that trust the stated timing: known ones decide the phase, whatever else was answered."""
    text = F.to_json(F.struct(
        pick("ln", (1, "before"), (2, "During"), (3, "AFTER"), (4, "late"), (6, "")).alias("timing"), F.lit("IN_ACT").alias("phase"),
        F.lit("SHOOTER").alias("who_initiated")))
    rows = D.from_text(coded(spark, sf, "ln").withColumn("text", text), "text", R.PHASE_SCHEMA, "obs")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), R.normal_phase(mode=m).alias("p")) for m in ("direct", "sequence")])
    return rows.select("ok", "ln", F.inline(modes)).select("ok", "ln", "mode", "p.timing", "p.phase")


@query(
    "answer_repair",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN 'UNKNOWN' ELSE 'IN_ACT' END AS phase,
         CASE WHEN event_type IN ('error', 'click') THEN 'UNKNOWN' ELSE upper(event_type) END AS timing,
         event_type IN ('error', 'click') AS failed FROM events""",
)
def answer_repair(spark, sf):
    """Objects in prose, cut off inside a string (repaired), cut off after a nested object (lost), or absent."""
    body = F.concat(F.lit('{"timing": "'), F.upper("event_type"), F.lit('", "phase": "IN_ACT"'))
    text = (
        F.when(F.col("event_type") == "error", F.lit("no answer"))
        .when(F.col("event_type") == "view", F.concat(F.lit("Sure. "), body, F.lit(', "note": "cut } off')))
        .when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), body, F.lit(', "obs": {"a": 1}, "done":')))
        .otherwise(F.concat(F.lit("Here: "), body, F.lit(', "obs": {"a": 1}} Done.')))
    )
    parsed = roles.table(spark, sf, "events").select("event_id", D.parse_answer(text, R.PHASE_SCHEMA).alias("obs"))
    unknown = F.lit("UNKNOWN")
    return parsed.select(
        "event_id", F.coalesce("obs.phase", unknown).alias("phase"), F.coalesce("obs.timing", unknown).alias("timing"), F.col("obs").isNull().alias("failed")
    )
