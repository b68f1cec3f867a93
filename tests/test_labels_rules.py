"""Label merging, sampling, splits, rule tables, metrics."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attribix.operators import evaluate as E
from attribix.operators import labels as L
from attribix.operators import rules as R
from attribix.sources import documents as D


def test_priority_merge(spark):
    a = spark.createDataFrame([(1, "YES", "landing_classifier"), (2, "NO", "landing_classifier")], "k int, label string, source string")
    b = spark.createDataFrame([(1, "NO", "v3_foul_type", "n"), (3, "NO", "elsewhere", "n"), (3, "YES", "v3_foul_type", "m")], "k int, label string, source string, note string")
    merged = L.keep_by_priority(L.union_sources([a, b]), ["k"], "source", L.SOURCE_PRIORITY, [F.col("label")])
    assert {r.k: (r.label, r.note) for r in merged.collect()} == {1: ("YES", None), 2: ("NO", None), 3: ("YES", "m")}


def candidates(spark, n=400):
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        session = rnd.choice([0, 0, 0, *range(1, 90)])
        rows.append((f"k{i}", session, 2010 + session % 4 if session else 2010))
    return spark.createDataFrame(rows, "key string, session int, season int"), rows


def test_quota_sample_holds_its_caps(spark):
    df, _ = candidates(spark)
    got = L.quota_sample(df, "key", "session", "season", 60, 42).collect()
    assert len(got) == 60 == len({r.key for r in got})
    assert max(Counter(r.session for r in got).values()) <= 2
    assert min(Counter(r.season for r in got).values()) >= 15
    again = L.quota_sample(df.repartition(7), "key", "session", "season", 60, 42).collect()
    assert {r.key for r in got} == {r.key for r in again}
    other = L.quota_sample(df, "key", "session", "season", 60, 43).collect()
    assert {r.key for r in got} != {r.key for r in other}


def test_small_season_is_topped_up_from_the_others(spark):
    rows = [(f"a{i}", i, 2010) for i in range(3)] + [(f"b{i}", 100 + i, 2011) for i in range(60)]
    got = L.quota_sample(spark.createDataFrame(rows, "key string, session int, season int"), "key", "session", "season", 20, 1).collect()
    assert Counter(r.season for r in got) == {2010: 3, 2011: 17}


def test_too_few_candidates_are_all_returned(spark):
    rows = [(f"k{i}", 1, 2010) for i in range(6)]
    df = spark.createDataFrame(rows, "key string, session int, season int")
    assert L.quota_sample(df, "key", "session", "season", 6, 42, all_if_few=True).count() == 6
    assert L.quota_sample(df, "key", "session", "season", 6, 42).count() == 2


def test_split_reproduces_the_published_counts(spark):
    rows = [(i, "YES" if i < 143 else "NO") for i in range(284)] 
    got = Counter((r.label, r.fold) for r in L.stratified_split(spark.createDataFrame(rows, "k int, label string"), "k", "label").collect())
    assert got == {("YES", "train"): 114, ("NO", "train"): 113, ("YES", "val"): 29, ("NO", "val"): 28}
    one = L.stratified_split(spark.createDataFrame([(1, "a")] + [(i, "b") for i in range(2, 12)], "k int, label string"), "k", "label").collect()
    assert sum(r.fold == "val" for r in one) == 3 and len(one) == 11


def test_kfold_is_balanced(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(100)]
    got = Counter((r.label, r.fold) for r in L.stratified_kfold(spark.createDataFrame(rows, "k int, label string"), "k", "label", 5).collect())
    for label in "ab":
        sizes = [got[(label, f)] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_crosstab_and_tags(spark):
    df = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), (None, "p")], "a string, b string")
    got = {(r.a, r.b): r.n for r in L.crosstab_margins(df, "a", "b").collect()}
    assert got[("All", "All")] == 4 and got[("x", "All")] == 2 and got[("All", "p")] == 3 and got[(None, "p")] == 1
    tags = spark.createDataFrame([("b", "DRV-INIT", ""), ("b", "DRV-INIT", "BEFORE"), ("b", "CONTEST", None), (None, "CONTEST", None)], "t string, c string, w string")
    assert [r[0] for r in tags.select(L.tags_complete(["t"], "c", "w")).collect()] == [False, True, True, False]


def decide(spark, schema, texts, column):
    df = D.from_text(spark.createDataFrame([(t,) for t in texts], "t string"), "t", schema, "obs")
    return [r[0] for r in df.select(column("obs")).collect()]


def test_primary_contact_fallbacks(spark):
    def text(i, contacts='[{"shooter_motion":"ascent"},{"shooter_motion":"descent","defender_body_part":"hip"}]'):
        return '{"shot_type":"jump","contacts":%s,"primary_foul_contact_index":%s}' % (contacts, i)

    texts = [text("0"), text("1"), text("-1"), text("9"), text('"x"'), text("null"), text("0", "[]"), '{"shot_type":"drive"}', "broken", text("0", "[{}]")]
    df = D.from_text(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", R.DESCRIBE_SCHEMA, "obs")
    got = [r.d.rule for r in R.add_describe_decision(df, "obs", "d").orderBy("i").collect()]
    assert got == ["ascent_contact", "descent_body_contact", "descent_body_contact", "descent_body_contact", "ascent_contact", "ascent_contact", "no_contacts", "drive", "no_contacts", "no_contacts"]


def test_spatial_keeps_a_stated_label(spark):
    texts = ['{"landing_foul":" yes ","who_initiated_contact":"SHOOTER_JUMPED_INTO_DEFENDER"}', '{"landing_foul":"?","defender_in_landing_zone":"no"}', "{}"]
    got = decide(spark, R.SPATIAL_SCHEMA, texts, R.spatial_decision)
    assert [(g.label, g.rule, g.confidence) for g in got] == [("YES", "stated", "LOW"), ("NO", "clear_of_zone", "LOW"), ("UNCLEAR", "unclear", "LOW")]


def test_phase_flags_are_three_valued(spark):
    good = '{"gather_complete_at_contact":true,"both_hands_on_vertical_arc":true,"shooter_initiates_contact":false,"hook_or_bar_arm":false,"rising_without_release":false,"arm_direction_at_contact":"UPWARD_SHOT_ARC","could_still_abort":false,"ball_location_at_contact":"AT_RELEASE","shooter_body_state":"LANDING"}'
    texts = [good, good.replace('"could_still_abort":false,', ""), '{"hook_or_bar_arm":true}', '{"timing":"after"}', '{"phase":"in_act"}', "{}", '{"who_initiated":"DEFENDER","ball_state_at_contact":"RELEASED"}']
    got = decide(spark, R.PHASE_SCHEMA, texts, R.normal_phase)
    assert [tuple(g) for g in got] == [("IN_ACT", "DURING"), ("PRE_COMMIT", "BEFORE"), ("PRE_COMMIT", "BEFORE"), ("IN_ACT", "DURING"), ("IN_ACT", "DURING"), ("UNKNOWN", "UNKNOWN"), ("IN_ACT", "AFTER")]
    only = decide(spark, R.PHASE_SCHEMA, ['{"phase":"IN_ACT","ball_location_at_contact":"HIP"}', '{"phase":"IN_ACT","hook_or_bar_arm":false,"ball_location_at_contact":"HIP"}'], R.normal_phase)
    assert [g.phase for g in only] == ["IN_ACT", "PRE_COMMIT"]
    direct = decide(spark, R.PHASE_SCHEMA, ['{"timing":"after"}', '{"timing":"late"}'], lambda o: R.normal_phase(o, "direct"))
    assert [tuple(g) for g in direct] == [("IN_ACT", "AFTER"), ("UNKNOWN", "UNKNOWN")]


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(True, False), (False, False), (True, None)], "t boolean, p boolean")
    got = E.confusion(df, F.col("t"), F.col("p")).first()
    assert (got.tp, got.fp, got.fn, got.tn, got.n_undecided, got.precision, got.recall, got.f1) == (0, 0, 1, 1, 1, 0.0, 0.0, 0.0)
    none = E.confusion(df.withColumn("p", F.lit(None).cast("boolean")), F.col("t"), F.col("p")).first()
    assert none.n_undecided == 3 and none.accuracy == 0.0
    gates = spark.createDataFrame([(0.85, 0.7), (0.9, 0.1), (0.6, 1.0), (0.1, 1.0)], "p double, r double").select(R.gate_verdict("p", "r"))
    assert [g[0] for g in gates.collect()] == ["PASS", "PROMISING", "MARGINAL", "BELOW_BASELINE"]


def test_rule_grid_against_nested_loops(spark):
    rnd = random.Random(6)
    rows = [(rnd.random() < 0.4, rnd.choice([0.0, 0.1, 0.22, 0.5]), float(rnd.randint(0, 5)), rnd.choice([0.1, 0.2, 0.35, 0.9]), rnd.choice([0.4, 0.7, 1.0, 2.0])) for _ in range(80)]
    df = spark.createDataFrame(rows, "t boolean, z double, o double, d double, h double")
    got = {(r.zone, r.overlap, r.min_dist, r.contact_h): (r.tp, r.fp, r.fn, r.tn) for r in E.rule_grid(df, F.col("t"), "z", "o", "d", "h").collect()}
    assert len(got) == 448
    for g in itertools.product(*E.RULE_GRID.values()):
        hit = [(z > g[0] or o >= g[1] or (d < g[2] and h < g[3]), t) for t, z, o, d, h in rows]
        assert got[tuple(map(float, g))] == (hit.count((True, True)), hit.count((True, False)), hit.count((False, True)), hit.count((False, False)))
    best = E.best_grid_point(E.rule_grid(df, F.col("t"), "z", "o", "d", "h")).first()
    assert best.score == pytest.approx(max(r.score for r in E.rule_grid(df, F.col("t"), "z", "o", "d", "h").collect()))


def test_threshold_sweep_is_inclusive(spark):
    df = spark.createDataFrame([(True, 0.5), (False, 0.5), (True, 0.2)], "t boolean, s double")
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in E.threshold_sweep(df, F.col("t"), "s").collect()}
    assert got[0.5] == (1, 1, 1, 0) and got[0.55] == (0, 0, 2, 1) and len(got) == 9
