"""With/without effects, profiles and roll-ups on hand-made rows and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attribix.operators import effects as E
from attribix.operators import profiles as P

ROWS = "subject string, session int, season int, period string, y double, m double, cov double"


def world(seed=7, n=160):
    rnd = random.Random(seed)
    rows, team = [], []
    for s in range(n):
        subject = "star" if rnd.random() < 0.5 else rnd.choice(["a", "b"])
        rows.append((subject, s, 2010 + s % 5, rnd.choice(["RS", "RS", "PO"]), float(rnd.randint(0, 12)), float(rnd.choice([0, 0.5, 20, 36])), rnd.choice([None, 100.0, 110.0])))
        if s % 11:
            team += [(s, x) for x in rnd.sample(["r1", "r2", "r3", "r4", "r5"], rnd.choice([2, 3, 4]))]
    return rows, team


def sums(spark, rows, team, **kw):
    return E.with_without_sums(
        spark.createDataFrame(rows, ROWS), spark.createDataFrame(team, "session int, actor string"),
        "subject", "session", "actor", "y", "m", "cov", **kw,
    )


@pytest.mark.parametrize("need_team", [True, False])
def test_adjusted_delta_against_rescan(spark, need_team):
    rows, team = world()
    got = {(r.subject, r.actor): r for r in E.adjusted_delta(sums(spark, rows, team, need_team=need_team), 5).collect()}
    member = {}
    for s, a in team:
        member.setdefault(s, set()).add(a)
    want = 0
    for subject in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == subject and (not need_team or r[1] in member)]
        for actor in ("r1", "r2", "r3", "r4", "r5"):
            yes = [r for r in mine if actor in member.get(r[1], ())]
            no = [r for r in mine if actor not in member.get(r[1], ())]
            if len(yes) < 5:
                assert (subject, actor) not in got
                continue
            want += 1

            def rate(part):
                return 36 * sum(r[4] for r in part) / max(sum(r[5] for r in part), 1)

            def cov(part):
                known = [r[6] for r in part if r[6] is not None]
                return sum(known) / len(known) if known else None

            g = got[(subject, actor)]
            assert (g.n_with, g.n_without) == (len(yes), len(no))
            assert g.raw_delta == pytest.approx(rate(yes) - rate(no))
            if cov(yes) is None or cov(no) is None:
                assert g.adj_delta is None
            else:
                assert g.adj_delta == pytest.approx(rate(yes) - rate(no) - 0.15 * (cov(yes) - cov(no)))
    assert want == len(got)


def test_missing_covariate_side_nulls_the_adjusted_delta(spark):
    rows = [("a", i, 2010, "RS", 1.0, 36.0, None if i < 5 else 100.0) for i in range(10)]
    got = E.adjusted_delta(sums(spark, rows, [(i, "r" if i < 5 else "q") for i in range(10)]), 5).filter("actor = 'r'").first()
    assert got.adj_delta is None and got.raw_delta == 0.0


def test_actor_in_every_session_has_an_empty_complement(spark):
    rows = [("a", i, 2010, "RS", 0.1 * i, 36.0, 100.0) for i in range(7)]
    got = E.adjusted_delta(sums(spark, rows, [(i, "r") for i in range(7)]), 5).first()
    assert (got.n_without, got.y_without, got.rate_without) == (0, 0.0, 0.0)


def test_duplicate_rows_are_dropped_before_totals(spark):
    rows = [("a", 1, 2010, "RS", 4.0, 36.0, None), ("a", 1, 2010, "RS", 4.0, 36.0, None), ("a", 2, 2010, "RS", 2.0, 36.0, None)]
    df = E.dedupe_sessions(spark.createDataFrame(rows, ROWS), "subject", "session", [F.col("season")])
    assert df.count() == 2


def test_missing_delta_counts_in_the_suppressor_denominator(spark):
    pairs = spark.createDataFrame([("a", "r", -1.0, -1.0), ("b", "r", None, 2.0), ("c", "r", 1.0, 0.0), ("d", "q", 1.0, 1.0)], "s string, actor string, adj_delta double, raw_delta double")
    got = {r.actor: r for r in E.actor_rollup(pairs, "s", "actor").collect()}
    assert got["r"].suppressor_score == pytest.approx(1 / 3) and got["r"].mean_delta == 0.0 and got["r"].n_pairs == 3
    assert got["q"].std_delta is None


def test_period_shift_needs_both_periods(spark):
    pairs = spark.createDataFrame([("r", "RS", 1.0), ("r", "PO", 3.0), ("q", "RS", 1.0), ("z", "PO", None), ("z", "RS", 1.0)], "actor string, period string, adj_delta double")
    got = E.period_shift(pairs, "actor", "period").collect()
    assert [(r.actor, r.rs_po_delta) for r in got] == [("r", 2.0)]


def test_profile_and_pivot(spark):
    events = spark.createDataFrame([(1, "r", "X"), (1, "r", "X"), (2, "r", "X"), (3, "q", "X"), (3, None, "X"), (1, "q", "Y")], "session int, actor string, kind string")
    sessions = spark.createDataFrame([(1, "RS"), (2, "PO"), (3, "RS"), (4, "RS"), (5, None)], "session int, period string")
    team = spark.createDataFrame([(1, "r"), (1, "q"), (2, "r"), (3, "q"), (4, "r"), (4, "r")], "session int, actor string")
    prof = P.actor_profile(events, sessions, team, "actor", "session", "period", F.col("kind") == "X")
    got = {(r.actor, r.period): (r.n_events, r.n_called, r.n_assigned, r.per_session) for r in prof.collect()}
    assert got == {("r", "RS"): (2, 1, 2, 1.0), ("r", "PO"): (1, 1, 1, 1.0), ("q", "RS"): (1, 1, 2, 0.5)}
    wide = {r.actor: r for r in P.pivot_profile(prof, "actor", "period").collect()}
    assert (wide["q"].per_session_PO, wide["q"].per_session_delta, wide["r"].total_events, wide["r"].total_sessions) == (0.0, -0.5, 3, 3)
    strict = {r.actor: r.per_session_delta for r in P.pivot_profile(prof, "actor", "period", parity=False).collect()}
    assert strict["q"] is None and strict["r"] == 0.0
    alone = {(r.actor, r.period): r.n_assigned for r in P.actor_profile(events, sessions, None, "actor", "session", "period", F.col("kind") == "X").collect()}
    assert alone[("q", "RS")] == 1


def test_name_conflicts_and_first_row(spark):
    dim = spark.createDataFrame([("A.Bell", 2, "x"), ("A.Bell", 1, "y"), ("B.Cole", 3, "z")], "name string, id int, v string")
    assert [tuple(r) for r in P.name_conflicts(dim, "name", "id").collect()] == [("A.Bell", 2)]
    got = {r.name: (r.id, r.v) for r in P.first_per_key(dim, ["name"], [F.col("id")]).collect()}
    assert got["A.Bell"] == (1, "y")


def test_row_order_does_not_matter(spark, rows):
    data, team = world(3)
    a = rows(E.adjusted_delta(sums(spark, data, team), 5).select("subject", "actor", "n_with", F.round("adj_delta", 6)))
    b = rows(E.adjusted_delta(sums(spark, data[::-1], team[::-1]), 5).select("subject", "actor", "n_with", F.round("adj_delta", 6)))
    assert a == b


def test_extreme_actors_may_be_text(spark):
    rows = [("s", "bob", 1.0), ("s", "al", 1.0), ("s", "cy", -1.0), ("s", "dee", -1.0), ("t", "x", None)]
    got = E.extreme_actors(spark.createDataFrame(rows, "s string, a string, d double"), "s", "a", "d").collect()
    assert [tuple(r) for r in got] == [("s", "cy", -1.0, "al", 1.0)]


def test_covariate_slope_is_the_one_within_subjects(spark):
    """Levels of subjects differ along the covariate the other way; the slope within them is found."""
    rng = np.random.default_rng(3)
    rows = []
    for subject in range(6):
        for _ in range(30):
            c = 10.0 * subject + rng.normal()
            rows.append((subject, float(36.0 * (500 - 40 * subject + 0.7 * c + rng.normal(0, 0.01)) / 36.0), 36.0, float(c)))
    rows += [(9, 1.0, 36.0, None), (10, 5.0, 36.0, 2.0)]
    df = spark.createDataFrame(rows, "s int, y double, m double, c double")
    got = E.covariate_slope(df, "s", "y", "m", "c").first()
    assert got.slope == pytest.approx(0.7, abs=0.01) and got.n_rows == 181 and got.n_subjects == 7
    within = {k: [r for r in rows if r[0] == k] for k in range(6)}
    rc = sum(((np.array([r[1] for r in v]) - np.mean([r[1] for r in v])) * np.array([r[3] for r in v])).sum() for v in within.values())
    cc = sum(((np.array([r[3] for r in v]) - np.mean([r[3] for r in v])) ** 2).sum() for v in within.values())
    assert got.slope == pytest.approx(rc / cc)
    assert E.covariate_slope(df.filter("s > 8"), "s", "y", "m", "c").first().slope is None
