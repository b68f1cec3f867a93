"""Rank tests, tails, variance analysis, review rates and name matching."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from attribix.functions import tails
from attribix.operators import audit as A
from attribix.operators import stats as S


def test_tails_match_published_tables(spark):
    """Critical values as printed in tables of the t, F, normal and correlation distributions, and closed forms."""
    lit = lambda *v: [F.lit(float(x)) for x in v]
    cases = [
        (tails.t_two_sided(*lit(2.228, 10)), 0.05, 2e-5), (tails.t_two_sided(*lit(12.706, 1)), 0.05, 1e-5), (tails.t_two_sided(*lit(3.169, 10)), 0.01, 1e-5),
        (tails.t_two_sided(*lit(1.9602, 100_000)), 0.05, 1e-4), (tails.t_two_sided(*lit(0, 5)), 1.0, 1e-9), (tails.t_two_sided(*lit(1, 1)), 0.5, 1e-9),
        (tails.p_f(*lit(4.1028, 2, 10)), 0.05, 1e-4), (tails.p_f(*lit(2.5336, 5, 30)), 0.05, 2e-4), (tails.p_f(*lit(3.6990, 5, 30)), 0.01, 1e-4),
        (tails.p_f(*lit(3, 2, 2)), 0.25, 1e-9), (tails.p_f(*lit(1, 5000, 5000)), 0.5, 1e-9), (tails.p_f(*lit(0, 3, 3)), 1.0, 1e-9),
        (tails.p_normal(*lit(1.959964)), 0.05, 1e-7), (tails.p_normal(*lit(-2.575829)), 0.01, 1e-7), (tails.p_normal(*lit(0)), 1.0, 1e-9),
        (tails.p_normal(*lit(30)), 0.0, 1e-15), (tails.p_normal(*lit(5)), 5.7330e-7, 1e-10),
        (tails.p_correlation(*lit(0.632, 10)), 0.05, 5e-4), (tails.p_correlation(*lit(1, 5)), 0.0, 0), (tails.p_correlation(*lit(0.5, 3)), 2 / 3, 1e-9),
        (tails.p_correlation(*lit(0.01, 1_000_000)), 1.5e-23, 1e-23),
    ]
    got = spark.range(1).select(*[c.cast("double").alias(f"c{i}") for i, (c, _, _) in enumerate(cases)]).first()
    for value, (_, want, within) in zip(got, cases, strict=True):
        assert value == pytest.approx(want, abs=within), want
    none = spark.range(1).select(
        tails.p_correlation(F.lit(0.5), F.lit(2)), tails.p_f(F.lit(None), F.lit(1), F.lit(1)), tails.p_normal(F.lit(None)), tails.p_f(F.lit(1.0), F.lit(0), F.lit(9))).first()
    assert list(none) == [None] * 4


def test_exact_rank_test_against_all_arrangements(spark):
    """Every split of few values in two, in groups; ties and larger samples take the approximation."""
    rnd = random.Random(7)
    groups = {g: ([rnd.random() for _ in range(n)], [rnd.random() for _ in range(m)]) for g, (n, m) in enumerate([(1, 1), (3, 4), (5, 5), (2, 9), (1, 6)])}
    rows = [(g, x, True) for g, (a, _) in groups.items() for x in a] + [(g, x, False) for g, (_, b) in groups.items() for x in b]
    rows += [(90, 1.0, True), (90, 1.0, False), (90, 2.0, False)]
    rows += [(91, rnd.random(), i % 2 == 0) for i in range(100)]
    got = {r.g: r for r in S.mann_whitney(spark.createDataFrame(rows, "g int, v double, a boolean"), "v", F.col("a"), ["g"]).collect()}
    for g, (a, b) in groups.items():
        both, n = sorted(a + b), len(a)
        u_of = lambda chosen: sum(x > y for x in chosen for y in set(both) - set(chosen))
        middle, u = n * len(b) / 2, u_of(a)
        every = [u_of(c) for c in combinations(both, n)]
        want = sum(abs(w - middle) >= abs(u - middle) for w in every) / len(every)
        assert got[g].exact and got[g].u == u and got[g].p_value == pytest.approx(min(1, want))
    assert not got[90].exact and not got[91].exact and 0 <= got[91].p_value <= 1


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_spearman_and_pearson_with_ties(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), float(rnd.randint(0, 6)), float(rnd.randint(0, 9))) for _ in range(120)] + [("c", 1.0, float(i)) for i in range(6)] + [("d", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in S.spearman(df, "x", "y", ["g"], 5).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"].spearman_rho is None
    for g in "ab":
        x, y = np.array([r[1:] for r in rows if r[0] == g]).T
        assert got[g].spearman_rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    st = S.stack_pairs(S.with_scopes(df, F.col("g") == "a"), [("x", "y"), ("y", "x")], ["qualified_only"])
    full = {(r.qualified_only, r.x): r for r in S.correlations(st, ["qualified_only"], 10).collect()}
    x, y = np.array([r[1:] for r in rows]).T
    assert full[(False, "x")].pearson_r == pytest.approx(np.corrcoef(x, y)[0, 1]) and full[(False, "x")].n == len(rows)
    assert full[(True, "y")].n == sum(r[0] == "a" for r in rows)
    assert 0 <= full[(False, "x")].pearson_p <= 1


def test_mann_whitney(spark):
    a, b = [1.1, 2.2, 2.2, 3.0, 9.0, 4.0], [2.2, 0.5, 0.7, 1.1, 3.0]
    df = spark.createDataFrame([(x, True) for x in a] + [(x, False) for x in b] + [(None, True)], "v double, a boolean")
    got = S.mann_whitney(df, "v", F.col("a")).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    both = np.array(a + b)
    n = len(both)
    ties = sum(c**3 - c for c in np.unique(both, return_counts=True)[1])
    sd = np.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got.u == u and got.z == pytest.approx((abs(u - 15) - 0.5) / sd)
    assert (got.median_a, got.median_b, got.n_a, got.n_b) == (np.median(a), np.median(b), 6, 5)
    same = spark.createDataFrame([(1.0, True), (1.0, False)], "v double, a boolean")
    assert S.mann_whitney(same, "v", F.col("a")).first().z is None


def test_anova_and_residuals(spark):
    g = np.random.default_rng(4)
    rows = [(f"r{i}", float(g.normal(i, 2)), float(g.normal())) for i in range(3) for _ in range(40)] + [("few", 100.0, 0.0)] * 5
    df = spark.createDataFrame(rows, "actor string, y double, x double")
    got = S.anova(df, "actor", "y").first()
    groups = [np.array([r[1] for r in rows if r[0] == f"r{i}"]) for i in range(3)]
    grand = np.concatenate(groups).mean()
    ssb, ssw = sum(len(v) * (v.mean() - grand) ** 2 for v in groups), sum(((v - v.mean()) ** 2).sum() for v in groups)
    assert got.f == pytest.approx(ssb / 2 / (ssw / 117)) and got.eta2 == pytest.approx(ssb / (ssb + ssw)) and got.n_actors == 3
    assert got.p_value < 0.01
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    slope, icept = np.polyfit(x, y, 1)
    res = sorted(r.e for r in S.residualise(df, "y", "x", "e").collect())
    assert np.allclose(res, sorted(y - icept - slope * x))


def test_audit_rates_have_every_column(spark):
    ev = spark.createDataFrame([(1, "CC"), (1, "CC"), (1, "INC"), (2, "CC")], "session int, d string")
    counts = A.decision_counts(ev, "session", "d")
    assert {r.session: (r.cc, r.inc, r.ic, r.cnc, r.n_adjudicated, r.n_cc_inc) for r in counts.collect()} == {1: (2, 1, 0, 0, 3, 3), 2: (1, 0, 0, 0, 1, 1)}
    team = spark.createDataFrame([(1, "r"), (2, "r"), (3, "q")], "session int, actor string")
    got = A.actor_audit_rates(counts, team, "session", "actor").collect()
    assert [(r.actor, r.inc_rate, r.ic_rate, r.n_sessions) for r in got] == [("r", 0.25, 0.0, 2)]
    flags = ev.select(*A.decision_flags("d")).groupBy().sum().first()
    assert tuple(flags) == (1, 3, 0, 4)


def test_name_matching_against_nested_loop(spark):
    rnd = random.Random(3)
    firsts, lasts = ["Al", "Bo", "Alina", "Karl", "Joel", "De"], ["Li", "O", "Embry", "Town", "Fox", "Embr"]
    targets = sorted({f"{rnd.choice(firsts)} {rnd.choice(lasts)}" for _ in range(25)})
    names = [f"{rnd.choice(['', 'X', 'Mr '])}{rnd.choice(firsts)}{rnd.choice([' ', '-', ' van '])}{rnd.choice(lasts)}{rnd.choice(['', ' Jr'])}" for _ in range(150)]
    t = spark.createDataFrame([(i, x, x.split()[0], x.split()[-1]) for i, x in enumerate(targets)], "o int, target string, first string, last string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {r.name: r.target for r in A.match_prefix(n, "name", t, "first", "last", "o", "target").collect()}
    want = {}
    for x in names:
        for y in targets:
            if y.split()[-1] in x and y.split()[0][:3] in x[:10]:
                want.setdefault(x, y)
    assert got == want
    got = {r.name: r.target for r in A.match_contains(n, "name", t, "last", "o", "target", "first").collect()}
    want = {}
    for x in names:
        for y in targets:
            if y.split()[-1].lower() in x.lower() and y.split()[0].lower() in x.lower():
                want.setdefault(x, y)
    assert got == want


def test_counted_correlations_equal_those_of_the_rows(spark):
    """Rows that stand for several ones against the same rows written out; a constant has no correlation."""
    g = random.Random(3)
    rows = [(g.choice([None, 0.1, 0.7, 1e6 + 0.1]), 0.1, g.randrange(4), g.randrange(3)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a double, k double, p int, q int")
    pairs = [("a", "p"), ("k", "p"), ("a", "q")]
    long = [(a, k, int(kind == "p"), int(kind == "q")) for a, k, p, q in rows for kind, n in (("p", p), ("q", q)) for _ in range(n)]
    want = S.correlations(S.stack_pairs(spark.createDataFrame(long, "a double, k double, p int, q int"), pairs), [], 5)
    got = S.counted_correlations(S.stack_flag_counts(df, pairs, ["p", "q"]), 5)
    names = ["n", "pearson_r", "spearman_rho", "pearson_p", "spearman_p"]
    a, b = [{(r.x, r.y): [r[c] for c in names] for r in d.collect()} for d in (got, want)]
    assert len(b) == 3 and a.keys() == b.keys() and b["k", "p"][1] is None
    for key in b:
        assert a[key] == [v if v is None else pytest.approx(v, abs=1e-12) for v in b[key]], key
