"""Bucketed ordered operators against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attribix.functions.numeric import order_bucket
from attribix.operators import ordered as O
from attribix.operators import sequence as Q
from attribix.plans import sequences


def skewed(n=400, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else rnd.choice("abc")
        out.append((key, i, rnd.choice([-3.5, -1.0, 0.0, 0.25, 1.0, 7.0, 1e6]), rnd.choice("XYZ")))
    return out


SCHEMA = "k string, t long, v double, kind string"


def bucket(width=37):
    return F.floor(F.col("t") / width)


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[0], r[1])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_order_bucket_never_decreases(spark):
    rnd = random.Random(3)
    vals = sorted([rnd.uniform(-1, 1) * 10 ** rnd.randint(-300, 300) for _ in range(3000)] + [0.0, 1.0, 2.0, 4.0, -4.0, np.nextafter(4.0, 0), np.nextafter(8.0, 0)])
    got = [r.b for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, v double").select("i", order_bucket("v").alias("b")).orderBy("i").collect()]
    assert all(a <= b for a, b in zip(got, got[1:]))


def test_running_totals_cross_bucket_borders(spark):
    data = skewed()
    df = spark.createDataFrame(data, SCHEMA)
    got = O.running_totals(df, ["k"], ["t"], bucket(), {"s": F.col("v"), "n": F.lit(1)}, {"n": "total"}).collect()
    found = {(r.k, r.t): (r.s, r.n, r.total) for r in got}
    assert len(found) == len(data)
    for k, rows in by_key(data).items():
        s = 0.0
        for i, r in enumerate(rows, 1):
            s += r[2]
            assert found[(k, r[1])] == (s, i, len(rows))


def test_null_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 1, 1.0, "X"), (None, 50, 2.0, "X")], SCHEMA)
    got = sorted((r.t, r.s) for r in O.running_totals(df, ["k"], ["t"], bucket(), {"s": F.col("v")}).collect())
    assert got == [(1, 1.0), (50, 3.0)]


def test_running_max(spark):
    data = skewed(seed=4)
    got = O.running_max(spark.createDataFrame(data, SCHEMA), ["k"], ["t"], bucket(), "v", "best", "prev").collect()
    found = {(r.k, r.t): (r.best, r.prev) for r in got}
    for k, rows in by_key(data).items():
        best = None
        for r in rows:
            now = r[2] if best is None else max(best, r[2])
            assert found[(k, r[1])] == (now, best)
            best = now


def test_lookahead_spans_sparse_buckets(spark):
    data = [r for r in skewed() if r[1] % 90 < 12]
    got = O.lookahead(spark.createDataFrame(data, SCHEMA), ["k"], ["t"], bucket(), ["kind", "t"], 4).collect()
    found = {(r.k, r.t): [tuple(x) for x in r.ahead] for r in got}
    for k, rows in by_key(data).items():
        for i, r in enumerate(rows):
            assert found[(k, r[1])] == [(x[3], x[1]) for x in rows[i + 1 : i + 5]]


def test_quantiles_and_ranks_match_numpy(spark):
    data = skewed(seed=9)
    df = spark.createDataFrame(data, SCHEMA)
    q = {r.k: (r.a, r.b, r.c) for r in O.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}).collect()}
    ranks = {(r.k, r.v): (r.avg_rank, r.n_tied, r.n_group) for r in O.average_ranks(df, ["k"], "v").collect()}
    for k, rows in by_key(data).items():
        v = np.array([r[2] for r in rows])
        assert np.allclose(q[k], np.percentile(v, [10, 50, 90]))
        for x in set(v):
            assert ranks[(k, x)] == ((v < x).sum() + ((v == x).sum() + 1) / 2, (v == x).sum(), len(v))


def test_longest_run(spark):
    data = skewed(seed=5)
    got = {r.k: r.longest for r in O.longest_run(spark.createDataFrame(data, SCHEMA), ["k"], ["t"], bucket(), F.col("v") > 0).collect()}
    for k, rows in by_key(data).items():
        best = run = 0
        for r in rows:
            run = run + 1 if r[2] > 0 else 0
            best = max(best, run)
        assert got[k] == best


def test_sequence_patterns(spark):
    text = {"two": "XYY", "three": "XYYY", "four": "XYYYY", "seven": "XYYYYYYY", "split": "XYYZY", "mid": "ZXYYYZX", "xx": "XXYYYX"}
    data = [(k, i, float(i), c) for k, s in text.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(data, SCHEMA)
    hits = Q.followed_by_exactly(df, ["k"], ["t"], bucket(2), "kind", "X", "Y", 3, ["t"]).collect()
    assert sorted((r.k, r.t, r.next_t) for r in hits) == [("mid", 1, 2), ("three", 0, 1), ("xx", 1, 2)]
    nxt = Q.followed_by(df, ["k"], ["t"], bucket(2), "kind", "X", "Y", "v", F.lit(1.0)).collect()
    assert sorted(r.k for r in nxt) == ["four", "seven", "split", "three", "two"]


def test_tail_slope(spark):
    data = [("a", i, float(v), "X") for i, v in enumerate([5, 1, 4, 4, 10, 0, 3])] + [("b", 0, 1.0, "X")]
    got = {r.k: (r.tail_step, r.mean_step) for r in Q.tail_slope(spark.createDataFrame(data, SCHEMA), ["k"], ["t"], "v", 5).collect()}
    assert got["a"] == (np.mean(np.diff([4, 4, 10, 0, 3])), np.mean(np.diff([5, 1, 4, 4, 10, 0, 3])))
    assert got["b"] == (None, None)


def test_closest_pair_against_all_pairs(spark):
    rnd = random.Random(11)
    data = []
    for g in range(6):
        for i in range(rnd.choice([1, 2, 3, 60, 120])):
            data.append((g, i, rnd.gauss(0, 10), rnd.gauss(0, 1)))
    data += [(9, 1, 1.0, 1.0), (9, 2, 5.0, 5.0), (9, 3, 5.0, 5.0), (9, 4, 5.0, 5.0)]
    got = {r.g: (r.i_a, r.i_b) for r in Q.closest_pair(spark.createDataFrame(data, "g int, i int, x double, y double"), ["g"], "i", "x", "y").collect()}
    want = {}
    for g in {d[0] for d in data}:
        p = [d for d in data if d[0] == g]
        pairs = [(np.hypot(a[2] - b[2], a[3] - b[3]), a[1], b[1]) for a in p for b in p if a[1] < b[1]]
        if pairs:
            want[g] = min(pairs)[1:]
    assert got == want


@pytest.mark.parametrize("n", [2000, 20000])
def test_close_pairs_stay_few(spark, n):
    """Two far rows of points that alternate in x, so that neighbours in x say nothing of the smallest distance."""
    data = [(0, i, float(i), 0.0 if i % 2 else 1e6) for i in range(n)]
    places = spark.createDataFrame(data, "g int, a int, x double, y double")
    cells = Q.with_cells(places, ["g"], "x", "y")
    assert cells.groupBy("__cx", "__cy").count().agg(F.max("count")).first()[0] <= 16
    assert Q.near_pairs(cells, ["g"], "x", "y").count() <= 4 * n
    best = Q.closest_pair(places.withColumnRenamed("a", "i"), ["g"], "i", "x", "y").first()
    assert (best.i_a, best.i_b, best.dist) == (0, 2, 2.0)


def busy(n=3000):
    """One user's events within one second, many of them at one instant, and some events of others."""
    rnd = random.Random(12)
    rows = [("hot", 1_700_000_000_000_000 + rnd.choice([0, 0, 0, 7, 250_000, 999_999]), i * 3) for i in range(n)]
    rows += [(rnd.choice(["a", None]), 1_700_000_000_000_000 + rnd.randrange(10**12), 10_000 + i) for i in range(400)]
    return [(k, t, i, float(rnd.randint(0, 50)), rnd.choice(["purchase", "view", "view"])) for k, t, i in rows]


def busy_frame(spark):
    shape = "user_id string, us long, event_id long, value double, event_type string"
    return spark.createDataFrame(busy(), shape).withColumn("ts", F.timestamp_micros("us"))


@pytest.mark.parametrize("bound", [40, 1_000_000])
def test_a_busy_second_is_cut(spark, bound):
    rows = busy_frame(spark)
    cut = sequences.bucketed(rows, bound)
    assert cut.columns == [*rows.columns, "bucket"]
    sizes = [r["count"] for r in cut.groupBy("user_id", "bucket").count().collect()]
    assert sum(sizes) == 3400
    if bound == 40:
        # 2^10 / 3 ids share the finest level; every other stretch is within the bound.
        assert max(sizes) <= 342 and len(sizes) > 15
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    backwards = cut.withColumn("before", F.lag("bucket").over(order)).filter("before > bucket").count()
    assert backwards == 0


def test_cut_buckets_change_no_result(spark):
    rows = busy_frame(spark)
    cut, whole = sequences.bucketed(rows, 40), rows.withColumn("bucket", F.lit(0))
    keys, order, at = ["user_id"], ["ts", "event_id"], F.col("bucket")

    def same(make):
        a, b = (sorted(map(repr, make(df).drop("bucket").collect())) for df in (cut, whole))
        assert a == b and a

    same(lambda df: O.longest_run(df, keys, order, at, F.col("value") > 20))
    same(lambda df: O.running_max(df, keys, order, at, "value", "best", "prev"))
    same(lambda df: Q.followed_by_exactly(df, keys, order, at, "event_type", "purchase", "view", 3, ["event_id", "value"]))


def test_few_rows_cost_one_aggregation(spark):
    cut = sequences.bucketed(busy_frame(spark))
    assert len(cut.schema["bucket"].dataType.fields) == 1
    assert sequences.bucketed(busy_frame(spark).filter("false")).count() == 0
