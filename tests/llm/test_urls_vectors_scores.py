import random

import numpy as np
import pytest

from attribix.llm import cotraining, host_reputation, voronoi_knn

from .conftest import EDGES

# --- URL filters


def pages(llm, rows, **more):
    df = llm.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, rule int")
    return df


def outcomes(llm, rows):
    return llm.createDataFrame(rows, "doc_id long, quality int")


def test_rules_and_parts(llm):
    urls = {
        1: ("HTTP://WWW.Example.COM/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        2: ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        3: ("http://example.com/en", "example.com", "/en", "com/", "allow"),
        4: ("https://a.b.net/es/y", "a.b.net", "/es/y", "net/es/", "block"),
        5: ("https://a.b.net/de/", "a.b.net", "/de/", None, "allow"),
        6: ("http://x.com", "x.com", "", None, "allow"),
        7: ("http://x.com?/a", "x.com", "", None, "allow"),
        8: ("no scheme/com/", "", "", None, "allow"),
        9: (None, "", "", None, "allow"),
        10: ("a://b.com/x://c.net/fr/", "b.com", "/x://c.net/fr/", "com/", "allow"),
        11: ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        12: ("http://ÄÉ.net/fr/\nz#", "ÄÉ.net", "/fr/\nz", "net/fr/", "block"),
        13: ("http://net/es/", "net", "/es/", "net/es/", "block"),
        14: ("", "", "", None, "allow"),
    }
    df = pages(llm, [(i, u[0]) for i, u in urls.items()] + [(None, "http://x.com/a"), (1, urls[1][0])])
    rows = host_reputation.judged(df, outcomes(llm, [])).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == urls[r.page_id][1:]


def test_reputation(llm):
    rows, marks, i = [], [], 0
    for host, good, bad in (("good.a.org", 60, 2), ("bad.a.org", 1, 80), ("few.a.org", 0, 2), ("new.a.org", 0, 0), ("x.b.co.uk", 5, 1), ("y.b.co.uk", 0, 60)):
        for k in range(good + bad + 1):
            rows.append((i, f"http://{host}/p{k}"))
            if k < good + bad:
                marks.append((i, int(k < good)))
            i += 1
    marks += [(0, None), (None, 1), (10**9, 0)]
    got = {r.host: r for r in host_reputation.judged(pages(llm, rows), outcomes(llm, marks)).collect()}
    assert {h for h, r in got.items() if r.verdict == "block"} == {"bad.a.org", "y.b.co.uk"}
    assert got["good.a.org"].host_mean > got["new.a.org"].host_mean > got["bad.a.org"].host_mean
    # Hosts with little of their own lie near their domain.
    assert got["few.a.org"].host_mean > 0.15
    again = host_reputation.judged(pages(llm, rows), outcomes(llm, marks).repartition(5)).collect()
    assert {r.host: r.verdict for r in again} == {h: r.verdict for h, r in got.items()}


def test_names_domains_and_suffixes(llm):
    names = ["a.gov.uk", "b.gov.uk", "www.a.co.uk", "x.com", "10.0.0.1", "localhost", "", "many.site", *[f"{p}n{i}.host.org" for i in range(25) for p in ("", "www.")]]
    rows = llm.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.domain, r.suffix) for r in host_reputation.with_domains(rows).collect()}
    assert got["a.gov.uk"] == ("a.gov.uk", "gov.uk") and got["b.gov.uk"][0] == "b.gov.uk" and got["www.a.co.uk"] == ("a.co.uk", "co.uk")
    assert got["x.com"] == ("x.com", "com") and got["10.0.0.1"] == ("10.0.0.1", "10.0.0.1") and got["localhost"] == ("localhost", "localhost")
    assert got["many.site"] == ("many.site", "site") and got[""] == ("", "")
    # 25 names stand below host.org, so it acts as a suffix.
    assert got["www.n3.host.org"] == ("n3.host.org", "host.org") and got["n3.host.org"] == ("n3.host.org", "host.org")
    few = {r.name: r.domain for r in host_reputation.with_domains(rows, (), 26).collect()}
    assert few["www.n3.host.org"] == "host.org" and few["a.gov.uk"] == "gov.uk"


def test_ports_and_user_names_share_a_reputation(llm):
    urls = [(i, f"http://{'u:p@' if i % 3 == 0 else ''}a.bad.org{':8080' if i % 2 else ''}{'.' if i == 5 else ''}/x") for i in range(60)]
    rows = host_reputation.judged(pages(llm, urls), outcomes(llm, [(i, 0) for i in range(60)])).collect()
    assert len({round(r.host_mean, 12) for r in rows}) == 1 and len({r.host for r in rows}) == 5


def test_no_pages(llm):
    assert host_reputation.judged(pages(llm, []), outcomes(llm, [(1, 1)])).collect() == []


# --- Top-k


def vectors(llm, rows):
    return llm.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, d int, cell int")


def brute(rows, k, every):
    ok = [(i, np.floor(64.0 * np.array(v, np.float32).astype(float))) for i, v in rows
          if i is not None and v is not None and None not in v and np.isfinite(np.array(v, np.float32)).all()]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, [int(x) for x in v] + [0] * (width - len(v))) for i, v in ok]
    out = []
    for q, v in ok:
        if q % every == 0:
            best = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2**63)), 2**63 - 1), c) for c, w in ok if c != q)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("case", ["spread", "clusters", "hot", "ties"])
def test_top_k(llm, case, monkeypatch):
    rng = np.random.default_rng(len(case))
    n, width = 600, 8
    x = rng.normal(size=(n, width)) * 0.3
    if case == "clusters":
        x += rng.normal(size=(6, width))[rng.integers(0, 6, n)] * 3
    if case == "hot":
        x[: n // 3] = x[0]
    if case == "ties":
        x = np.round(x)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(voronoi_knn, "GROUP", 7)
    monkeypatch.setattr(voronoi_knn, "BLOCK", 16)
    monkeypatch.setattr(voronoi_knn, "BLOCKS_PER_TASK", 3)
    assert result(voronoi_knn.top_k(vectors(llm, rows), k=5, every=7, pivots=12)) == brute(rows, 5, 7)


def test_vectors_of_all_kinds(llm):
    big = 1e15
    rows = [
        (0, [1.0, 2.0]), (20, [-0.01, 0.5, 3.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]),
        (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, []), (40, []), (7, [big, -big]), (60, [big, big]), (20, [9.0]), (8, [0.0, 0.0]),
    ]
    assert result(voronoi_knn.top_k(vectors(llm, rows), k=4)) == brute(rows, 4, 20)
    assert voronoi_knn.top_k(vectors(llm, [])).collect() == []
    assert voronoi_knn.top_k(vectors(llm, [(1, [1.0])])).collect() == []
    assert voronoi_knn.top_k(vectors(llm, [(0, [1.0])])).collect() == []


def test_far_blocks_are_not_replicated(llm):
    """Points far apart in many cells: a group of queries meets a small share of the candidates."""
    rng = np.random.default_rng(1)
    spots = rng.normal(size=(10, 4))
    spots = spots / np.linalg.norm(spots, axis=1)[:, None]
    x = spots[rng.integers(0, 10, 2000)] * 0.5 + rng.normal(size=(2000, 4)) * 0.002
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    assert result(voronoi_knn.top_k(vectors(llm, rows), k=3, every=50)) == brute(rows, 3, 50)


# --- Co-training


def labelled(rng, n):
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        source = f"s{rng.randrange(10) if rng.random() < 0.2 else int(bad)}"
        docs.append((i, text, "en", source, len(text)))
        labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_accuracy(llm, make):
    rng = random.Random(3)
    docs, labels = labelled(rng, 1500)
    model = cotraining.train(make(docs, clashes=True), outcomes(llm, [x for x in labels if x[0] % 3 == 0]))
    assert model.handed and sum(n for _, n in model.handed) > 100
    rows = {r.doc_id: r for r in cotraining.scored(make(docs), model).collect()}
    test = [(i, y) for i, y in labels if i % 3]
    right = lambda name: np.mean([(rows[i][name] >= 0.5) == (y == 1) for i, y in test])
    assert right("score") > 0.97 and right("p_metadata") > 0.8
    assert all(rows[i].kept == (rows[i].score >= 0.5) for i, _ in test)
    again = cotraining.train(make(docs).repartition(5), outcomes(llm, [x for x in labels if x[0] % 3 == 0]))
    assert np.allclose(again.views[0].weights, model.views[0].weights, atol=1e-8) and again.handed == model.handed


def weak_view(n=3000):
    rng = np.random.default_rng(5)
    y = (rng.random(n) < 0.5).astype(int)
    return y, rng.normal(size=(n, 30)) + y[:, None] * 0.45, rng.normal(size=(n, 2)) + y[:, None] * 5


def test_pseudo_labels_help_a_weak_view():
    """The content view has few labels; the metadata view is sure of many other rows."""
    y, content, metadata = weak_view()
    few = slice(60)
    held = np.arange(60) % 4 == 0
    rest = (content[60:], metadata[60:])
    right = lambda m: np.mean((m.views[0].logit(content) > 0) == (y == 1))
    train = lambda rounds: cotraining.co_train(content[few], metadata[few], y[few], held, lambda v: cotraining.pool_sums(v, rest), rounds)
    model = train(5)
    assert right(model) > right(train(0)) + 0.02
    assert sum(n for v, n in model.handed if v == 1) > 5 * 2000  # every sure row counts in every round


def test_one_exchange_against_brute_force(llm, make):
    """The sums of a round over all rows, by Spark and row by row in plain loops, and the step they lead to."""
    rng = random.Random(8)
    docs, labels = labelled(rng, 240)
    features = cotraining.featured(make(docs))
    rows = {r.doc_id: np.frombuffer(r.x, "<f4").astype(float) for r in features.collect()}
    x = np.array([rows[d[0]] for d in docs])
    y = np.array([q for _, q in labels])
    a, b = cotraining._parts(x)
    views = (cotraining.fit(a[:60], y[:60].astype(float)), cotraining.fit(b[:60], y[:60].astype(float)))
    got = cotraining._exchange(features, views, 0.8)
    want = []
    for v, size in ((0, a.shape[1]), (1, b.shape[1])):
        for label in (0, 1):
            n, slope, gram = 0, np.zeros(size + 1), np.zeros((size + 1, size + 1))
            for i in range(len(docs)):
                p = 1 / (1 + np.exp(-views[1 - v].logit((a, b)[1 - v][i : i + 1])[0]))
                if (p if label else 1 - p) < 0.8:
                    continue
                z = np.append(((a, b)[v][i] - views[v].mean) / views[v].scale, 1.0)
                q = 1 / (1 + np.exp(-np.clip(z @ views[v].weights, -30, 30)))
                n, slope, gram = n + 1, slope + z * (q - label), gram + np.outer(z, z) * q * (1 - q)
            want.append((n, slope, gram))
    assert all(w[0] > 0 for w in want)
    for g, (n, slope, gram) in zip(got, want, strict=True):
        assert g.n == n and np.allclose(g.gradient, slope, atol=1e-8) and np.allclose(g.gram, gram, atol=1e-8)
    sums = cotraining.Sums.from_bytes(got[0].to_bytes())
    assert sums.n == got[0].n and (sums.gram == got[0].gram).all()


def test_rows_that_share_an_id(llm, make):
    docs, labels = labelled(random.Random(1), 80)
    twice = [*docs, *[(i, "one other text under the id " * (i % 7), "de", None, 3) for i, *_ in docs]]
    one = cotraining.train(make(twice), outcomes(llm, labels[:60]))
    other = cotraining.train(make(twice[::-1]).repartition(3), outcomes(llm, labels[:60]))
    assert np.allclose(one.views[0].weights, other.views[0].weights, atol=1e-8)


def test_scores_without_labels(llm, edges, make):
    for labels, want in (([], 0.5), ([(5, 1), (4, 1), (4, None)], 0.75)):
        model = cotraining.train(edges, outcomes(llm, labels))
        rows = cotraining.scored(edges, model).collect()
        assert len(rows) == len(EDGES)
        assert {round(r.score, 9) for r in rows} == {want}
    assert cotraining.scored(make([]), model).collect() == []


def test_features_of_edges():
    for e in EDGES:
        assert np.isfinite(cotraining.content_features(e[1])).all()
        assert np.isfinite(cotraining.metadata_features(*e[2:])).all()
