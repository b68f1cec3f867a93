import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attribix.llm import simhash_trie as S
from attribix.llm.shared import UnionFind, components

from .conftest import EDGES


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def brute_components(marks, budget=2):
    found = UnionFind()
    values = sorted({f for _, f in marks})
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                found.join(a, b)
    low = {}
    for doc, f in marks:
        if doc is not None:
            low[found.root(f)] = min(low.get(found.root(f), doc), doc)
    return Counter((doc, f, low.get(found.root(f))) for doc, f in marks)


def result(df):
    return Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect())


@pytest.mark.parametrize("text", [e[1] for e in EDGES if not e[1] or len(e[1]) < 1000] + ["A", "A b", "A B C", "É É É É", "a b c a b c a b c"])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute(text)


def test_corpus(corpus, texts):
    assert result(S.near_duplicates(corpus)) == brute_components([(d, brute(t)) for d, t in texts])


def test_edges(edges):
    marks = [(e[0], S.fingerprint(e[1])) for e in EDGES]
    assert result(S.near_duplicates(edges)) == brute_components(marks)
    kept = S.one_of_each(edges)
    assert kept.columns == edges.columns
    assert kept.count() == len({S.fingerprint(e[1]) for e in EDGES})


def test_empty(make):
    assert S.near_duplicates(make([])).collect() == []
    assert S.one_of_each(make([])).collect() == []


def close(rng, centre, most):
    for bit in rng.sample(range(64), rng.randint(0, most)):
        centre ^= 1 << bit
    return centre


@pytest.mark.parametrize("budget", [0, 1, 2, 4])
def test_linked_blocks_find_every_pair(budget):
    rng = random.Random(budget)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({close(rng, rng.choice(centres), 4) for _ in range(600)} | {0, 1, (1 << 64) - 1})
    a = np.array(values, np.uint64)
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= budget}
    got = [(int(i), int(j)) for x, y in S.linked_blocks(a, None, budget, 0) for i, j in zip(x, y)]
    assert len(got) == len(set(got)) and set(got) == want
    # Two nodes of depth 1.
    lo, hi = a[a < 1 << 63], a[a >= np.uint64(1 << 63)]
    want = {(i, j) for i in range(len(lo)) for j in range(len(hi)) if int(lo[i] ^ hi[j]).bit_count() <= budget}
    got = [(int(i), int(j)) for x, y in S.linked_blocks(lo, hi, budget, 1) for i, j in zip(x, y)]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("leaf, stride", [(8, 6), (40, 4), (10_000, 6)])
def test_crowded_nodes_are_split(llm, leaf, stride):
    """A third of the fingerprints lie around one centre, so the trie goes deep there alone."""
    rng = random.Random(leaf)
    centre = rng.getrandbits(64)
    values = {close(rng, centre, 3) for _ in range(150)} | {rng.getrandbits(64) for _ in range(300)}
    values |= {close(rng, v, 3) for v in list(values)[:100]}
    df = llm.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    rows = S.linked(df, 2, leaf, stride).groupBy("fp").agg(F.sum("n_links").alias("n")).collect()
    ordered = sorted(values)
    want = {a: n for a in ordered if (n := sum((a ^ b).bit_count() <= 2 for b in ordered) - 1)}
    assert {r.fp % (1 << 64): r.n for r in rows} == want


def test_components_of_chains_loops_and_stars(llm):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(100, 180)] + [(300, 300), (400, 401), (401, 402), (402, 400)]
    random.Random(1).shuffle(edges)
    df = llm.createDataFrame(edges + [(None, 500), (501, None)], "a long, b long").repartition(7)
    roots = {r.node: r.root for r in components(df, "a", "b").collect()}
    want = {i: 0 for i in range(1, 61)} | {i: 100 for i in [*range(101, 180), 200]} | {401: 400, 402: 400}
    assert roots == want


def test_one_of_each_keeps_rows_of_other_groups(make):
    rows = [(1, "alpha beta gamma delta"), (1, "quite another text here"), (2, "alpha beta gamma delta"), (1, "alpha beta gamma delta")]
    kept = sorted((r.doc_id, r.text) for r in S.one_of_each(make(rows)).collect())
    assert kept == [(1, "alpha beta gamma delta"), (1, "quite another text here")]


def test_nodes_are_cut_no_finer_than_they_need(llm):
    """No step in the cost where nodes begin to outgrow the leaf, and no lost or doubled pair of halves."""
    looks, sizes = {}, {}
    for n in (3_900, 4_300, 60_000, 70_000, 120_000, 250_000, 280_000):
        pairs = S.node_pairs(llm.range(n).select(F.xxhash64("id").alias("fp"))).agg(
            F.count(F.lit(1)).alias("c"), F.sum(F.col("n") + F.col("m")).alias("s"), F.max(F.greatest("n", "m")).alias("most")).first()
        looks[n], sizes[n] = pairs.s / n, pairs.most
    assert all(m <= S.LEAF for m in sizes.values())
    for n, look in looks.items():
        depth = max(0, math.ceil(math.log2(n / S.LEAF)))
        assert look <= 2 * (1 + depth + depth * (depth - 1) // 2)  # nodes within two bits of one at the depth it needs
    assert looks[70_000] <= 2 * looks[60_000] and looks[280_000] <= 2 * looks[250_000]


@pytest.mark.parametrize("leaf, stride", [(8, 1), (8, 6), (40, 3)])
def test_hot_nodes_beside_even_ones(llm, leaf, stride):
    """A crowd of near copies among spread fingerprints: every pair within the budget is met once."""
    rng = random.Random(leaf + stride)
    centre = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(150)} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {}
    for r in S.linked(llm.createDataFrame([(v,) for v in signed], "fp long"), 2, leaf, stride).collect():
        got[r.fp] = got.get(r.fp, 0) + r.n_links
    want = {a: n for a in signed if (n := sum(a != b and (a % 2**64 ^ b % 2**64).bit_count() <= 2 for b in signed))}
    assert got == want
