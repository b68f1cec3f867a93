import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attribix.llm import fuzzy_lines as L
from attribix.llm.shared import UnionFind
from attribix.session import checkpoint_root

from .conftest import EDGES


def levenshtein(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab cé", k=rng.randint(0, 14))) for _ in "ab")
        most = rng.randint(0, 16)
        assert L.edit_distance(a, b, most) == min(levenshtein(a, b), most + 1)
        top = max(len(a), len(b))
        assert L.alike(a, b) == (5 * levenshtein(a, b) <= top)


def simhash(words):
    hashes, top = [xxhash.xxh64_intdigest(w) for w in words], (1 << 64) - 1
    pairs = [(x * 0x9E3779B97F4A7C15 + (y ^ (y >> 29)) * 0xBF58476D1CE4E5B9) & top for x, y in zip(hashes, hashes[1:])]
    hashes += [p ^ (p >> 32) for p in pairs]
    return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))


def test_simhashes():
    rng = random.Random(2)
    for sizes in ([1], [1, 2, 3], [5, 70_000, 2], [40_000, 1, 1, 33_000]):
        lines = [rng.choices(["a", "b", "c", "delta", "x"], k=n) for n in sizes]
        hashes = np.array([xxhash.xxh64_intdigest(w) for words in lines for w in words], np.uint64)
        assert L.simhashes(hashes, sizes).tolist() == [simhash(w) for w in lines]


@pytest.mark.parametrize("budget, blocks", [(3, 5), (2, 4), (1, 2), (3, 6)])
def test_close_fingerprints_find_every_pair(llm, budget, blocks):
    rng = random.Random(budget * 10 + blocks)
    centres = [rng.getrandbits(64) for _ in range(10)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(20)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(a, b) for a in signed for b in signed if a < b and (a % 2**64 ^ b % 2**64).bit_count() <= budget}
    got = [tuple(r) for r in L.close_fingerprints(llm.createDataFrame([(v,) for v in signed], "fp long"), budget, blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_keys_of_fingerprints_are_never_broadcast(llm):
    """Ten keys of each fingerprint are sized as one, so a table far above the broadcast limit looks far below it."""
    fps = llm.range(1000).select(F.xxhash64("id").alias("fp"))
    plan = L.close_fingerprints(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_heads_of_fingerprints_are_never_broadcast(make, monkeypatch):
    """One row a fingerprint; its size is told from packed files of entries and comes out many times too low."""
    plans, write = [], L.checkpointed
    monkeypatch.setattr(L, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    L.removed_lines(make([(i, f"one line {i}\nanother line") for i in range(20)])).collect()
    read = [p.splitlines() for p in plans if "head#" in p and "leads#" in p]
    assert read
    for rows in read:
        at = [i for i, row in enumerate(rows) if re.search(r"Scan ExistingRDD\[fp#\d+L?,head#", row)]
        assert at and not any("BroadcastExchange" in row for i in at for row in rows[i - 2 : i])


def brute(rows, budget=3):
    """Texts after dedup, of rows with different ids."""
    first = {}
    for doc, text in sorted(rows):
        for k, words in enumerate(L.normal_lines(text)):
            if words:
                first.setdefault(b" ".join(words).decode(), (doc, k))
    names, found = list(first), UnionFind()
    marks = [simhash(n.encode().split()) for n in names]
    for i in range(len(names)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= budget and L.alike(names[i], names[j]):
                found.join(names[i], names[j])
    kept = {}
    for name, at in first.items():
        kept[found.root(name)] = min(kept.get(found.root(name), at), at)
    stay = lambda doc, k, words: not words or kept[found.root(b" ".join(words).decode())] == (doc, k)
    return {
        doc: None if text is None else "\n".join(
            line for k, (line, words) in enumerate(zip(text.split("\n"), L.normal_lines(text), strict=True)) if stay(doc, k, words))
        for doc, text in rows}


def varied(seed):
    rng = random.Random(seed)
    vocabulary = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    base = [rng.choices(vocabulary, k=rng.randint(3, 60)) for _ in range(25)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(rng.choice(["", "- ", "12. "]) + " ".join(words).capitalize() + rng.choice(["", ".", "\r"]))
        rows.append((doc, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(make, seed):
    rows = varied(seed)
    got = {r.doc_id: r.text for r in L.deduplicated(make(rows)).collect()}
    assert got == brute(rows)
    assert sum(t.count("\n") for _, t in rows) > sum(t.count("\n") for t in got.values())


def test_corpus(corpus, texts):
    assert {r.doc_id: r.text for r in L.deduplicated(corpus).collect()} == brute(texts)


def test_edges(edges):
    kept = L.kept_lines(edges)
    assert kept.columns == edges.columns
    rows = kept.collect()
    assert len(rows) == len(EDGES)
    texts = sorted(repr((r.doc_id, r.text)) for r in rows)
    assert texts == sorted(repr((e[0], e[1])) for e in EDGES)


def test_places_and_counts(make):
    rows = [(1, "Chapter one\n\nsame line here\nlast"), (2, "same  line, HERE!\n---\nown line"), (2, "chapter 7\nsame line here"), (3, "own line\nown line\n")]
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.deduplicated(make(rows)).collect()}
    assert got == {(1, rows[0][1], 4, 0), (2, "---\nown line", 3, 1), (2, "chapter 7", 2, 1), (3, "", 3, 2)}


def test_empty(make):
    assert L.kept_lines(make([])).collect() == []


@pytest.mark.parametrize("marks", [1, 4])
def test_groups_under_one_fingerprint(make, marks):
    """Many unlike lines under few close fingerprints, so most looks at the first line of a fingerprint fail."""
    rng = random.Random(marks)
    texts = ["\n".join(" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "epsilon"], k=rng.randint(2, 6))) for _ in range(3)) for _ in range(40)]
    docs = make(list(enumerate(texts)))
    rows = L.lines(docs).withColumn("fp", F.pmod("fp", F.lit(marks))).withColumn("position", L._position("doc_id", "place"))
    entries = rows.groupBy("entry").agg(F.min("position").alias("first"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    found, want = UnionFind(), UnionFind()
    for a, b in L.links(rows, entries, docs, 2, 4, L.SIMILARITY).collect():
        found.join(a, b)
    names = sorted({" ".join(w.decode() for w in words) for t in texts for words in L.normal_lines(t)})
    for i, a in enumerate(names):
        for b in names[:i]:
            if L.alike(a, b):
                want.join(b, a)
    key = lambda name: xxhash.xxh3_128_digest(name)
    classes = lambda root: sorted(sorted(n for n in names if root(n) == r) for r in {root(n) for n in names})
    assert classes(lambda n: found.root(key(n))) == classes(lambda n: want.root(n))


def test_staged_lines_take_little_disk(llm, make, tmp_path):
    """Bytes that stay on disk for a line; whole rows of a checkpoint took more."""
    rng = random.Random(9)
    rows = [(d, "\n".join(" ".join(rng.choices("abcdefghijklmnop", k=12)) for _ in range(100))) for d in range(200)]
    before, context = checkpoint_root(llm), llm.sparkContext
    context.setCheckpointDir(str(tmp_path))
    try:
        L.removed_lines(make(rows)).count()
    finally:
        context.setCheckpointDir(before)
    written = sum(p.stat().st_size for p in tmp_path.rglob("part-*"))
    assert written < 90 * 20_000
