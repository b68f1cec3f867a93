import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from attribix.llm import lexical as L

from .conftest import EDGES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(items, docs, k=10):
    """Every document against every item, in Python integers."""
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    total, size = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c, n in held:
            m = 100 - 90 + (90 * n * total) // size
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is None, d if d is not None else 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(items, docs, **how):
    return sorted((tuple(r) for r in L.top_documents(items, docs, **how).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def table(llm, rows):
    return llm.createDataFrame(rows, "item_id long, text string")


def test_terms():
    text = "İt's über_x1 ЖA\x7fB日本 \x80q²"
    assert [t.decode() for t in L.terms_of(text)] == words(text)


def test_corpus(llm, corpus, texts):
    items = llm.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    asked = [(r.item_id, r.text) for r in items.collect()]
    assert found(items, corpus) == brute(asked, texts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ties_copies_and_blocks_of_queries(llm, make, seed, monkeypatch):
    """Few words give many equal scores; small segments and blocks of postings give many bounds."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    docs = [(rng.choice([None, i, i // 3]), " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for i in range(900)]
    docs += [(5000 + i, "w0 w1 w2 same copy") for i in range(200)]
    items = [(i // 2 if i < 6 else i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(40)] + [(None, "same copy"), (77, "nowhere")]
    segments = L.index
    monkeypatch.setattr(L, "index", lambda d: segments(d, segment_docs=50))
    assert found(table(llm, items), make(docs), query_terms=60) == brute(items, docs)


def test_bounds_are_exact_and_spare_blocks(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)
    rng = random.Random(9)
    counts = [Counter(rng.choices([b"a", b"b", b"c", b"d", b"rare%d" % rng.randint(0, 99)], [50, 20, 5, 2, 1], k=rng.randint(1, 70))) for _ in range(400)]
    made = L.segment(list(range(400)), counts)
    total, size = 400, sum(c.total() for c in counts)
    part = L.Segment(made, total, size)
    part.bound(list(part.number.values()))
    for term, k in part.number.items():
        rows = []
        for b in range(part.lists[k], part.lists[k + 1]):
            docs, value = part.block(b)
            assert part.best[b] == value.max()
            rows += zip(docs.tolist(), value.tolist(), strict=True)
        want = [(i, 10**9 * c[term] // (1000 * c[term] + 8 * (10 + 90 * c.total() * total // size))) for i, c in enumerate(counts) if c[term]]
        assert rows == want and part.top[k] == max(v for _, v in want) and part.df[k] == len(want)
    heap = L.Heap(10)
    weights = {b"rare1": 6000, b"rare2": 6000, b"d": 900, b"a": 3}
    every = L.search_segment(part, weights, heap)
    fresh = L.Segment(made, total, size)
    fresh.bound(list(fresh.number.values()))
    before = (heap.score.tolist(), heap.ids.tolist())
    assert L.search_segment(fresh, weights, heap) < every
    assert heap.score[0] == before[0][0]


def test_a_task_holds_few_segments(llm, make):
    """One task writes 20 segments of about 2 MB and another reads them; each once had them in memory together."""
    rng = random.Random(4)
    docs = make([(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(3000))) for i in range(200)]).coalesce(1)
    segments = L.index(docs, segment_docs=10)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in segments.inputFiles()]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == 20 and max(groups) <= 4

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    got = segments.coalesce(1).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 20 and sum(r.size for r in got) > 30e6 and max(r.size for r in got) < 16e6


def test_long_lengths_stay_exact():
    n = np.array([5, 10**9, 4 * 10**12], np.int64)
    assert L.lengths_weighed(n, 10**9, 10**13).tolist() == [10 + 90 * int(x) * 10**9 // 10**13 for x in n]


def test_edges(llm, edges, make):
    items = [(1, "One six"), (2, None), (3, ""), (4, "w1 w29999 text"), (None, "some words")]
    assert found(table(llm, items), edges) == brute(items, [(e[0], e[1]) for e in EDGES])
    assert found(table(llm, items), make([])) == []
    assert found(table(llm, []), edges) == []
    assert found(table(llm, [(2, None)]), edges) == []
