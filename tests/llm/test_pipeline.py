"""The pipeline against a plain computation of each stage, and its stages on the edge rows."""

import zlib
from itertools import takewhile

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from tokenizers import Tokenizer

import corpus_pipeline
from attribix.llm import secrets, simhash_trie
from attribix.llm.shared import staged

from .conftest import EDGES
from .test_fuzzy_lines import brute as brute_lines
from .test_quality_rules import brute as brute_measures
from .test_simhash_trie import brute_components

SF = "/root/testdata/sf0.001"


def run_all(llm, docs):
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(llm, docs, SF), name)
        kept.append(docs)
    return kept


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def stages(llm, corpus):
    return run_all(llm, corpus)


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns_stay(stages, corpus):
    assert all(df.columns == corpus.columns and df.dtypes == corpus.dtypes for df in stages[:-1])


def sent_whole(plan):
    """The operators below each broadcast of a plan."""
    rows = [(len(row) - len(row.lstrip(" :+-")), row) for row in plan.splitlines()]
    for i, (depth, row) in enumerate(rows):
        if "BroadcastExchange" in row:
            yield [x for _, x in takewhile(lambda y: y[0] > depth, rows[i + 1 :])]  # noqa: B023


def test_no_stage_broadcasts_exploded_rows(llm, corpus, monkeypatch):
    """Spark sizes rows before they are exploded, so many of them look few enough for the driver."""
    plans, write = [], DataFrame.checkpoint

    def recorded(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "checkpoint", recorded)
    for df in run_all(llm, corpus):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert any("Generate explode" in plan for plan in plans)
    assert not [below for plan in plans for below in sent_whole(plan) if any("Generate" in row for row in below)]


def test_rules_stage(stages, texts):
    """No host of these is rejected or trusted, so a document goes for its own failures alone."""
    want = []
    for doc, text in texts:
        n, chars, symbols, lines, dup, repeat = brute_measures(text)
        base = n < 50 or 100 * repeat > 50 * n
        own = 100 * symbols > 20 * n or (dup >= 3 and 100 * dup > 30 * lines) or chars < 2 * n or chars > 25 * n
        if not (base or own):
            want.append((doc, text))
    assert rows(stages[0]) == want


def test_line_stage(stages):
    before = rows(stages[0])
    assert dict(rows(stages[1])) == brute_lines(before)
    assert all(r.n_chars == len(r.text) for r in stages[1].join(stages[0].withColumnRenamed("text", "was"), "doc_id").where("text <> was").select(stages[1]["*"]).collect())


def test_near_dedup_stage(stages):
    before = rows(stages[1])
    found = brute_components([(d, simhash_trie.fingerprint(t)) for d, t in before])
    assert [d for d, _ in rows(stages[2])] == sorted({low for _, _, low in found})


def test_secrets_stage(stages):
    assert rows(stages[3]) == [(d, secrets.mask(t)) for d, t in rows(stages[2])]
    assert all(not secrets.spans_of(t) for _, t in rows(stages[3]))


def test_packing_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    parts = {(r.doc_id, r.piece): r for r in stages[4].collect()}
    want = {}
    for doc, text in rows(stages[3]):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[doc, piece] = (at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()))
    assert {k: (r.start, r.length, r.ids_crc32) for k, r in parts.items()} == want
    bins = {}
    for r in parts.values():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        ends = [0] + [o + n for o, n in sorted(held)]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 2048
    total = sum(n for _, n, _ in want.values())
    assert len(bins) <= -(-total // 2048) + 2


def test_run_is_the_last_stage(llm, stages):
    assert sorted(map(tuple, corpus_pipeline.run(llm, SF).collect())) == sorted(map(tuple, stages[4].collect()))


def test_edges(llm, edges, make):
    found = run_all(llm, edges)
    assert all(df.columns == edges.columns for df in found[:-1])
    assert found[0].count() < len(EDGES)
    assert all(df.count() == 0 for df in run_all(llm, make([])))
