import re
from collections import Counter

import pytest

from attribix.llm import quality_rules as Q

from .conftest import EDGES


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g, c in Counter(grams).items() if c > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("text", [e[1] for e in EDGES] + ["a b c a b c", "a a a a", "a b c d a b c", "x\nx\n\nx y\n", "a\x0bb\x1cc\xa0d # <|>"])
def test_measures(text):
    assert Q.measures(text) == brute(text)


def test_measures_of_the_corpus(texts):
    assert all(Q.measures(t) == brute(t) for _, t in texts)


def test_edges(edges):
    rows = Q.judged(edges).collect()
    assert len(rows) == len(EDGES)
    assert {r.base_failed for r in rows if r.doc_id in (1, 2, 3, 5)} == {True}
    assert Q.kept_documents(edges).columns == edges.columns


def test_empty(make):
    assert Q.judged(make([])).collect() == []
    assert Q.kept_documents(make([])).collect() == []


def words(n, salt):
    return " ".join(f"{salt}word{i}x" for i in range(n))


def test_host_verdicts(make):
    good = [(i, words(60, f"g{i}"), "en", "good") for i in range(40)]
    junk = [(100 + i, "### " * 60 + words(60, f"j{i}"), "en", "junk") for i in range(200)]
    mixed = [(400, words(60, "m"), "en", "junk"), (401, "# " * 60 + words(60, "n"), "en", "good"), (402, words(60, "o"), "en", None)]
    kept = {r.doc_id: (r.kept, r.host_verdict) for r in Q.judged(make(good + junk + mixed)).collect()}
    assert all(kept[i][0] for i in range(40))
    assert kept[400] == (False, "rejected")
    assert not kept[401][0]
    assert kept[402][0]
    ids = {r.doc_id for r in Q.kept_documents(make(good + junk + mixed)).collect()}
    assert ids == {i for i, (k, _) in kept.items() if k}


def test_trusted_host_is_forgiven(make):
    bad = "# " * 60 + words(60, "bad")
    rows = [(i, words(60, f"t{i}"), "en", "trusted") for i in range(3000)] + [(5000, bad, "en", "trusted")]
    rows += [(6000 + i, bad if i % 2 else words(60, f"o{i}"), "en", "other") for i in range(20)]
    kept = {r.doc_id: (r.kept, r.host_verdict) for r in Q.judged(make(rows)).collect()}
    assert kept[5000] == (True, "trusted")
    assert kept[6000][0] and not kept[6001][0]


def test_rows_that_share_an_id_are_judged_alone(make):
    rows = [(1, words(60, "a"), "en", "s"), (1, "short", "en", "s")]
    assert [r.text for r in Q.kept_documents(make(rows)).collect()] == [words(60, "a")]
