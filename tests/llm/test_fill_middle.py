import hashlib
import random

import pytest

from attribix.llm import fill_middle as M

from .conftest import EDGES


def brute(doc_id, text):
    """The contract word for word, on whole strings."""
    text = text or ""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, prefix, middle, out = "plain", None, None, text
    else:
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        prefix, middle = a, b - a
        if h[3] % 100 < 20:
            form, out = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
        else:
            form, out = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, n, form, prefix, middle, sha(out), sha(text)


def rows(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()), key=repr)


def test_corpus(corpus, texts):
    got = rows(M.digests(corpus))
    assert got == sorted((brute(d, t) for d, t in texts), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_edges(edges):
    assert rows(M.digests(edges)) == sorted((brute(e[0], e[1]) for e in EDGES), key=repr)


def test_sentinels_and_borders(make):
    """Texts with sentinels stay plain; parts of sentinels at every border don't confuse the way back."""
    rng = random.Random(5)
    made = [(i, "".join(rng.choices(["<", "P", ">", "S", "M", "<P", "S>", "é", "\n", "𝄞", " "], k=rng.randint(0, 9)))) for i in range(600)]
    got = rows(M.digests(make(made)))
    assert got == sorted((brute(d, t) for d, t in made), key=repr)
    assert any("<P>" in t for _, t in made)


def test_round_trip(make, texts):
    made = make([(d, t) for d, t in texts] + [(None, "no id at all"), (-7, "a negative one")], clashes=True)
    out = M.transformed(made, "how")
    assert out.columns == [*made.columns, "how"]
    back = M.restored(out, "how")
    assert back.columns == made.columns
    assert sorted(map(repr, back.collect())) == sorted(map(repr, made.na.fill({"text": ""}).collect()))
    assert out.where("how <> 'plain' and text not like '%<M>%'").count() == 0


def test_pieces_make_the_output(make, texts):
    made = make(texts)
    want = {r.doc_id: r.text for r in M.transformed(made).collect()}
    by_id, got = dict(texts), {d: [] for d, _ in texts}
    for r in sorted(M.pieces(made).collect(), key=lambda r: (r.doc_id, r.place)):
        source = by_id[r.doc_id] or "" if r.buffer == "text" else r.buffer
        got[r.doc_id].append(source[r.start : r.start + r.length])
    assert {d: "".join(p) for d, p in got.items()} == want


@pytest.mark.parametrize("places", [(0, 0), (0, 5), (5, 5), (2, 3)])
def test_cuts_keep_the_text(places, monkeypatch):
    monkeypatch.setattr(M, "SLICE", 2)
    table = M.PieceTable.of("aé𝄞de").cut(*places)
    assert [p.length for p in table.pieces] == [places[0], places[1] - places[0], 5 - places[1]]
    assert table.text() == "aé𝄞de" and table.sha256() == hashlib.sha256("aé𝄞de".encode()).hexdigest()


def test_inverse():
    for order in M.FORMS.values():
        assert [order[k] for k in M.inverse(order)] == list(range(6))


def test_empty(make):
    assert M.digests(make([])).collect() == [] and M.transformed(make([])).collect() == [] and M.pieces(make([])).collect() == []
