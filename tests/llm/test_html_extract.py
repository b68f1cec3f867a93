import time
from html.parser import HTMLParser

import numpy as np
import pytest

from attribix.llm import block_labeller as B
from attribix.llm import html_extract as H
from attribix.llm.html_blocks import INLINE, blocks
from attribix.llm.page_templates import composed


class Article(HTMLParser):
    """Text of the article elements by the standard library's parser; elements that aren't inline part words."""

    def __init__(self):
        super().__init__()
        self.inside, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag not in INLINE:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in INLINE:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def article(page):
    parser = Article()
    parser.feed(page)
    parser.close()
    return " ".join("".join(parser.parts).split())


@pytest.fixture(scope="module")
def model():
    return B.labeller()


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks():
    page = """<!DOCTYPE html><head><title>A &amp; B</title><style>p{}</style><script>var x = "</p><p>no</p>";</script></head>
    <body><!-- <p>no</p> --><p>one <b>two</b>three<br>four
    &lt;b&gt; 1 < 2 &nbsp; &#233;<ul><li>a<li><a href='x>y'>b</a></ul><h2>head</h3>tail<div hidden class="siteNav top_1">x</div>"""
    assert texts(page) == ["A & B", "one twothree four <b> 1 < 2 é", "a", "b", "head", "tail", "x"]
    found = {b.text: b for b in blocks(page)}
    assert found["b"].linked == 1 and found["a"].linked == 0
    assert found["b"].leaf == ("li",) and found["b"].path == ("body", "ul", "li", "a")
    assert set(found["x"].leaf) >= {"div", ".site", ".nav", ".top"}
    assert found["tail"].path == ("body",)


@pytest.mark.parametrize("page, want", [
    (None, []), ("", []), ("plain text", ["plain text"]), ("<p", []), ("a<!-- b", ["a"]), ("<script>x", []),
    ("<SCRIPT>a</SCRIPT >b", ["b"]), ("<p>a</div></p></p>b", ["a", "b"]), ("a < b <3 <", ["a < b <3 <"]), ("<p title='a>b>c</p>d", ["b>c", "d"]),
    ("<td>a<td>b<tr>c", ["a", "b", "c"]), ("<p>a\x00b\x85c</p>", ["a\x00b c"]), ("<textarea>x</textarea>y", ["x", "y"]), ("<?x y?>z", ["z"]),
])
def test_odd_markup(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("page", [
    "<" * 400_000, "<a '" * 100_000, "<a \"'" * 100_000, "<!--" * 100_000, "<div>" * 100_000, "</p>" * 100_000, "<li>" * 100_000, "&" * 400_000,
    "<div>" * 50_000 + "</p>" * 50_000, "<ul>" * 40_000 + "<li>" * 40_000, "<b>" * 40_000 + "<li>x" * 20_000, "<script>" * 50_000,
])
def test_time_is_linear(page):
    begin = time.process_time()
    blocks(page)
    assert time.process_time() - begin < 4


def test_gradients():
    page, good = B.labelled(composed(1, 3)[0])
    model = B.Labeller.new(1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    made, lengths = B.features(page), np.array([len(page)])

    def loss():
        p = model.forward(model.vectors(made).astype(np.float64), lengths)
        return -np.mean(np.log(np.where(good > 0.5, p, 1 - p)))

    grad = model.gradients(made, lengths, good)
    rng = np.random.default_rng(0)
    for name in ("in_on", "again_on", "again_back", "bias_back", "score"):
        at = tuple(rng.integers(n) for n in model.weights[name].shape)
        kept = model.weights[name][at]
        model.weights[name][at] = kept + 1e-2
        high = loss()
        model.weights[name][at] = kept - 1e-2
        low = loss()
        model.weights[name][at] = kept
        assert grad[name][at] == pytest.approx((high - low) / 2e-2, rel=0.1, abs=2e-4)


def test_scores_do_not_depend_on_the_batch(model):
    pages = [B.labelled(p)[0] for p in composed(12, 7)] + [[]]
    together = model.scores(pages)
    for page, score in zip(pages, together, strict=True):
        assert np.allclose(model.scores([page])[0], score, atol=1e-4)


def test_held_out_pages(model):
    right = total = perfect = 0
    for page in composed(200, 4711):
        found, good = B.labelled(page)
        ok = (model.scores([found])[0] >= H.TAKEN) == (good > 0.5)
        right, total, perfect = right + ok.sum(), total + len(ok), perfect + ok.all()
    assert right / total > 0.99 and perfect > 180


def test_the_whole_page_decides(model):
    """The same element reads as article or not by what stands around it."""
    words = "Some words that make a sentence of their own, with a comma in it."
    body = f"<h1>Title of it</h1><p>{words} {words}</p><p>{words}</p>"
    page = f"<body><div class='post'>{body}</div><div class='comments'><h3>2 comments</h3><div><p>{words}</p></div><div><p>{words}</p></div></div></body>"
    assert H.texts_of([page], model) == [f"Title of it {words} {words} {words}"]


def test_given_pages(llm, model):
    pages = llm.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {(r.page_id, r.url): article(r.html) for r in pages.collect()}
    got = {(r.page_id, r.url): r.text for r in H.extracted(pages).collect()}
    assert got == want


@pytest.mark.parametrize("page, want", [
    ("<body><header><div class='logo'>Daily</div><nav><ul><li><a href=/a>Home</a></li></ul></nav></header><main><h1>A title here</h1>"
     "<p>First part of it, quite long.</p><div class='ad-slot'>Buy it now</div><p>Second part of it, quite long as well.</p></main>"
     "<aside class='sidebar'><h3>Related</h3><p>Another piece to read.</p></aside><section id='comments'><h2>Comments</h2><div class='comment'>"
     "<p>I liked this article very much, thanks.</p></div></section><footer>&copy; 2020</footer></body>",
     "A title here First part of it, quite long. Second part of it, quite long as well."),
    ("<body><div class='cookie-notice'>We use cookies.</div><div id='content' class='post-content'><h2>On rivers</h2><p>Rivers run to the sea, mostly.</p>"
     "<ul><li>one river</li><li>two rivers</li></ul></div><form class='newsletter'><label>Email</label><button>Subscribe</button></form></body>",
     "On rivers Rivers run to the sea, mostly. one river two rivers"),
])
def test_other_layouts(model, page, want):
    assert H.texts_of([page], model) == [want]


def test_edges(llm, model):
    html = "<nav><a href=/>x</a></nav><article><p>" + "long words here. " * 60_000 + "</p></article>"
    many = "<article>" + "<p>A line of its own, with words.</p>" * 5_000 + "</article><footer>end</footer>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p></p> <br>"), (4, None, html), (5, "u", many), (5, "u", many), (None, "u", "<script>x</script>")]
    pages = llm.createDataFrame([(*r, 7, "mine") for r in rows], "page_id long, url string, html string, score int, __text string")
    got = sorted((r.page_id or 0, r.url or "", r.text) for r in H.extracted(pages).collect())
    line = " ".join(["A line of its own, with words."] * 5_000)
    assert got == [(0, "u", ""), (1, "", ""), (2, "u", ""), (3, "u", ""), (4, "", "long words here. " * 59_999 + "long words here."), (5, "u", line), (5, "u", line)]
    more = H.with_text(pages, "out")
    assert more.columns == [*pages.columns, "out"] and more.where("out <> ''").count() == 3
    assert H.block_scores(pages).where("page_id = 5 and text = 'end' and score < 0.5").count() == 2
    none = pages.where("false")
    assert H.extracted(none).collect() == [] and H.with_text(none).collect() == [] and H.block_scores(none).collect() == []
