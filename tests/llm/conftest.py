import pytest

from attribix.llm.shared import prepared

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use inside, as further columns of a table.
CLASHES = ["kept", "fp", "root", "node", "h", "d", "entry", "first", "class", "spans", "ids", "length", "n", "x", "k", "label", "__h"]


def _long(words):
    return " ".join(f"w{i}" for i in range(words))


EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t\n ", "en", "a", 5),
    (4, _long(30_000), "en", None, 1),
    (5, "one two three four five six", "en", "b", 1),
    (5, "one two three four five six", "en", "b", 1),
    (5, "another text under the same id", "de", "b", 1),
    (None, "a row without an id that has some words", "en", "a", 1),
    (None, None, None, None, None),
    (6, "x" * 100_000, "en", "a", 1),
    (7, "İstanbul ß ſecret 日本 é é ​ \x85 12 ½ 'tis it's", "en", "a", 1),
]


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def make(llm):
    def build(rows, clashes=False):
        df = llm.createDataFrame([(*r, None, None, None)[:5] for r in rows], SHAPE)
        if clashes:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(7) for c in CLASHES})
        return df

    return build


@pytest.fixture(scope="session")
def edges(make):
    return make(EDGES, clashes=True)


@pytest.fixture(scope="session")
def corpus(llm):
    return llm.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").orderBy("doc_id").collect()]
