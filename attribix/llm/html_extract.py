"""Main text of HTML pages: the blocks a recurrent labeller takes for the article.

Each page is cut into leaf blocks with the path of elements above them, the labeller scores every block with the whole
page in view, and the blocks it takes are joined in page order. The model is fitted once on the driver and sent to the
tasks; its size does not depend on the data.

Defined results: a null or empty page has an empty text, and so has a page of which no block is taken. A page without
markup is one block, judged like any other. Repeated rows each get a row; a null page_id or url stays null. An empty
table gives an empty result. Further columns are not read by :func:`extracted` and not touched by :func:`with_text`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import block_labeller
from .block_labeller import Labeller
from .html_blocks import blocks
from .shared import takes_over

TAKEN = 0.5


def texts_of(pages: list[str | None], model: Labeller) -> list[str]:
    """Main text of each page."""
    found = [blocks(p) for p in pages]
    return [
        " ".join(b.text for b, s in zip(page, score, strict=True) if s >= TAKEN)
        for page, score in zip(found, model.scores(found), strict=True)]


def _text(model: Labeller):
    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        takes_over("html", block_labeller.forget)
        return pa.array(texts_of(pages.to_pylist(), model), pa.string())

    return text.asNondeterministic()


def extracted(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text of every page."""
    model = model or block_labeller.labeller()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("html", block_labeller.forget)
        for batch in batches:
            found = pa.array(texts_of(batch.column("html").to_pylist(), model), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), found], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string")


def with_text(pages: DataFrame, column: str = "text", model: Labeller | None = None) -> DataFrame:
    """``pages`` with the main text as a further column."""
    return pages.withColumn(column, _text(model or block_labeller.labeller())(F.col("html").cast("string")))


def block_scores(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, place, text, score of every block, for those who want another threshold."""
    model = model or block_labeller.labeller()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("html", block_labeller.forget)
        for batch in batches:
            found = [blocks(p) for p in batch.column("html").to_pylist()]
            rows = [
                (i, place, b.text, float(s)) for i, page, score in zip(batch.column("page_id").to_pylist(), found, model.scores(found), strict=True)
                for place, (b, s) in enumerate(zip(page, score, strict=True))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64()), strict=True)],
                names=["page_id", "place", "text", "score"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, place int, text string, score double")
