"""Fill-in-middle by piece tables.

A document is a list of descriptors (buffer, start, length) over immutable buffers: its text and the three sentinels.
Cutting splits descriptors, a form arranges them, and neither copies text. The output's hash streams over the descriptors
slice by slice. Restoring takes the output as the buffer, cuts it at its sentinels, and puts the descriptors back by the
inverse of the form's permutation.

The cuts and the form come from a hash of the doc_id, so a retry makes the same choice. Texts that hold a sentinel stay
plain, so every other output can be cut again without doubt: a sentinel has ``<`` only at its start and ``>`` only at its
end, so none can arise across the border of two pieces.

Defined results: a null text is empty; an empty text is plain. A null doc_id has no digits, so all such rows use the hash
of ``1:``. Rows that share a doc_id have the same hashes and their own cuts. Texts of any length are cut by code points;
a slice of ``SLICE`` code points is encoded at a time. An empty table gives an empty result. Further columns are not read
by :func:`digests` and :func:`pieces`, and not touched by :func:`transformed` and :func:`restored`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, takes_over

# Sentinels before prefix, suffix and middle; per cent of plain documents, and of spm among the others.
SENTINELS = ("<P>", "<S>", "<M>")
ARRANGED, SPM = 90, 20

#: Order of the descriptors prefix, middle, suffix, <P>, <S>, <M> in the output of a form.
FORMS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
#: Buffer 0 is the text; the sentinels follow.
TEXT = 0

SLICE = 1 << 20


class Piece(NamedTuple):
    """``length`` code points of a buffer, from ``start``."""

    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over buffers that never change."""

    def __init__(self, buffers: tuple[str, ...], pieces: list[Piece]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: str) -> PieceTable:
        return cls((text, *SENTINELS), [Piece(TEXT, 0, len(text))])

    def cut(self, *places: int) -> PieceTable:
        """Split at code points counted from the start; a cut at an end gives an empty descriptor, so n cuts give n + 1."""
        out, at, rest = [], 0, list(self.pieces)
        for place in sorted(places):
            while rest and at + rest[0].length < place:
                at += rest[0].length
                out.append(rest.pop(0))
            buffer, start, length = rest.pop(0)
            out.append(Piece(buffer, start, place - at))
            rest.insert(0, Piece(buffer, start + place - at, length - (place - at)))
            at = place
        return PieceTable(self.buffers, out + rest)

    def with_sentinels(self) -> PieceTable:
        return PieceTable(self.buffers, self.pieces + [Piece(k, 0, len(self.buffers[k])) for k in range(1, len(self.buffers))])

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[k] for k in order])

    def slices(self) -> Iterator[str]:
        for buffer, start, length in self.pieces:
            for at in range(start, start + length, SLICE):
                yield self.buffers[buffer][at : min(at + SLICE, start + length)]

    def text(self) -> str:
        return "".join(self.slices())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.slices():
            digest.update(part.encode())
        return digest.hexdigest()


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    back = [0] * len(order)
    for at, k in enumerate(order):
        back[k] = at
    return tuple(back)


def chosen(doc_id: int | None, text: str) -> tuple[str, int | None, int | None]:
    """Form, prefix and middle length of a document."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    first, second, third, fourth = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or third % 100 >= ARRANGED or any(s in text for s in SENTINELS):
        return "plain", None, None
    low, high = sorted((first % (len(text) + 1), second % (len(text) + 1)))
    return "spm" if fourth % 100 < SPM else "psm", low, high - low


def arranged(text: str, form: str, prefix: int | None, middle: int | None) -> PieceTable:
    """The output's descriptors."""
    whole = PieceTable.of(text)
    return whole if form == "plain" else whole.cut(prefix, prefix + middle).with_sentinels().arranged(FORMS[form])


def rebuilt(output: str, form: str) -> PieceTable:
    """The text's descriptors over the output as buffer, from output and form alone."""
    if form == "plain":
        return PieceTable.of(output)
    order = FORMS[form]
    marks = [k for k in order if k >= 3]
    places, at = [], 0
    for k in marks:  # each sentinel comes first where it was put, as no piece holds one
        at = output.index(SENTINELS[k - 3], at)
        places += [at, at + len(SENTINELS[k - 3])]
        at += len(SENTINELS[k - 3])
    parts = PieceTable.of(output).cut(*places[1:])  # the first sentinel begins the output
    prefix_middle_suffix = parts.arranged(inverse(order)).pieces[:3]
    return PieceTable(parts.buffers, prefix_middle_suffix)


def _mapped(docs: DataFrame, schema: str, row) -> DataFrame:
    """doc_id and what ``row`` gives for (doc_id, text), column by column."""
    names, kinds = zip(*(x.rsplit(" ", 1) for x in schema.split(", ")), strict=True)
    of = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("fill_middle", lambda: None)
        for batch in batches:
            rows = [row(d.as_py(), t.as_py() or "") for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, of[k]) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {schema}")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of the output and of the text rebuilt from it."""

    def row(doc_id, text):
        form, prefix, middle = chosen(doc_id, text)
        table = arranged(text, form, prefix, middle)
        output = text if form == "plain" else table.text()
        return len(text), form, prefix, middle, table.sha256(), rebuilt(output, form).sha256()

    return _mapped(docs, "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string", row)


def pieces(docs: DataFrame) -> DataFrame:
    """doc_id, form and the output's descriptors in order: place, buffer (``text`` or a sentinel), start, length.

    Whoever holds the texts can make the output from these without it being stored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("fill_middle", lambda: None)
        for batch in batches:
            rows = []
            for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc_id, text = d.as_py(), t.as_py() or ""
                form, prefix, middle = chosen(doc_id, text)
                for at, piece in enumerate(arranged(text, form, prefix, middle).pieces):
                    name = "text" if piece.buffer == TEXT else SENTINELS[piece.buffer - 1]
                    rows.append((doc_id, form, at, name, piece.start, piece.length))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "form", "place", "buffer", "start", "length"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, form string, place int, buffer string, start long, length long")


def transformed(docs: DataFrame, form: str = "form") -> DataFrame:
    """``docs`` with ``text`` arranged and a further column ``form``; a null text comes out empty."""

    @F.arrow_udf("struct<text:string,form:string>")
    def arrange(ids: pa.Array, texts: pa.Array) -> pa.Array:
        takes_over("fill_middle", lambda: None)
        rows = []
        for d, t in zip(ids, texts, strict=True):
            text = t.as_py() or ""
            made = chosen(d.as_py(), text)
            rows.append({"text": arranged(text, *made).text(), "form": made[0]})
        return pa.array(rows, pa.struct([("text", pa.string()), ("form", pa.string())]))

    made = fresh(docs, "__made")[0]
    rows = docs.withColumn(made, arrange.asNondeterministic()(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return rows.select(
        *[F.col(made)["text"].alias("text") if c == "text" else F.col(c) for c in docs.columns], F.col(made)["form"].alias(form))


def restored(docs: DataFrame, form: str = "form") -> DataFrame:
    """The inverse of :func:`transformed`: ``docs`` with ``text`` as it was, without the form column."""

    @F.arrow_udf("string")
    def rebuild(texts: pa.Array, forms: pa.Array) -> pa.Array:
        takes_over("fill_middle", lambda: None)
        return pa.array([rebuilt(t.as_py() or "", f.as_py()).text() for t, f in zip(texts, forms, strict=True)], pa.string())

    return docs.withColumn("text", rebuild.asNondeterministic()("text", form)).drop(form)
