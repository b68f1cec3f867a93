"""Ranked lexical search by Block-Max MaxScore.

The index is cut into segments of ``SEGMENT_DOCS`` documents or ``SEGMENT_BYTES`` of text, each built by one task from the
documents it reads, so no text is shuffled. A segment holds a postings list for every term, in blocks of ``BLOCK``
documents. A block's documents and frequencies are packed in as few bytes as its largest values need; beside it stand its
competitive (frequency, length) pairs, those of which no other pair has a higher frequency and a shorter document. With
the collection's totals they give the exact highest score of any document in the block. A segment is a row of megabytes;
it is written in a row group of its own or of a few and handed to a search by one or two, so what a task holds does not
depend on how much it reads.

A search takes the queries in blocks of bounded size. For each segment and query, the lists are put in the order of
their highest scores. Those whose highest scores together can't reach the query's tenth score so far are not essential:
a document in no other list can't enter. The essential lists give the candidates; then the others are taken from the
highest down, and a candidate goes as soon as its score, the maximum of its block in this list and the highest scores of
the lists to come can't reach the tenth score. Only blocks with candidates left are unpacked. A task keeps one heap a
query over all segments it reads, and the heaps of all tasks are merged by a window.

Scores are the contract's integers. A document with an equal score and a smaller doc_id is never rejected, as bounds must
stay below the tenth score.

Defined results: a document without a term (null or empty text among them) is not in the collection. Rows that share a
doc_id are documents of their own; rows with a null doc_id come last among equal scores. Items that share an item_id are
one item with the terms of all; an item without terms gives no rows. Empty tables give an empty result. Further columns
are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .shared import LARGE_ROWS, staged, takes_over

# Fixed values of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, FREQUENCY, LENGTH, B_PERCENT = 1_000_000_000, 1000, 8, 90
K = 10

BLOCK = 128
SEGMENT_DOCS = 1024
SEGMENT_BYTES = 4 << 20
#: Distinct (item, term) pairs of one block of queries, about.
QUERY_TERMS = 200_000

_TERMS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    """Terms of the whole text, with repeats."""
    return (text or "").encode().translate(_TERMS).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each posting adds to a score, a unit of its term's weight."""
    return SCALE * tf // (FREQUENCY * tf + LENGTH * m)


def lengths_weighed(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents of n terms, in a collection of ``docs`` documents and ``terms`` terms."""
    if len(n) and B_PERCENT * int(n.max()) * docs < 1 << 63:
        return 100 - B_PERCENT + B_PERCENT * n * docs // terms
    return np.array([100 - B_PERCENT + B_PERCENT * int(x) * docs // terms for x in n], np.int64)


def _width(largest: np.ndarray) -> np.ndarray:
    """Bytes that hold each value: 1, 2, 4 or 8."""
    return np.select([largest < 1 << 8, largest < 1 << 16, largest < 1 << 32], [1, 2, 4], 8)


def _pack(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Write each value little-endian at its place, in its number of bytes."""
    for k in range(int(width.max(initial=0))):
        rows = width > k
        out[at[rows] + k] = (values[rows] >> (8 * k)) & 255


#: Columns of a segment, and how each array is stored.
ARRAYS = {
    "ids": "<i8", "null_ids": "u1", "sizes": "<i8", "lists": "<i4", "df": "<i4", "first": "<i4", "last": "<i4", "held": "<i4",
    "at": "<i8", "gap_width": "u1", "tf_width": "u1", "payload": "u1", "pairs": "<i4", "pair_tf": "<i4", "pair_size": "<i8",
}
SEGMENT = "n_docs long, n_terms long, terms binary, " + ", ".join(f"{name} binary" for name in ARRAYS)


def segment(ids: list[int | None], counts: list[Counter]) -> dict:
    """Postings of documents, each given by the counts of its terms (at least one)."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    term = np.fromiter((number[t] for c in counts for t in c), np.int64)
    tf = np.fromiter((x for c in counts for x in c.values()), np.int64)
    sizes = np.array([sum(c.values()) for c in counts], np.int64)
    doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    order = np.argsort(term, kind="stable")
    term, tf, doc = term[order], tf[order], doc[order]
    df = np.bincount(term, minlength=len(number))
    start = np.cumsum(df) - df
    blocks_of = -(-df // BLOCK)
    lists = np.concatenate([[0], np.cumsum(blocks_of)])
    place = np.arange(len(term)) - start[term]
    block = lists[term] + place // BLOCK
    begin = np.searchsorted(block, np.arange(lists[-1]))
    held = np.diff(np.append(begin, len(block)))
    gap = np.diff(doc, prepend=0)
    gap[begin] = 0
    gap_width, tf_width = (_width(np.maximum.reduceat(x, begin)) for x in (gap, tf))
    room = held * (gap_width + tf_width)
    at = np.cumsum(room) - room
    payload = np.zeros(int(room.sum()), np.uint8)
    inside = place % BLOCK
    _pack(payload, at[block] + inside * gap_width[block], gap, gap_width[block])
    _pack(payload, at[block] + held[block] * gap_width[block] + inside * tf_width[block], tf, tf_width[block])
    # Competitive pairs: by falling frequency, those shorter than all before them in the block.
    n = sizes[doc]
    falling = np.lexsort((n, -tf, block))
    shift = block * (int(n.max()) + 1)
    shown = (n - shift)[falling]
    lowest = np.minimum.accumulate(shown)
    ahead = np.append(np.inf, lowest[:-1])
    keep = falling[shown < ahead]
    pairs = np.concatenate([[0], np.cumsum(np.bincount(block[keep], minlength=lists[-1]))])
    arrays = {
        "ids": [NO_ID if i is None else i for i in ids], "null_ids": [i is None for i in ids], "sizes": sizes, "lists": lists,
        "df": df, "first": doc[begin], "last": doc[begin + held - 1], "held": held, "at": at, "gap_width": gap_width,
        "tf_width": tf_width, "payload": payload, "pairs": pairs, "pair_tf": tf[keep], "pair_size": n[keep]}
    return {
        "n_docs": len(ids), "n_terms": int(sizes.sum()), "terms": b"\n".join(number),
        **{name: np.asarray(values).astype(ARRAYS[name]).tobytes() for name, values in arrays.items()}}


def _batch(made: dict) -> pa.RecordBatch:
    kinds = {"n_docs": pa.int64(), "n_terms": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in made.items()], names=list(made))


def index(docs: DataFrame, segment_docs: int = SEGMENT_DOCS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The segments, one row each, written to the shared folder."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("lexical", lambda: None)
        ids, counts, size = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = t.as_py()
                if not (terms := terms_of(text)):
                    continue
                ids.append(d.as_py())
                counts.append(Counter(terms))
                size += len(text)
                if len(ids) >= segment_docs or size >= segment_bytes:
                    made = _batch(segment(ids, counts))
                    ids, counts, size = [], [], 0
                    yield made
        if ids:
            yield _batch(segment(ids, counts))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, SEGMENT)
    return staged(rows, "lexical", **LARGE_ROWS)


class Segment:
    """A segment in a task; blocks are unpacked when first looked at."""

    def __init__(self, row: dict, docs: int, terms: int):
        for name, kind in ARRAYS.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.number = {t: i for i, t in enumerate(row["terms"].split(b"\n"))}
        self.m = lengths_weighed(self.sizes, docs, terms)
        self.docs, self.terms = docs, terms
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.best = np.zeros(len(self.held), np.int64)
        self.top: dict[int, int] = {}

    def bound(self, lists: list[int]) -> None:
        """Work out the highest impact of each block of these lists, and of each list."""
        if not lists:
            return
        k = np.array(lists)
        lo, hi = self.pairs[self.lists[k]], self.pairs[self.lists[k + 1]]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
        value = impacts(self.pair_tf[at].astype(np.int64), lengths_weighed(self.pair_size[at], self.docs, self.terms))
        first, after = self.lists[k], self.lists[k + 1]
        blocks = np.repeat(first - np.concatenate([[0], np.cumsum(after - first)[:-1]]), after - first) + np.arange(int((after - first).sum()))
        ends = np.cumsum(self.pairs[blocks + 1] - self.pairs[blocks])
        self.best[blocks] = np.maximum.reduceat(value, np.append(0, ends[:-1]))
        tops = np.maximum.reduceat(value, np.cumsum(hi - lo) - (hi - lo))
        self.top.update(zip(lists, tops.tolist(), strict=True))

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        found = self.unpacked.get(b)
        if found is None:
            at, held, gw, tw = int(self.at[b]), int(self.held[b]), int(self.gap_width[b]), int(self.tf_width[b])
            gaps = np.frombuffer(self.payload, f"<u{gw}", held, at).astype(np.int64)
            tf = np.frombuffer(self.payload, f"<u{tw}", held, at + held * gw).astype(np.int64)
            docs = np.cumsum(gaps) + self.first[b]
            found = self.unpacked[b] = docs, impacts(tf, self.m[docs])
        return found


class Heap:
    """The best (score, doc_id) of a query so far."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.null = np.zeros(0, np.uint8)

    @property
    def least(self) -> int:
        """A score below which nothing enters."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def search_segment(part: Segment, weights: dict[bytes, int], heap: Heap) -> int:
    """Put the segment's best documents for one query into its heap; returns how many blocks were looked into."""
    lists = sorted(
        ((w * part.top[k], w, k) for t, w in weights.items() if w > 0 and (k := part.number.get(t)) is not None))
    if not lists:
        return 0
    below = np.cumsum([x for x, _, _ in lists])
    essential = int(np.searchsorted(below, heap.least))  # lists before it can't reach the heap together
    if essential == len(lists):
        return 0
    score, looked = np.zeros(len(part.ids), np.int64), 0
    for _, w, k in lists[essential:]:
        for b in range(part.lists[k], part.lists[k + 1]):
            docs, value = part.block(b)
            score[docs] += w * value
            looked += 1
    left = np.nonzero(score)[0]
    for i in range(essential - 1, -1, -1):
        _, w, k = lists[i]
        left = left[score[left] + below[i] >= heap.least]
        if not len(left):
            return looked
        lo, hi = part.lists[k], part.lists[k + 1]
        b = lo + np.searchsorted(part.last[lo:hi], left)
        inside = b < hi
        inside[inside] = part.first[b[inside]] <= left[inside]
        most = np.zeros(len(left), np.int64)
        most[inside] = w * part.best[b[inside]]
        stays = score[left] + most + (below[i - 1] if i else 0) >= heap.least
        left, b, inside = left[stays], b[stays], inside[stays]
        for one in np.unique(b[inside]).tolist():
            docs, value = part.block(one)
            wanted = left[inside & (b == one)]
            at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
            hit = docs[at] == wanted
            score[wanted[hit]] += w * value[at[hit]]
            looked += 1
    left = left[score[left] >= heap.least]
    if len(left):
        heap.add(score[left], part.ids[left], part.null_ids[left])
    return looked


def _searched(segments: DataFrame, queries: dict[int, dict[bytes, int]], docs: int, terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k documents a task knows for each query."""
    wanted = set().union(*queries.values()) if queries else set()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over("lexical", lambda: None)
        heaps = {item: Heap(k) for item in queries}
        for batch in batches:
            for i in range(batch.num_rows):
                part = Segment({name: batch.column(name)[i].as_py() for name in ("terms", *ARRAYS)}, docs, terms)
                part.bound([n for t, n in part.number.items() if t in wanted])
                for item, weights in queries.items():
                    search_segment(part, weights, heaps[item])
        rows = [
            (item, None if none else i, s) for item, heap in heaps.items()
            for i, none, s in zip(heap.ids.tolist(), heap.null.tolist(), heap.score.tolist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "doc_id", "score"])

    return segments.select("terms", *ARRAYS).mapInArrow(run, "item long, doc_id long, score long")


def frequencies(segments: DataFrame) -> DataFrame:
    """(term, df) of every term of every segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, df in zip(batch.column("terms"), batch.column("df"), strict=True):
                names = terms.as_py().decode().split("\n")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(np.frombuffer(df.as_py(), ARRAYS["df"]).astype(np.int64))], names=["term", "df"])

    return segments.select("terms", "df").mapInArrow(run, "term string, df long")


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of the items."""
    low = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    return items.select(
        F.col("item_id").cast("long"), F.explode(F.regexp_extract_all(low, F.lit(f"({TERM})"), F.lit(1))).alias("term")).distinct()


def weighed(pairs: DataFrame, segments: DataFrame, docs: int) -> DataFrame:
    """(item_id, term, weight) of the pairs whose term some document holds."""
    names = pairs.select("term").distinct()
    df = frequencies(segments).join(names, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return pairs.join(df, "term").select("item_id", "term", weight.alias("weight"))


def top_documents(items: DataFrame, docs: DataFrame, k: int = K, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item."""
    segments = index(docs)
    totals = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    pairs = checkpointed(item_terms(items))
    known = checkpointed(weighed(pairs, segments, totals[0] or 0))
    # Items in blocks by a hash; each block's terms go to every task that searches.
    blocks = -(-known.count() // query_terms)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    found = None
    for one in range(blocks):
        names: dict[int | None, int] = {}
        queries: dict[int, dict[bytes, int]] = {}
        for item, term, weight in known.where(block == one).collect():
            queries.setdefault(names.setdefault(item, len(names)), {})[term.encode()] = weight
        part = _searched(segments, queries, totals[0], totals[1], k)
        back = items.sparkSession.createDataFrame(sorted(((n, i) for i, n in names.items())), "item long, item_id long")
        part = part.join(back, "item").select("item_id", "doc_id", "score")
        found = part if found is None else found.union(part)
    if found is None:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
