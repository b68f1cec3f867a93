"""Best-two-fit packing of whole documents into sequences of a fixed number of tokens.

Which documents share a sequence depends on their lengths alone, and there are no more lengths than tokens in a
sequence. So the packing is worked out once on the table of lengths and their counts (at most ``capacity`` rows,
whatever the size of the corpus): a bin is filled greedily with the longest that fit; then its smallest document gives
way to two unpacked ones that fill the gap it leaves more tightly. The bin is repeated as often as the counts allow.
Every document then takes its place by its number among those of equal length.

Defined results: a null or empty text is the end token alone. Only documents longer than a sequence are cut, into full
pieces and a rest. Rows that share a doc_id are documents of their own, each with its pieces from 0. Rows with a null
doc_id are packed like the others. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .shared import staged
from .tokens import word_encoder

CAPACITY = 2048
END = 0


def pieces(docs: DataFrame, path: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian, as wide as ``width`` bytes) of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        width, last = encoder.dtype.itemsize, encoder.end(end)
        step = capacity * width
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text) + last
                rows += [(doc, i // step, i // width, len(ids[i : i + step]) // width, ids[i : i + step]) for i in range(0, len(ids), step)]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([width] * len(rows), pa.int32())],
                names=["doc_id", "piece", "start", "length", "ids", "width"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary, width int")


def _fill(left: dict[int, int], lengths: list[int], gap: int) -> dict[int, int]:
    """Greedy fill: as many as possible of the longest that fits, then of the next."""
    used: dict[int, int] = {}
    at = len(lengths)
    while gap > 0:
        at = bisect_right(lengths, gap, 0, at)
        if not at:
            break
        length = lengths[at - 1]
        take = min(left[length], gap // length)
        used[length] = take
        gap -= take * length
        at -= 1
    return used


def _two(left: dict[int, int], lengths: list[int], used: dict[int, int], room: int, beat: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest at most ``room`` and above ``beat``."""
    free = [x for x in lengths[: bisect_right(lengths, room)] if left[x] > used.get(x, 0)]
    best, lo, hi = None, 0, len(free) - 1
    while lo <= hi:
        total = free[lo] + free[hi]
        if total > room:
            hi -= 1
            continue
        if total > beat and (lo < hi or left[free[lo]] - used.get(free[lo], 0) >= 2):
            best, beat = (free[lo], free[hi]), total
            if total == room:
                break
        lo += 1
    return best


def bins(counts: dict[int, int], capacity: int = CAPACITY, two: bool = True) -> Iterator[tuple[int, dict[int, int]]]:
    """(repeats, {length: how many of it}) of every kind of bin. Counts are used up to zero. Without ``two``, greedy alone."""
    left = {x: n for x, n in counts.items() if n > 0}
    lengths = sorted(left)
    while lengths:
        used = _fill(left, lengths, capacity)
        gap = capacity - sum(x * n for x, n in used.items())
        smallest = min(used)
        if two and gap and (pair := _two(left, lengths, used, gap + smallest, smallest)):
            used[smallest] -= 1
            for x in pair:
                used[x] = used.get(x, 0) + 1
            used = {x: n for x, n in used.items() if n}
        repeats = min(left[x] // n for x, n in used.items())
        yield repeats, used
        for x, n in used.items():
            left[x] -= n * repeats
            if not left[x]:
                del left[x]
                lengths.pop(bisect_right(lengths, x) - 1)


def fewest(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins by best-two-fit, or by its greedy fill alone for the rare counts where the exchange costs a bin."""
    return min((list(bins(counts, capacity, two)) for two in (True, False)), key=lambda found: sum(n for n, _ in found))


def slots(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows length, first number, copies in a bin, first sequence, offset in it; by length, then first number."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for repeats, used in fewest(counts, capacity):
        offset = 0
        for x in sorted(used, reverse=True):
            rows.append((x, taken.get(x, 0), used[x], sequence, offset))
            taken[x] = taken.get(x, 0) + used[x] * repeats
            offset += x * used[x]
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placed(parts: DataFrame, capacity: int = CAPACITY, spread: int | None = None) -> DataFrame:
    """``parts`` (with doc_id, piece, length and any payload) with sequence_id and offset added.

    ``parts`` must be a written table. Pieces of one length are numbered within ``spread`` hash buckets, and a bucket
    starts where the ones before it end, so no task sees all pieces of a frequent length.
    """
    spark = parts.sparkSession
    spread = spread or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucketed = parts.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.lit(spread)))
    sizes = checkpointed(bucketed.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n")))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("__n")).collect()}  # at most ``capacity`` rows
    table = slots(counts, capacity)
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpointed(sizes.select("length", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")))
    number = F.row_number().over(Window.partitionBy("length", "__b").orderBy("doc_id", "piece")) - 1
    numbered = (
        bucketed.withColumn("__k", number).join(starts, ["length", "__b"])
        .withColumn("__k", F.col("__k") + F.col("__first")).drop("__b", "__first")
    )
    columns = [c for c in parts.columns]
    fields = [parts.schema[c] for c in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            k = batch.column("__k").to_numpy()
            row = np.empty(len(k), np.int64)
            for x in np.unique(length):
                lo, hi = begins[x], begins[x + 1]
                at = length == x
                row[at] = lo + np.searchsorted(table[lo:hi, 1], k[at], "right") - 1
            nth = k - table[row, 1]
            copies = table[row, 2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(table[row, 3] + nth // copies),
                 pa.array(table[row, 4] + nth % copies * length)],
                names=[*columns, "sequence_id", "offset"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return numbered.mapInArrow(run, f"{shape}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their ids and their places: sequence_id, and offset without gaps from 0."""
    return placed(staged(pieces(docs, path, end, capacity), "pieces"), capacity)
