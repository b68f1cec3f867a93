"""Exact top-k by inner product as a Voronoi kNN join.

Components become integers, floor(64 x). With M the largest norm, a candidate v is taken as the point (v, sqrt(M^2 - |v|^2))
and a query q as (q, 0): the nearest points are the highest inner products, as |q|^2 + M^2 - 2 q.v is the squared
distance. Both sides are dealt to the cells of a bounded number of pivots. Small summaries of the cells (counts, radii,
the distances of the few members nearest to the pivot) give each group of queries an upper bound of the distance of its
k-th neighbour, and from it the least distance to the pivot at which a member of another cell can still matter. Blocks
of candidates, cut by that distance, go only to the groups that need them; each task solves its group locally, block by
block. Bounds are kept loose by ``SLACK``, scores are whole numbers, so the result is exact.

Defined results: vectors that are null or hold a null or non-finite component, and rows with a null vec_id, take no
part. A shorter vector counts as padded with zeros. Rows that repeat a vec_id are candidates of their own, but never of
a query with that id; a query that is repeated gets its ranks once for each row. Equal scores rank by vec_id. Scores beyond 64
bits are cut to their range. Fewer candidates than k give fewer ranks. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

K = 20
EVERY = 20
SCALE = 64.0
PIVOTS = 64
#: Rings around a pivot that candidates of its cell are cut into.
RINGS = 4
#: Queries of a group and candidates of a block, at most.
GROUP, BLOCK = 256, 1024
#: Blocks of one group that one task solves; further blocks of the group go to others, whose results are merged.
BLOCKS_PER_TASK = 256
#: Looseness of a bound, as a share of the largest norm; distances are off by far less.
SLACK = 1e-5


def _whole(values: list[float | None] | None) -> np.ndarray | None:
    if values is None or any(x is None for x in values):
        return None
    x = np.floor(SCALE * np.array(values, np.float64))
    return x if np.isfinite(x).all() else None


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vs, sizes, norms, tops = [], [], [], [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            x = _whole(v)
            if i is not None and x is not None:
                ids.append(i)
                vs.append(x.astype("<f8").tobytes())
                sizes.append(len(x))
                norms.append(float(x @ x))
                tops.append(float(np.abs(x).max(initial=0)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(vs, pa.binary()), pa.array(sizes, pa.int32()), pa.array(norms, pa.float64()), pa.array(tops, pa.float64())],
            names=["vec_id", "v", "size", "norm2", "top"])


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, v (components as whole doubles), size, norm2, top (largest component) of the rows that take part."""
    return table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
        _vectors, "vec_id long, v binary, size int, norm2 double, top double")


def _matrix(blobs: list[bytes], width: int, kind: str = "<f8") -> np.ndarray:
    out = np.zeros((len(blobs), width))
    for row, b in zip(out, blobs, strict=True):
        x = np.frombuffer(b, kind)
        row[: len(x)] = x
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact whole inner products: in doubles as long as no sum can leave their range, else in Python's integers."""
    top = (np.abs(q).sum(1).max(initial=0)) * np.abs(c).max(initial=0)
    if top < 2**53:
        return (q @ c.T).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in c] for x in q]
    return np.array([[min(max(s, low), high) for s in row] for row in exact], dtype=np.int64)


def _to_pivots(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the points (x, extra) to all pivots."""
    d = (x**2).sum(1)[:, None] + (extra**2)[:, None] - 2 * (x @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1]) + (pivots**2).sum(1)
    return np.sqrt(np.maximum(d, 0))


def _celled(width: int, top2: float, pivots: np.ndarray, kind: str, query: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v").to_pylist(), width)
            extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(top2 - batch.column("norm2").to_numpy(), 0))
            d = _to_pivots(x, extra, pivots)
            cell = d.argmin(1)
            small = [row.tobytes() for row in x.astype(kind)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(small, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])],
                names=["vec_id", "v", "cell", "d"])

    return run


def top_k(table: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each row whose vec_id divides by ``every``."""
    spark = table.sparkSession
    rows = checkpointed(vectors(table))
    total = rows.agg(F.max("size"), F.max("norm2"), F.max("top"), F.count(F.lit(1))).first()
    if not total[3]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, top2 = max(1, total[0]), total[1]
    kind = next((t for t, most in (("<i1", 2**7), ("<i2", 2**15), ("<i4", 2**31)) if total[2] < most), "<f8")
    slack = SLACK * (1 + np.sqrt(top2))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).select("v").collect()  # at most ``pivots``
    base = _matrix([r[0] for r in chosen], width)
    centres = np.unique(np.hstack([base, np.sqrt(np.maximum(top2 - (base**2).sum(1), 0))[:, None]]), axis=0)
    apart = _to_pivots(centres[:, :-1], centres[:, -1], centres)
    schema = "vec_id long, v binary, cell int, d double"
    points = checkpointed(rows.mapInArrow(_celled(width, top2, centres, kind, False), schema))
    queries = checkpointed(rows.where(F.col("vec_id") % every == 0).mapInArrow(_celled(width, top2, centres, kind, True), schema))

    # Summaries of the cells; at most ``pivots`` rows, of up to k + 1 pairs, reach the driver. A query is no neighbour of
    # its own, and an id counts once: k + 1 different ids hold k neighbours of any query.
    spread = F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("vec_id", "v"), spread)
    near = points.groupBy("cell", "vec_id").agg(F.min("d").alias("d")).withColumn("s", F.pmod(F.xxhash64("vec_id"), spread))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("cell", "s").orderBy("d"))).where(F.col("r") <= k + 1)
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).where(F.col("r") <= k + 1)
    nearest = {r[0]: r[1] for r in near.groupBy("cell").agg(F.collect_list(F.struct("vec_id", "d"))).collect()}
    radius = {r[0]: r[1] for r in points.groupBy("cell").agg(F.max("d")).collect()}

    # Groups of queries: cell after cell, each next to one that is near, in order of distance, ``GROUP`` to a group.
    sizes = checkpointed(queries.groupBy("cell", salt.alias("s")).agg(F.count(F.lit(1)).alias("n")))
    held = {r[0]: r[1] for r in sizes.groupBy("cell").agg(F.sum("n")).collect()}  # at most ``pivots`` rows
    begin, at, left = {}, 0, set(held)
    here = min(left, default=None)
    while left:
        begin[here], at = at, at + held[here]
        left.remove(here)
        here = min(left, key=lambda j, i=here: (apart[i, j], j), default=None)
    if not begin:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    offset = F.create_map(*[F.lit(x) for pair in begin.items() for x in pair])
    before = Window.partitionBy("cell").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("cell").alias("__c"), F.col("s").alias("__s"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) + offset[F.col("cell")]).alias("first"))
    numbered = queries.withColumn("s", salt).withColumn(
        "r", F.row_number().over(Window.partitionBy("cell", "s").orderBy("d", "vec_id")) - 1)
    numbered = numbered.join(starts, (F.col("cell") == F.col("__c")) & (F.col("s") == F.col("__s")))
    groups = checkpointed(
        numbered.withColumn("part", F.floor((F.col("r") + F.col("first")) / GROUP)).groupBy("part").agg(
            F.collect_list(F.struct("vec_id", "v", "cell", "d")).alias("members")))

    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each group and cell of candidates, the least distance to that cell's pivot that can matter."""
        for batch in batches:
            out = []
            for part, cells, ds in zip(*(batch.column(c).to_pylist() for c in ("part", "cells", "ds")), strict=True):
                cells, ds = np.array(cells), np.array(ds)
                least = dict.fromkeys(nearest, np.inf)
                for i in np.unique(cells):
                    reach = ds[cells == i].max()
                    above: dict[int, float] = {}
                    for j, rows in nearest.items():
                        for name, d in rows:
                            above[name] = min(above.get(name, np.inf), d + reach + apart[i, j])
                    ranked = sorted(above.values())
                    theta = ranked[k] if len(ranked) > k else np.inf
                    for j in least:
                        least[j] = min(least[j], apart[i, j] - reach - theta - slack)
                out += [(part, j, float(x)) for j, x in least.items()]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64()), strict=True)],
                names=["part", "cell", "least"])

    limits = checkpointed(groups.select("part", F.col("members.cell").alias("cells"), F.col("members.d").alias("ds")).mapInArrow(
        bounds, "part long, cell int, least double"))

    # Blocks of candidates: rings of a cell, large ones in parts.
    edge = F.create_map(*[F.lit(x) for j, r in radius.items() for x in (j, float(r) + 1e-9)])
    ringed = points.withColumn("ring", F.floor(F.col("d") * RINGS / edge[F.col("cell")]))
    # At most ``pivots`` times ``RINGS`` + 1 counts reach the driver.
    counted = [((r[0], r[1]), -(-r[2] // BLOCK)) for r in ringed.groupBy("cell", "ring").agg(F.count(F.lit(1))).collect()]
    shares = F.create_map(*[x for (cell, ring), n in counted for x in (F.lit(cell * (RINGS + 1) + ring), F.lit(n))])
    blocks = checkpointed(
        ringed.withColumn("nth", F.pmod(F.xxhash64("vec_id", "v"), shares[F.col("cell") * (RINGS + 1) + F.col("ring").cast("int")]))
        .groupBy("cell", "ring", "nth").agg(F.max("d").alias("far"), F.collect_list(F.struct("vec_id", "v")).alias("block")))
    wanted = blocks.select("cell", "ring", "nth", "far").join(limits, "cell").where("far >= least")
    place = F.row_number().over(Window.partitionBy("part").orderBy("cell", "ring", "nth")) - 1
    work = (
        wanted.select("part", "cell", "ring", "nth", F.floor(place / BLOCKS_PER_TASK).alias("slice"))
        .join(blocks.select("cell", "ring", "nth", "block"), ["cell", "ring", "nth"])
        .join(groups.select("part", F.col("members.vec_id").alias("ids"), F.col("members.v").alias("vs")), "part")
        .select("part", "slice", "ids", "vs", "block")
    )
    dealt = work.repartition("part", "slice").sortWithinPartitions("part", "slice")

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, q, best = None, None, None, None

        def out():
            row, vec, score = best
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * len(row), pa.int64()), pa.array(row), pa.array(ids[row]), pa.array(vec), pa.array(score)],
                names=["part", "row", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in ("part", "slice"))
                if key != at:
                    if at is not None:
                        yield out()
                    at = key
                    ids = np.array(batch.column("ids")[i].as_py(), np.int64)
                    q = _matrix(batch.column("vs")[i].as_py(), width, kind)
                    best = tuple(np.zeros(0, np.int64) for _ in range(3))
                block = batch.column("block")[i].values
                cand = block.field("vec_id").to_numpy()
                scores = _scores(q, _matrix(block.field("v").to_pylist(), width, kind))
                floor = np.full(len(ids), np.iinfo(np.int64).min)
                full = np.bincount(best[0], minlength=len(ids)) >= k
                low = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(low, best[0], best[2])
                floor[full] = low[full]
                r, c = np.nonzero((scores >= floor[:, None]) & (ids[:, None] != cand[None, :]))
                row, vec, score = (np.concatenate(x) for x in zip(best, (r, cand[c], scores[r, c]), strict=True))
                # The highest score has the lowest complement, also where its negative has no place in 64 bits.
                order = np.lexsort((vec, ~score, row))
                sorted_row = row[order]
                keep = order[np.arange(len(row)) - np.searchsorted(sorted_row, sorted_row) < k]
                best = row[keep], vec[keep], score[keep]
        if at is not None:
            yield out()

    partial = dealt.mapInArrow(solve, "part long, row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("part", "row").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
