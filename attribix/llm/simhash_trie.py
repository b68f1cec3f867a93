"""Near-duplicates by SimHash, found by a self-join of the binary trie of fingerprints.

The trie's nodes are walked in pairs from the root. A pair carries the bits in which its two prefixes differ; children
whose differing bits exceed the budget are never visited. The upper levels are walked by Spark, a few bits a
round and only where a pair still holds more than ``LEAF`` fingerprints, so a crowded node (a large group of near
copies) is split further while the others are done. The rest of the walk runs inside tasks, on two sorted blocks of
at most ``LEAF`` fingerprints each.

Only distinct fingerprints enter the trie; a group of equal ones is a single leaf. Tasks return stars of what is
linked, not pairs, so nothing grows with the square of a group.

Defined results: a null or empty text has fingerprint zero and is linked like any other. Rows with a null doc_id are
fingerprinted and lend their links; they name no component, so a component of such rows alone has a null id. Repeated
rows each get a row. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .shared import UnionFind, ascii_words, components, fresh, takes_over

SEED = 42
SHINGLE = 3
BUDGET = 2
#: Fingerprints of a node that one task takes whole.
LEAF = 4096
#: Bits the trie goes down in one round of Spark at most.
STRIDE = 6
#: Pairs of fingerprints in the node pairs of one task, most of which the walk never looks at; a fraction of a second.
WORK = 1 << 29
#: Node pairs a task holds at a time; more are put aside and walked later.
FRONTIER = 200_000
#: Products of two nodes' sizes at which their fingerprints are compared at once.
DIRECT = 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, A-Z in lower case."""
    words = ascii_words((text or "").encode().lower())
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes())


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    takes_over("simhash", lambda: None)
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(found.view(np.int64))], names=["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), fp (as a signed long) of every document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h")).mapInArrow(
        _fingerprints, "doc_id long, h long, fp long")


def linked_blocks(a: np.ndarray, b: np.ndarray | None, budget: int, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of fingerprints within ``budget`` bits, by walking two tries together.

    ``a`` and ``b`` are sorted unsigned arrays, each of one node at depth ``top``; without ``b``, pairs i < j of ``a``.
    """
    one = b is None
    b = a if one else b
    if not len(a) or not len(b):
        return
    first = int(a[0] ^ b[0]) >> (64 - top) if top else 0
    start = np.array([[0, len(a), 0, len(b), first.bit_count(), top]], np.int64)
    stack = [start] if first.bit_count() <= budget else []
    while stack:
        pairs = stack.pop()
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (size <= DIRECT) | (pairs[:, 5] == 64)
        for lo in range(0, int(small.sum()), FRONTIER // DIRECT):
            yield from _compared(a, b, pairs[small][lo : lo + FRONTIER // DIRECT], budget, one)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        bit = (63 - pairs[:, 5]).astype(np.uint64)
        cut = [_cut(x, pairs[:, k], pairs[:, k + 1], bit) for x, k in ((a, 0), (b, 2))]
        down = []
        for x in (0, 1):
            for y in (0, 1):
                kid = np.stack([
                    cut[0] if x else pairs[:, 0], pairs[:, 1] if x else cut[0],
                    cut[1] if y else pairs[:, 2], pairs[:, 3] if y else cut[1],
                    pairs[:, 4] + (x != y), pairs[:, 5] + 1], 1)
                ok = (kid[:, 0] < kid[:, 1]) & (kid[:, 2] < kid[:, 3]) & (kid[:, 4] <= budget)
                if one:
                    ok &= kid[:, 0] <= kid[:, 2]  # a pair of siblings once
                down.append(kid[ok])
        down = np.concatenate(down)
        stack += [down[i : i + FRONTIER] for i in range(0, len(down), FRONTIER)]


def _cut(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where each node's half with the next bit set begins."""
    mask = np.left_shift(np.uint64(1), bit)
    head = x[lo] & ~(mask | (mask - np.uint64(1)))
    return np.clip(np.searchsorted(x, head | mask), lo, hi)


def _compared(a, b, pairs, budget, one) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
    size = na * nb
    at = np.repeat(np.arange(len(pairs)), size)
    k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    i, j = pairs[at, 0] + k // nb[at], pairs[at, 2] + k % nb[at]
    ok = np.bitwise_count(a[i] ^ b[j]) <= budget
    if one:
        ok &= i < j
    if ok.any():
        yield i[ok], j[ok]


def _walk(budget: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for depth, xs, ys in zip(*(batch.column(n).to_pylist() for n in ("depth", "xs", "ys")), strict=True):
                a = np.sort(np.array(xs, np.int64).view(np.uint64))
                b = None if ys is None else np.sort(np.array(ys, np.int64).view(np.uint64))
                every = a if b is None else np.concatenate([a, b])
                found, links = UnionFind(), np.zeros(len(every), np.int64)
                for i, j in linked_blocks(a, b, budget, depth):
                    j = j if b is None else j + len(a)
                    links += np.bincount(i, minlength=len(every)) + np.bincount(j, minlength=len(every))
                    for p, q in zip(every[i].tolist(), every[j].tolist(), strict=True):
                        found.join(p, q)
                at = np.nonzero(links)[0]
                if len(at):
                    roots = np.array([found.root(x) for x in every[at].tolist()], np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(every[at].view(np.int64)), pa.array(roots.view(np.int64)), pa.array(links[at])],
                        names=["fp", "root", "n_links"])

    return run


def node_pairs(distinct: DataFrame, budget: int = BUDGET, leaf: int = LEAF, stride: int = STRIDE) -> DataFrame:
    """(depth, x, y, n, m): pairs of trie nodes within the budget, each of at most ``leaf`` fingerprints, and their sizes.

    Every two fingerprints within the budget lie in exactly one pair. A round goes down as many bits as bring the middle
    one of the nodes that are still too large just below ``leaf``, so nodes are not cut finer than they need; what is
    larger goes on in the next round.
    """
    node = lambda d: F.shiftrightunsigned("fp", 64 - d) if d else F.lit(0).cast("long")
    done, depth = None, 0
    pairs = distinct.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).alias("bits"), "n",
        F.col("n").alias("m"))
    while True:
        pairs = checkpointed(pairs)
        small = (F.greatest("n", "m") <= leaf) if depth < 64 else F.lit(True)
        part = pairs.where(small).select(F.lit(depth).alias("depth"), "x", "y", "n", "m")
        done = part if done is None else done.union(part)
        open_pairs = pairs.where(~small)
        size = None if depth >= 64 else open_pairs.agg(F.percentile_approx(F.greatest("n", "m"), 0.5)).first()[0]
        if size is None:
            return done
        step = min(max(1, math.ceil(math.log2(size / leaf))), stride, 64 - depth)
        masks = sorted((m for m in range(1 << step) if m.bit_count() <= budget), key=int.bit_count)
        below = checkpointed(distinct.groupBy(node(depth + step).alias("kid")).agg(F.count(F.lit(1)).alias("size")))
        kids = below.withColumn("parent", F.shiftrightunsigned("kid", step))
        wanted = (
            open_pairs.join(kids, F.col("x") == F.col("parent"))
            .select(F.col("kid").alias("x2"), F.col("size").alias("n2"), "x", "y", "bits")
            .withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
            .where(F.col("bits") + F.bit_count("mask") <= budget)
            .withColumn("y2", F.shiftleft("y", step).bitwiseOR(
                F.col("x2").bitwiseAND(F.lit((1 << step) - 1).cast("long")).bitwiseXOR(F.col("mask"))))
            .where((F.col("x") != F.col("y")) | (F.col("x2") <= F.col("y2")))
        )
        pairs = wanted.join(below, F.col("y2") == F.col("kid")).select(
            F.col("x2").alias("x"), F.col("y2").alias("y"),
            (F.col("bits") + F.bit_count("mask")).cast("int").alias("bits"), F.col("n2").alias("n"),
            F.col("size").alias("m"))
        depth += step


def linked(distinct: DataFrame, budget: int = BUDGET, leaf: int = LEAF, stride: int = STRIDE) -> DataFrame:
    """(fp, root, n_links): stars of fingerprints within ``budget`` bits of each other, from distinct ones.

    n_links counts the partners met in one pair of nodes; each pair of fingerprints meets in exactly one, so their
    sums are exact. The pairs are dealt over tasks by the work they make, as their bytes say little of it.
    """
    spark = distinct.sparkSession
    node = lambda d: F.shiftrightunsigned("fp", 64 - d) if d else F.lit(0).cast("long")
    tasks = node_pairs(distinct, budget, leaf, stride)
    depths = [r[0] for r in tasks.select("depth").distinct().collect()]  # at most 64 of them
    if not depths:
        return spark.createDataFrame([], "fp long, root long, n_links long")
    parts = max(1, -(-int(tasks.agg(F.sum(F.col("n") * F.col("m"))).first()[0]) // WORK))
    ends = tasks.select("depth", F.col("x").alias("node")).union(tasks.select("depth", "y")).distinct()
    blocks = None
    for d in depths:
        part = distinct.select(F.lit(d).alias("depth"), node(d).alias("node"), "fp")
        blocks = part if blocks is None else blocks.union(part)
    blocks = checkpointed(
        blocks.join(ends, ["depth", "node"], "left_semi").groupBy("depth", "node").agg(F.collect_list("fp").alias("fps")))
    left = blocks.select(F.col("depth").alias("__d"), F.col("node").alias("__n"), F.col("fps").alias("xs")).repartition(parts, "__d", "__n")
    right = blocks.select(F.col("depth").alias("__e"), F.col("node").alias("__m"), F.col("fps").alias("ys")).repartition(parts, "__e", "__m")
    alone = tasks.where("x = y").repartition(parts, "depth", "x").join(left, (F.col("depth") == F.col("__d")) & (F.col("x") == F.col("__n"))).select(
        "depth", "xs", F.lit(None).cast("array<long>").alias("ys"))
    two = (
        tasks.where("x <> y").repartition(parts, "depth", "x")
        .join(left, (F.col("depth") == F.col("__d")) & (F.col("x") == F.col("__n"))).select("depth", "y", "xs")
        .repartition(parts, "depth", "y")
        .join(right, (F.col("depth") == F.col("__e")) & (F.col("y") == F.col("__m")))
        .select("depth", "xs", "ys")
    )
    return alone.union(two).mapInArrow(_walk(budget), "fp long, root long, n_links long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, leaf: int = LEAF, stride: int = STRIDE) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable), n_links (other fingerprints within the budget), and h and class.

    class is one fingerprint of the component; h is the hash of the text.
    """
    marks = checkpointed(fingerprints(docs))
    distinct = checkpointed(marks.groupBy("fp").agg(F.min("doc_id").alias("low")))
    stars = checkpointed(linked(distinct, budget, leaf, stride))
    roots = components(stars, "fp", "root")
    links = stars.groupBy("fp").agg(F.sum("n_links").alias("n_links"))
    classed = checkpointed(
        distinct.join(roots, F.col("fp") == F.col("node"), "left")
        .select("fp", "low", F.coalesce("root", "fp").alias("class")))
    lowest = checkpointed(classed.groupBy("class").agg(F.min("low").alias("component_id")).withColumnRenamed("class", "__c"))
    named = classed.join(lowest, F.col("class") == F.col("__c")).select("fp", "class", "component_id")
    named = checkpointed(
        named.join(links, "fp", "left").select(F.col("fp").alias("__fp"), "class", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return marks.join(named, F.col("fp") == F.col("__fp")).select(
        "doc_id", "fp", "component_id", "n_links", "h", "class")


def one_of_each(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id, all columns as they were.

    Rows without an id come last. Rows that share id and text are one document; of these, one row stays.
    """
    found = near_duplicates(docs, budget)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    names = fresh(docs, "__none", "__id", "__h")
    stay = found.groupBy("class").agg(F.min(first).alias("f")).select(
        *[F.col(f"f.{part}").alias(name) for part, name in zip(("none", "id", "h"), names, strict=True)])
    keys = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.col("text").cast("string")))
    keyed = docs.withColumns(dict(zip(names, keys, strict=True)))
    return keyed.join(checkpointed(stay), names, "left_semi").dropDuplicates(names).drop(*names)
