"""Fuzzy line dedup: one occurrence of each group of lines that read the same.

Lines are normalised (lower case, numbers to 0, ASCII punctuation and white space to one space). Equal ones are one
entry with its first occurrence. The SimHash of an entry covers its words and word pairs. Fingerprints within ``BUDGET`` bits differ in at most that many of
``BLOCKS`` blocks, so they agree in the others: entries are joined on every choice of that many equal blocks, the
Hamming distance is part of the join, and the edit similarity of the normalised lines decides. The linked entries form
connected groups, and of each group the first occurrence stays, by doc_id, then by place in the document.

Defined results: a line of ASCII punctuation and white space alone is never removed, so null and empty texts stay as
they are. Rows that share a doc_id have the same place in the order: what several of them hold as their line of one
number stays in each. Rows with a null doc_id share the place before all others. A document may lose all its lines; its row stays with what is left. An empty table gives an empty result. Other
columns of the table are not touched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, cleared
from .shared import LOCAL_NODES, UnionFind, components, fresh, staged, takes_over

BUDGET = 3
BLOCKS = 5
SIMILARITY = 0.8

#: Words hashed to bits at a time.
CHUNK = 1 << 15
#: Words whose hashes are held at a time, besides one line.
HELD = 1 << 18

_PLAIN = bytes(
    b if b > 127 or b == 10 or chr(b).isalpha() else 48 if chr(b).isdigit() else 32 for b in range(256))
_ZEROS = re.compile(b"00+")


def normal_lines(text: str | None) -> list[list[bytes]]:
    """Words of every line of the text, in lower case, each number as 0."""
    data = (text or "").lower().encode().translate(_PLAIN)
    if b"00" in data:
        data = _ZEROS.sub(b"0", data)
    return [line.split() for line in data.split(b"\n")]


def normal(line: str) -> str:
    """The normalised line."""
    return b" ".join(normal_lines(line)[0]).decode()


#: Bits of a byte, from the highest, as eight counters of eight bits; so many words, each with its pair, fill none of them.
_COUNTERS = np.array([sum((b >> (7 - k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
_FULL = 127


def _ones(hashes: np.ndarray, pairs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each line."""
    parts = -(-sizes // _FULL)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(sizes) - sizes - _FULL * first, parts) + _FULL * np.arange(int(parts.sum()))
    counters = lambda x: _COUNTERS[x.astype(">u8").view(np.uint8).reshape(-1, 8)]
    ones = np.add.reduceat(counters(hashes) + counters(pairs), starts, axis=0).view(np.uint8).reshape(-1, 64)
    return ones.astype(np.int64) if len(parts) == len(ones) else np.add.reduceat(ones, first, axis=0, dtype=np.int64)


def simhashes(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Fingerprint of each line from the hashes of all their words in a row, over words and pairs of words side by side.

    No line is empty.
    """
    sizes = np.array(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    pairs = np.zeros_like(hashes)
    pairs[:-1] = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + (hashes[1:] ^ (hashes[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    pairs ^= pairs >> np.uint64(32)
    pairs[ends - 1] = 0  # no pair across the end of a line
    out = np.empty(len(sizes), np.uint64)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        if hi - lo > 1:
            ones = _ones(hashes[a:b], pairs[a:b], sizes[lo:hi])
        else:
            cuts = [*range(a, b, CHUNK), b]
            ones = sum(_ones(hashes[i:j], pairs[i:j], np.array([j - i])) for i, j in zip(cuts, cuts[1:]))
        out[lo:hi] = np.packbits(ones * 2 > 2 * sizes[lo:hi, None] - 1, axis=1).view(">u8").ravel().astype(np.uint64)
        lo = hi
    return out


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    takes_over("lines", lambda: None)
    for batch in batches:
        row, place, names, hashes, sizes = [], [], [], [], []

        def out():
            fps = simhashes(np.array(hashes, np.uint64), sizes)
            at = pa.array(row, pa.int32())
            made = pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(place, pa.int32()),  # noqa: B023
                 pa.array(names, pa.binary()), pa.array(fps.view(np.int64))],
                names=["doc_id", "h", "place", "entry", "fp"])
            for x in (row, place, names, hashes, sizes):
                x.clear()
            return made

        for i, text in enumerate(batch.column("text").to_pylist()):
            for k, words in enumerate(normal_lines(text)):
                if words:
                    row.append(i)
                    place.append(k)
                    names.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    hashes += map(xxhash.xxh64_intdigest, words)
                    sizes.append(len(words))
                    if len(hashes) > HELD:
                        yield out()
        if row:
            yield out()


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), place (from 0), entry (hash of the normalised line), fp of every line with a word."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h")).mapInArrow(
        _lines, "doc_id long, h long, place int, entry binary, fp long")


def masks(budget: int = BUDGET, blocks: int = BLOCKS) -> list[int]:
    """Signed 64-bit masks, one for every choice of blocks that must agree."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    found = [sum(choice) for choice in combinations(block, blocks - budget)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def close_fingerprints(fps: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (fp, other), fp the smaller, of distinct fingerprints within ``budget`` bits, each once.

    A key is the agreeing blocks and a number for their choice in one; keys of two choices that meet by chance are sorted
    out by the distance. A pair that agrees in several choices counts in the first. The keys are always shuffled: Spark sizes
    the exploded rows as if each fingerprint still had one, and would send all of them to the driver and every task.
    """
    chosen = masks(budget, blocks)
    marks = [xxhash.xxh64_intdigest(str(i)) - (1 << 63) for i in range(len(chosen))]

    def key(fp, mask, mark):
        return fp.bitwiseAND(F.lit(mask).cast("long")).bitwiseXOR(F.lit(mark).cast("long"))

    keyed = fps.select("fp", F.explode(F.array(*[key(F.col("fp"), m, x) for m, x in zip(chosen, marks, strict=True)])).alias("k"))
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = None
    for mask, mark in zip(chosen, marks, strict=True):
        agrees, here = apart.bitwiseAND(F.lit(mask).cast("long")) == 0, key(F.col("a.fp"), mask, mark)
        first = F.when(agrees, here) if first is None else first.when(agrees, here)
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(apart) <= budget) & (F.col("a.k") == first)
    return a.hint("merge").join(b, on).select(F.col("a.fp").alias("fp"), F.col("b.fp").alias("other"))


def edit_distance(a: str, b: str, at_most: int) -> int:
    """Edits between the two, or ``at_most`` + 1 if there are more. Columns of the table are held as bits of one integer."""
    if abs(len(a) - len(b)) > at_most:
        return at_most + 1
    head = 0
    top = min(len(a), len(b))
    while head < top and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < top - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return min(len(a) + len(b), at_most + 1)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, high = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for k, ch in enumerate(b):
        eq = where.get(ch, 0)
        x = eq | down
        flat = (((x & up) + up) ^ up) | x
        plus, minus = down | (full & ~(flat | up)), up & flat
        score += 1 if plus & high else -1 if minus & high else 0
        if score - (len(b) - 1 - k) > at_most:
            return at_most + 1
        plus = (plus << 1 | 1) & full
        up = (minus << 1) & full | (full & ~(flat | plus))
        down = plus & flat
    return score


def alike(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edits / longer length is at least ``similarity``."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(v), len(w)) for v, w in zip(x, y, strict=True) if v != w) <= most:
        return True  # changing word for word is one way, so the fewest edits are no more
    return edit_distance(a, b, most) <= most


def _position(doc: str, place: str):
    """Place of a line among all lines as one number, which sorts like (doc_id, place) and aggregates without sorting."""
    return F.coalesce(F.col(doc), F.lit(-(2**63)).cast("long")).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(place)


def links(rows: DataFrame, entries: DataFrame, docs: DataFrame, budget: int, blocks: int, similarity: float) -> DataFrame:
    """(a, b) of entries whose fingerprints are close and whose normalised lines are alike; pairs that follow from others may be left out.

    Each entry is first held against the first one of its fingerprint, and the first ones of close fingerprints against
    each other, so a group of like lines costs as many looks as it has lines. Only where one of these looks fails do all
    entries of the two fingerprints meet.
    """
    heads = checkpointed(entries.groupBy("fp").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("c")))
    close = checkpointed(close_fingerprints(heads.select("fp"), budget, blocks))
    met = close.select("fp").union(close.select("other")).union(heads.where("c > 1").select("fp")).distinct()
    # Written columns are sized from their packed files, far below their rows in memory: never to be sent whole.
    known = met.join(heads.hint("merge"), "fp").select(F.col("fp").alias("f"), "head", "c")
    cleared(entries.sparkSession)
    held = checkpointed(
        entries.join(known, F.col("fp") == F.col("f")).select("entry", "first", "fp", "c", (F.col("first") == F.col("head")).alias("leads")))
    lines_of = _texts(rows, held, docs)
    cleared(entries.sparkSession)

    lead = held.where("leads").select(F.col("fp").alias("f1"), F.col("entry").alias("a"))
    partner = lead.toDF("f2", "b")
    looked = checkpointed(
        held.where("c > 1").join(partner, F.col("fp") == F.col("f2")).where("entry <> b and (not leads or entry < b)")
        .select(F.col("entry").alias("a"), "b", F.col("fp").alias("f1"), "f2")
        .union(close.join(lead, F.col("fp") == F.col("f1")).join(partner, F.col("other") == F.col("f2")).select("a", "b", "f1", "f2")))
    found = checkpointed(_verified(looked.select("a", "b"), lines_of, similarity))
    failed = checkpointed(looked.join(found, ["a", "b"], "left_anti").select("f1", "f2").distinct())
    rough = failed.where("f1 = f2").select(F.col("f1").alias("r")).distinct()
    several = held.where("c > 1").select(F.col("fp").alias("r")).distinct()
    apart = (
        rough.select(F.col("r").alias("f1"), F.col("r").alias("f2"))
        .union(close.join(rough, F.col("fp") == F.col("r")).select("fp", "other"))
        .union(close.join(rough, F.col("other") == F.col("r")).select("fp", "other"))
        .union(failed.join(several, F.col("f1") == F.col("r"), "left_semi"))
        .union(failed.join(several, F.col("f2") == F.col("r"), "left_semi")).distinct().toDF("x", "y"))
    left = held.select(F.col("fp").alias("f1"), F.col("entry").alias("a"), F.col("leads").alias("l1"))
    second = (
        checkpointed(apart).join(left, F.col("x") == F.col("f1")).join(left.toDF("f2", "b", "l2"), F.col("y") == F.col("f2"))
        .where("not (l1 and l2) and (x <> y or a < b)").select("a", "b"))
    return found.union(_verified(second, lines_of, similarity))


def _texts(rows: DataFrame, held: DataFrame, docs: DataFrame) -> DataFrame:
    """e and line of the entries in ``held``, each from its first occurrence."""
    ends = held.select(F.col("entry").alias("e"), F.col("first").alias("f"))
    wanted = checkpointed(
        rows.join(ends, (F.col("entry") == F.col("e")) & (F.col("position") == F.col("f")))
        .groupBy("e").agg(F.min("doc_id").alias("d"), F.min("h").alias("wh"), F.min("place").alias("at")))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    on = source["doc_id"].eqNullSafe(F.col("d")) & (source["h"] == F.col("wh"))
    # Repeated rows give a line more than once.
    return checkpointed(wanted.join(source, on).select("e", F.split("text", "\n")[F.col("at")].alias("line")).distinct())


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose lines are alike, or that other pairs have linked already."""
    two = (
        pairs.join(texts.select(F.col("e").alias("a"), F.col("line").alias("x")), "a")
        .join(texts.select(F.col("e").alias("b"), F.col("line").alias("y")), "b").select("a", "b", "x", "y")
    )

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What the pairs so far have connected needs no look at its lines.
        takes_over("line_pairs", lambda: None)
        found, shown = UnionFind(), lru_cache(4096)(normal)
        for batch in batches:
            ok = []
            for a, b, x, y in zip(*batch.columns, strict=True):
                a, b = a.as_py(), b.as_py()
                ok.append(found.root(a) == found.root(b) or alike(shown(x.as_py()), shown(y.as_py()), similarity))
                if ok[-1]:
                    found.join(a, b)
            if len(found.up) > LOCAL_NODES:
                found = UnionFind()
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return two.mapInArrow(verify, "a binary, b binary")


def removed_lines(docs: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS, similarity: float = SIMILARITY) -> DataFrame:
    """d, wh (doc_id and hash of the text) and places (of the lines to remove) of every document that loses lines."""
    # The two large tables, as Parquet: rows of a checkpoint take more.
    rows = staged(lines(docs), "lines").withColumn("position", _position("doc_id", "place"))
    entries = staged(rows.groupBy("entry").agg(
        F.min("position").alias("first"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "entries")
    roots = components(links(rows, entries, docs, budget, blocks, similarity), "a", "b")
    members = roots.union(roots.select("root", "root")).distinct().toDF("node", "root")
    cleared(docs.sparkSession)
    named = checkpointed(members.join(entries, F.col("node") == F.col("entry")).select("entry", "root", "first"))
    keep = checkpointed(named.groupBy("root").agg(F.min("first").alias("kept")))
    grouped = checkpointed(named.select(F.col("entry").alias("g"), "root").join(keep, "root").select("g", "kept"))
    # Only lines of entries that occur again, or in a group, can go.
    again = checkpointed(
        entries.join(grouped, F.col("entry") == F.col("g"), "left").where("n > 1 or g is not null")
        .select(F.col("entry").alias("e"), F.coalesce("kept", "first").alias("kept")))
    gone = rows.select("doc_id", "h", "place", "entry", "position").join(again, F.col("entry") == F.col("e")).where("position <> kept")
    return gone.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("wh")).agg(F.collect_set("place").alias("places"))


def deduplicated(
    docs: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS, similarity: float = SIMILARITY,
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, and two more columns: its lines, and how many were removed."""
    d, wh, places = fresh(docs, "__d", "__wh", "__places")
    gone = checkpointed(removed_lines(docs, budget, blocks, similarity)).toDF(d, wh, places)
    cleared(docs.sparkSession)
    split = F.split(F.col("text").cast("string"), "\n")
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone[d]) & (F.xxhash64(docs["text"]) == gone[wh]), "left")
    stay = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col(places), i)), "\n")
    return (
        joined.withColumn(counts[0], F.coalesce(F.size(split), F.lit(0)).cast("long"))
        .withColumn(counts[1], F.coalesce(F.size(places), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(stay))
        .drop(d, wh, places)
    )


def kept_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that stay, and ``n_chars``, where it exists, counted anew for documents that lost some."""
    counts = tuple(fresh(docs, "__lines", "__removed"))
    out = deduplicated(docs, counts=counts)
    if "n_chars" in docs.columns:
        count = F.when(F.col(counts[1]) > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
