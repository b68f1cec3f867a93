"""Token ids in binary shards, found through a minimal perfect hash of document keys.

Layout of a folder:

* ``shard-*.tokens``: the ids of consecutive documents in ascending doc_id order, little-endian and of fixed width, behind
  an 8-byte header (``TOKSHRD`` and the width) and before the documents' lengths (unsigned 32-bit), their number and
  the number of ids (unsigned 64-bit each). A shard file can be read without the index.
* ``shards`` (Parquet): number, file and width of every shard; only files listed here count, so files left by lost or
  repeated tasks do no harm.
* ``index`` (Parquet): for each hash bucket of keys one :class:`KeyIndex`. A key is a doc_id and the number of its
  occurrence, from 0. Its slot holds a fingerprint of the key and shard, place, length and start of the payload.

Finding a key takes a fixed number of steps, whatever the number of documents: bucket, level bits, rank, slot.

Defined results: a null or empty text is the end token alone. Rows that share a doc_id are written one after another,
each under its occurrence number. A null doc_id is a key like others and comes first. Keys that were not written are
not found (but for fingerprints that agree by chance, one in 2^32). An empty table makes an index without entries.
Further columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .tokens import word_encoder

END = 1
MAGIC = b"TOKSHRD"
HEADER = len(MAGIC) + 1
#: Keys of an index bucket on average; one bucket is built, and loaded, at a time.
BUCKET_KEYS = 20_000
#: Bits of a level for each key that is left; levels before the few that still collide are listed one by one.
SPARE = 2
LEVELS = 24
#: Bytes read at once from a shard.
READ = 4 << 20

SLOT = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("n", "<u4"), ("at", "<u8"), ("start", "<u8")])


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder that all executors share; ``file:/x`` and plain paths are a shared mount."""
    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(uri)


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class KeyIndex:
    """Minimal perfect hash of one bucket, by levels of bits: a key's slot is the rank of its bit.

    On each level a key sets the bit its hash points to; keys that share a bit go on to the next, smaller level. The
    few left after the last level are listed with their slots.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray, slots: np.ndarray):
        self.sizes, self.bits, self.rest, self.slots = sizes, bits, rest, slots
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, marks: np.ndarray, values: np.ndarray) -> "KeyIndex":
        """``keys`` are 64-bit hashes, ``marks`` second hashes; ``values`` has the fields of :data:`SLOT` but mark."""
        sizes, words, order = [], [], []
        left = np.arange(len(keys))
        for level in range(LEVELS):
            if not len(left):
                break
            size = (len(left) * SPARE + 63) // 64 * 64
            spot = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            count = np.bincount(spot, minlength=size)
            alone = count[spot] == 1
            mine = left[alone]
            order.append(mine[np.argsort(spot[alone])])
            words.append(np.packbits(count == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone]
        order = np.concatenate([*order, left]) if len(keys) else np.zeros(0, np.int64)
        slots = np.zeros(len(keys), SLOT)
        for name in ("shard", "n", "at", "start"):
            slots[name] = values[name][order]
        slots["mark"] = (marks[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
        rest = np.stack([keys[left], marks[left]], 1) if len(left) else np.zeros((0, 2), np.uint64)
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8"), rest, slots)

    def to_bytes(self) -> bytes:
        head = struct.pack("<III", len(self.sizes), len(self.rest), len(self.slots))
        return b"".join([
            head, np.array(self.sizes, "<u4").tobytes(), self.bits.astype("<u8").tobytes(), self.rest.astype("<u8").tobytes(),
            self.slots.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> "KeyIndex":
        levels, rest, slots = struct.unpack_from("<III", data)
        sizes = np.frombuffer(data, "<u4", levels, 12).tolist()
        at = 12 + 4 * levels
        words = sum(sizes) // 64
        bits = np.frombuffer(data, "<u8", words, at)
        left = np.frombuffer(data, "<u8", 2 * rest, at + 8 * words).reshape(-1, 2)
        return cls(sizes, bits, left, np.frombuffer(data, SLOT, slots, at + 8 * words + 16 * rest))

    def find(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not in."""
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            spot = (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = spot >> 6, (spot & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            open_, base = open_[~hit], base + size
        listed = {tuple(k): len(self.slots) - len(self.rest) + i for i, k in enumerate(self.rest.tolist())}
        if listed:
            for i in open_.tolist():
                out[i] = listed.get((int(keys[i]), int(marks[i])), -1)
        found = out >= 0
        wrong = self.slots["mark"][out[found]] != (marks[found] & np.uint64(0xFFFFFFFF)).astype("<u4")
        out[np.nonzero(found)[0][wrong]] = -1
        return out


def _key(doc: Column, nth: Column) -> dict[str, Column]:
    """Two hashes of a key: the first chooses bucket and slot, the second gives the stored fingerprint. A null doc_id differs from all others."""
    parts = (doc.isNull(), F.coalesce(doc, F.lit(0).cast("long")), nth.cast("int"))
    return {"key": F.xxhash64(*parts), "mark": F.xxhash64(F.lit("mark"), *parts)}


def _writer(folder: str, path: str, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        width, last, number = encoder.dtype.itemsize, encoder.end(end), TaskContext.get().partitionId()
        store, root = file_system(folder)
        out, lengths, at, name = None, [], 0, f"shard-{number:06d}-{uuid.uuid4().hex}.tokens"
        before, nth = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
                out.write(MAGIC + bytes([width]))
            docs = batch.column("doc_id").to_pylist()
            sizes, places, nths = [], [], []
            for doc, text in zip(docs, batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text) + last
                nth = nth + 1 if lengths and doc == before else 0
                before = doc
                out.write(ids)
                sizes.append(len(ids) // width)
                places.append(at)
                nths.append(nth)
                at += sizes[-1]
                lengths.append(sizes[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(docs), pa.int32()), pa.array([name] * len(docs)), pa.array([width] * len(docs), pa.int32()),
                 batch.column("doc_id"), pa.array(nths, pa.int32()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())],
                names=["shard", "file", "width", "doc_id", "nth", "at", "n"])
        if out is not None:
            out.write(np.array(lengths, "<u4").tobytes() + struct.pack("<QQ", len(lengths), at))
            out.close()

    return run


def write(docs: DataFrame, folder: str, path: str, end: int = END) -> None:
    """Encode ``docs`` by the vocabulary at ``path`` into shards below ``folder`` and build the index.

    Rows are dealt by ranges of doc_id; ties are split by a row number, so a doc_id of many rows fills no single shard.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("__row"))
    ranged = rows.repartitionByRange("doc_id", "__row").sortWithinPartitions("doc_id", "__row").select("doc_id", "text")
    listed = checkpointed(ranged.mapInArrow(
        _writer(folder, path, end), "shard int, file string, width int, doc_id long, nth int, at long, n long"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = listed.groupBy("shard").agg(
        F.first("file").alias("file"), F.first("width").alias("width"), F.sum("n").alias("ids"), F.count(F.lit(1)).alias("docs"),
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shards = shards.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)))
    shards.coalesce(1).write.parquet(f"{folder}/shards")
    shards = spark.read.parquet(f"{folder}/shards")
    # A doc_id's occurrences go on in the next shard: count those in the shards before. Only the last of a shard can go on.
    ends = listed.join(shards.select("shard", F.col("low").alias("__l"), F.col("high").alias("__h")), "shard").where(
        F.col("doc_id").eqNullSafe(F.col("__h")) | F.col("doc_id").eqNullSafe(F.col("__l")) | F.col("doc_id").isNull()
    ).groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = checkpointed(
        ends.withColumn("carried", F.coalesce(F.sum("here").over(before), F.lit(0))).where("carried > 0")
        .select(F.col("shard").alias("__s"), F.col("doc_id").alias("__d"), "carried"))
    total = listed.count()
    buckets = max(1, -(-total // BUCKET_KEYS))
    entries = (
        listed.join(shards.select("shard", "base"), "shard")
        .join(carried, (F.col("shard") == F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
        .withColumn("nth", (F.col("nth") + F.coalesce("carried", F.lit(0))).cast("int"))
        .withColumns(_key(F.col("doc_id"), F.col("nth")))
        .select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key", "mark", "shard", "n", "at", (F.col("at") + F.col("base")).alias("start"))
    )

    def build(group: pa.Table) -> pa.Table:
        keys, marks = (group.column(c).to_numpy().view(np.uint64) for c in ("key", "mark"))
        index = KeyIndex.build(keys, marks, {c: group.column(c).to_numpy() for c in ("shard", "n", "at", "start")})
        return pa.table({"bucket": group.column("bucket")[:1], "buckets": pa.array([buckets], pa.int32()), "index": pa.array([index.to_bytes()])})

    entries.groupBy("bucket").applyInArrow(build, "bucket int, buckets int, index binary").write.parquet(f"{folder}/index")


def find(keys: DataFrame, folder: str) -> DataFrame:
    """doc_id, nth, shard, at, n, start of those of ``keys`` (doc_id, nth; each once) that the index holds."""
    spark = keys.sparkSession
    index = spark.read.schema("bucket int, buckets int, index binary").parquet(f"{folder}/index")
    row = index.select("buckets").first()
    buckets = row[0] if row else 1
    asked = keys.select(F.col("doc_id").cast("long"), F.col("nth").cast("int")).withColumns(_key(F.col("doc_id"), F.col("nth")))
    asked = asked.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))

    def look(wanted: pa.Table, held: pa.Table) -> pa.Table:
        if not wanted.num_rows or not held.num_rows:
            return wanted.slice(0, 0).select(["doc_id", "nth"]).append_column("shard", pa.array([], pa.int32())).append_column(
                "at", pa.array([], pa.int64())).append_column("n", pa.array([], pa.int64())).append_column("start", pa.array([], pa.int64()))
        one = KeyIndex.from_bytes(held.column("index")[0].as_py())
        slot = one.find(*(wanted.column(c).to_numpy().view(np.uint64) for c in ("key", "mark")))
        ok = slot >= 0
        got = one.slots[slot[ok]]
        cols = {c: wanted.column(c).filter(pa.array(ok)) for c in ("doc_id", "nth")}
        return pa.table(cols | {"shard": pa.array(got["shard"].astype(np.int32))} | {c: pa.array(got[c].astype(np.int64)) for c in ("at", "n", "start")})

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(
        look, "doc_id long, nth int, shard int, at long, n long, start long")


def read(keys: DataFrame, folder: str) -> DataFrame:
    """doc_id, nth, start, n_tokens, ids, width of those of ``keys`` that were written, read from the shard files."""
    spark = keys.sparkSession
    shards = spark.read.parquet(f"{folder}/shards").select(F.col("shard").alias("__s"), "file", "width")
    found = find(keys, folder).join(shards, F.col("shard") == F.col("__s"))
    dealt = found.repartition("file", F.floor(F.col("at") / (READ * 4))).sortWithinPartitions("file", "at")

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        name, source, lo, block = None, None, 0, b""
        for batch in batches:
            values = []
            for file, width, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "width", "at", "n")), strict=True):
                if file != name:
                    if source:
                        source.close()
                    name, source, lo, block = file, store.open_input_file(f"{root}/{file}"), 0, b""
                begin, size = HEADER + at * width, n * width
                if not lo <= begin <= begin + size <= lo + len(block):
                    lo, block = begin, source.read_at(max(size, READ), begin)
                values.append(block[begin - lo : begin - lo + size])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("nth"), batch.column("start"), batch.column("n"), pa.array(values, pa.binary()), batch.column("width")],
                names=["doc_id", "nth", "start", "n_tokens", "ids", "width"])
        if source:
            source.close()

    return dealt.mapInArrow(load, "doc_id long, nth int, start long, n_tokens long, ids binary, width int")


def keys_of(docs: DataFrame) -> DataFrame:
    """(doc_id, nth) of every row of ``docs``."""
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).cast("int").alias("c"))
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("nth"))
