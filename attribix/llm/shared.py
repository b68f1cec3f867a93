"""Helpers the operators share: batch sizes, staged tables, row keys, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, configure

#: Rows of one Arrow batch; whole texts go through Python, so a batch is kept to a few MB.
BATCH_ROWS = "256"
#: Bytes after which a batch takes no further row, where its rows are larger.
BATCH_BYTES = "8m"


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the operators here: small Arrow batches besides what all plans rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Settings of a Parquet file whose rows are megabytes each. The writer looks at its size after every row and not only after
#: 100, so a row group, which a writer gathers and a reader loads as one, holds a few of them at any size of the input.
LARGE_ROWS = {
    "parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
}


def staged(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back; cuts lineage.

    The folder outlives the call, as its reader is lazy. ``settings`` are the Parquet writer's.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**settings).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_keepers: dict[str, Callable[[], None]] = {}


def takes_over(name: str, forget: Callable[[], None]) -> None:
    """Called where a task begins. A Python worker serves many stages; what the tasks of one operator have remembered
    goes when one of another begins."""
    for other in [k for k in _keepers if k != name]:
        _keepers.pop(other)()
    if name not in _keepers:
        _keepers[name] = forget
        pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def ascii_words(data: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of UTF-8 bytes; ``bytes.split`` knows exactly these six separators."""
    return data.split()


class UnionFind:
    """Smallest member as root, over any ordered keys."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.up[high] = low
            self.up.setdefault(low, low)

    def stars(self) -> Iterator[tuple]:
        """(member, root) of every member that is not its own root."""
        for x in list(self.up):
            if (r := self.root(x)) != x:
                yield x, r


#: Keys of one local union-find at most; beyond that its stars are handed on and it starts anew.
LOCAL_NODES = 200_000


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, names, kinds = UnionFind(), None, None

    def out():
        pairs = list(found.stars())
        for i in range(0, len(pairs), 20_000):
            part = pairs[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in part], kinds[j]) for j in (0, 1)], names=names)

    for batch in batches:
        names, kinds = batch.schema.names, batch.schema.types
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.join(a, b)
        if len(found.up) > LOCAL_NODES:
            yield from out()
            found = UnionFind()
    if names:
        yield from out()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that is linked to a smaller one; root is the smallest node reachable.

    Large-star and small-star rounds: every node is moved to the smallest of its neighbourhood until all stars are
    stable. Each task first contracts what it holds to stars. Loops and repeated links do no harm; links with a null
    end are none. No task ever needs a whole component: neighbours meet their minimum in a join that can be split.
    """
    from ..session import checkpointed

    kind = links.schema[a].dataType.simpleString()
    edges = links.select(F.col(a).alias("node"), F.col(b).alias("root")).where("node <> root")
    contracted = lambda df: df.mapInArrow(_contract, f"node {kind}, root {kind}")
    edges = checkpointed(contracted(edges).distinct())

    def state(df):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root"))).first()

    last = state(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        low = checkpointed(both.groupBy("node").agg(F.min("root").alias("__m")).select(
            F.col("node").alias("__n"), F.least("node", "__m").alias("__low")))
        large = both.join(low, F.col("node") == F.col("__n")).where("root > node").select(
            F.col("root").alias("node"), F.col("__low").alias("root"))
        large = checkpointed(large.distinct())
        low = checkpointed(large.groupBy("node").agg(F.min("root").alias("__low")).withColumnRenamed("node", "__n"))
        small = large.join(low, F.col("node") == F.col("__n")).where("root <> __low").select(
            F.col("root").alias("node"), F.col("__low").alias("root"))
        stars = low.select(F.col("__n").alias("node"), F.col("__low").alias("root"))
        edges = checkpointed(contracted(small.union(stars)).distinct())
        now = state(edges)
        if now == last:
            break
        last = now
    return edges
