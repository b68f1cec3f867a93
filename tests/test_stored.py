"""Tables that are written in part and read in part: partitions by season, and the append index of a stream."""

import glob
import hashlib
import os
import re

from pyspark.sql import functions as F

from attribix.plans import stored
from attribix.sources import tables as S
from attribix.streaming import ingest

SF = "/root/testdata/sf0.001"


def digests(folder):
    found = {}
    for path in glob.glob(f"{folder}/**/*.parquet", recursive=True):
        with open(path, "rb") as f:
            found[os.path.relpath(path, folder)] = hashlib.md5(f.read()).hexdigest()
    return found


def season(path):
    return re.match(r"season=(\w+)", path)[1]


def test_a_rewrite_leaves_other_seasons_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([(i, 2000 + i % 4) for i in range(200)], "id long, season int")
    folder = str(tmp_path / "t")
    S.replace_partitions(rows, folder, ["season"], 2)
    before = digests(folder)
    for bump in (1000, 2000):
        S.replace_partitions(rows.filter("season = 2001").withColumn("id", F.col("id") + bump), folder, ["season"], 2)
    after = digests(folder)
    assert {p: d for p, d in before.items() if season(p) != "2001"} == {p: d for p, d in after.items() if season(p) != "2001"}
    assert {season(p) for p in after} == {"2000", "2001", "2002", "2003"}
    back = S.read_partitions(spark, folder, "id long, season int")
    assert sorted((r.id, r.season) for r in back.collect()) == sorted((i + (2000 if i % 4 == 1 else 0), 2000 + i % 4) for i in range(200))
    S.replace_partitions(rows.filter("false"), folder, ["season"])
    assert digests(folder) == after


def test_a_large_season_is_split_by_its_size(spark, tmp_path):
    """More tasks write a season that outgrows them, whatever the number of files asked for."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256k")
    try:
        rows = spark.range(300_000).select("id", F.rand(1).alias("x"), F.lit(2001).alias("season"))
        S.replace_partitions(rows, str(tmp_path / "t"), ["season"], 2)
    finally:
        spark.conf.set(key, before)
    assert len(glob.glob(f"{tmp_path}/t/season=2001/*.parquet")) > 4
    back = S.read_partitions(spark, str(tmp_path / "t"), "id long, x double, season int")
    assert back.agg(F.count("id"), F.countDistinct("id")).first()[:] == (300_000, 300_000)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_prune_folders(spark):
    folder = stored.season_folder(spark, SF)
    rows = S.read_partitions(spark, folder, stored.SHAPE)
    assert re.search(r"PartitionFilters: \[.*season#\d+ IN \(1995,1996\)", plan(rows.filter(F.col("season").isin(1995, 1996)).select("event_type")))
    read = rows.filter("season = 1996").select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert read and all("season=1996" in r.f for r in read)


def test_a_joined_season_prunes_folders(spark):
    assert "dynamicpruning" in plan(stored.season_of_most(spark, SF))


def batches(spark, tmp_path, n, size=30, buckets=4096):
    """A stream of n small deliveries; returns the bytes of index files that each one had to look at."""
    read = []
    original = ingest._written

    def counted(session, path, shape, touched, before):
        found = original(session, path, shape, touched, before)
        files = [] if found is None else found.filter(f"{ingest.BATCH} >= 0").inputFiles()
        read.append(sum(os.path.getsize(f.removeprefix("file:").replace("///", "/").replace("%3D", "=")) for f in files))
        return found

    ingest._written = counted
    try:
        for i in range(n):
            rows = spark.createDataFrame([(f"s{i}", k, i) for k in range(size)] + ([(f"s{i - 1}", 0, i)] if i else []), "session string, num long, delivery int")
            rows.write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
            ingest.ingest_available(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["session", "num"], ["session"], buckets).awaitTermination()
    finally:
        ingest._written = original
    return read


def test_reads_of_the_index_do_not_grow(spark, tmp_path):
    read = batches(spark, tmp_path, 6)
    shape = "session string, num long, delivery int"
    rows = ingest.read_merged(spark, str(tmp_path / "out"), shape)
    assert sorted((r.session, r.num, r.delivery) for r in rows.collect()) == [(f"s{i}", k, i) for i in range(6) for k in range(30)]
    # Every delivery after the first repeats one key of the session before, whose folder alone it reads.
    assert read[0] == 0 and 0 < max(read[2:]) <= 1.5 * read[1]


def test_a_batch_is_shuffled_once_against_the_known(spark, tmp_path, monkeypatch):
    """A row is dealt out once to be held against the written keys and against the rest of its batch."""
    plans, real = [], ingest.checkpointed

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(ingest, "checkpointed", recorded)
    batches(spark, tmp_path, 2, size=20)
    first, again = plans[0], "".join(plans[2:4])
    assert len(plans) == 4 and "Exchange" not in first
    assert len(re.findall(r"Exchange hashpartitioning", again)) <= 2  # the batch, and the known keys
    rows = ingest.read_merged(spark, str(tmp_path / "out"), "session string, num long, delivery int")
    assert rows.count() == 40


def test_merged_batches_read_the_same(spark, tmp_path):
    batches(spark, tmp_path, 4, size=5)
    shape, out = "session string, num long, delivery int", str(tmp_path / "out")
    before = sorted(map(tuple, ingest.read_merged(spark, out, shape).collect()))
    ingest.merge_batches(spark, out, shape, 2)
    ingest.merge_batches(spark, out, shape, 3)
    os.makedirs(f"{out}/{ingest.MERGED}/upto=4")  # a merge that did not end
    assert sorted(map(tuple, ingest.read_merged(spark, out, shape).collect())) == before
    assert len(before) == 20


def test_a_repeated_batch_gives_the_same_table(spark, tmp_path):
    """The last batch runs again, as after a failure between its writes and its commit."""
    batches(spark, tmp_path, 2, size=5)
    shape, out = "session string, num long, delivery int", str(tmp_path / "out")
    before = sorted(map(tuple, ingest.read_merged(spark, out, shape).collect()))
    os.remove(tmp_path / "state" / "commits" / "1")
    for crc in glob.glob(str(tmp_path / "state" / "commits" / ".1.crc")):
        os.remove(crc)
    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    ingest.ingest_available(stream, out, str(tmp_path / "state"), ["session", "num"], ["session"], 4096).awaitTermination()
    assert sorted(map(tuple, ingest.read_merged(spark, out, shape).collect())) == before
