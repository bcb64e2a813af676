"""Bucketed tables: only touched buckets are rewritten, writers keep one another's rows, runs count once."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskframe.operators.upsert import upsert
from riskframe.sources.commits import AppendTable, BucketTable
from riskframe.streaming.incremental import read_stream, stream_bucket_snapshot, stream_bucket_upsert

NOW = datetime(2024, 5, 1)
SCHEMA = "k long, fixed string, v double"


def rows(spark, ids, v, fixed="f"):
    return spark.createDataFrame([(i, fixed, float(v)) for i in ids], SCHEMA)


def content(table):
    return {r.k: (r.fixed, r.v) for r in table.read().collect()}


def files(path):
    return {str(f) for f in Path(path, "data").rglob("*.parquet")}


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), ["k"], 200)
    assert table.read() is None
    table.upsert(rows(spark, range(10_000), 1), ["v"], now=NOW)
    before = files(tmp_path)
    # one key in a hundred buckets' worth: at most as many buckets as keys are read and written
    version = table.upsert(rows(spark, [5, 17, 10_001], 2, "g"), ["v"], now=NOW)
    made = files(tmp_path) - before
    assert 1 <= len(made) <= 3 and before <= files(tmp_path)
    want = {i: ("f", 1.0) for i in range(10_000)} | {5: ("f", 2.0), 17: ("f", 2.0), 10_001: ("g", 2.0)}
    assert content(table) == want
    assert version == 2 and table.read(1).count() == 10_000
    plan = table._rows(table.log.read(2), sorted(table.log.read(2)["changed"]))
    assert len(plan.inputFiles()) == len(made)


def test_equals_the_whole_table_upsert(spark, tmp_path):
    old = rows(spark, range(50), 1).withColumn("loaded_at", F.lit(NOW).cast("timestamp"))
    new = spark.createDataFrame([(i % 60, "n", float(i), i) for i in range(30, 150)], SCHEMA + ", seq long")
    table = BucketTable(spark, str(tmp_path), ["k"], 7)
    table.merge(old, lambda base, batch: batch, "first")
    table.upsert(new, ["v"], "seq", now=NOW)
    want = upsert(old, new, ["k"], ["v"], "seq", "loaded_at", NOW)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, want.collect()))


def test_interleaved_writers_lose_nothing(spark, tmp_path):
    a, b = (BucketTable(spark, str(tmp_path), ["k"], 8) for _ in range(2))
    a.upsert(rows(spark, range(40), 0), ["v"], now=NOW)

    def merge(old, batch):
        return upsert(old, batch, ["k"], ["v"], None, "loaded_at", NOW)

    bucket = {r.k: r.b for r in a.read().select("k", a._bucket().alias("b")).collect()}
    one = 0
    other = next(k for k in bucket if bucket[k] != bucket[one])
    same = next(k for k in bucket if k != one and bucket[k] == bucket[one])
    # other buckets: the second writer claims the version after without writing again
    first, second = a.stage(rows(spark, [one], 1), merge, "r1"), b.stage(rows(spark, [other], 2), merge, "r2")
    assert a.commit(first) == 2 and b.commit(second) == 3
    assert (content(a)[one][1], content(a)[other][1]) == (1.0, 2.0)
    # the same bucket: the second writer has to merge again
    first, second = a.stage(rows(spark, [one], 3), merge, "r3"), b.stage(rows(spark, [same], 4), merge, "r4")
    assert a.commit(first) == 4 and b.commit(second) is None
    assert b.merge(rows(spark, [same], 4), merge, "r4") == 5
    assert (content(a)[one][1], content(a)[same][1]) == (3.0, 4.0)
    # a version can be claimed once
    assert not a.log.claim(5, {"run_id": "x"})


def test_a_run_counts_once(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], 4)
    assert table.upsert(rows(spark, [1], 1), ["v"], now=NOW, run_id="a") == 1
    assert table.upsert(rows(spark, [1], 2), ["v"], now=NOW, run_id="b") == 2
    # the first run tried again would set the older value
    assert table.upsert(rows(spark, [1], 1), ["v"], now=NOW, run_id="a") == 1
    assert content(table) == {1: ("f", 2.0)} and table.log.last() == 2
    log = AppendTable(spark, str(tmp_path / "runs"))
    assert log.read() is None
    for run in ("x", "y", "x"):
        log.append(rows(spark, [1, 2], 1, run), run)
    assert log.read().groupBy("fixed").count().orderBy("fixed").collect() == [("x", 2), ("y", 2)]


def test_edges(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path), ["k"], 4)
    with pytest.raises(ValueError):
        table.upsert(rows(spark, [None], 1), ["v"])
    table.upsert(rows(spark, [1], 1), ["v"], now=NOW)
    # an empty batch is a version without changes, keys of another integer type hash alike
    table.upsert(rows(spark, [], 1), ["v"], now=NOW)
    table.upsert(rows(spark, [1], 5).withColumn("k", F.col("k").cast("int")), ["v"], now=NOW)
    assert content(table) == {1: ("f", 5.0)}
    with pytest.raises(ValueError):
        BucketTable(spark, str(tmp_path), ["fixed"])
    assert BucketTable(spark, str(tmp_path), ["k"], 99).n_buckets == 4


def test_streams_and_a_replayed_epoch(spark, tmp_path):
    src = tmp_path / "in"
    for n, ids in enumerate(([1, 2], [2, 3])):
        rows(spark, ids, n, "s").withColumn("ts", F.lit(n).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(src))
    for n, (start, path) in enumerate(((stream_bucket_upsert, "u"), (stream_bucket_snapshot, "s"))):
        table = BucketTable(spark, str(tmp_path / path), ["k"], 4)
        # two checkpoint folders: the second query delivers every epoch again under the same name
        for again in ("c1", "c2"):
            stream = read_stream(spark, str(src), SCHEMA + ", ts timestamp", max_files=1)
            if n:
                start(stream, table, "ts", "job", str(tmp_path / path / again)).awaitTermination()
            else:
                start(stream, table, ["v", "ts"], "job", str(tmp_path / path / again)).awaitTermination()
            assert table.log.last() == 2
        assert {k for k in content(table)} == {1, 2, 3}
