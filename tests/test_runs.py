"""Run tables in buckets and cached embeddings."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources import embeddings, runs
from tessera.streaming import sessions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files_read(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_merges_exchange_only_the_touched_buckets(spark, tmp_path):
    at = str(tmp_path / "run")
    first = spark.range(500).select("id", F.lit(1).alias("version"), F.lit("a").alias("x"))
    runs.merge(spark, at, first, ["id"])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("*.parquet")}
    assert rows(runs.load(spark, at)) == rows(first) and len(before) > 30
    second = spark.createDataFrame([(7, 2, "b"), (7, 3, "c"), (None, 2, "n"), (900, 2, "new")], "id long, version int, x string")
    runs.merge(spark, at, second, ["id"], latest="version")
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("*.parquet")}
    assert len(set(before) - set(after)) <= 3  # files of the buckets of three keys
    want = {(i, 1, "a") for i in range(500) if i != 7} | {(7, 3, "c"), (None, 2, "n"), (900, 2, "new")}
    assert set(map(tuple, runs.load(spark, at).collect())) == want
    runs.merge(spark, at, second, ["id"], latest="version")  # repeated after a crash
    assert runs.load(spark, at).count() == len(want)
    found = runs.look_up(spark, at, spark.createDataFrame([(7,), (8,), (12345,)], "id long"), ["id"])
    assert rows(found) == [(7, 3, "c"), (8, 1, "a")] and len(files_read(found)) <= 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    runs.merge(spark, at, spark.createDataFrame([(1, 5)], "id long, version int"), ["id"])
    assert {r.x for r in runs.load(spark, at).filter("id = 1").collect()} == {None}


def test_unseen_rows(spark, tmp_path):
    at = str(tmp_path / "run")
    some = spark.range(10).withColumn("x", F.lit(1))
    assert runs.unseen(spark, at, some, ["id"]).count() == 10
    runs.merge(spark, at, some.filter("id < 4"), ["id"])
    assert rows(runs.unseen(spark, at, some.unionAll(some), ["id"]).select("id")) == [(k,) for k in range(4, 10)]
    with pytest.raises(FileNotFoundError):
        runs.look_up(spark, str(tmp_path / "none"), some, ["id"])


def test_a_resumed_run_reads_the_buckets_of_its_keys(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    calls = spark.sparkContext.accumulator(0)

    def process(df):
        def count(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema)

    def run(checkpoint):
        stream = spark.readStream.schema("id long, t string").parquet(source)
        sessions.resume(stream, process, ["id"], target, str(tmp_path / checkpoint)).awaitTermination()
        return rows(spark.read.parquet(target).select("id", "t"))

    spark.range(200).select("id", F.lit("x").alias("t")).write.parquet(source)
    want = [(k, "x") for k in range(200)]
    assert run("a") == want and calls.value == 200
    assert run("b") == want and calls.value == 200  # a lost checkpoint: every batch comes again, no key is processed twice
    spark.createDataFrame([(5, "again"), (777, "new")], "id long, t string").write.mode("append").parquet(source)
    assert run("a") == [*want, (777, "new")] and calls.value == 201
    known = runs.touched(spark, target, spark.createDataFrame([(777,)], "id long"), ["id"])
    assert len({f.split("bucket=")[1].split("/")[0] for f in files_read(known)}) == 1


def test_equal_texts_are_embedded_once_and_a_second_run_embeds_none(spark, tmp_path):
    sent, calls, failed = (spark.sparkContext.accumulator(0) for _ in range(3))
    marker = str(tmp_path / "failed")

    def model(texts):
        import os

        assert len(texts) <= 4
        if not os.path.exists(marker):
            open(marker, "w").close()
            failed.add(1)
            raise TimeoutError
        sent.add(len(texts))
        calls.add(1)
        return [[len(t), t.count("a")] for t in texts]

    docs = spark.createDataFrame([(k, None if k == 3 else "a" * (k % 13)) for k in range(60)], "id long, text string").coalesce(1)
    run = lambda df, name="m": rows(embeddings.embed(df, "id", "text", model, str(tmp_path / "cache"), name, batch=4, wait=0.01))
    want = sorted((k, None if k == 3 else [float(k % 13)] * 2) for k in range(60))
    assert run(docs) == want and (sent.value, failed.value) == (13, 1) and calls.value >= 4
    assert run(docs) == want and sent.value == 13
    more = docs.union(spark.createDataFrame([(100, "ab")], "id long, text string"))
    assert run(more) == [*want, (100, [2.0, 1.0])] and sent.value == 14
    assert run(docs, "other") == want and sent.value == 27
    assert run(docs.filter("false")) == []


def test_only_the_texts_of_a_call_leave_their_batch():
    texts = pa.array([chr(97 + k % 26) * 100_000 for k in range(400)])
    frame = pa.record_batch([pa.array([str(k) for k in range(400)]), texts], ["digest", "__text"])
    model = lambda some: [[len(t), t.count("b")] for t in some]
    tracemalloc.start()
    try:
        made = [r for b in embeddings.vectors_of(iter([frame, frame.slice(0, 0), frame.slice(7, 5)]), model, 32, 1, 0.0) for r in b.to_pylist()]
        assert tracemalloc.get_traced_memory()[1] < 10e6  # of 40 MB
    finally:
        tracemalloc.stop()
    assert made == [{"digest": str(k), "vector": [100_000.0, 100_000.0 * (k % 26 == 1)]} for k in [*range(400), *range(7, 12)]]
    with pytest.raises(ValueError, match="31 vectors for 32 texts"):
        list(embeddings.vectors_of(iter([frame]), lambda some: [[0.0]] * 31, 32, 1, 0.0))
