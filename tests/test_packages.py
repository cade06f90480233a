"""Packages as a data source, against the reader of whole archives."""

import io
import pickle
import tracemalloc
import zipfile

import pyarrow as pa
import pytest

from tessera.sources import archives as A
from tessera.sources import packages as P


def zipped(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def rows(df):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    inner = zipped([("c.txt", b"inner"), ("deep.zip", zipped([("d/e.txt", b"deep")])), ("d/", b"")])
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.zip").write_bytes(zipped([(f"f/{k}.txt", (f"text {k} " * 300).encode()) for k in range(120)] + [("empty.txt", b""), ("in.zip", inner), ("bad.zip", b"no"), ("naïve.txt", b"x")]))
    (tmp_path / "sub" / "b.ZIP").write_bytes(zipped([("s.txt", b"stored" * 50)], zipfile.ZIP_STORED))
    (tmp_path / "c.zip").write_bytes(zipped([("b.txt", b"bz" * 5000)], zipfile.ZIP_BZIP2))
    (tmp_path / "d.zip").write_bytes(zipped([("l.txt", b"lz" * 5000)], zipfile.ZIP_LZMA))
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    (tmp_path / "_half.zip").write_bytes(b"unfinished")
    (tmp_path / "other.txt").write_bytes(b"no package")
    return tmp_path


def test_members_are_those_of_whole_archives(spark, folder):
    P.register(spark)
    whole = spark.createDataFrame([(str(p), p.read_bytes()) for p in sorted(folder.rglob("*")) if p.suffix.lower() == ".zip" and p.name[0] != "_"], "path string, content binary")
    want = rows(A.read_archives(whole))
    read = spark.read.format("package").option("path", str(folder))
    assert rows(read.load()) == want and len(want) == 120 + 9
    split = read.option("partitionMembers", 7).load()
    assert split.rdd.getNumPartitions() >= 19 and rows(split) == want  # one archive alone is read by 18 tasks
    assert rows(read.option("partitionBytes", 500).load()) == want
    assert rows(spark.read.format("package").option("path", f"file://{folder}/a.zip").load()) == [r for r in want if r[0].endswith("/a.zip")]
    flat = spark.read.format("package").option("path", f"{folder}/a.zip").option("nested", "false").load()
    assert {r.file_path for r in flat.collect() if r.file_extension == "zip"} == {"in.zip", "bad.zip"}


def test_damaged_members_give_an_error_and_the_others_stay(spark, tmp_path):
    P.register(spark)
    data = bytearray(zipped([("a.txt", b"first" * 100), ("b.txt", b"second" * 100)]))
    data[40] ^= 0xFF  # inside the first member
    (tmp_path / "x.zip").write_bytes(bytes(data))
    got = {r.file_path: (r.raw_content, r.error) for r in spark.read.format("package").option("path", str(tmp_path)).load().collect()}
    assert got["a.txt"][0] is None and got["a.txt"][1] and bytes(got["b.txt"][0]) == b"second" * 100


def test_packages_are_written_by_tasks_and_seen_when_whole(spark, tmp_path):
    P.register(spark)
    at = str(tmp_path / "out")
    made = spark.range(50).selectExpr("concat('d/', id, '.txt') AS file_path", "CAST(repeat(CAST(id AS STRING), 100) AS BINARY) AS raw_content").repartition(4)
    made.write.format("package").mode("append").save(at)
    made.filter("file_path < 'd/2'").write.format("package").mode("append").save(at)
    back = spark.read.format("package").option("path", at).load()
    assert back.count() == 50 + made.filter("file_path < 'd/2'").count()
    made.write.format("package").mode("overwrite").save(at)
    assert sorted((r.file_path, bytes(r.raw_content)) for r in spark.read.format("package").option("path", at).load().collect()) == sorted((r.file_path, bytes(r.raw_content)) for r in made.collect())
    broken = made.selectExpr("file_path", "CAST(IF(file_path = 'd/7.txt', raise_error('stop'), 'x') AS BINARY) AS raw_content")
    with pytest.raises(Exception, match="stop"):
        broken.write.format("package").mode("append").save(at)
    assert spark.read.format("package").option("path", at).load().count() == 50
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("package").option("path", str(empty)).load().count() == 0


def test_new_packages_arrive_in_a_stream_once(spark, tmp_path):
    P.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(zipped([("a.txt", b"1")]))

    def run():
        stream = spark.readStream.format("package").option("path", str(tmp_path / "in")).option("settle", 0).load()
        done = stream.selectExpr("file_path", "CAST(raw_content AS STRING) AS text").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        done.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a.txt", "1")]
    (tmp_path / "in" / "b.zip").write_bytes(zipped([("b.txt", b"2"), ("c.txt", b"3")]))
    assert run() == [("a.txt", "1"), ("b.txt", "2"), ("c.txt", "3")]
    assert run() == [("a.txt", "1"), ("b.txt", "2"), ("c.txt", "3")]


def test_tasks_hand_members_on_by_bytes_and_write_archives_of_few(tmp_path, monkeypatch):
    monkeypatch.setattr(P, "ARCHIVE_MEMBERS", 30)
    monkeypatch.setattr(P, "BATCH_BYTES", 10_000)
    members = [(f"d/{k}.txt", None if k == 5 else bytes([k]) * (50_000 if k == 7 else 1_000)) for k in range(70)]
    batch = lambda some: pa.record_batch([pa.array([b for _, b in some], pa.binary()), pa.array([a for a, _ in some], pa.string())], ["raw_content", "file_path"])
    writer = P.PackageWriter({"path": str(tmp_path)}, False)
    told = writer.write(iter([batch(members[:45]), batch([]), batch(members[45:])]))
    assert len(told.names) == 3 and not P.archives_of(str(tmp_path))
    writer.commit([told, None, P.PackageWriter({"path": str(tmp_path)}, False).write(iter([]))])
    assert sorted(len(zipfile.ZipFile(a.path).namelist()) for a in P.archives_of(str(tmp_path))) == [10, 30, 30]
    reader = P.PackageReader({"path": str(tmp_path)})
    made = [b for part in reader.partitions() for b in reader.read(part)]
    assert all(b.num_rows == 1 or sum(map(len, b.column("raw_content").to_pylist())) <= 10_000 for b in made)
    assert sorted((r["file_path"], r["raw_content"]) for b in made for r in b.to_pylist()) == sorted((n, d or b"") for n, d in members)


def test_a_task_holds_no_second_copy_of_a_batch(tmp_path):
    content = pa.array([bytes([k % 251]) * 100_000 for k in range(400)], pa.binary())
    batch = pa.record_batch([pa.array([f"{k}.txt" for k in range(400)]), content], ["file_path", "raw_content"])
    tracemalloc.start()
    try:
        writer = P.PackageWriter({"path": str(tmp_path)}, False)
        writer.commit([writer.write(iter([batch]))])
        reader = P.PackageReader({"path": str(tmp_path)})
        assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == 400
        assert tracemalloc.get_traced_memory()[1] < 15e6  # of 40 MB
    finally:
        tracemalloc.stop()


def test_the_driver_keeps_places_and_no_members(tmp_path):
    members = [(f"folder/{'é' if k % 2 else 'e'}{k}.txt", b"x" * (k % 7)) for k in range(3000)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, (name, data) in enumerate(members):
            if k % 10 == 0:
                z.writestr(f"folder/{k}/", b"")
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=k % 3 == 0) as f:
                f.write(data)
        z.comment = b"last"
    (tmp_path / "a.zip").write_bytes(b"#!/bin/sh\n" * 50 + out.getvalue())  # its offsets don't count what stands before it
    (tmp_path / "b.zip").write_bytes(zipped([("only/", b"")]))
    reader = P.PackageReader({"path": str(tmp_path), "partitionMembers": "100"})
    parts = reader.partitions()
    assert len(parts) == 30 and len(pickle.dumps(parts)) < 10_000
    assert sorted((r["file_path"], r["raw_content"], r["error"]) for part in parts for b in reader.read(part) for r in b.to_pylist()) == sorted((n, d, None) for n, d in members)
    whole = P.PackageReader({"path": str(tmp_path)})
    assert sum(b.num_rows for part in whole.partitions() for b in whole.read(part)) == 3000
