"""Single files written by many tasks, and folders of files read with filters."""

from __future__ import annotations

import os
import struct

import pytest
from pyspark.sql import functions as F

from voxelspring import cloud, sources
from voxelspring.operators import select
from voxelspring.sources import onefile
from voxelspring.sources.files import numbered_lines, ordered_lines
from voxelspring.sources.onefile import OneFileWriter
from voxelspring.sources.text import write_one_text


def test_text_comes_in_order(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("pid"), (F.col("id") / 7.0).alias("x")).repartition(5)
    path = str(tmp_path / "c.xyz")
    size = write_one_text(df, path, "pid", digits=3, integers=("pid",))
    want = "".join(f"{r['pid']};{r['x']:.3f}\n" for r in sorted(df.collect()))
    assert open(path).read() == want and size == len(want) and os.listdir(tmp_path) == ["c.xyz"]
    write_one_text(df.limit(0), path, "pid")
    assert open(path).read() == ""


def test_ply_records_in_their_places(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") * 17 % 3001).alias("pid"), *[(F.col("id") * i + 0.5).alias(c) for i, c in enumerate("xyz")], *[F.lit(0.5).alias(c) for c in "rgb"]).repartition(3)
    path = f"file://{tmp_path}/c.ply"
    assert sources.write_ply(df, path) == 3000
    got = [tuple(r)[1:4] for r in sources.read_ply(spark, path).orderBy("pid").collect()]
    assert got == [tuple(r)[1:4] for r in df.orderBy("pid").collect()] and os.listdir(tmp_path) == ["c.ply"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(200).select(F.col("id").alias("pid"), F.when(F.col("id") == 150, F.raise_error(F.lit("no"))).otherwise(F.lit(1.0)).cast("double").alias("x"))
    with pytest.raises(Exception, match="no"):
        write_one_text(bad, str(tmp_path / "c.xyz"), "pid")
    assert os.listdir(tmp_path) == []


def test_a_repeated_task_and_missing_bytes(tmp_path):
    import pyarrow as pa

    draft, path = str(tmp_path / "d"), str(tmp_path / "f")
    open(draft, "wb").write(b"\0" * 6)
    writer = OneFileWriter({"path": path, "draft": draft, "size": "6"})
    batch = lambda o, d: iter([pa.RecordBatch.from_arrays([pa.array([o]), pa.array([d], pa.binary())], names=["offset", "data"])])
    writer.write(batch(3, b"def"))
    messages = [writer.write(batch(3, b"def")), writer.write(batch(0, b"abc"))]
    writer.commit(messages)
    assert open(path, "rb").read() == b"abcdef"
    open(draft, "wb").write(b"\0" * 6)
    with pytest.raises(RuntimeError):
        writer.commit(messages[:1])
    assert not os.path.exists(draft)


def las_file(path, xs):
    """A LAS 1.2 file, point format 0, steps of 0.01, at y = x / 2 and z = 1."""
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<IIBHI", head, 96, 227, 0, 0, 20, len(xs))
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 0, 0, 0)
    box = [v for c in (xs, [x / 2 for x in xs], [1.0]) for v in (max(c), min(c))]
    struct.pack_into("<6d", head, 179, *box)
    path.write_bytes(bytes(head) + b"".join(struct.pack("<iiiHBBbBH", round(x * 100), round(x * 50), 100, 7, 0, 2, 0, 0, 0) for x in xs))


def test_filters_leave_out_files_of_a_folder(spark, tmp_path):
    (tmp_path / "more").mkdir()
    for i, at in enumerate((0, 100, 200, 300)):
        las_file(tmp_path / ("more" if i == 3 else ".") / f"{i}.las", [float(at + k) for k in range(50)])
    whole = sources.read_las(spark, str(tmp_path))
    assert whole.count() == 200 and whole.rdd.getNumPartitions() == 4
    near = select.within(whole, (130.0, 65.0, 1.0), 12.0)
    assert near.rdd.getNumPartitions() == 1
    assert sorted((r["file"], r["pid"]) for r in near.collect()) == sorted(("1.las", k) for k in range(50) if (k - 30) ** 2 * 1.25 <= 144)
    assert sources.read_las(spark, str(tmp_path)).where("x > 1000").count() == 0
    # only a bound on one column leaves files out; other conditions don't
    assert whole.where("x + y > 448").count() == sum(1.5 * (300 + k) > 448 for k in range(50))


def test_a_folder_of_ply_files(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("pid"), *[(F.col("id") * (i + 1)).cast("double").alias(c) for i, c in enumerate("xyz")])
    files = sources.write_ply_parts(df.repartition(3), str(tmp_path))
    found = sources.read_ply(spark, str(tmp_path))
    assert found.count() == 300 and found.select("file").distinct().count() == files.count()
    assert sorted(r["x"] for r in found.where("z BETWEEN 30 AND 60").collect()) == [float(x) for x in range(10, 21)]


def test_tasks_sort_no_more_than_a_range(spark, monkeypatch):
    monkeypatch.setattr(cloud, "RANGE", 100)
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    sizes = [r["n"] for r in cloud.in_ranges(df, "k").groupBy(F.spark_partition_id()).agg(F.count("k").alias("n")).collect()]
    assert len(sizes) >= 40 and max(sizes) < 400
    numbered = cloud.with_pid(df, "k")
    assert len(numbered.inputFiles()) >= 40
    assert [r["k"] for r in numbered.orderBy("pid").collect()] == sorted(r["k"] for r in df.collect())
    assert [r["pid"] for r in numbered.orderBy("pid").select("pid").collect()] == list(range(5000))


def test_rows_for_the_writer_are_short(spark, tmp_path):
    text = F.when(F.col("id") % 1000 == 7, F.repeat(F.lit("ü"), 9000)).otherwise(F.col("id").cast("string"))
    lines = spark.range(12_000).select(text.alias("line"), F.col("id").alias("o")).coalesce(1)
    placed, size = onefile.placed_lines(lines, "o")
    rows = sorted((r["offset"], bytes(r["data"])) for r in placed.collect())
    want = "".join(f"{r['line']}\n" for r in lines.orderBy("o").collect()).encode()
    assert b"".join(d for _, d in rows) == want and size == len(want)
    assert [o for o, _ in rows] == [sum(len(d) for _, d in rows[:i]) for i in range(len(rows))]
    assert all(len(d) <= onefile.BYTES or d.count(b"\n") == 1 for _, d in rows) and len(rows) < 200


def test_lines_are_numbered_by_parts(spark, tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("".join(f"{'x' * (i * 7919 % 60)}{i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert ordered_lines(spark, str(path)).select("split").distinct().count() > 10
        found = numbered_lines(spark, str(path)).orderBy("nth").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["nth"] for r in found] == list(range(3000))
    assert [r["value"] for r in found] == path.read_text().splitlines()
    (tmp_path / "none.txt").write_text("")
    assert numbered_lines(spark, str(tmp_path / "none.txt")).count() == 0
