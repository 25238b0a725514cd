"""The block index: blocks, balls, pruned planes, filters that skip row groups, kept tables."""

from __future__ import annotations

import random
import time
from pathlib import Path

import numpy as np
import pytest

from voxelspring.operators import blocks, neighbors, plane, select
from voxelspring.storage import Kept

SCHEMA = "pid long, x double, y double, z double"


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], SCHEMA)


def spread(n, seed=2):
    draw = random.Random(seed)
    rows = [(draw.random() * 9, draw.random() * 9, draw.random() * 9) for _ in range(n)]
    return rows + [(4.0, 4.0, 4.0)] * (n // 3) + [(1e5, -1e5, 0.0)]


def test_blocks_hold_a_bounded_number_of_points_each_once(spark):
    rows = spread(300)
    found = blocks.packed(cloud(spark, rows), size=16).collect()
    assert max(r["n"] for r in found) <= 16 and sorted(p["pid"] for r in found for p in r["points"]) == list(range(len(rows)))
    for r in found:
        for c in "xyz":
            values = [p[c] for p in r["points"]]
            assert (min(values), max(values)) == (r[f"low_{c}"], r[f"high_{c}"])
    assert blocks.packed(cloud(spark, []), size=16).count() == 0


def test_nodes_above_cover_all(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 3)
    found = blocks.levels(blocks.packed(cloud(spark, spread(200)), size=8))
    assert [t.agg({"n": "sum"}).first()[0] for t in found] == [267] * len(found) and found[-1].count() == 1


def test_balls_of_many_centres(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 3)
    rows = spread(150)
    own = cloud(spark, rows)
    found = neighbors.balls(blocks.packed(own, size=8), own.where("pid % 7 = 0"), 1.5)
    want = {(i, j) for i in range(0, len(rows), 7) for j in range(len(rows)) if sum((a - b) ** 2 for a, b in zip(rows[i], rows[j], strict=True)) <= 2.25}
    assert {(r["a"], r["b"]) for r in found.collect()} == want


def test_balls_that_hold_whole_blocks_store_no_row_for_each(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 3)
    monkeypatch.setattr(neighbors, "REACH", 5)
    sizes, keep = [], neighbors.stored
    monkeypatch.setattr(neighbors, "stored", lambda df: sizes.append((out := keep(df)).count()) or out)
    rows = [(i % 10, i // 10 % 10, i // 100) for i in range(1000)]
    own = cloud(spark, rows)
    for radius in (3.0, 100.0):
        found = neighbors.balls(blocks.packed(own, size=8), own.where("pid % 100 = 0"), radius).collect()
        want = {(i, j) for i in range(0, 1000, 100) for j in range(1000) if sum((a - b) ** 2 for a, b in zip(rows[i], rows[j], strict=True)) <= radius**2}
        assert len(found) == len(want) and {(r["a"], r["b"]) for r in found} == want
    assert sizes and max(sizes) <= 5 * 10


def test_a_stored_table_leaves_no_shuffle_files(spark):
    from voxelspring import storage

    keep = spark.conf.get(storage.CLEANUP, None)
    files = lambda: {f for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).glob("*/shuffle_*.data")}
    before = files()
    found = storage.stored(spark.range(1000).repartition(3, "id"))
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(storage.CLEANUP, None) == keep and found.count() == 1000


def test_an_index_keeps_one_copy_of_its_cloud(spark):
    from voxelspring.storage import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    own = cloud(spark, spread(100))
    for make in (blocks.z_ordered, blocks.packed):
        before = set(folder.glob("table-*"))
        out = make(own)
        assert len(set(folder.glob("table-*")) - before) == 1 and out.count()


@pytest.mark.parametrize("threshold", [0.0, 0.05, 2.0, 1e6])
def test_planes_over_blocks_count_the_same_points(spark, threshold):
    draw = np.random.default_rng(1)
    rows = [(float(i % 9), float(i // 9 % 9), 0.0 if i % 2 else draw.random() * 4) for i in range(500)]
    own = cloud(spark, rows)
    planes = [(0, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 0.0, -4.0), *((i, *v) for i, v in enumerate(((n / np.linalg.norm(n)).tolist() + [float(draw.normal())] for n in draw.normal(size=(20, 3))), 2))]
    packed = blocks.packed(own, size=16)
    plain = {r["at"]: r["n"] for r in plane._counts(own, planes, threshold).collect()}
    pruned = {r["at"]: r["n"] for r in plane._counts_of_blocks(packed, planes, threshold).collect()}
    assert plain == pruned
    table = spark.createDataFrame([tuple(map(float, p[1:])) for p in planes], "a double, b double, c double, d double").selectExpr("0L as it", "*")
    assert plane.share_evaluated(packed, table, threshold) < (0.7 if threshold != 1e6 else 0.01)


def test_planes_one_after_the_other_over_blocks(spark, monkeypatch):
    rows = [(i % 9, i // 9, 0) for i in range(81)] + [(i % 9, 3, 1 + i // 9) for i in range(81)] + [(2.5, 7.5, 9.25)]
    own = cloud(spark, rows).union(spark.createDataFrame([(900, None, 1.0, 1.0)], SCHEMA))
    plain, whole = plane.multi_plane(own, 2, 0.01, 60)
    monkeypatch.setattr(plane, "SMALL", 0)
    models, points = plane.multi_plane(own, 2, 0.01, 60)
    assert sorted(map(tuple, models.collect())) == sorted(map(tuple, plain.collect()))
    assert sorted((r["pid"], r["segment"]) for r in points.collect()) == sorted((r["pid"], r["segment"]) for r in whole.collect())


def scanned(df) -> int:
    """Rows that the scans of the executed plan put out."""
    plan = df._jdf.queryExecution()
    df.collect()
    node = plan.executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


def test_a_ball_skips_row_groups(spark):
    own = spark.range(200_000).selectExpr("id as pid", "(id * 7919 % 1009) / 10D as x", "(id * 104729 % 1013) / 10D as y", "(id * 611953 % 1019) / 10D as z")
    ball = lambda df: select.within(df, (20.0, 30.0, 40.0), 4.0)
    ordered = blocks.z_ordered(own)
    assert sorted(r["pid"] for r in ball(ordered).collect()) == sorted(r["pid"] for r in ball(own).collect())
    assert scanned(ball(ordered)) < 200_000 / 4


def test_kept_tables_follow_their_file(spark, tmp_path):
    path, kept, made = str(tmp_path / "t"), Kept(), []

    def make():
        made.append(1)
        return blocks.stored(spark.read.parquet(path))

    spark.range(3).write.parquet(path)
    assert kept.get(spark, path, "n", make).count() == 3 and kept.get(spark, path, "n", make).count() == 3 and len(made) == 1
    spark.range(5).write.mode("append").parquet(path)
    assert kept.get(spark, path, "n", make).count() == 8 and len(made) == 2


def test_planes_over_many_blocks_of_a_batch_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    n, own = 4_000, np.random.default_rng(3).normal(size=(500, 4))
    at = np.random.default_rng(4).normal(size=(n, 3))
    points = pa.array([[{"x": x, "y": y, "z": z}] for x, y, z in at.tolist()])
    sides = [pa.array(at[:, i]) for i in range(3) for _ in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int64)), *sides, points], names=["n", *plane.SIDES, "points"])
    total, evaluated, step = np.zeros(500, np.int64), np.zeros(500, np.int64), max(1, plane.TOGETHER // 8 // 500)
    tracemalloc.start()
    for a in range(0, n, step):
        plane._add_blocks(batch.slice(a, step), own, 0.5, total, evaluated)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (total == (np.abs(at @ own[:, :3].T + own[:, 3]) <= 0.5).sum(axis=0)).all()
    assert peak < 8 * n * len(own)  # less than one interval's side for each block and plane


def test_numbering_stores_no_column_that_only_orders(spark, monkeypatch):
    from voxelspring import cloud as own

    seen, keep = [], own.stored
    monkeypatch.setattr(own, "stored", lambda df: seen.append(df.columns) or keep(df))
    rows = own.with_pid(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string"), "k", kept=["v"]).collect()
    assert seen == [["v", "__at"]] and sorted((r["pid"], r["v"]) for r in rows) == [(0, "a"), (1, "b"), (2, "c")]


def test_the_segment_in_sql_text_joins_nothing(spark):
    from voxelspring.plans.catalogue import _sql_segment

    found = _sql_segment(spark.createDataFrame([(0, 25.0, 50.0, 9.0, 6), (1, 25.0, 50.0, 70.0, 1), (2, 0.0, 9.0, 0.0, 6)], f"{SCHEMA}, cls int"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(6, 2, 2)]
