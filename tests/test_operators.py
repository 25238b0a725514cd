"""Hand-made cases and properties of the point operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspring import functions as X
from voxelspring.cloud import with_pid
from voxelspring.operators import blocks, cluster, generate, graph, neighbors, normals, plane, polygon, select, voxel
from voxelspring.streaming import point_stream, running_voxel_counts

SCHEMA = "pid long, x double, y double, z double"


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], SCHEMA)


def test_square_area_needs_order(spark):
    ring = cloud(spark, [(0, 0, 0), (1, 1, 0), (1, 0, 0), (0, 1, 0)])
    assert polygon.area(ring).first()["area"] == pytest.approx(0.0)
    assert polygon.area(polygon.sorted_ring(ring), "ord").first()["area"] == pytest.approx(1.0)


def test_plane_offset_uses_unit_normal(spark):
    pts = cloud(spark, [(0, 0, 5), (2, 0, 5), (0, 2, 5), (3, 3, 5), (1, 1, 9)])
    best = plane.ransac_plane(pts, 0.01, 50).first()
    assert best["n"] == 4 and abs(best["d"]) == pytest.approx(5.0) and abs(best["c"]) == pytest.approx(1.0)
    assert {r["pid"] for r in plane.segment(pts, 0.01, 50).where("is_inlier").collect()} == {0, 1, 2, 3}


def test_degenerate_clouds_have_no_plane(spark):
    line = cloud(spark, [(i, 0, 0) for i in range(6)])
    assert plane.ransac_plane(line, 0.1, 30).count() == 0
    assert plane.segment(line, 0.1, 30).where("is_inlier").count() == 0


def test_voxel_on_the_maximum_edge(spark):
    pts = cloud(spark, [(0, 0, 0), (1, 0, 0), (7, 0, 0), (12, 0, 0)])
    assert voxel.voxels_per_axis(pts, 6).first()["nx"] == 2
    assert {r["vx"] for r in voxel.voxel_counts(pts, 6).collect()} == {0, 1, 2}


def test_subsample_takes_members(spark):
    pts = generate.shapes(spark, 800, 4, 3).select("pid", "x", "y", "z").cache()
    best = voxel.subsample(pts, 1.0)
    assert best.count() == voxel.voxel_counts(pts, 1.0).count()
    assert best.join(pts, ["pid", "x", "y", "z"], "left_anti").count() == 0


def test_select_and_complement(spark):
    pts = cloud(spark, [(i, 0, i) for i in range(10)])
    assert sorted(r["pid"] for r in select.by_ids(pts, (1, 3)).collect() + select.by_ids(pts, (1, 3), True).collect()) == list(range(10))
    assert select.by_ids(pts, pts.where("pid > 7").select("pid"), True).count() == 8
    assert [r["pid"] for r in select.above_mean(pts).orderBy("pid").collect()] == [5, 6, 7, 8, 9]
    assert select.within(pts, (0, 0, 0), math.sqrt(2)).count() == 2


def test_two_blobs(spark):
    pts = cloud(spark, [(i * 0.1, 0, 0) for i in range(6)] + [(9 + i * 0.1, 0, 0) for i in range(6)] + [(50, 0, 0)])
    labels = {r["pid"]: r["label"] for r in cluster.dbscan(pts, 0.15, 3).collect()}
    # the ends have two neighbours with themselves and are border points
    assert labels == {**dict.fromkeys(range(6), 1), **dict.fromkeys(range(6, 12), 7), 12: -1}
    assert cluster.cluster_count(cluster.dbscan(pts, 0.15, 3, dense=True)).first()["clusters"] == 2


def test_knn_matches_brute_force(spark):
    pts = generate.shapes(spark, 300, 3, 5).select("pid", "x", "y", "z").cache()
    rows = pts.collect()
    found = {}
    for r in neighbors.knn(pts, 5).collect():
        found.setdefault(r["a"], {})[r["rank"]] = r["b"]
    for p in rows[::17]:
        order = sorted((sum((p[c] - q[c]) ** 2 for c in "xyz"), q["pid"]) for q in rows if q["pid"] != p["pid"])
        assert [found[p["pid"]][i + 1] for i in range(4)] == [pid for _, pid in order[:4]]


def test_normals_of_a_flat_grid(spark):
    pts = cloud(spark, [(i * 0.05, j * 0.05, 1) for i in range(6) for j in range(6)] + [(40, 40, 40)])
    found = {r["pid"]: r for r in normals.point_normals(pts, 0.2, 16).collect()}
    assert found[14]["nz"] == pytest.approx(1.0) and found[36]["nz"] is None


def test_wcss_of_one_cluster_is_the_variance(spark):
    pts = cloud(spark, [(0, 0, 0), (2, 0, 0), (0, 2, 0), (2, 2, 0)])
    assert cluster.total_squares(pts, ["x", "y"]).first()["wcss"] == pytest.approx(8.0)


def test_refined_planes_split_the_cloud(spark):
    pts = cloud(spark, [(i, j, 0) for i in range(4) for j in range(4)] + [(i, j, 9) for i in range(4) for j in range(4)])
    out = plane.refined_planes(pts, 2, 0.01, 60, 1.5, 3).groupBy("segment").count().collect()
    assert {r["segment"]: r["count"] for r in out} == {0: 16, 1: 16}


def test_generator_and_sphere(spark):
    pts = generate.shapes(spark, 1003, 4, 1)
    assert pts.count() == 1000 and pts.where("kind = 'plane'").select(F.round("z", 9)).distinct().count() <= 4
    vertices, faces = generate.sphere_mesh(spark)
    assert vertices.count() == 762 and faces.count() == 1520
    out = normals.vertex_normals(vertices, faces).join(vertices, "vid").select(F.min(F.expr("nx*x+ny*y+nz*z")).alias("m")).first()
    assert out["m"] > 0.99


def test_palettes(spark):
    df = spark.createDataFrame([(-1,), (0,), (3,)], "label int")
    rows = df.select("label", *[e.alias(n) for n, e in X.label_color(F.col("label"), F.lit(3)).items()]).orderBy("label").collect()
    assert rows[0]["r"] == 0.0 and rows[1]["r"] == X.PALETTE[0][0] and rows[2]["b"] == X.PALETTE[9][2]
    assert X.result_name("scan.v2.xyz", "_inliers.xyz") == "scan_inliers.xyz"
    assert X.result_name("./data/v1.0/scan.xyz", "_r.xyz") == "./data/v1.0/scan_r.xyz"
    assert X.voxel_result_name("in/scan.las", 6.0) == "in/scan_voxel-best_point_6.xyz"


def test_stream_counts(spark, tmp_path):
    cloud(spark, [(0, 0, 0), (1, 0, 0), (7, 0, 0)]).write.parquet(str(tmp_path / "in"))
    q = running_voxel_counts(point_stream(spark, str(tmp_path / "in")), 6.0).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["vx"], r["n"]) for r in spark.table("counts").collect()} == {(0, 2), (1, 1)}


def brute_labels(rows, eps, least):
    """DBSCAN over a list of points, pids by place."""
    near = [[j for j, q in enumerate(rows) if sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= eps * eps] for p in rows]
    core = [len(n) >= least for n in near]
    label = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i, n in enumerate(near):
            low = min((label[j] for j in n if core[j]), default=i) if core[i] else i
            if low < label[i]:
                label[i], moved = low, True
    return [label[i] if core[i] else min((label[j] for j in near[i] if core[j]), default=-1) for i in range(len(rows))]


def test_dbscan_with_crowded_cells(spark):
    """Cells with many points, equal points, cells that only just touch, and a rim of single points."""
    rng = random.Random(3)
    spots = [(0, 0, 0), (0.9, 0, 0), (1.85, 0.3, 0.1), (6, 0, 0), (6.97, 0, 0)]
    rows = [tuple(c + rng.gauss(0, 0.12) for c in s) for s in spots for _ in range(40)]
    rows += [(3.0 + 0.3 * i, 0.1 * rng.random(), 0.0) for i in range(6)] + [(20.0, 20.0, 20.0)] * 12 + [(-30.0, 0.0, 0.0)]
    rng.shuffle(rows)
    for eps in (0.5, 1.0):
        found = {r["pid"]: r["label"] for r in cluster.dbscan(cloud(spark, rows), eps, 5).collect()}
        assert [found[i] for i in range(len(rows))] == brute_labels(rows, eps, 5)


@pytest.mark.parametrize("kind", ["outlier", "flat", "equal", "dense and sparse"])
def test_knn_of_uneven_clouds(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbors, "SMALL", 0)
    monkeypatch.setattr(neighbors, "SIZE", 8)
    monkeypatch.setattr(blocks, "FAN", 3)
    rng = random.Random(4)
    rows = {
        "outlier": [(rng.random(), rng.random(), rng.random()) for _ in range(150)] + [(5e5, -4e5, 1.0)],
        "flat": [(rng.random(), rng.random(), 2.0) for _ in range(150)],
        "equal": [(1.0, 1.0, 1.0)] * 90 + [(rng.random(), 0.0, 0.0) for _ in range(20)],
        "dense and sparse": [(rng.gauss(0, 1e-4), rng.gauss(0, 1e-4), 0.0) for _ in range(100)] + [(rng.uniform(-9, 9),) * 3 for _ in range(40)],
    }[kind]
    found = {}
    for r in neighbors.knn(cloud(spark, rows), 5).collect():
        found.setdefault(r["a"], {})[r["rank"]] = r["b"]
    for i, p in enumerate(rows):
        order = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for j, q in enumerate(rows) if j != i)
        assert [found[i][n] for n in range(1, 5)] == [j for _, j in order[:4]]


def test_numbers_follow_the_whole_order(spark):
    """A frequent first key, nulls and ids with gaps."""
    rows = [(7 if i % 3 else i, (i * 37) % 100, i) for i in range(300)] + [(None, 5, 900), (None, None, 901)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = {r["c"]: r["pid"] for r in with_pid(df, "a", "b", "c").collect()}
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert [got[r[2]] for r in sorted(rows, key=key)] == list(range(len(rows)))


def test_refit_and_automatic_threshold(spark):
    rng = random.Random(6)
    flat = [(rng.random() * 9, rng.random() * 9, rng.gauss(0, 0.02)) for _ in range(200)] + [(rng.random() * 9, rng.random() * 9, 5 + rng.random()) for _ in range(30)]
    pts = cloud(spark, flat).cache()
    best, again = plane.ransac_plane(pts, 0.1, 50).first(), plane.ransac_plane(pts, 0.1, 50, refit=True).first()
    assert abs(again["c"]) > 0.9999 and abs(again["d"]) < 0.02 and again["n"] >= best["n"]
    assert plane.threshold_of(pts, "auto") == pytest.approx(neighbors.mean_spacing(pts, 8).first()["spacing"])


def test_inertia_and_elbow(spark):
    pts = cloud(spark, [(0, 0, 0), (0, 2, 0), (10, 0, 0), (10, 2, 0)])
    centers = pts.where("pid IN (0, 2)").select(F.col("pid").alias("label"), "x", "y")
    assert cluster.inertia(cluster.lloyd(pts, ["x", "y"], centers, 3)).first()["wcss"] == pytest.approx(4.0)
    found = {r["k"]: r["wcss"] for r in cluster.elbow(pts, ["x", "y"], 2).collect()}
    assert found == {1: pytest.approx(104.0), 2: pytest.approx(4.0)}


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(4)
    for n, m, parts in ((1, 0, 1), (60, 40, 5), (400, 380, 7)):
        edges = [(int(a) * 3 - 90, int(b) * 3 - 90) for a, b in rng.integers(0, n, (m, 2))]
        root = {}

        def find(v, root=root):
            while root.setdefault(v, v) != v:
                v = root[v]
            return v

        for a, b in edges:
            if a != b:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        table = spark.createDataFrame([*edges, (None, 5), (9, None)], "a long, b long").repartition(parts)
        for own in (table, graph.forest(table)):
            assert {r["node"]: r["label"] for r in graph.components(own).collect()} == {v: find(v) for v in root}


def test_ransac_draws_are_the_same_fetched_whole_and_by_rank(spark):
    pts = cloud(spark, [(float(i % 7), float(i % 5), float(i * i % 11)) for i in range(60)]).where("pid % 3 > 0")
    n, low, high = pts.count(), 1, 59
    ranks = [0, 3, 17, n - 1]
    assert plane.points_at(pts, n, low, high, ranks, n) == plane.points_at(pts, n, low, high, ranks, 0)
