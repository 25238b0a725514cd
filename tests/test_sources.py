"""Round trips of every format."""

from __future__ import annotations

import struct

from voxelspring import sources


def test_text_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.23456, -2.0, 3)], "x double, y double, label int")
    sources.write_text(df, str(tmp_path / "out"), 4, integers=("label",))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1.2346;-2.0000;3"]
    sources.write_text(df, str(tmp_path / "full"), None)
    assert spark.read.text(str(tmp_path / "full")).first()["value"] == "1.23456;-2.0;3"


def test_delimited_and_whitespace(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("X;Y;Z;R;G;B\n1;2;3;255;0;51\n")
    cloud = sources.table_to_cloud(sources.read_delimited(spark, str(tmp_path / "a.xyz"))).first()
    assert (cloud["x"], cloud["r"], cloud["b"]) == (1.0, 1.0, 0.2)
    (tmp_path / "b.xyz").write_text("x y z r g b\n1 2  3 4 5 6\n\n7 8 9 1 2 3\n")
    rows = sources.read_whitespace(spark, str(tmp_path / "b.xyz"), list("xyzrgb")).orderBy("x").collect()
    assert [r["x"] for r in rows] == [1.0, 7.0] and rows[0]["b"] == 6.0


def test_las(spark, tmp_path):
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<IIBHI", head, 96, 227, 0, 2, 26, 2)
    struct.pack_into("<3d", head, 131, 0.01, 0.01, 0.5)
    struct.pack_into("<3d", head, 155, 100, 0, -1)
    record = lambda x, rgb: struct.pack("<iiiHBBbBH", x, 2, 3, 7, 0, 6, 0, 0, 0) + struct.pack("<HHH", *rgb)
    (tmp_path / "a.las").write_bytes(bytes(head) + record(150, (65535, 0, 1)) + record(-50, (1, 2, 3)))
    rows = sources.read_las(spark, str(tmp_path / "a.las")).orderBy("pid").collect()
    assert [(r["x"], r["y"], r["z"], r["red"], r["classification"]) for r in rows] == [(101.5, 0.02, 0.5, 65535, 6), (99.5, 0.02, 0.5, 1, 6)]


def test_ply(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.5, 2.0, 3.0, 1.0, 0.0, 0.2), (1, -1.0, 0.0, 0.25, 0.0, 1.0, 0.0)], "pid long, x double, y double, z double, r double, g double, b double")
    assert sources.write_ply(df, str(tmp_path / "a.ply")) == 2
    rows = sources.read_ply(spark, str(tmp_path / "a.ply")).orderBy("pid").collect()
    assert [(r["x"], r["z"], r["red"], r["blue"]) for r in rows] == [(1.5, 3.0, 255.0, 51.0), (-1.0, 0.25, 0.0, 0.0)]
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n")
    assert sources.read_ply(spark, str(tmp_path / "b.ply")).first()["z"] == 3.0


def test_obj(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# mesh\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1/1 2/2/2 3/3/3 4/4/4\n")
    vertices, faces = sources.read_obj(spark, str(tmp_path / "a.obj"))
    assert vertices.count() == 4 and [tuple(r)[1:] for r in faces.orderBy("fid").collect()] == [(1, 2, 3), (1, 3, 4)]


def test_obj_fans_and_references(spark, tmp_path):
    """Faces with many corners, references that count back, and faces between the vertices."""
    n = 1500
    ring = "\n".join(f"v {i} {i % 7} 0" for i in range(n))
    (tmp_path / "b.obj").write_text(f"{ring}\nf -3 -2 -1\nv 9 9 9\nf -1 1 2\nf " + " ".join(str(i + 1) for i in range(n)) + "\nf 1 2\n")
    vertices, faces = sources.read_obj(spark, str(tmp_path / "b.obj"))
    rows = [tuple(r) for r in faces.orderBy("fid").collect()]
    assert vertices.count() == n + 1 and vertices.where("vid = 1501").first()["x"] == 9.0
    assert rows[:2] == [(1, n - 2, n - 1, n), (2, n + 1, 1, 2)]
    assert [r[1:] for r in rows[2:]] == [(1, i, i + 1) for i in range(2, n)] and [r[0] for r in rows] == list(range(1, n + 1))


def test_parts_and_paths_of_hadoop(spark, tmp_path):
    df = spark.range(1000).selectExpr("id AS pid", "id * 0.5D AS x", "-id * 1.0D AS y", "3.0D AS z").repartition(3)
    found = sources.write_ply_parts(df, str(tmp_path / "parts"))
    back = [sources.read_ply(spark, str(tmp_path / "parts" / r["file"])).count() for r in found.collect()]
    assert back == [r["points"] for r in found.collect()] and sum(back) == 1000
    assert sources.write_ply(df, f"file://{tmp_path}/one.ply") == 1000
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.cloud.link./in", f"file://{tmp_path}")
    for path in (f"file://{tmp_path}/one.ply", "viewfs://cloud/in/one.ply"):
        rows = sources.read_ply(spark, path).orderBy("pid").collect()
        assert len(rows) == 1000 and (rows[999]["x"], rows[999]["y"]) == (499.5, -999.0)


def test_seven_columns_and_corners(spark, tmp_path):
    (tmp_path / "p.xyz").write_text("x;y;z;illuminance;reflectance;intensity;nb_of_returns\n1;2;3;4;5;6;7\n2;2;3;4;5;6;8\n3;2;3;4;5;6;9\n")
    schema = "x double, y double, z double, illuminance double, reflectance double, intensity double, nb_of_returns double"
    rows = sources.read_delimited(spark, str(tmp_path / "p.xyz"), schema).orderBy("x").collect()
    assert [r["nb_of_returns"] for r in rows] == [7.0, 8.0, 9.0]
    ring = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 1.0, 0.0), (3, 0.0, 1.0)], "pid long, x double, y double")
    sources.write_corners(ring, str(tmp_path / "sorted"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "sorted")).collect()]
    assert sorted(lines) == sorted(r["line"] for r in sources.corner_lines(ring, in_order=False).collect()) and len(lines) == 4
    assert lines[0] == "1.000000000;0.000000000"
