"""Seeded clouds of spheres, cubes and planes, and a sphere mesh."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shapes(spark: SparkSession, num_points: int = 5000, num_shapes: int = 1, seed: int = 0) -> DataFrame:
    """(pid, shape, kind, x, y, z): num_points // num_shapes points for each shape, the remainder is
    left out. A sphere has one radius in [0.5, 1), a cube is filled, a plane lies at z = 0; each is
    moved to a centre in [-5, 5)^3."""
    rng = random.Random(seed)
    each = num_points // num_shapes
    rows = [(i, rng.choice(("sphere", "cube", "plane")), rng.uniform(0.5, 1), *(rng.uniform(-5, 5) for _ in range(3))) for i in range(num_shapes)]
    table = spark.createDataFrame(rows, "shape long, kind string, radius double, cx double, cy double, cz double")
    u, v, w = (F.rand(seed + i) for i in (1, 2, 3))
    points = spark.range(each * num_shapes).select(F.col("id").alias("pid"), F.floor(F.col("id") / each).alias("shape"), u.alias("u"), v.alias("v"), w.alias("w")).join(F.broadcast(table), "shape")
    theta, phi = 2 * math.pi * F.col("u"), math.pi * F.col("v")
    ball = (F.sin(phi) * F.cos(theta) * F.col("radius"), F.sin(phi) * F.sin(theta) * F.col("radius"), F.cos(phi) * F.col("radius"))
    box = tuple(2 * F.col(c) - 1 for c in "uvw")
    at = {c: F.when(F.col("kind") == "sphere", b).when(F.col("kind") == "cube", q).otherwise(q if c != "z" else F.lit(0.0)) + F.col(f"c{c}") for c, b, q in zip("xyz", ball, box, strict=True)}
    return points.select("pid", "shape", "kind", *[e.alias(c) for c, e in at.items()])


def sphere_mesh(spark: SparkSession, radius: float = 1.0, resolution: int = 20) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a sphere of 2 * resolution meridians and resolution rings."""
    n, m = 2 * resolution, resolution
    poles = spark.createDataFrame([(0, 0.0, 0.0, radius), (1, 0.0, 0.0, -radius)], "vid long, x double, y double, z double")
    grid = spark.range((m - 1) * n).select((F.col("id") + 2).alias("vid"), ((F.floor(F.col("id") / n) + 1) * math.pi / m).alias("a"), (F.col("id") % n * 2 * math.pi / n).alias("t"))
    vertices = poles.union(grid.select("vid", radius * F.sin("a") * F.cos("t"), radius * F.sin("a") * F.sin("t"), radius * F.cos("a")))
    i, j = F.floor(F.col("id") / n), F.col("id") % n
    k = (j + 1) % n
    ring = lambda r, s: 2 + r * n + s
    last = m - 2
    caps = spark.range(n).select(F.explode(F.array(F.array(F.lit(0), ring(0, j), ring(0, k)), F.array(F.lit(1), ring(last, k), ring(last, j)))).alias("f"))
    body = spark.range(last * n).select(F.explode(F.array(F.array(ring(i, j), ring(i + 1, j), ring(i + 1, k)), F.array(ring(i, j), ring(i + 1, k), ring(i, k)))).alias("f"))
    faces = caps.select(F.col("f").cast("array<long>")).union(body.select(F.col("f").cast("array<long>"))).select(F.col("f")[0].alias("v1"), F.col("f")[1].alias("v2"), F.col("f")[2].alias("v3"))
    return vertices, faces
