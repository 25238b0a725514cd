"""Normals of points (smallest eigenvector of the neighbours' covariance) and of mesh vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspring.cloud import XYZ
from voxelspring.functions import cross
from voxelspring.operators.neighbors import hybrid, nearest_points

AXES = ("nx", "ny", "nz")


def point_normals(df: DataFrame, radius: float | None = None, max_nn: int = 30) -> DataFrame:
    """(pid, nx, ny, nz) from the max_nn nearest points, within the radius where one is given; null below
    three neighbours or where they don't span a plane; nz >= 0, then ny, then nx. The eigenvector
    comes in closed form, so all of it stays in column expressions."""
    found = nearest_points(df, max_nn) if radius is None else hybrid(df, radius, max_nn)
    near = found.join(df.select(F.col("pid").alias("b"), *XYZ), "b")
    pairs = [(p, q) for i, p in enumerate(XYZ) for q in XYZ[i:]]
    cov = near.groupBy("a").agg(F.count(F.lit(1)).alias("m"), *[F.covar_pop(p, q).alias(p + q) for p, q in pairs])
    c = {k: F.col(k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
    cov = cov.withColumn("mean", (c["xx"] + c["yy"] + c["zz"]) / 3)
    off = c["xy"] ** 2 + c["xz"] ** 2 + c["yz"] ** 2
    cov = cov.withColumn("p", F.sqrt(((c["xx"] - F.col("mean")) ** 2 + (c["yy"] - F.col("mean")) ** 2 + (c["zz"] - F.col("mean")) ** 2 + 2 * off) / 6))
    m, p = F.col("mean"), F.col("p")
    a, b, d = (F.try_divide(c[k] - m, p) for k in ("xx", "yy", "zz"))
    e, f, g = (F.try_divide(c[k], p) for k in ("xy", "xz", "yz"))
    half_det = (a * (b * d - g * g) - e * (e * d - g * f) + f * (e * g - b * f)) / 2
    cov = cov.withColumn("low", m + 2 * p * F.cos(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half_det))) / 3 + 2 * F.pi() / 3))
    low = F.col("low")
    rows = [(c["xx"] - low, c["xy"], c["xz"]), (c["xy"], c["yy"] - low, c["yz"]), (c["xz"], c["yz"], c["zz"] - low)]
    # the longest cross product of two rows of C - low * I points along the eigenvector
    for i, (u, v) in enumerate(((0, 1), (0, 2), (1, 2))):
        n = cross(rows[u], rows[v])
        cov = cov.withColumn(f"n{i}", F.struct((n[0] ** 2 + n[1] ** 2 + n[2] ** 2).alias("s"), n[0].alias("x"), n[1].alias("y"), n[2].alias("z")))
    cov = cov.withColumn("v", F.greatest("n0", "n1", "n2"))
    unit = {k: F.try_divide(F.col(f"v.{x}"), F.sqrt("v.s")) for k, x in zip(AXES, XYZ, strict=True)}
    cov = cov.select(F.col("a").alias("pid"), "m", F.col("v.s").alias("s"), *[u.alias(k) for k, u in unit.items()])
    # a component of rounding errors alone has no sign
    sign = F.when(F.abs("nz") > 1e-9, F.signum("nz")).when(F.abs("ny") > 1e-9, F.signum("ny")).otherwise(F.signum("nx"))
    good = (F.col("m") >= 3) & (F.col("s") > 0)
    return cov.select("pid", *[F.when(good, F.col(k) * sign).alias(k) for k in AXES])


def vertex_normals(vertices: DataFrame, faces: DataFrame, weighted: bool = True) -> DataFrame:
    """(vid, nx, ny, nz): normalised sum of the faces' normals, weighted by their areas or evenly."""
    out = faces
    for i in "123":
        out = out.join(vertices.select(F.col("vid").alias(f"v{i}"), *[F.col(c).alias(c + i) for c in XYZ]), f"v{i}")
    u, v = (tuple(F.col(c + i) - F.col(c + "1") for c in XYZ) for i in "23")
    out = out.withColumns({k: n for k, n in zip(AXES, cross(u, v), strict=True)})
    length = F.sqrt(sum((F.col(k) ** 2 for k in AXES[1:]), F.col(AXES[0]) ** 2))
    if not weighted:
        out = out.withColumn("_len", length).withColumns({k: F.col(k) / F.nullif(F.col("_len"), F.lit(0.0)) for k in AXES})
    out = out.select(F.explode(F.array("v1", "v2", "v3")).alias("vid"), *AXES).groupBy("vid").agg(*[F.sum(k).alias(k) for k in AXES])
    return out.withColumn("_len", F.nullif(length, F.lit(0.0))).select("vid", *[(F.col(k) / F.col("_len")).alias(k) for k in AXES])


def mesh_center(vertices: DataFrame) -> DataFrame:
    return vertices.agg(*[F.avg(c).alias(c) for c in XYZ])
