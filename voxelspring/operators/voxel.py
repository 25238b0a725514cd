"""Voxel grids: counts, barycentres, one real point for each voxel, colours, top of column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspring.cloud import XYZ, squared_distance, with_pid

KEY = ("vx", "vy", "vz")


def with_voxel(df: DataFrame, size: float, origin: str = "min") -> DataFrame:
    """df with vx, vy, vz = floor((c - origin) / size). origin: the cloud's minimum, or "half" for the
    minimum less half a voxel. The minimum is a broadcast one-row aggregate."""
    shift = size / 2 if origin == "half" else 0.0
    low = df.agg(*[F.min(c).alias(f"_min{c}") for c in XYZ])
    df = df.crossJoin(F.broadcast(low))
    return df.withColumns({k: F.floor((F.col(c) - (F.col(f"_min{c}") - F.lit(shift))) / F.lit(float(size))).cast("long") for k, c in zip(KEY, XYZ, strict=True)}).drop(*[f"_min{c}" for c in XYZ])


def voxels_per_axis(df: DataFrame, size: float) -> DataFrame:
    return df.agg(*[F.ceil((F.max(c) - F.min(c)) / size).cast("long").alias(f"n{c}") for c in XYZ])


def voxel_counts(df: DataFrame, size: float, origin: str = "min") -> DataFrame:
    return with_voxel(df, size, origin).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


def barycenters(df: DataFrame, size: float, origin: str = "min") -> DataFrame:
    return with_voxel(df, size, origin).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in XYZ])


def members(df: DataFrame, size: float, origin: str = "min") -> DataFrame:
    """Every voxel with the list of its points; only for voxels of bounded content."""
    return with_voxel(df, size, origin).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pid", *XYZ))).alias("points"))


def subsample(df: DataFrame, size: float, origin: str = "min", mode: str = "closest", digits: int | None = None) -> DataFrame:
    """One point for each occupied voxel: the member nearest to the barycentre (ties go to the smaller
    pid), or with mode "barycenter" the barycentre itself. digits: decimals of the squared distance
    that count, for comparing with engines whose means differ in the last place.

    Voxels with many points cost no sort: the nearest member comes from a partial aggregate.
    """
    if mode == "barycenter":
        return barycenters(df, size, origin)
    keyed = with_voxel(df, size, origin)
    centers = keyed.groupBy(*KEY).agg(*[F.avg(c).alias(f"m{c}") for c in XYZ])
    d2 = squared_distance(tuple(map(F.col, XYZ)), tuple(F.col(f"m{c}") for c in XYZ))
    d2 = d2 if digits is None else F.round(d2, digits)
    point = F.struct("pid", *XYZ)
    return keyed.join(centers, [*KEY]).groupBy(*KEY).agg(F.min_by(point, F.struct(d2, "pid")).alias("p")).select(*KEY, "p.*")


def voxel_colors(df: DataFrame, size: float, origin: str = "half") -> DataFrame:
    """Every voxel with the mean colour of its points."""
    return with_voxel(df, size, origin).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "rgb"])


def top_of_column(voxels: DataFrame) -> DataFrame:
    """For each (vx, vy) the highest vz and its colour."""
    return voxels.groupBy("vx", "vy").agg(F.max("vz").alias("vz"), F.max_by(F.struct(*"rgb"), "vz").alias("c")).select("vx", "vy", "vz", "c.*")


def coverage(tops: DataFrame, size: float) -> DataFrame:
    """Columns whose top is not black count as built: numbers, areas and the built share."""
    black = (F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0)
    n = tops.agg(F.count_if(~black).alias("built"), F.count_if(black).alias("rest"))
    area = F.lit(float(size) ** 2)
    return n.select("built", "rest", (F.col("built") * area).alias("built_area"), (F.col("rest") * area).alias("rest_area"), (F.col("built") / F.nullif(F.col("built") + F.col("rest"), F.lit(0))).alias("ratio"))


def member_rows(df: DataFrame, size: float, origin: str = "min") -> DataFrame:
    """Every point with its voxel and its rank there, from 1 by pid. A voxel's points are ranked by the
    places of voxels in the whole order, so that one with many points is not one task."""
    keyed = with_voxel(df, size, origin)
    numbered = with_pid(keyed, *KEY, "pid", name="_at")
    first = numbered.groupBy(*KEY).agg(F.min("_at").alias("_first"))
    return numbered.join(first, [*KEY]).withColumn("rank", F.col("_at") - F.col("_first") + 1).drop("_at", "_first")
