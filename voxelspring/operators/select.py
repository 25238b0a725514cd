"""Filters, selections, decimation and extrema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspring.cloud import squared_distance, with_pid


def above_mean(df: DataFrame, column: str = "z") -> DataFrame:
    """Rows strictly above the column's mean, which is a scalar subquery in the filter."""
    return df.where(F.col(column) > df.select(F.avg(column)).scalar())


def of_class(df: DataFrame, *codes: int) -> DataFrame:
    return df.where(F.col("cls").isin(*codes))


def by_ids(df: DataFrame, ids, invert: bool = False) -> DataFrame:
    """Rows with the given pids, a short list or a DataFrame of pid; with invert, all others."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("pid"), "pid", "left_anti" if invert else "left_semi")
    found = F.col("pid").isin(*ids)
    return df.where(~found if invert else found)


def within(df: DataFrame, center: tuple[float, float, float], radius: float) -> DataFrame:
    """Points in the ball, its surface included. The box around it reaches the scan."""
    point = tuple(map(F.col, "xyz"))
    box = [F.col(c).between(m - radius, m + radius) for c, m in zip("xyz", center, strict=True)]
    return df.where(box[0] & box[1] & box[2] & (squared_distance(point, tuple(map(F.lit, center))) <= radius * radius))


def decimate(df: DataFrame, factor: int = 160, dense: bool = True) -> DataFrame:
    """Every factor-th row by pid, from the first; pid is dense or is numbered first."""
    if dense:
        return df.where(F.col("pid") % factor == 0)
    return with_pid(df, "pid", name="_rank").where(F.col("_rank") % factor == 0).drop("_rank")


def translate(df: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    return df.withColumns({c: F.col(c) + F.lit(float(d)) for c, d in zip("xyz", (dx, dy, dz), strict=True)})


def low_high(df: DataFrame) -> DataFrame:
    """The lowest and the highest point; the smallest pid of equal ones."""
    point = F.struct("pid", "x", "y", "z")
    found = df.agg(F.min_by(point, F.struct("z", "pid")).alias("low"), F.max_by(point, F.struct(F.col("z"), -F.col("pid"))).alias("high"))
    return found.select(F.explode(F.array(F.struct(F.lit("low").alias("kind"), F.col("low").alias("p")), F.struct(F.lit("high").alias("kind"), F.col("high").alias("p")))).alias("e")).select("e.kind", "e.p.*")


def merge(*clouds: DataFrame) -> DataFrame:
    """All points of all clouds, duplicates included."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out
