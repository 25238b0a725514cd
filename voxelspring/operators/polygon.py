"""Rings of (pid, x, y): centroid, angular order, area."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspring.functions import bearing


def centroid(ring: DataFrame) -> DataFrame:
    """Mean of the corners."""
    return ring.agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def sorted_ring(ring: DataFrame, by: str = "ring", digits: int | None = None) -> DataFrame:
    """ring with `ord`, from 0, by falling bearing about the corners' mean (counter-clockwise). digits:
    decimals of the bearing that count, for comparing with other engines."""
    ring = ring if by in ring.columns else ring.withColumn(by, F.lit(0))
    whole = Window.partitionBy(by)
    angle = bearing(F.col("x"), F.col("y"), F.avg("x").over(whole), F.avg("y").over(whole))
    angle = angle if digits is None else F.round(angle, digits)
    ring = ring.withColumn("_angle", angle)
    return ring.withColumn("ord", F.row_number().over(whole.orderBy(F.desc("_angle"), "pid")) - 1).drop("_angle")


def area(ring: DataFrame, order: str = "pid", by: str = "ring") -> DataFrame:
    """Absolute area of each closed ring in the given order of its corners."""
    ring = ring if by in ring.columns else ring.withColumn(by, F.lit(0))
    w = Window.partitionBy(by).orderBy(order)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in "xy")
    terms = ring.select(by, (F.col("x") * ny - nx * F.col("y")).alias("t"))
    return terms.groupBy(by).agg((F.abs(F.sum("t")) / 2).alias("area"))
