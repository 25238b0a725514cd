"""Clouds that arrive as files: running voxel counts over a stream, by the batch operators' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspring.operators.voxel import KEY


def point_stream(spark: SparkSession, path: str, schema: str = "pid long, x double, y double, z double") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def running_voxel_counts(points: DataFrame, size: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Voxel counts so far. A stream has no minimum, so the origin is given."""
    keys = [F.floor((F.col(c) - F.lit(float(o))) / F.lit(float(size))).cast("long").alias(k) for k, c, o in zip(KEY, "xyz", origin, strict=True)]
    return points.select(*keys).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
