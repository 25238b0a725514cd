"""Files as Spark sees them: any path that Hadoop can open, read from the driver or by lines."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from voxelspring.storage import stored


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def first_bytes(spark: SparkSession, path: str, count: int) -> bytes:
    system, at = _hadoop(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readNBytes(count))
    finally:
        stream.close()


def write_blocks(spark: SparkSession, path: str, blocks) -> None:
    """One file from blocks of bytes, one block in memory at a time."""
    system, at = _hadoop(spark, path)
    stream = system.create(at, True)
    try:
        for block in blocks:
            stream.write(bytearray(block))
    finally:
        stream.close()


def local_path(path: str) -> str | None:
    """The path for open(), or None where only Hadoop reads it."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, and split and at, which order the lines of a file; files are read in parts."""
    found = spark.read.text(path)
    meta = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "file"), ("file_block_start", "split"))]
    return found.select("value", *meta).withColumn("at", F.monotonically_increasing_id())


def numbered_lines(spark: SparkSession, path: str, name: str = "nth") -> DataFrame:
    """value and the number, from 0, of each line of a file. A part of a file is read in order by one task, so a line's
    number is that of the lines in earlier parts plus its place in its own: nothing is sorted, and what is counted
    over parts has a row for each."""
    lines = stored(ordered_lines(spark, path).select("value", "split", "at"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("head"))
    starts = parts.select("split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("head")).alias("start"))
    return lines.join(F.broadcast(starts), "split").select((F.col("start") + F.col("at")).alias(name), "value")


class Range(InputPartition):
    """Records of one file."""

    def __init__(self, path: str, first: int, count: int):
        super().__init__((path, first, count))
        self.path, self.first, self.count = path, first, count


def ranges(path: str, count: int, most: int) -> list[Range]:
    return [Range(path, a, min(most, count - a)) for a in range(0, count, most)]


def files_at(path: str, suffix: str) -> list[str]:
    """The file itself, or the files of a folder and of those in it that end so, in order."""
    if not os.path.isdir(path):
        return [path]
    found = [os.path.join(folder, f) for folder, _, names in os.walk(path) for f in names]
    return sorted(f for f in found if f.lower().endswith(suffix) and not os.path.basename(f).startswith((".", "_")))


class Bounds:
    """What filters say about single columns: the smallest and largest values that can pass."""

    def __init__(self):
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}

    def take(self, filters) -> None:
        for f in filters:
            if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or len(f.attribute) != 1 or not isinstance(f.value, (int, float)):
                continue
            name = f.attribute[0]
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.low[name] = max(self.low.get(name, f.value), f.value)
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.high[name] = min(self.high.get(name, f.value), f.value)

    def __bool__(self) -> bool:
        return bool(self.low or self.high)

    def meets(self, box: dict[str, tuple[float, float]]) -> bool:
        """Whether a box (low, high by column) can hold a row that passes."""
        return all(high >= self.low.get(c, high) and low <= self.high.get(c, low) for c, (low, high) in box.items())

    def kept(self, batch):
        """The rows of a batch that can pass."""
        import pyarrow.compute as pc

        for bounds, holds in ((self.low, pc.greater_equal), (self.high, pc.less_equal)):
            for c in set(bounds).intersection(batch.schema.names):
                batch = batch.filter(holds(batch.column(c), bounds[c]))
        return batch
