"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='voxelspring-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Spark's setting that deletes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Writes in here leave no shuffle files; otherwise these lie on the executors' disks until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: it cuts the lineage, and it outlives a
    lost executor. Its shuffle files are deleted, as nothing reads them again. row_group: bytes of a row group,
    where filters are to skip parts of a file."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_cleaned(df.sparkSession):
        (df.write if row_group is None else df.write.option("parquet.block.size", row_group)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version_of(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(time of change, bytes) of a file or folder on any file system; None if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    return system.getFileStatus(where).getModificationTime(), system.getContentSummary(where).getLength()


class Kept:
    """Tables derived from a file, stored once and used again while the file is as it was and the stored
    table is there."""

    def __init__(self):
        self.tables: dict[tuple, tuple[tuple, DataFrame]] = {}

    def get(self, spark: SparkSession, source: str, name: str, make) -> DataFrame:
        key, version = (spark.sparkContext.applicationId, source, name), version_of(spark, source)
        if key in self.tables:
            seen, df = self.tables[key]
            if seen == version and all(version_of(spark, f) for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}):
                return df
        df = make()
        self.tables[key] = version, df
        return df


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables that stored() wrote, once nothing reads them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/table-" in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
