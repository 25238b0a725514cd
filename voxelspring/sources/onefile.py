"""One file written by many tasks: each puts its bytes where they belong, none pass through the driver."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from voxelspring.cloud import in_ranges
from voxelspring.storage import stored

#: Bytes of a row for the writer, or one line; Spark hands it batches of 10,000 rows.
BYTES = 4096


@dataclass
class Written(WriterCommitMessage):
    size: int


class OneFileWriter(DataSourceArrowWriter):
    """Takes (offset, data). A task that is repeated writes the same bytes in the same place. The file gets
    its name when all bytes are there; an aborted job leaves nothing."""

    def __init__(self, options):
        self.path, self.draft, self.size = options["path"], options["draft"], int(options["size"])

    def write(self, iterator):
        size = 0
        with open(self.draft, "r+b") as f:
            for batch in iterator:
                for offset, data in zip(*(batch.column(c).to_pylist() for c in ("offset", "data")), strict=True):
                    f.seek(offset)
                    f.write(data)
                    size += len(data)
        return Written(size)

    def commit(self, messages):
        size = sum(m.size for m in messages if m is not None)
        if size != self.size:
            self.abort(messages)
            raise RuntimeError(f"{size} bytes instead of {self.size} were written for {self.path}")
        os.replace(self.draft, self.path)

    def abort(self, messages):
        if os.path.exists(self.draft):
            os.remove(self.draft)


class OneFile(DataSource):
    @classmethod
    def name(cls):
        return "one_file"

    def writer(self, schema, overwrite):
        return OneFileWriter(self.options)


def write_at(df: DataFrame, path: str, head: bytes, size: int) -> None:
    """Write (offset, data) rows of df, `size` bytes together, after `head`, which offsets count from. path:
    one that open() takes on the driver and all executors."""
    folder, name = os.path.split(path)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(head)
        f.truncate(len(head) + size)
    df.sparkSession.dataSource.register(OneFile)
    try:
        out = df.select((F.col("offset") + len(head)).alias("offset"), "data")
        out.write.format("one_file").option("draft", draft).option("size", size).mode("append").save(path)
    finally:
        if os.path.exists(draft):
            os.remove(draft)


def placed_lines(lines: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """((offset, data), bytes of all): the text column `line` in an order, line ends included. The rows are
    sorted by ranges; a partition adds up its own bytes, and what is added up over partitions is one
    number each."""

    def within(batches):
        at = 0
        for batch in batches:
            starts, found, size = [], [], BYTES
            for text in batch.column("line").to_pylist():
                data = f"{text}\n".encode()
                if size + len(data) > BYTES:
                    starts.append(at)
                    found.append([])
                    size = 0
                found[-1].append(data)
                size, at = size + len(data), at + len(data)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([b"".join(f) for f in found], pa.binary())], names=["at", "data"])

    part = F.spark_partition_id().alias("part")
    ordered = in_ranges(lines, *order).select("line")
    own = stored(ordered.mapInArrow(within, "at long, data binary").select("at", "data", part))
    start, starts = 0, []
    # one row for each partition
    for r in own.groupBy("part").agg(F.sum(F.octet_length("data")).cast("long").alias("n")).orderBy("part").collect():
        starts.append((r["part"], start))
        start += r["n"]
    table = own.sparkSession.createDataFrame(starts, "part int, start long")
    return own.join(F.broadcast(table), "part").select((F.col("start") + F.col("at")).alias("offset"), "data"), start
