"""PLY point files: ASCII and binary little-endian in, binary little-endian out."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from voxelspring.cloud import with_pid
from voxelspring.sources.files import Bounds, Range, files_at, first_bytes, local_path, numbered_lines, ranges, write_blocks
from voxelspring.sources.onefile import BYTES, write_at

#: Kinds of properties and their numpy types. Fixed values.
KINDS = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
RECORDS = 1_000_000
#: Bytes in which a header ends.
HEADER = 65_536


def header(data: bytes, path: str) -> dict:
    """Format, number of vertices, their properties, where the body begins, and the header's lines."""
    if data.split(b"\n", 1)[0].strip() != b"ply":
        raise ValueError(f"{path} is no PLY file")
    end = data.index(b"\n", data.index(b"end_header")) + 1
    lines = data[:end].decode("ascii").splitlines()
    out: dict = {"properties": [], "count": 0, "body": end, "lines": len(lines)}
    element = None
    for word in map(str.split, lines):
        if word[:1] == ["format"]:
            out["format"] = word[1]
        elif word[:1] == ["element"]:
            if element is None and word[1] != "vertex":
                raise ValueError("vertices come first")
            element = word[1]
            out["count"] = int(word[2]) if element == "vertex" else out["count"]
        elif word[:1] == ["property"] and element == "vertex":
            out["properties"].append((word[2], KINDS[word[1]]))
    return out


def local_header(path: str) -> dict:
    with open(path, "rb") as f:
        return header(f.read(HEADER), path)


def schema_of(head: dict) -> str:
    return ", ".join(["pid long", *(f"`{n}` double" for n, _ in head["properties"])])


def points(data: bytes, head: dict, first: int) -> pa.RecordBatch:
    rec = np.frombuffer(data, np.dtype(head["properties"]))
    columns = [pa.array(np.arange(first, first + len(rec))), *(pa.array(rec[n].astype(np.float64)) for n in rec.dtype.names)]
    return pa.RecordBatch.from_arrays(columns, names=["pid", *rec.dtype.names])


class PlyReader(DataSourceReader):
    """The vertices of one binary file or of all in a folder; those outside the ranges that filters leave
    aren't handed on."""

    def __init__(self, options):
        self.path, self.bounds = options["path"], Bounds()

    def pushFilters(self, filters):
        self.bounds.take(filters)
        return filters  # Spark decides on each row

    def partitions(self):
        return [r for path in files_at(self.path, ".ply") for r in ranges(path, local_header(path)["count"], RECORDS)] or [Range("", 0, 0)]

    def read(self, part):
        if not part.count:
            return
        head = local_header(part.path)
        size = np.dtype(head["properties"]).itemsize
        with open(part.path, "rb") as f:
            f.seek(head["body"] + part.first * size)
            batch = self.bounds.kept(points(f.read(part.count * size), head, part.first))
        yield batch.append_column("file", pa.array([os.path.basename(part.path)] * len(batch))) if os.path.isdir(self.path) else batch


class PlySource(DataSource):
    @classmethod
    def name(cls):
        return "ply_points"

    def schema(self):
        path = self.options["path"]
        return schema_of(local_header(files_at(path, ".ply")[0])) + (", file string" if os.path.isdir(path) else "")

    def reader(self, schema):
        return PlyReader(self.options)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """pid and every vertex property as double, from one file, or from all binary files of a folder, which have
    the same properties, with `file` then. ASCII bodies are read by lines, in parts. Of
    binary ones, a path that open() takes on every executor is read by ranges of records; any other by
    Spark's reader of binary files, in one task and up to 2 GB."""
    own = local_path(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if own is not None and os.path.isdir(own):
        spark.dataSource.register(PlySource)
        return spark.read.format("ply_points").option("path", own).load()
    head = header(first_bytes(spark, path, HEADER), path)
    if head["format"] == "ascii":
        lines = numbered_lines(spark, path, "line")
        nth, parts = F.col("line") - head["lines"], F.split(F.trim("value"), r"\s+")
        return lines.where((nth >= 0) & (nth < head["count"])).select(nth.alias("pid"), *[parts[i].cast("double").alias(n) for i, (n, _) in enumerate(head["properties"])])
    if own is not None:
        spark.dataSource.register(PlySource)
        return spark.read.format("ply_points").option("path", own).load()
    size = np.dtype(head["properties"]).itemsize

    def decoded(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                for a in range(0, head["count"], RECORDS):
                    begin = head["body"] + a * size
                    yield points(data[begin : begin + min(RECORDS, head["count"] - a) * size], head, a)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decoded, schema_of(head))


def _colored(df: DataFrame) -> bool:
    return all(c in df.columns for c in "rgb")


def _coordinates(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double") for c in [*"xyz", *("rgb" if _colored(df) else "")]])


def file_head(count: int, color: bool) -> bytes:
    names = [f"property double {c}" for c in "xyz"] + ["property uchar " + c for c in ("red", "green", "blue")] * color
    return "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {count}", *names, "end_header", ""]).encode("ascii")


def records(batch: pa.RecordBatch, color: bool) -> bytes:
    rec = np.zeros(len(batch), np.dtype([(c, "<f8") for c in "xyz"] + [(c, "u1") for c in ("red", "green", "blue")] * color))
    for c in "xyz":
        rec[c] = batch.column(c).to_numpy(zero_copy_only=False)
    for c, name in zip("rgb", ("red", "green", "blue"), strict=True):
        if color:
            rec[name] = np.clip(np.floor(batch.column(c).to_numpy(zero_copy_only=False) * 255 + 0.5), 0, 255)
    return rec.tobytes()


def write_ply(df: DataFrame, path: str) -> int:
    """One binary little-endian PLY file of x, y, z (double) and, where there are any, colours (uchar), in the
    order of pid. Where executors can open() the path, each writes its records in their places. A path that
    only Hadoop writes gets its blocks from the driver, one after the other; for large clouds there:
    write_ply_parts."""
    color, own, spark = _colored(df), local_path(path), df.sparkSession
    if own is None:

        def pack(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([records(batch, color)], pa.binary())], names=["block"])

        n = df.count()
        ordered = _coordinates(df.orderBy("pid") if "pid" in df.columns else df).mapInArrow(pack, "block binary")
        blocks = (r["block"] for r in ordered.toLocalIterator())
        write_blocks(spark, path, (b for part in ([file_head(n, color)], blocks) for b in part))
        return n
    key = df if "pid" in df.columns else df.withColumn("pid", F.monotonically_increasing_id())
    placed = with_pid(key.select("pid", *_coordinates(df).columns), "pid", name="nth")
    placed = placed.select("nth", *[F.col(c).cast("double") for c in placed.columns if c not in ("pid", "nth")])
    width = 24 + 3 * color
    step = BYTES // width

    def place(batches):
        for batch in batches:
            nth, data = batch.column("nth").to_numpy(), records(batch, color)
            edges = [0, *(np.flatnonzero(np.diff(nth) != 1) + 1).tolist(), len(nth)]
            runs = [(at, min(b, at + step)) for a, b in zip(edges, edges[1:]) for at in range(a, b, step)]
            yield pa.RecordBatch.from_arrays([pa.array([int(nth[a]) * width for a, _ in runs], pa.int64()), pa.array([data[a * width : b * width] for a, b in runs], pa.binary())], names=["offset", "data"])

    n = placed.count()
    write_at(placed.mapInArrow(place, "offset long, data binary"), own, file_head(n, color), n * width)
    return n


def write_ply_parts(df: DataFrame, folder: str) -> DataFrame:
    """(file, points): a whole PLY file for each partition, written by the executors into a folder that
    open() takes on all of them. A file gets its name once it is whole, so a repeated task replaces it."""
    color, own = _colored(df), local_path(folder)
    if own is None:
        raise ValueError("executors write parts with open(); give a folder that they share")

    def write(batches):
        name = f"part-{TaskContext.get().partitionId():05d}.ply"
        os.makedirs(own, exist_ok=True)
        body, count, draft = f"{own}/.{name}-{uuid.uuid4().hex}", 0, f"{own}/.{name}-{uuid.uuid4().hex}"
        with open(body, "wb") as f:
            for batch in batches:
                f.write(records(batch, color))
                count += len(batch)
        with open(draft, "wb") as f, open(body, "rb") as g:
            f.write(file_head(count, color))
            while block := g.read(1 << 24):
                f.write(block)
        os.replace(draft, f"{own}/{name}")
        os.remove(body)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], names=["file", "points"])

    written = _coordinates(df).mapInArrow(write, "file string, points long").collect()  # a row for each partition
    return df.sparkSession.createDataFrame(written, "file string, points long")
