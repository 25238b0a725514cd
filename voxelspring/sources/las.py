"""LAS point files, read by ranges of records."""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from voxelspring.sources.files import Bounds, Range, files_at, local_path, ranges

SCHEMA = "pid long, x double, y double, z double, red int, green int, blue int, intensity int, classification int"
#: Offset of the colours in a record of each point format; formats without colours give nulls.
COLOR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
RECORDS = 1_000_000
HEADER = 375


def header(head: bytes, path: str) -> dict:
    """What the first HEADER bytes of a file tell."""
    if head[:4] != b"LASF":
        raise ValueError(f"{path} is no LAS file")
    minor = head[25]
    offset, _, fmt, size, count = struct.unpack_from("<IIBHI", head, 96)
    if minor >= 4 and not count:
        (count,) = struct.unpack_from("<Q", head, 247)
    if fmt & 0x80:
        raise ValueError(f"{path} is compressed")
    scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    high_low = struct.unpack_from("<6d", head, 179)
    box = {c: (high_low[2 * i + 1], high_low[2 * i]) for i, c in enumerate("xyz")}
    # a writer may leave the box empty, or round it to the steps of the coordinates
    whole = {c: (-float("inf"), float("inf")) for c in "xyz"}
    box = {c: (a - s, b + s) for (c, (a, b)), s in zip(box.items(), map(abs, scale), strict=True)} if any(high_low) else whole
    return {"offset": offset, "format": fmt & 0x3F, "size": size, "count": count, "scale": scale, "shift": shift, "box": box}


def local_header(path: str) -> dict:
    with open(path, "rb") as f:
        return header(f.read(HEADER), path)


def points(data: bytes, head: dict, first: int) -> pa.RecordBatch:
    """The records in data, the first of which has the number `first`."""
    fmt, kinds = head["format"], [("xyz", ("<i4", 3), 0), ("intensity", "<u2", 12), ("cls", "u1", 16 if head["format"] >= 6 else 15)]
    if fmt in COLOR_AT:
        kinds.append(("rgb", ("<u2", 3), COLOR_AT[fmt]))
    names, formats, offsets = zip(*kinds, strict=True)
    rec = np.frombuffer(data, np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": head["size"]}))
    xyz = rec["xyz"] * np.array(head["scale"]) + np.array(head["shift"])
    rgb = [pa.array(rec["rgb"][:, i].astype(np.int32)) for i in range(3)] if fmt in COLOR_AT else [pa.nulls(len(rec), pa.int32())] * 3
    cls = rec["cls"] if fmt >= 6 else rec["cls"] & 31
    columns = [pa.array(np.arange(first, first + len(rec))), *(pa.array(xyz[:, i]) for i in range(3)), *rgb]
    columns += [pa.array(rec["intensity"].astype(np.int32)), pa.array(cls.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class LasReader(DataSourceReader):
    """The records of one file or of all in a folder; files whose box no filter's range meets aren't read,
    and records outside the ranges aren't handed on."""

    def __init__(self, options):
        self.path, self.bounds, self.many = options["path"], Bounds(), options.get("many") == "true"

    def pushFilters(self, filters):
        self.bounds.take(filters)
        return filters  # Spark decides on each row

    def partitions(self):
        out = []
        for path in files_at(self.path, ".las"):
            head = local_header(path)
            if self.bounds.meets(head["box"]):
                out += ranges(path, head["count"], RECORDS)
        return out or [Range("", 0, 0)]

    def read(self, part):
        if not part.count:
            return
        head = local_header(part.path)
        with open(part.path, "rb") as f:
            f.seek(head["offset"] + part.first * head["size"])
            batch = self.bounds.kept(points(f.read(part.count * head["size"]), head, part.first))
        yield batch.append_column("file", pa.array([os.path.basename(part.path)] * len(batch))) if self.many else batch


class LasSource(DataSource):
    @classmethod
    def name(cls):
        return "las_points"

    def schema(self):
        return SCHEMA + (", file string" if self.options.get("many") == "true" else "")

    def reader(self, schema):
        return LasReader(self.options)


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """Scaled coordinates and 16-bit colours of one file, or of all files of a folder, with `file` then; pid is
    a record's place in its file. A path that open() takes on every executor is read by ranges of records,
    and filters on x, y and z leave files out by the boxes of their headers; any other path, one file, by
    Spark's reader of binary files, in one task and up to 2 GB."""
    own = local_path(path)
    if own is not None:
        spark.dataSource.register(LasSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        return spark.read.format("las_points").option("path", own).option("many", str(os.path.isdir(own)).lower()).load()

    def decoded(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                head = header(data[:HEADER], path)
                for a in range(0, head["count"], RECORDS):
                    begin = head["offset"] + a * head["size"]
                    yield points(data[begin : begin + min(RECORDS, head["count"] - a) * head["size"]], head, a)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decoded, SCHEMA)
