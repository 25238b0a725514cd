"""A block index over a cloud: points along a Z-order curve, cut into blocks of a bounded number of points
whatever their density, with the box of each block, and boxes of runs of blocks above them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspring.cloud import XYZ, with_pid
from voxelspring.storage import drop_stored, stored

#: Points of a block, and blocks or nodes of the node above them.
SIZE, FAN = 256, 64


def finite(df: DataFrame, columns: tuple[str, ...] = XYZ) -> DataFrame:
    return df.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in columns))


def z_key(columns: tuple[str, ...], low: list[float], high: list[float]) -> Column:
    """Bits of the columns' places in their ranges, taken in turns from the highest."""
    bits, key = 63 // len(columns), F.lit(0).cast("long")
    for i, (c, a, b) in enumerate(zip(columns, low, high, strict=True)):
        steps = F.lit(0.0) if b <= a else (F.col(c) - a) / ((b - a) or 1.0) * float(1 << bits)
        place = F.least(F.floor(steps), F.lit((1 << bits) - 1)).cast("long")
        for bit in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(place, bit).bitwiseAND(1), bit * len(columns) + len(columns) - 1 - i))
    return key


def in_z_order(df: DataFrame, size: int, columns: tuple[str, ...] = XYZ) -> DataFrame:
    """df with the number of its block; points are ordered along the curve and then by pid, and numbered
    by ranges, so a block holds `size` points even where all are equal."""
    found = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()
    low, high = ([found[f"{f}_{c}"] or 0.0 for c in columns] for f in ("min", "max"))
    numbered = with_pid(df.withColumn("__z", z_key(columns, low, high)), "__z", "pid", name="__nth", kept=df.columns)
    return numbered.withColumn("block", F.floor(F.col("__nth") / size)).drop("__nth")


#: Bytes of a row group of a cloud in Z-order, about 30,000 points without attributes.
ROW_GROUP = 1 << 20


def z_ordered(df: DataFrame, columns: tuple[str, ...] = XYZ) -> DataFrame:
    """df stored along the curve, so that a row group has a small box and filters on the columns skip most."""
    ordered = in_z_order(df, SIZE, columns)
    out = stored(ordered, ROW_GROUP)
    drop_stored(ordered)  # the numbered table, a second copy of the cloud
    return out


def boxes_of(columns: tuple[str, ...] = XYZ) -> list[Column]:
    return [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("low", F.min), ("high", F.max))]


def packed(df: DataFrame, size: int = SIZE, columns: tuple[str, ...] = XYZ, whole: bool = False) -> DataFrame:
    """(block, n, low_*, high_*, points): a stored row for each block, its points by pid. whole: the cloud is
    known to fit in one block. A cloud that has blocks, as from z_ordered(), keeps them."""
    own = df if "block" in df.columns else df.withColumn("block", F.lit(0).cast("long")) if whole else in_z_order(df, size, columns)
    points = F.sort_array(F.collect_list(F.struct(*[c for c in own.columns if c != "block"]))).alias("points")
    out = stored(own.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *boxes_of(columns), points))
    if "block" not in df.columns and not whole:
        drop_stored(own)
    return out


def levels(blocks: DataFrame, columns: tuple[str, ...] = XYZ) -> list[DataFrame]:
    """Stored boxes (node, up, n, low_*, high_*) of the blocks and of the nodes above them, up to one root;
    up: the number of the node above. Nodes are runs of the curve, so near ones are together."""
    sides = [f"{s}_{c}" for c in columns for s in ("low", "high")]
    up = F.floor(F.col("node") / FAN).alias("up")
    out = [stored(blocks.select(F.col("block").alias("node"), "n", *sides).select("node", up, "n", *sides))]
    last = out[0].agg(F.max("node")).first()[0] or 0
    while last:
        merged = [(F.min if s.startswith("low") else F.max)(s).alias(s) for s in sides]
        above = out[-1].groupBy(F.col("up").alias("node")).agg(F.sum("n").alias("n"), *merged)
        out.append(stored(above.select("node", up, "n", *sides)))
        last //= FAN
    return out


def ancestor(block: Column, level: int) -> Column:
    """The number of the node above a block, so many levels up."""
    return F.floor(block / FAN**level)


def gap2(columns: tuple[str, ...] = XYZ, other: str = "q") -> Column:
    """The squared distance between a box and the box with names prefixed by `other`."""
    total = F.lit(0.0)
    for c in columns:
        gap = F.greatest(F.lit(0.0), F.col(f"{other}low_{c}") - F.col(f"high_{c}"), F.col(f"low_{c}") - F.col(f"{other}high_{c}"))
        total = total + gap * gap
    return total


def reach2(columns: tuple[str, ...] = XYZ, other: str = "q") -> Column:
    """The squared distance between the farthest points of the two boxes."""
    total = F.lit(0.0)
    for c in columns:
        far = F.greatest(F.col(f"high_{c}"), F.col(f"{other}high_{c}")) - F.least(F.col(f"low_{c}"), F.col(f"{other}low_{c}"))
        total = total + far * far
    return total


def block_arrays(batch: pa.RecordBatch, names: tuple[str, ...]):
    """For each block of a batch, or of a slice of one, the named fields of its points, as arrays. The fields of
    no more blocks than the batch has are in memory."""
    column = batch.column("points")
    offsets = column.offsets.to_numpy()
    first = int(offsets[0]) if len(offsets) else 0
    values, offsets = column.values.slice(first, int(offsets[-1]) - first if len(offsets) else 0), offsets - first
    # field() of a slice is that of the whole array
    fields = [values.field(values.type.get_field_index(n)) for n in names]
    fields = [(f if len(f) == len(values) else f.slice(values.offset, len(values))).to_numpy(zero_copy_only=False) for f in fields]
    for a, b in zip(offsets, offsets[1:]):
        yield tuple(f[a:b] for f in fields)


def distances2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, summed axis by axis as expressions do."""
    total = (a[:, None, 0] - b[None, :, 0]) ** 2
    for i in range(1, a.shape[1]):
        total += (a[:, None, i] - b[None, :, i]) ** 2
    return total
