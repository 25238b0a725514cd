"""Spatial joins: radius pairs by grid cells, nearest neighbours and hybrid search over a block index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspring.cloud import XYZ, squared_distance
from voxelspring.operators.blocks import SIZE, ancestor, block_arrays, distances2, finite, gap2, levels, packed, reach2
from voxelspring.storage import drop_stored, stored

CELL = ("i", "j", "k")
#: Places of a cloud so small that it is one block.
SMALL = 4096
#: Distances of one product.
TOGETHER = 1_000_000
#: Room for rounding in comparisons of bounds.
SLACK = 1e-9
#: Nodes that a ball meets at most, on average, in a table of balls and nodes.
REACH = 64


def with_cell(df: DataFrame, size: float, names: tuple[str, ...] = CELL) -> DataFrame:
    return df.withColumns({n: F.floor(F.col(c) / F.lit(float(size))).cast("long") for n, c in zip(names, XYZ, strict=True)})


def around(df: DataFrame, rings: int = 1, names: tuple[str, ...] = CELL) -> DataFrame:
    """A row for each cell up to `rings` away."""
    for n in names:
        df = df.withColumn(n, F.explode(F.sequence(F.col(n) - rings, F.col(n) + rings)))
    return df


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"a{c}" for c in XYZ})


def _d2():
    return squared_distance(tuple(F.col(f"a{c}") for c in XYZ), tuple(map(F.col, XYZ)))


def radius_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(a, b, d2): all points b of `right` within the radius of a point a of `left`, itself included
    where both hold it. Points meet in grid cells as wide as the radius: an equi-join, no pairs
    beyond neighbouring cells."""
    a = _renamed(around(with_cell(left.select(F.col("pid").alias("a"), *XYZ), radius)))
    b = with_cell(right.select(F.col("pid").alias("b"), *XYZ), radius)
    return a.join(b, [*CELL]).withColumn("d2", _d2()).where(F.col("d2") <= radius * radius).select("a", "b", "d2")


def smallest(d2: np.ndarray, pids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest (d2, pid) of each row in order; what a row lacks is infinite."""
    if d2.shape[1] > k:
        near = d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
    else:
        near = np.ones(d2.shape, bool)
    row, column = np.nonzero(near & np.isfinite(d2))
    order = np.lexsort((pids[row, column], d2[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, column, rank = (x[rank < k] for x in (row, column, rank))
    out, of = np.full((len(d2), k), np.inf), np.zeros((len(d2), k), np.int64)
    out[row, rank], of[row, rank] = d2[row, column], pids[row, column]
    return out, of


def _best(asked: np.ndarray, at: np.ndarray, pids: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """smallest() for points against a block, some rows at a time."""
    step = max(1, TOGETHER // max(1, len(at)))
    parts = []
    for i in range(0, len(asked), step):
        d2 = distances2(asked[i : i + step], at)
        d2[d2 > limit] = np.inf
        parts.append(smallest(d2, np.broadcast_to(pids, d2.shape), k))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _ranked(a: np.ndarray, d2: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    row, rank = np.nonzero(np.isfinite(d2))
    return pa.RecordBatch.from_arrays([pa.array(a[row]), pa.array(b[row, rank]), pa.array(d2[row, rank]), pa.array((rank + 1).astype(np.int32))], names=["a", "b", "d2", "rank"])


POINT = ("pid", *XYZ, "asked")
SIDES = [f"{s}_{c}" for c in XYZ for s in ("low", "high")]
GROUP = "gid long, tau2 double, " + ", ".join(f"q{s} double" for s in SIDES) + ", pids binary, at binary"
FOUND = "a long, b long, d2 double, rank int"


def _within_blocks(blocks: DataFrame, k: int, limit: float) -> DataFrame:
    """FOUND where all points are in one block."""

    def run(batches):
        for batch in batches:
            for pid, x, y, z, asked in block_arrays(batch, POINT):
                at, asked = np.column_stack([x, y, z]), asked.astype(bool)
                if asked.any():
                    yield _ranked(pid[asked], *_best(at[asked], at, pid, k, limit))

    return blocks.select("points").mapInArrow(run, FOUND)


def _groups(blocks: DataFrame, k: int, limit: float) -> DataFrame:
    """Points of a block that see about as far: by the power of 4 of the squared distance to the k-th nearest in their own
    block, an upper bound. Of each group the largest such bound, the box and the points."""

    def run(batches):
        for batch in batches:
            out = []
            for block, (pid, x, y, z, asked) in zip(batch.column("block").to_pylist(), block_arrays(batch, POINT), strict=True):
                at, asked = np.column_stack([x, y, z]), asked.astype(bool)
                if not asked.any():
                    continue
                own, of = at[asked], pid[asked]
                far = np.minimum(_best(own, at, pid, k, limit)[0][:, -1], limit)
                kind = np.where(np.isfinite(far), np.frexp(np.where(np.isfinite(far), far, 1.0))[1] // 2, 1000)
                for c in np.unique(kind):
                    m = kind == c
                    box = [v for i in range(3) for v in (own[m, i].min(), own[m, i].max())]
                    out.append((block * 2048 + int(c) + 1024, far[m].max(), *box, of[m].tobytes(), own[m].tobytes()))
            if out:
                kinds = [pa.int64(), *[pa.float64()] * 7, pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in GROUP.split(", ")])

    return stored(blocks.select("block", "points").mapInArrow(run, GROUP))


def _open_blocks(groups: DataFrame, boxes: list[DataFrame], k: int) -> DataFrame:
    """(gid, bound, box of the group, node, lb2): the blocks that may hold one of the k nearest of a group's
    points, found from the root down. A node stays if it is no farther than the group's bound; a node of k
    points or more bounds it by its farthest corner, unless k is 0."""
    front = groups.drop("pids", "at").withColumn("node", F.lit(0).cast("long")).withColumn("lb2", F.lit(0.0))
    names = front.columns
    if len(boxes) == 1:
        root = boxes[0].select("node", *SIDES)
        return stored(front.drop("lb2").join(root, "node").withColumn("lb2", gap2()).where(F.col("lb2") <= F.col("tau2") * (1 + SLACK)).select(*names))
    for level in reversed(boxes[:-1]):
        below = level.select(F.col("node").alias("child"), F.col("up").alias("node"), "n", *SIDES)
        met = front.drop("lb2").join(below, "node").withColumn("lb2", gap2()).where(F.col("lb2") <= F.col("tau2") * (1 + SLACK))
        if k:
            far = F.min(F.when(F.col("n") >= k, reach2())).over(Window.partitionBy("gid"))
            met = met.withColumn("tau2", F.least(F.col("tau2"), far))
        front = stored(met.where(F.col("lb2") <= F.col("tau2") * (1 + SLACK)).withColumn("node", F.col("child")).select(*names))
    return front


def _halos(front: DataFrame, blocks: DataFrame) -> DataFrame:
    """(gid, lb2, pids, at): of each open block the points that are near enough to the group's box."""
    sides = [f"q{s}" for s in SIDES]

    def run(batches):
        for batch in batches:
            tau2 = batch.column("tau2").to_numpy()
            box = np.column_stack([batch.column(s).to_numpy() for s in sides]).reshape(-1, 3, 2)
            pids, ats = [], []
            for (pid, x, y, z), t, b in zip(block_arrays(batch, POINT[:4]), tau2, box, strict=True):
                at = np.column_stack([x, y, z])
                gap = np.maximum(0.0, np.maximum(b[:, 0] - at, at - b[:, 1]))
                near = (gap * gap).sum(axis=1) <= t * (1 + SLACK)
                pids.append(pid[near].tobytes())
                ats.append(at[near].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("gid"), batch.column("lb2"), pa.array(pids, pa.binary()), pa.array(ats, pa.binary())], names=["gid", "lb2", "pids", "at"])

    met = front.withColumnRenamed("node", "block").join(blocks.select("block", "points"), "block")
    return met.select("gid", "lb2", "tau2", *sides, "points").mapInArrow(run, "gid long, lb2 double, pids binary, at binary")


def _searched(rows: DataFrame, k: int, limit: float) -> DataFrame:
    """FOUND from rows (gid, lb2, pids, at): a group's own points, with lb2 -1, and then blocks by their lower
    bound, which are passed over once it is above the k-th of every point. A task holds one group."""

    def run(batches):
        gid, pids, at, d2, of = None, None, None, None, None
        for batch in batches:
            for g, lb2, p, q in zip(*(batch.column(c).to_pylist() for c in ("gid", "lb2", "pids", "at")), strict=True):
                p, q = np.frombuffer(p, np.int64), np.frombuffer(q).reshape(-1, 3)
                if lb2 < 0:
                    if gid is not None:
                        yield _ranked(pids, d2, of)
                    gid, pids, at = g, p, q
                    d2, of = np.full((len(p), k), np.inf), np.zeros((len(p), k), np.int64)
                    continue
                if lb2 > d2[:, -1].max() * (1 + SLACK) or not len(p):
                    continue
                more, other = _best(at, q, p, min(k, len(p)), limit)
                d2, of = smallest(np.concatenate([d2, more], axis=1), np.concatenate([of, other], axis=1), k)
        if gid is not None:
            yield _ranked(pids, d2, of)

    return rows.repartition("gid").sortWithinPartitions("gid", "lb2").mapInArrow(run, FOUND)


def _off2() -> Column:
    """The squared distance of a centre (ax, ay, az) to a box."""
    total = F.lit(0.0)
    for c in XYZ:
        gap = F.greatest(F.lit(0.0), F.col(f"low_{c}") - F.col(f"a{c}"), F.col(f"a{c}") - F.col(f"high_{c}"))
        total = total + gap * gap
    return total


def balls(blocks: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """(a, b, d2): the points b of a block index within the radius of each centre a, a table (pid, x, y, z).
    Only blocks whose boxes the balls reach are read.

    Balls go down the boxes as long as they meet REACH nodes of a level on average. From there on they meet the
    blocks of a node where these lie, so what is stored and moved grows with centres and points, however
    many points a ball holds; only the result grows with the pairs."""
    at = [f"a{c}" for c in XYZ]
    near = _off2() <= float(radius) ** 2 * (1 + SLACK)
    front = centers.select(F.col("pid").alias("a"), *[F.col(c).alias(f"a{c}") for c in XYZ], F.lit(0).cast("long").alias("node"))
    most, boxes, kept = REACH * front.count(), levels(blocks), []
    level = len(boxes) - 1
    while level:
        below = boxes[level - 1].select(F.col("up").alias("node"), F.col("node").alias("child"), *SIDES)
        met = front.join(below, "node").where(near).select("a", *at, F.col("child").alias("node"))
        if met.count() > most:
            break
        front, level = stored(met), level - 1
        kept.append(front)
    drop_stored(*kept[:-1], *boxes)
    points = blocks.select(ancestor(F.col("block"), level).alias("node"), *SIDES, "points").join(front, "node").where(near)
    points = points.select("a", *at, F.explode("points").alias("p"))
    points = points.select("a", *at, F.col("p.pid").alias("b"), *[F.col(f"p.{c}").alias(c) for c in XYZ])
    return points.withColumn("d2", _d2()).where(F.col("d2") <= radius * radius).select("a", "b", "d2")


def nearest(df: DataFrame, k: int, radius: float | None = None, asked: Column | None = None) -> DataFrame:
    """(a, b, d2, rank): the k nearest points of each place, itself included, within the radius where one
    is given; ties go to the smaller pid. a: the smallest pid at the place. asked: a condition on the
    points that are asked for, all without it. Points with a missing coordinate take no part.

    Points at the same place are asked for once, and of each place only the k smallest pids can be
    among anyone's k nearest, so many equal points cost no pairs. The others lie in blocks of a bounded
    number of points. The k-th nearest in the own block bounds how far a point looks; a point that sees
    much farther than its neighbours, like an outlier, looks by itself. Blocks are found from the root of
    their boxes down, and searched from the nearest on until the bound is passed.
    """
    pts = finite(df.select("pid", *XYZ, (F.lit(True) if asked is None else asked).alias("asked")))
    first = F.row_number().over(Window.partitionBy(*XYZ).orderBy("pid"))
    few = pts.withColumn("nth", first).where(F.col("nth") <= k).drop("asked")
    if asked is None:
        few = few.withColumn("asked", F.col("nth") == 1)
    else:
        places = pts.where("asked").select(*[F.col(c).alias(f"_{c}") for c in XYZ]).distinct()
        few = few.join(places, [F.col(c) == F.col(f"_{c}") for c in XYZ], "left")
        few = few.withColumn("asked", (F.col("nth") == 1) & F.col("_x").isNotNull())
    few = stored(few.select(*POINT))
    limit = float("inf") if radius is None else radius * radius
    if few.count() <= SMALL:
        return _within_blocks(packed(few, whole=True), k, limit)
    blocks = packed(few, max(SIZE, 2 * k))
    groups = _groups(blocks, k, limit)
    front = _open_blocks(groups, levels(blocks), k)
    own = groups.select("gid", F.lit(-1.0).alias("lb2"), "pids", "at")
    return stored(_searched(own.union(_halos(front, blocks)), k, limit))


def _of_points(df: DataFrame, found: DataFrame, asked: Column | None = None) -> DataFrame:
    """What was found for places, for every point there that is asked for."""
    pts = df.select("pid", *XYZ)
    places = pts.groupBy(*XYZ).agg(F.min("pid").alias("a"))
    return (pts if asked is None else pts.where(asked)).join(places, [*XYZ]).select("pid", "a").join(found, "a")


def hybrid(df: DataFrame, radius: float = 0.1, max_nn: int = 16) -> DataFrame:
    """(a, b, d2, rank): up to max_nn nearest points within the radius, the point's own place included."""
    return _of_points(df, nearest(df, max_nn, radius)).select(F.col("pid").alias("a"), "b", "d2", "rank")


def nearest_points(df: DataFrame, k: int) -> DataFrame:
    """(a, b, d2, rank): the k nearest points of each point, its own place included."""
    return _of_points(df, nearest(df, k)).select(F.col("pid").alias("a"), "b", "d2", "rank")


def knn(df: DataFrame, k: int = 8, asked: Column | None = None) -> DataFrame:
    """(a, b, d2, rank): the k - 1 nearest other points (the point itself is the k-th of k), of all points or of
    those asked for."""
    others = _of_points(df, nearest(df, k, asked=asked), asked).where("pid <> b")
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("d2", "b"))
    return others.withColumn("rank", rank).where(F.col("rank") < k).select(F.col("pid").alias("a"), "b", "d2", "rank")


def mean_spacing(df: DataFrame, k: int = 8) -> DataFrame:
    """Mean distance to the k - 1 nearest others."""
    return knn(df, k).agg(F.avg(F.sqrt("d2")).alias("spacing"))
