"""Planes: RANSAC as one set-based job, binary segmentation, repeated and refined loops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspring.cloud import with_pid
from voxelspring.functions import unit_plane_distance
from voxelspring.operators.blocks import block_arrays, finite, packed
from voxelspring.operators.cluster import dbscan
from voxelspring.operators.neighbors import mean_spacing
from voxelspring.storage import drop_stored, stored

PLANE = ("a", "b", "c", "d")
PLANES = "it long, a double, b double, c double, d double"
SIDES = [f"{s}_{c}" for c in "xyz" for s in ("low", "high")]
#: Points times planes in one product.
TOGETHER = 2_000_000
#: Points of a cloud whose planes are scored without an index.
SMALL = 50_000


def draws(n: int, iterations: int) -> np.ndarray:
    """(iterations, 4): the iteration, from 1, and the ranks of three different points of n, by a fixed
    rule; draws of the same point are left out."""
    i = np.arange(1, iterations + 1, dtype=np.int64)
    s1 = (i * 7919 + 13) % n
    s2 = (s1 + 1 + (i * 104729 + 17) % (n - 1)) % n
    s3 = (i * 1299709 + 29) % n
    return np.column_stack([i, s1, s2, s3])[(s3 != s1) & (s3 != s2)]


def points_at(df: DataFrame, n: int, low: int, high: int, ranks: list[int], most: int) -> dict[int, tuple]:
    """The points at some ranks of pid: by pid itself where it is dense, else by numbers given to all; no
    more than `most` points are fetched and sorted as they are."""
    if n <= most:
        rows = sorted(map(tuple, df.select("pid", "x", "y", "z").where("pid IS NOT NULL").collect()), key=lambda r: r[0])
        return {r: rows[r][1:] for r in ranks}
    if high - low + 1 == n:
        ranked = df.select((F.col("pid") - low).alias("rn"), "x", "y", "z")
    else:
        ranked = with_pid(df.select("pid", "x", "y", "z"), "pid", name="rn")
    wanted = df.sparkSession.createDataFrame([(r,) for r in ranks], "rn long")
    return {r["rn"]: (r["x"], r["y"], r["z"]) for r in ranked.join(F.broadcast(wanted), "rn").collect()}


def drawn_planes(df: DataFrame, iterations: int) -> list[tuple]:
    """Rows of PLANES through three points drawn by rank of pid; triples without area are left out. At
    most three points for each iteration reach the driver."""
    size = df.agg(F.count("pid").alias("n"), F.min("pid").alias("low"), F.max("pid").alias("high")).first()
    found = []
    if size["n"] >= 3:
        drawn = draws(size["n"], iterations)
        at = points_at(df, *size, sorted({int(r) for r in drawn[:, 1:].reshape(-1)}), 3 * iterations)
        for it, *ranks in drawn.tolist():
            (px, py, pz), (qx, qy, qz), (sx, sy, sz) = (at[r] for r in ranks)
            nx = (qy - py) * (sz - pz) - (qz - pz) * (sy - py)
            ny = (qz - pz) * (sx - px) - (qx - px) * (sz - pz)
            nz = (qx - px) * (sy - py) - (qy - py) * (sx - px)
            length = (nx * nx + ny * ny + nz * nz) ** 0.5
            if length > 0:
                a, b, c = nx / length, ny / length, nz / length
                found.append((it, a, b, c, -(a * px + b * py + c * pz)))
    return found


def hypotheses(df: DataFrame, iterations: int = 1000) -> DataFrame:
    """PLANES: the unit planes that RANSAC scores."""
    return df.sparkSession.createDataFrame(drawn_planes(df, iterations), PLANES)


def _counts(df: DataFrame, planes: list[tuple], threshold: float) -> DataFrame:
    """(at, n): the points within the threshold by place in a list of planes. The planes, of which there
    are as many as iterations, go to the tasks; each counts its points in one pass and hands on one row."""
    own = np.array([r[1:] for r in planes], dtype=np.float64).reshape(-1, 4)

    def count(batches):
        total = np.zeros(len(own), np.int64)
        step = max(1, TOGETHER // max(1, len(own)))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"])
            for at in range(0, len(x), step):
                total += (np.abs(x[at : at + step] @ own[:, :3].T + own[:, 3]) <= threshold).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["counts"])

    parts = df.select(*[F.col(c).cast("double") for c in "xyz"]).mapInArrow(count, "counts array<long>")
    return parts.select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))


def _add_blocks(batch: pa.RecordBatch, own: np.ndarray, threshold: float, total: np.ndarray, evaluated: np.ndarray) -> None:
    """Add the points of some blocks that lie within the threshold of each plane, and those compared. The
    intervals of all these blocks and planes are in memory at once."""
    n = batch.column("n").to_numpy()
    box = np.column_stack([batch.column(s).to_numpy() for s in SIDES]).reshape(-1, 3, 2)
    middle, half = box.mean(axis=2), (box[:, :, 1] - box[:, :, 0]) / 2
    distance = np.abs(middle @ own[:, :3].T + own[:, 3])
    reach = half @ np.abs(own[:, :3]).T
    room = 1e-9 * (np.abs(middle).max(initial=0.0) + reach + np.abs(own[:, 3]) + threshold)
    inside = distance + reach + room <= threshold
    total += n @ inside
    cut = ~inside & (distance - reach - room <= threshold)
    for i, values in enumerate(block_arrays(batch, ("x", "y", "z"))):
        some = np.flatnonzero(cut[i])
        if len(some):
            near = np.abs(np.column_stack(values) @ own[some, :3].T + own[some, 3]) <= threshold
            total[some] += near.sum(axis=0)
            evaluated[some] += n[i]


def _counts_of_blocks(blocks: DataFrame, planes: list[tuple], threshold: float) -> DataFrame:
    """As _counts, over a block index, with the points compared (evaluated). Over a box a plane's distance
    lies in an interval about that of the middle; where the interval decides, all points of the block count
    or none does, and only planes that cut the slab's edge within the box meet its points."""
    own = np.array([r[1:] for r in planes], dtype=np.float64).reshape(-1, 4)

    def count(batches):
        total, evaluated = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        step = max(1, TOGETHER // 8 // max(1, len(own)))
        for batch in batches:
            for at in range(0, len(batch), step):
                _add_blocks(batch.slice(at, step), own, threshold, total, evaluated)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([total], kind), pa.array([evaluated], kind)], names=["counts", "evaluated"])

    parts = blocks.select("n", *SIDES, "points").mapInArrow(count, "counts array<long>, evaluated array<long>")
    each = parts.select(F.posexplode(F.arrays_zip("counts", "evaluated")).alias("at", "of"))
    return each.groupBy("at").agg(F.sum("of.counts").alias("n"), F.sum("of.evaluated").alias("evaluated"))


def share_evaluated(blocks: DataFrame, planes: DataFrame, threshold: float) -> float:
    """The share of all pairs of a point and a plane that scoring over the blocks compares."""
    rows = [tuple(r) for r in planes.select("it", *PLANE).collect()]
    pairs = len(rows) * (blocks.agg(F.sum("n")).first()[0] or 0)
    return (_counts_of_blocks(blocks, rows, threshold).agg(F.sum("evaluated")).first()[0] or 0) / pairs if pairs else 0.0


def score(df: DataFrame, planes: DataFrame, threshold: float) -> DataFrame:
    """planes with n, the points within the threshold."""
    rows = [tuple(r) for r in planes.select("it", *PLANE).collect()]
    sums = _counts(df, rows, threshold)
    listed = df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"at int, {PLANES}")
    return listed.join(F.broadcast(sums), "at", "left").select("it", *PLANE, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def threshold_of(df: DataFrame, threshold: float | str) -> float:
    """The threshold, or for "auto" the mean distance to the seven nearest points."""
    return float(mean_spacing(df, 8).first()["spacing"] or 0.0) if threshold == "auto" else float(threshold)


def refitted(df: DataFrame, plane: tuple, threshold: float) -> tuple:
    """The least-squares plane of the points within the threshold: through their mean, normal to their
    least spread; the plane itself where they don't span one."""
    near = with_inliers(df, plane, threshold).where("is_inlier")
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    r = near.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "xyz"], *[F.covar_pop(p[0], p[1]).alias(p) for p in pairs]).first()
    if r["n"] < 3:
        return plane
    xx, xy, xz, yy, yz, zz = (r[p] for p in pairs)
    values, vectors = np.linalg.eigh(np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]))
    if values[1] <= 0:
        return plane
    normal = vectors[:, 0] * (1.0 if vectors[:, 0] @ np.array(plane[:3]) >= 0 else -1.0)
    return (*normal.tolist(), -float(normal @ np.array([r["x"], r["y"], r["z"]])))


def best_plane(df: DataFrame, limit: float, iterations: int, refit: bool = False, blocks: DataFrame | None = None) -> tuple | None:
    """A row of PLANES with n: the plane with the most inliers, of equal ones the earliest; with refit,
    the least-squares plane of its inliers and their number. None for a degenerate cloud. blocks: a block
    index of df, over which planes are scored."""
    planes = drawn_planes(df, iterations)
    scored = _counts(df, planes, limit) if blocks is None else _counts_of_blocks(blocks, planes, limit)
    found = {r["at"]: r["n"] for r in scored.collect()} if planes else {}
    n, at = max(((n, -at) for at, n in found.items()), default=(0, 0))
    if not n:
        return None
    best = planes[-at]
    if not refit:
        return (*best, n)
    best = (best[0], *refitted(df, best[1:], limit))
    return (*best, _counts(df, [best], limit).first()["n"])


def ransac_plane(df: DataFrame, threshold: float | str = 0.05, iterations: int = 1000, refit: bool = False, blocks: DataFrame | None = None) -> DataFrame:
    """(it, a, b, c, d, n): the best plane; no row for a degenerate cloud. blocks: a block index of df."""
    best = best_plane(df, threshold_of(df, threshold), iterations, refit, blocks)
    return df.sparkSession.createDataFrame([] if best is None else [best], f"{PLANES}, n long")


def with_inliers(df: DataFrame, plane: tuple[float, float, float, float], threshold: float) -> DataFrame:
    """df with is_inlier for a unit plane; a distance equal to the threshold counts."""
    distance = unit_plane_distance(tuple(map(F.col, "xyz")), tuple(map(F.lit, plane)))
    return df.withColumn("is_inlier", F.coalesce(F.abs(distance) <= threshold, F.lit(False)))


def _sides(plane: tuple[float, float, float, float], threshold: float):
    """Conditions on a point of a block: within the threshold of a unit plane, and not."""
    at = tuple(map(F.lit, plane))

    def near(p):
        return F.abs(unit_plane_distance((p["x"], p["y"], p["z"]), at)) <= threshold

    return near, lambda p: ~near(p)


def segment(df: DataFrame, threshold: float | str = 0.05, iterations: int = 1000, refit: bool = False) -> DataFrame:
    """df with is_inlier for its best plane; all false if there is none."""
    limit = threshold_of(df, threshold)
    best = best_plane(df, limit, iterations, refit)
    return df.withColumn("is_inlier", F.lit(False)) if best is None else with_inliers(df, best[1:5], limit)


def multi_plane(df: DataFrame, planes: int = 10, threshold: float = 0.01, iterations: int = 1000, refit: bool = False) -> tuple[DataFrame, DataFrame]:
    """(models, points): up to `planes` planes, each fitted to what those before it left; points have
    `segment`, -1 for the rest. Points with a missing coordinate are rest. A cloud beyond SMALL is indexed
    once; each round takes its inliers out of the blocks and stores what is left of them."""
    models, done, rest, blocks = [], None, finite(df), None
    odd = df.where(" OR ".join(f"{c} IS NULL OR isnan({c})" for c in "xyz")).withColumn("segment", F.lit(-1))
    if df.count() > SMALL:
        blocks = packed(rest)
        rest = blocks.select(F.inline("points"))
    for i in range(planes):
        best = best_plane(rest, threshold, iterations, refit, blocks)
        if best is None:
            break
        models.append((i, *best[1:]))
        if blocks is None:
            split = stored(with_inliers(rest, models[-1][1:5], threshold))
            own, rest = split.where("is_inlier").drop("is_inlier"), split.where("NOT is_inlier").drop("is_inlier")
        else:
            near, far = _sides(models[-1][1:5], threshold)
            own = blocks.select(F.inline(F.filter("points", near)))
            left = blocks.withColumn("points", F.filter("points", far)).withColumn("n", F.size("points").cast("long"))
            blocks = stored(left.where("n > 0"))
            rest = blocks.select(F.inline("points"))
        own = own.withColumn("segment", F.lit(i))
        done = own if done is None else done.unionByName(own)
    rest = rest.withColumn("segment", F.lit(-1))
    out = rest if done is None else done.unionByName(rest)
    found = df.sparkSession.createDataFrame(models, "segment int, a double, b double, c double, d double, n long")
    return found, out.unionByName(odd).select(*df.columns, "segment")


def refined_planes(
    df: DataFrame,
    planes: int = 20,
    threshold: float = 0.01,
    iterations: int = 1000,
    eps: float | None = None,
    min_points: int = 10,
    exclude_noise: bool = False,
) -> DataFrame:
    """points with `segment`: each round clusters the best plane's inliers by density and keeps the
    largest cluster (noise counts as one unless excluded); the other inliers go back to the pool.
    eps defaults to ten thresholds."""
    eps = 10 * threshold if eps is None else eps
    done, rest = None, df
    for i in range(planes):
        best = best_plane(rest, threshold, iterations)
        if best is None:
            break
        split = stored(with_inliers(rest, best[1:5], threshold))
        inliers = split.where("is_inlier").drop("is_inlier")
        labels = stored(dbscan(inliers, eps, min_points))
        sizes = labels.where("label >= 0") if exclude_noise else labels
        top = sizes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").first()
        kept = labels.where(F.col("label") == (top["label"] if top else -2)).select("pid")
        own = stored(inliers.join(kept, "pid", "left_semi").withColumn("segment", F.lit(i)))
        done = own if done is None else done.unionByName(own)
        rest = stored(split.drop("is_inlier").join(kept, "pid", "left_anti"))
        drop_stored(split, labels)
    rest = rest.withColumn("segment", F.lit(-1))
    return rest if done is None else done.unionByName(rest)
