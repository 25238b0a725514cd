"""Clustering: DBSCAN by grid join and components, K-Means, within-cluster sums of squares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspring.cloud import XYZ, squared_distance
from voxelspring.operators.blocks import finite
from voxelspring.operators.graph import components, forest
from voxelspring.operators.kmeans import FEW, fitted, labelled
from voxelspring.operators.neighbors import CELL, around, radius_pairs, with_cell
from voxelspring.storage import stored


def _box_gaps(near: bool):
    """The squared distance between two boxes, between their nearest or their farthest points."""
    total = F.lit(0.0)
    for c in XYZ:
        if near:
            gap = F.greatest(F.lit(0.0), F.col(f"low_{c}2") - F.col(f"high_{c}"), F.col(f"low_{c}") - F.col(f"high_{c}2"))
        else:
            gap = F.greatest(F.col(f"high_{c}"), F.col(f"high_{c}2")) - F.least(F.col(f"low_{c}"), F.col(f"low_{c}2"))
        total = total + gap * gap
    return total


def _to_box(side: str):
    """The squared distance of a point to the box of the cell on the given side."""
    total = F.lit(0.0)
    for c in XYZ:
        gap = F.greatest(F.lit(0.0), F.col(f"low_{c}{side}") - F.col(c), F.col(c) - F.col(f"high_{c}{side}"))
        total = total + gap * gap
    return total


def _linked_cells(points: DataFrame, full: DataFrame, eps: float) -> DataFrame:
    """(a, b): nodes of full cells with points within eps of each other. Boxes decide most pairs, then the
    distance of one point of a cell, the nearest to the other's box, to all points there; for what that
    leaves open, the points of both that are near enough to the other's box are compared."""
    other = full.select(*[F.col(c).alias(f"{c}2") for c in full.columns])
    cells = around(full.withColumns({f"{c}2": F.col(c) for c in CELL}), 2, tuple(f"{c}2" for c in CELL))
    pairs = cells.join(other, [f"{c}2" for c in CELL]).where(F.col("node") < F.col("node2")).where(_box_gaps(True) <= eps * eps)
    pairs = stored(pairs.withColumn("sure", _box_gaps(False) <= eps * eps))
    sure = pairs.where("sure").select(F.col("node").alias("a"), F.col("node2").alias("b"))
    unsure = pairs.where("NOT sure")
    if not unsure.limit(1).count():
        return sure
    members = points.select(F.col("node").alias("of"), *XYZ)
    one = unsure.join(members, F.col("node") == F.col("of")).groupBy("node", "node2").agg(F.min_by(F.struct(*XYZ), _to_box("2")).alias("p"))
    apart = squared_distance(tuple(map(F.col, XYZ)), tuple(F.col(f"p.{c}") for c in XYZ))
    met = one.join(members, F.col("node2") == F.col("of")).groupBy("node", "node2").agg(F.min(apart).alias("d2")).where(F.col("d2") <= eps * eps)
    met = stored(met.select("node", "node2"))
    rest = stored(unsure.join(met, ["node", "node2"], "left_anti"))
    if not rest.limit(1).count():
        return sure.union(met)
    left = rest.join(members, F.col("node") == F.col("of")).where(_to_box("2") <= eps * eps)
    right = rest.join(members, F.col("node2") == F.col("of")).where(_to_box("") <= eps * eps)
    left = left.select("node", "node2", *[F.col(c).alias(f"a{c}") for c in XYZ])
    close = squared_distance(tuple(F.col(f"a{c}") for c in XYZ), tuple(map(F.col, XYZ))) <= eps * eps
    late = left.join(right.select("node", "node2", *XYZ), ["node", "node2"]).where(close).select("node", "node2").distinct()
    return sure.union(met).union(late)


def dbscan(df: DataFrame, eps: float = 0.05, min_points: int = 10, dense: bool = False) -> DataFrame:
    """(pid, label): the smallest pid of core points in the cluster, -1 for noise; a border point takes
    the smallest cluster next to it. A point counts among its own neighbours. With dense, clusters
    are numbered from 0 in that order.

    Cells are so small that all points of one are neighbours. A cell with min_points of them is full:
    all are core, and it is one node, however many they are. Only points of other cells, of which
    each has fewer, look for their neighbours one by one.
    """
    size = eps / 3**0.5 * (1 - 1e-9)
    placed = with_cell(df.select("pid", *XYZ), size)
    boxes = [f(c).alias(f"{n}_{c}") for c in XYZ for f, n in ((F.min, "low"), (F.max, "high"))]
    cells = stored(placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.min("pid").alias("node"), *boxes))
    points = stored(placed.join(cells.select(*CELL, F.when(F.col("n") >= min_points, F.col("node")).alias("node")), [*CELL], "left"))
    pairs = stored(radius_pairs(points.where("node IS NULL"), points, eps).select("a", "b"))
    single = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select(F.col("a").alias("pid"))
    core = points.where("node IS NOT NULL").select("pid", "node").union(single.select("pid", F.col("pid").alias("node")))
    touching = stored(pairs.join(core.withColumnRenamed("pid", "b"), "b").groupBy("a", "node").agg(F.count(F.lit(1)).alias("n")))
    of_core = touching.join(single.withColumnRenamed("pid", "a"), "a", "left_semi").select("a", F.col("node").alias("b"))
    across = _linked_cells(points.where("node IS NOT NULL"), cells.where(F.col("n") >= min_points).drop("n"), eps)
    labels = components(stored(forest(of_core.union(across))))
    label = F.coalesce("label", "node")
    joined = core.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("pid", label.alias("own"))
    near = touching.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").groupBy("a").agg(F.min(label).alias("next"))
    out = df.select("pid").join(joined, "pid", "left").join(near.withColumnRenamed("a", "pid"), "pid", "left")
    out = out.select("pid", F.coalesce("own", "next", F.lit(-1)).alias("label"))
    return numbered(out) if dense else out


def numbered(labels: DataFrame) -> DataFrame:
    """labels numbered from 0 by their order; -1 stays. Counting goes over clusters, not points."""
    names = labels.where("label >= 0").select("label").distinct().withColumn("nth", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))
    return labels.join(names, "label", "left").select("pid", F.coalesce("nth", F.lit(-1)).alias("label"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def largest_cluster(labels: DataFrame, exclude_noise: bool = False) -> DataFrame:
    sizes = cluster_sizes(labels.where("label >= 0") if exclude_noise else labels)
    return sizes.orderBy(F.desc("n"), "label").limit(1)


def cluster_count(labels: DataFrame) -> DataFrame:
    return labels.where("label >= 0").agg(F.countDistinct("label").alias("clusters"))


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 42, most: int = 300, digits: int | None = None) -> tuple[DataFrame, float]:
    """(pid with label, sum of squares) of k-means++ and Lloyd's rounds until the centres stay; features are
    not scaled. Labels follow the order of the seeds."""
    centers, wcss, _ = fitted(df, columns, [k], seed, most, digits)
    own = finite(df, tuple(columns))
    if k not in centers:
        return own.select("pid", F.lit(0).alias("label")), 0.0
    if len(centers[k]) <= FEW:
        return labelled(own.select("pid", *columns), columns, centers[k], digits).select("pid", "label"), wcss[k]
    best = nearest_center(columns, [(i, *c) for i, c in enumerate(centers[k].tolist())], digits)
    return own.select("pid", best["label"].alias("label")), wcss[k]


def total_squares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sum of squared distances to the mean: the closed form for one cluster."""
    return df.agg(sum((F.var_pop(c) * F.count(c) for c in columns[1:]), F.var_pop(columns[0]) * F.count(columns[0])).alias("wcss"))


def elbow(df: DataFrame, columns: list[str], most: int = 19, seed: int = 42, rounds: int = 300, digits: int | None = None) -> DataFrame:
    """(k, wcss) for k = 1..most. One seeding has the first centres of all; a round serves all that move."""
    wcss = fitted(df, columns, list(range(1, most + 1)), seed, rounds, digits)[1]
    return df.sparkSession.createDataFrame(sorted(wcss.items()), "k int, wcss double")


def nearest_center(columns: list[str], centers: list[tuple], digits: int | None = None):
    """struct(d2, label) of the nearest of a few centres (label, coordinates), ties to the smaller label."""

    def to(label, at):
        d2 = (F.col(columns[0]) - at[0]) * (F.col(columns[0]) - at[0])
        for c, v in zip(columns[1:], at[1:], strict=True):
            d2 = d2 + (F.col(c) - v) * (F.col(c) - v)
        return F.struct((d2 if digits is None else F.round(d2, digits)).alias("d2"), F.lit(label).alias("label"))

    found = [to(label, at) for label, *at in centers]
    return F.least(*found) if len(found) > 1 else found[0]


def lloyd(df: DataFrame, columns: list[str], centers: DataFrame, rounds: int, digits: int | None = None) -> DataFrame:
    """(pid, label, d2) after some rounds from given centres (label, columns), d2 to the assigned centre.
    The centres, as many as clusters, are literals, so points are assigned where they are; ties go to
    the smaller label; an empty cluster keeps its centre. digits: decimals of the squared distance
    that count, for comparing with other engines."""
    own = stored(df.select("pid", *columns))
    at = {r[0]: tuple(r)[1:] for r in centers.select("label", *columns).collect()}
    for i in range(rounds + 1):
        found = own.withColumn("best", nearest_center(columns, sorted((c, *v) for c, v in at.items()), digits))
        if i == rounds:
            return found.select("pid", F.col("best.label").alias("label"), F.col("best.d2").alias("d2"))
        means = found.groupBy(F.col("best.label").alias("label")).agg(*[F.avg(n).alias(n) for n in columns]).collect()
        at |= {r[0]: tuple(r)[1:] for r in means}


def inertia(assigned: DataFrame) -> DataFrame:
    """Sum of squared distances to the assigned centres."""
    return assigned.agg(F.sum("d2").alias("wcss"))
