"""K-Means: exact D-squared seeding (k-means++) and Lloyd's rounds to convergence for several numbers of
clusters at once, over blocks whose boxes tell which centres their points can have."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspring.operators.blocks import distances2, finite, packed
from voxelspring.storage import drop_stored, stored

#: Sums that the driver gets at once in a draw, and points that it gets at the end of it.
PARTS = 4096
#: A squared distance counts in so many parts of the squared diagonal of the bounding box.
UNITS = float(1 << 40)
#: Points of a cloud that is one block.
SMALL = 4096
#: Centres of all models together up to which points are assigned by column expressions, without an index.
FEW = 8
#: Squared distances farther apart than this in units of the last decimal that counts can't round to one number.
NEAR = 4.0
#: Points of blocks that go through the arithmetic of a round together.
POINTS = 1 << 16
#: Room for rounding when a box shuts out a centre, as a part of the larger distance.
SLACK = 1e-6


def draw(seed: int, nth: int) -> int:
    """A number below 2 ** 62 for the nth draw: two steps of a linear congruence for each."""
    x = (seed * 2654435761 + nth * 40503 + 1) % (1 << 31)
    high = (x * 1103515245 + 12345) % (1 << 31)
    return high << 31 | (high * 1103515245 + 12345) % (1 << 31)


def _square(columns: list[str], at: tuple) -> Column:
    terms = [(F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(columns, at, strict=True)]
    return reduce(lambda a, b: a + b, terms)


def pick(own: DataFrame, columns: list[str], weight: Column, number: int, low: int, high: int) -> tuple | None:
    """The coordinates of the point that a draw hits: points lie one after the other by pid, each as long as
    its weight, a whole number; None where all weights are 0. Sums of ranges of pids lead to the range,
    which is cut again until it has few pids, so no task and no driver gets all points."""
    rows, rest = own.withColumn("__w", weight.cast("decimal(20,0)")).where("__w > 0"), None
    while True:
        step = -(-(high - low + 1) // PARTS)
        if step == 1 and rest is not None:
            for r in sorted(rows.where(F.col("pid").between(low, high)).select("pid", "__w", *columns).collect()):
                if rest < r["__w"]:
                    return tuple(r[c] for c in columns)
                rest -= int(r["__w"])
        part = F.floor((F.col("pid") - low) / F.lit(step)).alias("part")
        found = sorted(rows.where(F.col("pid").between(low, high)).groupBy(part).agg(F.sum("__w").alias("w")).collect())
        total = sum(int(r["w"]) for r in found)
        if not total:
            return None
        rest = number % total if rest is None else rest
        for r in found:
            if rest < r["w"]:
                low, high = low + r["part"] * step, min(high, low + (r["part"] + 1) * step - 1)
                break
            rest -= int(r["w"])


def seeds(own: DataFrame, columns: list[str], k: int, seed: int) -> list[tuple]:
    """Up to k centres of k-means++: the first is drawn evenly, each other with a chance in proportion to its
    squared distance to the nearest before it, in whole units. There are fewer where fewer points differ."""
    sides = [f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))]
    box = own.agg(F.min("pid").alias("low"), F.max("pid").alias("high"), *sides).first()
    if box["low"] is None:
        return []
    span = reduce(lambda a, b: a + b, [(box[f"high{i}"] - box[f"low{i}"]) ** 2 for i in range(len(columns))])
    found = [pick(own, columns, F.lit(1), draw(seed, 0), box["low"], box["high"])]
    while len(found) < k and span:
        near = [_square(columns, at) for at in found]
        near = F.least(*near) if len(near) > 1 else near[0]
        point = pick(own, columns, F.floor(near / F.lit(span) * F.lit(UNITS)), draw(seed, len(found)), box["low"], box["high"])
        if point is None:
            break
        found.append(point)
    return found


def labelled(df: DataFrame, columns: list[str], centers: np.ndarray, digits: int | None) -> DataFrame:
    """df with `label` and `d2` of the nearest centre, ties to the smaller label. Distances are columns of their
    own, so that each is computed once; rounding, which costs more than all of them, is left to points that
    lie about as far from two centres."""
    names = [f"__d{i}" for i in range(len(centers))]
    own = df.withColumns({n: _square(columns, tuple(map(float, c))) for n, c in zip(names, centers, strict=True)})
    if len(names) == 1:
        return own.withColumn("label", F.lit(0)).withColumnRenamed("__d0", "d2")

    def first(of: list[Column], least: Column) -> Column:
        out = F.lit(len(of) - 1)
        for i in reversed(range(len(of) - 1)):
            out = F.when(of[i] <= least, F.lit(i)).otherwise(out)
        return out

    d2 = [F.col(n) for n in names]
    own, label = own.withColumn("d2", F.least(*d2)), first(d2, F.col("d2"))
    if digits is not None:
        limit = F.col("d2") + F.lit(NEAR * 10.0**-digits)
        own = own.withColumn("__near", reduce(lambda a, b: a + b, [(d <= limit).cast("int") for d in d2]))
        even = [F.round(d, digits) for d in d2]
        label = F.when(F.col("__near") == 1, label).otherwise(first(even, F.least(*even)))
    return own.withColumn("label", label).drop(*names, "__near")


def _plain_sums(own: DataFrame, columns: list[str], models: dict[int, np.ndarray], digits: int | None) -> DataFrame:
    """As _sums, from points as they are: a scan for each model, whose partial sums have a row for each centre."""
    out = None
    for m, centers in models.items():
        sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]
        n = F.count(F.lit(1)).cast("double")
        found = labelled(own.select(*columns), columns, centers, digits).groupBy("label").agg(n.alias("n"), F.sum("d2").alias("wcss"), n.alias("evaluated"), *sums)
        found = found.withColumn("model", F.lit(m))
        out = found if out is None else out.unionByName(found)
    return out


def _open_centers(centers: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each box and centre, whether the centre can be the nearest of a point in the box: all can but those that
    some other centre beats at each point, which the corner towards the beaten one decides."""
    best = distances2((low + high) / 2, centers).argmin(axis=1)
    to, of_best = 0.0, 0.0
    for i in range(centers.shape[1]):
        at = centers[best, i][:, None]
        corner = np.where(centers[:, i] > at, high[:, i, None], low[:, i, None])
        to, of_best = to + (centers[:, i] - corner) ** 2, of_best + (at - corner) ** 2
    could = to * (1 - SLACK) <= of_best
    could[np.arange(len(best)), best] = True
    return could


def _add(total: np.ndarray, label: np.ndarray, n, wcss: np.ndarray, evaluated, sums: list[np.ndarray]) -> None:
    """Add what lies at each label to its row of total: numbers, or the same one for all."""
    for i, values in enumerate((n, wcss, evaluated, *sums)):
        if np.ndim(values):
            total[:, i] += np.bincount(label, values, len(total))
        elif values:
            total[:, i] += values * np.bincount(label, minlength=len(total))


def _assign(total: np.ndarray, points: list[np.ndarray], box: tuple, own: tuple, centers: np.ndarray, digits: int | None) -> None:
    """Add what each centre of a model gets from blocks of one length to its row of total. points: an array for each
    column, with a row for each block; box: low and high corners; own: the blocks' means and squares about them."""
    size, (mean, squares) = points[0].shape[1], own
    could = _open_centers(centers, *box)
    count = could.sum(axis=1)
    order = np.argsort(~could, axis=1, kind="stable")  # the open centres first, by label
    single = count == 1
    if single.any():
        label = order[single, 0]
        wcss = squares[single] + size * ((mean[single] - centers[label]) ** 2).sum(axis=1)
        _add(total, label, size, wcss, 0, list(size * mean[single].T))
    for m in np.unique(count[~single]):
        rows = np.flatnonzero(count == m)
        at, could_be = [p[rows] for p in points], order[rows, :m]

        def to(nth: int) -> np.ndarray:
            return sum((p - centers[could_be[:, nth], i][:, None]) ** 2 for i, p in enumerate(at))  # noqa: B023

        best, second, nth = to(0), np.inf, np.zeros(at[0].shape, np.int64)
        for i in range(1, m):
            d2 = to(i)
            second = np.minimum(second, np.maximum(best, d2))
            nth[d2 < best] = i
            best = np.minimum(best, d2)
        if digits is not None:
            # rounding costs more than all distances, and only matters where two are about as near
            ties = np.nonzero(second <= best + NEAR * 10.0**-digits)
            if len(ties[0]):
                here = np.column_stack([p[ties] for p in at])
                d2 = sum((here[:, i, None] - centers[could_be[ties[0]], i]) ** 2 for i in range(len(at)))
                nth[ties] = np.round(d2, digits).argmin(axis=1)
                best[ties] = d2[np.arange(len(d2)), nth[ties]]
        label = np.take_along_axis(could_be, nth, axis=1).ravel()
        _add(total, label, 1, best.ravel(), 0, [p.ravel() for p in at])
        total[:, 2] += size * np.bincount(could_be.ravel(), minlength=len(total))


def _sums(blocks: DataFrame, columns: list[str], models: dict[int, np.ndarray], digits: int | None) -> DataFrame:
    """(model, label, n, wcss, evaluated, sums): what each cluster of each model gets. A block that has one
    open centre gives its sums without a distance to any other. Blocks of one length, all but the last of a
    cloud, go through the arithmetic together, about POINTS points at once."""
    width, names = len(columns), ("n", "wcss", "evaluated")

    def run(batches):
        total = {m: np.zeros((len(c), 3 + width)) for m, c in models.items()}
        for batch in batches:
            offsets, values = None, []
            for c in columns:
                offsets = batch.column(c).offsets.to_numpy()
                values.append(batch.column(c).values.to_numpy(zero_copy_only=False))
            sizes = np.diff(offsets)
            for size in np.unique(sizes[sizes > 0]):
                alike = np.flatnonzero(sizes == size)
                step = max(1, POINTS // int(size))
                for i in range(0, len(alike), step):
                    places = offsets[alike[i : i + step], None] + np.arange(size)
                    points = [v[places] for v in values]
                    box = tuple(np.column_stack([f(p, axis=1) for p in points]) for f in (np.min, np.max))
                    mean = np.column_stack([p.mean(axis=1) for p in points])
                    squares = sum(((p - mean[:, j, None]) ** 2).sum(axis=1) for j, p in enumerate(points))
                    for m, centers in models.items():
                        _assign(total[m], points, box, (mean, squares), centers, digits)
        rows = [(m, label, *map(float, r[:3]), r[3:].tolist()) for m, t in total.items() for label, r in enumerate(t)]
        kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 3, pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["model", "label", *names, "sums"])

    points = blocks.select(*[F.col(f"points.{c}").alias(c) for c in columns])
    parts = points.mapInArrow(run, "model int, label int, n double, wcss double, evaluated double, sums array<double>")
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    return parts.groupBy("model", "label").agg(*[F.sum(n).alias(n) for n in names], *sums)


def converged(blocks: DataFrame, columns: list[str], models: dict[int, list[tuple]], most: int = 300, digits: int | None = None) -> tuple[dict[int, np.ndarray], dict[int, float], float]:
    """(centres, sums of squares, share of points and centres evaluated) of each model after rounds until its
    centres stay, `most` at most. blocks: a block index, or for few centres the points themselves. All models that still move share a round, which is one pass; an empty cluster keeps its
    centre. Only sums come to the driver, one for each centre."""
    at = {m: np.array(c, float).reshape(-1, len(columns)) for m, c in models.items() if len(c)}
    moving, wcss, done, of = set(at), dict.fromkeys(models, 0.0), 0.0, 0.0
    for nth in range(most + 1):
        if not moving:
            break
        sums = _sums if "points" in blocks.columns else _plain_sums
        found = sums(blocks, columns, {m: at[m] for m in sorted(moving)}, digits).collect()
        for m in sorted(moving):
            own = [r for r in found if r["model"] == m]
            wcss[m] = sum(r["wcss"] for r in own)
            after = at[m].copy()
            for r in own:
                if r["n"]:
                    after[r["label"]] = [r[f"s{i}"] / r["n"] for i in range(len(columns))]
            done, of = done + sum(r["evaluated"] for r in own), of + sum(r["n"] for r in own) * len(at[m])
            scale = np.abs(after).max(initial=0.0)
            if np.abs(after - at[m]).max(initial=0.0) <= 1e-12 * scale:
                moving.discard(m)
            elif nth < most:
                at[m] = after
    return at, wcss, done / of if of else 0.0


def fitted(df: DataFrame, columns: list[str], numbers: list[int], seed: int = 42, most: int = 300, digits: int | None = None) -> tuple[dict[int, np.ndarray], dict[int, float], float]:
    """converged() for each number of clusters, with the first centres of one seeding. Points with a missing
    coordinate take no part. digits: decimals of the squared distance that count, for comparing with other
    engines."""
    own = stored(finite(df.select("pid", *[F.col(c).cast("double").alias(c) for c in columns]), tuple(columns)))
    first = seeds(own, columns, max(numbers), seed)
    n = own.count()
    # an index costs several passes and shuffles of all points, more than the rounds of a few centres
    plain = n > SMALL and sum(numbers) <= FEW
    blocks = own if plain else packed(own, columns=tuple(columns), whole=n <= SMALL)
    out = converged(blocks, columns, {k: first[:k] for k in numbers}, most, digits)
    drop_stored(*([own] if plain else [own, blocks]))
    return out
