"""K-Means against plain loops: draws, rounds, blocks, odd clouds."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from voxelspring.operators import blocks, cluster, kmeans

SCHEMA = "pid long, x double, y double, z double"


def cloud(spark, rows, gap=1):
    return spark.createDataFrame([(i * gap, *map(float, r)) for i, r in enumerate(rows)], SCHEMA)


def plain_seeds(rows, k, seed):
    at = np.array(rows, float)
    span = ((at.max(axis=0) - at.min(axis=0)) ** 2).sum()
    found, weight = [], np.ones(len(at), np.int64)
    for nth in range(k):
        if not weight.sum():
            break
        hit = kmeans.draw(seed, nth) % int(weight.sum())
        found.append(at[np.searchsorted(np.cumsum(weight), hit, side="right")])
        near = np.min([((at - f) ** 2).sum(axis=1) for f in found], axis=0)
        weight = np.floor(near / span * kmeans.UNITS).astype(np.int64) if span else np.zeros(len(at), np.int64)
    return [tuple(f) for f in found]


def plain_rounds(rows, centers, rounds):
    at, centers = np.array(rows, float), np.array(centers, float)
    for _ in range(rounds):
        label = ((at[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.array([at[label == i].mean(axis=0) if (label == i).any() else c for i, c in enumerate(centers)])
    d2 = ((at[:, None] - centers[None]) ** 2).sum(axis=2)
    return d2.argmin(axis=1), float(d2.min(axis=1).sum())


def spots(n, seed=5):
    draw = random.Random(seed)
    return [tuple(c + draw.gauss(0, 0.3) for c in draw.choice([(0, 0, 0), (9, 0, 0), (0, 9, 3), (5, 5, -7)])) for _ in range(n)]


@pytest.mark.parametrize(("parts", "gap"), [(4096, 1), (3, 1), (4, 1000)])
def test_draws_hit_the_points_of_the_prefix_sums(spark, monkeypatch, parts, gap):
    monkeypatch.setattr(kmeans, "PARTS", parts)
    rows = spots(40) + [(1.0, 1.0, 1.0)] * 5
    assert kmeans.seeds(cloud(spark, rows, gap), ["x", "y", "z"], 5, 7) == plain_seeds(rows, 5, 7)


def test_rounds_to_the_end_and_boxes_that_skip_points(spark):
    rows = spots(900)
    own = cloud(spark, rows)
    first = plain_seeds(rows, 6, 42)
    packed = blocks.packed(own, size=16)
    at, wcss, share = kmeans.converged(packed, ["x", "y", "z"], {k: first[:k] for k in (1, 3, 6)})
    for k in (1, 3, 6):
        labels, total = plain_rounds(rows, first[:k], 60)
        assert wcss[k] == pytest.approx(total) and len(at[k]) == k
    assert share < 0.6
    found, total = cluster.kmeans(own, ["x", "y", "z"], 3)
    assert [r["label"] for r in found.orderBy("pid").collect()] == plain_rounds(rows, plain_seeds(rows, 3, 42), 60)[0].tolist()


def test_odd_clouds(spark):
    same = cloud(spark, [(1, 2, 3)] * 7)
    assert [r["wcss"] for r in cluster.elbow(same, ["x", "y"], 3).orderBy("k").collect()] == [0.0, 0.0, 0.0]
    none = cloud(spark, [])
    assert cluster.kmeans(none, ["x", "y"], 2)[0].count() == 0
    holes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0), (2, 4.0, float("nan"), 0.0), (3, 9.0, 0.0, 0.0)], SCHEMA)
    found, total = cluster.kmeans(holes, ["x", "y"], 2)
    assert sorted(r["pid"] for r in found.collect()) == [0, 3] and total == 0.0


def test_few_centres_need_no_index(spark, monkeypatch):
    rows = spots(700) + [(4.5, 0.0, 0.0)] * 3
    own = cloud(spark, rows)
    monkeypatch.setattr(kmeans, "SMALL", 0)

    def none(*_, **__):
        raise AssertionError("an index of all points for three centres")

    monkeypatch.setattr(kmeans, "packed", none)
    found, total = cluster.kmeans(own, ["x", "y", "z"], 3, digits=9)
    labels, wcss = plain_rounds(rows, plain_seeds(rows, 3, 42), 60)
    assert [r["label"] for r in found.orderBy("pid").collect()] == labels.tolist() and total == pytest.approx(wcss)
    # a tie after rounding goes to the smaller label, though the other is nearer by less than counts
    at = np.array([[0.0, 0.0, 0.0], [2.0 - 1e-12, 0.0, 0.0]])
    tie = kmeans.labelled(cloud(spark, [(1, 0, 0), (1.1, 0, 0)]), ["x", "y", "z"], at, 9).orderBy("pid").collect()
    assert [r["label"] for r in tie] == [0, 1]


def test_a_round_takes_many_blocks_together(spark):
    rows = spots(20_003)
    # a copy of a point between two centres: a tie, which goes to the smaller label
    first = [*plain_seeds(rows, 18, 42), (100.0, 0.0, 0.0), (102.0, 0.0, 0.0)]
    rows = [*rows, (101.0, 0.0, 0.0), (101.0 + 1e-13, 0.0, 0.0)]
    models, columns = {k: np.array(first[-k:]) for k in range(1, 21)}, ["x", "y", "z"]
    took, found = [], []
    for size in (4, 1024):
        packed = blocks.packed(cloud(spark, rows), size=size)
        kmeans._sums(packed, columns, models, 9).collect()
        began = time.time()
        found.append({(r["model"], r["label"]): r for r in kmeans._sums(packed, columns, models, 9).collect()})
        took.append(time.time() - began)
    at = np.array(rows)
    for own in found:
        for k, centers in models.items():
            d2 = ((at[:, None] - centers[None]) ** 2).sum(axis=2)
            label = d2.round(9).argmin(axis=1)
            for i in range(k):
                r, mine = own[k, i], label == i
                assert r["n"] == mine.sum() and r["wcss"] == pytest.approx(d2[mine, i].sum())
                assert [r[f"s{j}"] for j in range(3)] == pytest.approx(at[mine].sum(axis=0).tolist())
    # 5,002 blocks instead of 20: what a block costs beside its points is small
    assert took[0] < 8 * took[1] + 1
