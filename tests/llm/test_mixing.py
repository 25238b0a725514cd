"""Mixing: targets by raising the rate in small steps, properties of the draws."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from voxelspring.llm import mixing

SCHEMA = "doc_id long, source string, text string, size long, sid long, target string"


def plain_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """Stop the sources that are above, share the rest among the others, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(most * sizes[s] for s in stopped)
        found = {s: most * sizes[s] for s in stopped} | {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if found[s] > most * sizes[s]}
        if not over:
            return found
        stopped |= over


def rows_of(seed: int) -> list[tuple]:
    draw, rows = random.Random(seed), []
    for source, n in ((None, 7), ("", 3), ("Z", 60), ("a", 25), ("é", 12), ("￿", 1), ("\U00010000", 9), ("none", 2)):
        for _ in range(n):
            words = 0 if source == "none" else draw.choice([0, 1, 3, 10, 40, 400])
            rows.append((len(rows), source, " \t".join(["w x"] * words) if words else draw.choice([None, "", " \n"])))
    return rows + [rows[9], rows[9], (None, "a", "one two")]


def test_targets_and_totals(spark):
    rows = rows_of(3)
    docs = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], SCHEMA)
    out = mixing.mix(docs, group=8).toPandas()
    sizes: dict = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = plain_targets(sizes)
    ids = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all() and (out.taken % out["size"].where(out["size"] > 0, 1) == 0).all()
    for source, size in sizes.items():
        own = out[[ids[None if np.isnan(i) else int(i)] == source for i in out.doc_id]]
        assert (own.source_size == size).all() and np.allclose(own.target, targets[source])
        # whole copies: never further off than the largest document
        assert abs(own.taken.sum() - targets[source]) <= own["size"].max()
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows_of(5)], SCHEMA)
    order = ["doc_id", "size", "taken"]
    first, again = (mixing.mix(d, group=4).toPandas().sort_values(order).reset_index(drop=True) for d in (docs.repartition(7), docs.repartition(2)))
    assert first.equals(again)


@pytest.mark.parametrize("settle", [mixing.settle, mixing.settle_alike])
def test_words_are_kept_and_documents_keep_their_average(settle):
    sizes = [900.0, 300.0, 40.0, 40.0, 7.0, 5.0, 1.0]
    part, n = 0.3, 4000
    seen = np.zeros(len(sizes))
    for seed in range(n):
        parts = [part] * len(sizes)
        left = settle(parts, sizes, mixing.draws(seed, np.arange(len(sizes))))
        assert abs(np.dot(parts, sizes) - part * sum(sizes)) < 1e-6
        assert all(p in (0, 1) for i, p in enumerate(parts) if i != left)
        seen += parts
    assert np.abs(seen / n - part).max() < 4 * (part * (1 - part) / n) ** 0.5


def test_a_large_document_leaves_little_when_small_ones_can_take_it_up(spark):
    rows = [(i, "a", "w " * (3000 if i < 3 else 1 + i % 20)) for i in range(2500)] + [(9000 + i, "b", "w " * 900) for i in range(20)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), share=0.7, group=16).toPandas()
    own = out[out.doc_id < 9000]
    assert own.target.iloc[0] < 2 * own.source_size.iloc[0] and abs(own.taken.sum() - own.target.iloc[0]) <= 20
