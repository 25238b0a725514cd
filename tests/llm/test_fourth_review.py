"""Sizes and bounds that the fourth review asked for."""

from __future__ import annotations

import numpy as np
import pytest

from voxelspring.llm import lm


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_messages_of_the_language_model_come_back(n):
    draw = np.random.default_rng(3)
    words = np.unique(draw.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
    assert (lm.unpacked(lm.packed(words, np.uint64)) == words).all()
    own = np.unique(lm.places(words, 7))
    edges = lm.cut(own, 7)
    assert edges[0] == 0 and edges[-1] == len(own)
    for s in range(7):
        part = own[edges[s] : edges[s + 1]]
        assert (lm.unpacked(lm.packed(part), s) == part).all()
    counts = draw.integers(1, 1 << 40, n) >> draw.integers(0, 40, n)
    assert (lm.unpacked_counts(lm.packed_counts(counts), n) == counts).all()


def test_questions_to_shards_are_small(spark, tmp_path):
    """Bytes that the questions, with their texts, take for each token: 22 and more when hashes went as they were."""
    draw = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(v)}" for v in draw.zipf(1.3, 400) % 20_000)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    grouped = type(docs).groupBy

    def spied(df, *columns):
        if columns == ("shard",) and "first" in df.columns:
            path = str(tmp_path / "questions")
            df.selectExpr("octet_length(first) + octet_length(second) AS n").write.mode("overwrite").parquet(path)
            seen["bytes"] = spark.read.parquet(path).agg({"n": "sum"}).first()[0]
        return grouped(df, *columns)

    mp = pytest.MonkeyPatch()
    try:
        mp.setattr(type(docs), "groupBy", spied)
        found = lm.score_documents(docs, broadcast_limit=0)
    finally:
        mp.undo()
    tokens = found.agg({"n_tokens": "sum"}).first()[0]
    assert tokens == 600 * 401 and seen["bytes"] / tokens < 10
