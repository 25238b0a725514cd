"""Cases of the first review: jobs that were cut short."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from voxelspring.llm import common, neardup, substrings, urls


def fresh(rng, n: int) -> list[str]:
    return [f"r{x}" for x in rng.integers(0, 10**12, n)]


@pytest.mark.parametrize("holders", [4, 60])
def test_passages_meet_behind_a_frequent_phrase(spark, holders):
    """A passage in two documents, all its anchors in a phrase that many others hold."""
    rng = np.random.default_rng(31)

    def windows(words):
        return substrings.windows(substrings.Block([common.shingle_hashes(common.word_hashes([w.encode() for w in words]), 5)]), 46)

    while True:
        passage = fresh(rng, 50)
        keys, at = windows(passage)
        if at.max() - at.min() < 12:
            break
    phrase = passage[at.min() : at.max() + 5]

    def holder(part):
        while True:
            text = fresh(rng, 60) + part + fresh(rng, 60)
            if set(keys) <= set(windows(text)[0]):
                return text

    first, second = holders // 2, 2 * holders - 2
    texts = {i: holder(passage if i in (first, second) else phrase) for i in range(1, 2 * holders)}
    while set(windows(texts[first])[0]) & set(windows(texts[second])[0]) > set(keys):
        texts[second] = holder(passage)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    for parts in (1, 7):
        found = substrings.duplicate_passages(docs.repartition(parts)).collect()
        assert {(r["doc_id"], r["ref_doc_id"], r["start_word"], r["n_words"]) for r in found} == {(second, first, 60, 50)}


def test_neighbouring_passages_keep_their_references(spark, tmp_path):
    rng = np.random.default_rng(32)
    a, b = fresh(rng, 80), fresh(rng, 80)
    rows = [(5, fresh(rng, 70) + a + fresh(rng, 70)), (9, fresh(rng, 70) + b + fresh(rng, 70)), (12, fresh(rng, 70) + a + b + fresh(rng, 70))]
    spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["doc_id"], r["ref_doc_id"], r["start_word"], r["n_words"]) for r in substrings.query(spark, str(tmp_path)).collect()}
    assert found == {(12, 5, 70, 80), (12, 9, 150, 80)}


def test_near_copies_of_four_fifths_go(spark):
    """One replaced word in 50: 45 of 55 shingles shared, in 200 pairs."""
    rng = np.random.default_rng(33)
    rows = []
    for i in range(200):
        own = fresh(rng, 54)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:25], "other", *own[26:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [neardup.shingle_set(t) for _, t in rows[:2]]
    assert 0.8 <= len(np.intersect1d(*sets)) / len(np.union1d(*sets)) < 0.85
    kept = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").toPandas().doc_id
    assert sorted(kept) == list(range(0, 400, 2))


def test_unresolved_buckets_link_all_that_share_one(spark):
    """A chain of small buckets is compared bucket by bucket, buckets that overlap almost wholly as one
    cloud; either way the links join all similar documents that share a bucket."""
    rng = np.random.default_rng(71)
    texts = []
    for _ in range(30):
        own = fresh(rng, 200)
        texts += [" ".join(own), " ".join([*own[:100], "other", *own[101:]]), " ".join([*own[:50], "third", *own[51:]])]
    sets = {i: neardup.shingle_set(t) for i, t in enumerate(texts)}
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "rep long, shingles binary")
    chain = {k: list(range(2 * k, min(2 * k + 4, 90))) for k in range(44)}
    heap = {k: [i for i in range(90) if i != k] for k in range(20)}
    similar = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))

    def joined(pairs):
        root = list(range(90))
        find = lambda x: x if root[x] == x else find(root[x])
        for i, j in pairs:
            p, q = sorted((find(i), find(j)))
            root[q] = p
        return [find(i) for i in range(90)]

    for buckets, by_bucket in ((chain, True), (heap, False)):
        still = spark.createDataFrame([(k, i, i) for k, members in buckets.items() for i in members], "key long, doc long, label long")
        parts = neardup.parts_of(still, neardup.cloud_of(still)).select("part").distinct().count()
        assert parts == (44 if by_bucket else 1)
        links = [(r["a"], r["b"]) for r in neardup.clouds(still, frame, 85, block=32).collect()]
        together = {tuple(sorted((i, j))) for members in buckets.values() for i in members for j in members if i != j}
        assert all(similar(i, j) for i, j in links)
        assert joined(links) == joined([p for p in together if similar(*p)])


def test_least_agreeing_minhashes():
    assert neardup.least_agreeing(256, 85) <= 187 and neardup.least_agreeing(48, 80) < 0.8 * 48


def test_url_sample_is_of_distinct_urls(spark):
    """Forty urls, one of them 5,000 times: the sample is the same with and without the repeats."""
    rows = [(f"http://h{i}.com/{i}", f"h{i}.com", f"/{i}", "block" if i % 2 else "allow") for i in range(40)]
    schema = "url string, host string, path string, rule_verdict string"
    once, often = (urls.train(spark.createDataFrame(r, schema), sample=30) for r in (rows, rows + rows[:1] * 5000))
    assert once.trees is not None and often.trees is not None
    assert once.shares.seen == often.shares.seen and often.shares.rows == 30
