"""Every operator on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

from __future__ import annotations

import json

import numpy as np
import pytest

from voxelspring.llm import bpe, chat, lm, media, neardup, neighbours, packing, substrings, toxicity, urls

WORDS = [f"w{i}" for i in range(4000)]
LONG = " ".join(WORDS)
PASSAGE = " ".join(WORDS[500:580])
ROWS = [
    (1, LONG, "en"), (2, LONG + " more", None), (3, None, "en"), (4, "", None), (5, " \n\t", "x"), (None, "null id " + PASSAGE, "en"),
    (6, "short text", "en"), (7, "short text", "en"), (7, "short text", "en"), (8, "x" * 3000, "en"), (9, "before it all " + PASSAGE + " after", "de"),
]
SCHEMA = "doc_id long, text string, keys string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, none):
    out = packing.pack(docs, capacity=64).toPandas()
    assert packing.pack(none).count() == 0
    assert set(out.doc_id.dropna().astype(int)) == {1, 2, 3, 4, 5, 6, 7, 8, 9} and out.length.max() <= 64
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.r_[0, g.length.cumsum().to_numpy()[:-1]]).all() and g.length.sum() <= 64
    assert out[out.doc_id == 3].length.tolist() == [1]


def test_codec_and_media(docs, none):
    own = bpe.digests(docs).toPandas()
    assert len(own) == len(ROWS) and own[own.doc_id == 3].n_tokens.item() == 0 and bpe.digests(none).count() == 0
    back = bpe.decode_column(bpe.encode_column(docs)).toPandas()
    assert back[back.doc_id == 6].text.item() == "short</w> text</w>"
    stored = media.store_texts(docs).toPandas()
    assert len(stored) == len(ROWS) and stored[stored.doc_id == 4].payload_bytes.item() == 64 and media.store_texts(none).count() == 0
    assert stored[stored.doc_id.isin([3, 4])].payload_sha256.nunique() == 1
    seen = media.describe(media.images_of_texts(docs, "bmp")).toPandas()
    assert seen.error.isna().all() and len(seen.dhash.iloc[0]) == 16


def test_lm_ways_agree(docs, none):
    a = lm.score_documents(docs).toPandas()
    b = lm.score_documents(docs, broadcast_limit=0).toPandas()
    order = ["doc_id", "n_tokens"]
    a, b = (x.sort_values(order).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(ROWS) and a[a.doc_id == 3].n_tokens.item() == 1
    assert np.allclose(a.score, b.score) and np.allclose(a.base_score, b.base_score) and (a.n_known == b.n_known).all()
    assert lm.score_documents(none).count() == 0


def test_search(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(230, 6)).round(1)
    rows = [(i, x.tolist(), "z") for i, x in enumerate(v)]
    bad = [(300, None, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0], None), (500, [float("nan")] * 6, None), (None, [1.0] * 6, None), (600, [], None)]
    # rows that repeat an id count each, queries too, and short or long vectors lack or add components
    more = [(rows[3][0], rows[3][1], "z"), (5, [0.9] * 6, "z"), (100, [2.0, -1.0], "z"), (231, [1.0] * 9, "z")]
    df = spark.createDataFrame(rows + bad + more, "vec_id long, embedding array<double>, sub string")
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows + more]
    want = []
    for n, (i, q) in enumerate(kept):
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for m, (j, v) in enumerate(kept) if m != n)[:10]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    for blocks in ({"vector_block": 50, "query_block": 2}, {"vector_block": 7, "pivots": 5}, {}):
        out = neighbours.top_k(df, lambda i: i % 100 == 0, **blocks).collect()
        assert sorted(map(tuple, out)) == sorted(want)
    assert neighbours.top_k(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (6, 1), (6, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_documents(docs, toxicity.train(docs, labels)).toPandas()
    assert len(out) == len(ROWS) and out.score.between(0, 1).all() and out[out.doc_id.isin([3, 4])].score.nunique() == 1
    assert toxicity.keep_clean(none, labels.limit(0)).columns == docs.columns
    assert toxicity.score_documents(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_urls(spark):
    rows = [(1, "http://a.com/x", 1), (2, "https://WWW.Example.com/en/1?q=1#f", 2), (3, "http://example.com/en/", 3), (4, "http://n.net/es/?a", 4), (5, None, 5), (6, "no scheme", 6), (7, "http://com", 7), (7, "http://xcom/", 8), (None, "ftp://b.net/fr/x://y", 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int")
    out = {(r["page_id"], r["host"]): r for r in urls.judge(df).collect()}
    assert out[1, "a.com"]["rule"] == "com/" and out[2, "www.example.com"]["verdict"] == "allow"
    assert out[3, "example.com"]["rule"] == "example.com/en/" and out[4, "n.net"]["rule"] == "net/es/"
    assert out[5, ""]["path"] == "" and out[6, ""]["rule"] is None and out[7, "com"]["path"] == "" and out[7, "com"]["rule"] is None
    assert out[None, "b.net"]["path"] == "/fr/x://y"
    assert urls.judge(df.limit(0)).count() == 0


def test_near_duplicates(spark, docs, none):
    out = neardup.cluster(docs).toPandas().set_index("doc_id")
    assert out.component_id[2] == 1 and not out.kept[2] and out.kept[1] and out.n_shingles[3] == 0
    assert out.component_id[4] == 4 and set(out.component_id[7]) == {6}
    assert neardup.cluster(none).count() == 0 and neardup.keep_one(docs).columns == docs.columns
    rng = np.random.default_rng(9)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(140):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            own[at] = f"e{rng.integers(10**9)}"
        rows.append((i, " ".join(own), None))
    found = neardup.cluster(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("doc_id").component_id
    sets = [set(neardup.shingle_set(t).tolist()) for _, t, _ in rows]
    root = list(range(140))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(140):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    assert [found[i] for i in range(140)] == [find(i) for i in range(140)]


def test_passages(docs, none):
    out = substrings.merged_passages(substrings.duplicate_passages(docs)).toPandas().set_index("doc_id")
    assert set(out.index) == {2, 9} and out.ref_doc_id.eq(1).all() and out.n_words[9] == 80 and out.start_word[9] == 3
    left = substrings.without_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(ROWS)
    assert left.where("doc_id = 9").first()["text"] == "before it all after"
    assert substrings.duplicate_passages(none).count() == 0 and substrings.without_duplicates(none).count() == 0


def test_tool_calls(spark):
    calls = lambda *c: json.dumps({"tool_calls": list(c)})
    make = lambda i, needs=(), **a: {"id": i, "name": "add", "arguments": a, "depends_on": list(needs)}
    rows = [
        (1, 0, "user", "hi", 0), (1, 1, "assistant", calls(make("a", x=1), make("b", ["a"], x="no")), 0), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"v": 2}}), 0),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": 1}), 0), (2, 0, "assistant", calls(make("p", ["q"], x=1), make("q", ["p"], x=1), make("r", ["nowhere"], x=1)), 0),
        (3, 0, "user", None, 0), (None, 1, "user", "x", 0), (4, 0, "user", "q", 0), (4, 1, "assistant", "r", 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int")
    schemas = chat.SCHEMAS | {"add": {"type": "object", "properties": {"x": {"type": "integer"}}}}
    out = {(r["conv_id"], r["call_id"]): r for r in chat.format_calls(*chat.calls_and_results(df), schemas).collect()}
    assert out[1, "a"]["status"] == "linked" and out[1, "a"]["valid"] and '"result":{"v":2}' in out[1, "a"]["line"]
    assert out[1, "b"]["level"] == 1 and out[1, "b"]["errors"] == ["$.x: not integer"] and out[1, "zz"]["status"] == "orphan"
    assert out[2, "p"]["level"] is None and out[2, "r"]["level"] == 0 and out[2, "r"]["errors"] == ["depends on 1 unknown calls"]
    assert out[3, "0"]["errors"] == ["$.text: shorter than 1"] and out[4, "0"]["status"] == "linked"
    assert chat.format_calls(*chat.calls_and_results(df.limit(0))).count() == 0
