"""The registered queries on whole tables against plain Python, as their contracts have them."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from voxelspring.llm import common, lm, media, neardup, packing, substrings, toxicity

DATA = "/root/testdata"
SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def documents(sf: str = SF) -> list[tuple]:
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def test_packing_pieces(spark):
    """Ids, cuts and digests by the library itself; places gapless; no more sequences than 11/9 of the volume."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    want = set()
    for doc, text in documents():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        cut = len(ids) - 1024 * (-(-len(ids) // 1024) - 1)
        edges = [0, *range(cut, len(ids) + 1, 1024)]
        want |= {(doc, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False))}
    out = packing.query(spark, SF).toPandas()
    assert set(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == want and len(out) == len(want)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 1024 and (g.offset.to_numpy() == np.r_[0, g.length.cumsum().to_numpy()[:-1]]).all()
    volume = -(-int(out.length.sum()) // 1024)
    assert out.sequence_id.nunique() <= 11 / 9 * volume + 1


@pytest.mark.parametrize("text", ["", "plain", "a  b\n\n c\t", "x" * 4000 + " y", " " * 1600 + "z", "don't we'll 12345 é漢😀 <|endoftext|> end"])
def test_fast_encoder_equals_the_library(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_vocabulary())
    assert packing.encoder(packing.default_vocabulary())(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_language_model_base(spark):
    rows = [(doc, zlib.crc32(str(doc).encode()) % 7 == 2, [*words_of(text), None]) for doc, text in documents()]
    counts = Counter(t for _, held, tokens in rows if not held for t in tokens)
    total, distinct = sum(counts.values()), len(counts)
    out = lm.query(spark, SF).toPandas().set_index("doc_id")
    for doc, held, tokens in rows:
        r = out.loc[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens), abs=1e-6)
    # probabilities of all words after one sum to less than one and pairs help
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum() and (out.score < 0).all()


def test_media_payloads(spark):
    out = media.query(spark, SF).toPandas().set_index("doc_id")
    for doc, text in documents():
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = out.loc[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        form = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())


def components_by_loop(sets: dict[int, set], percent: int) -> dict[int, int]:
    """The smallest id reachable over links of at least `percent`."""
    holders: dict[bytes, list[int]] = {}
    for doc, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(doc)
    shared: Counter = Counter()
    for docs in holders.values():
        shared.update((a, b) for i, a in enumerate(docs) for b in docs[:i])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {d: find(d) for d in sets}


def shingles(text: str | None) -> set:
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicate_links(spark):
    """All links of sf0.01 by brute force."""
    sf = f"{DATA}/sf0.01"
    sets = {doc: shingles(text) for doc, text in documents(sf)}
    want = components_by_loop(sets, 85)
    out = {r["doc_id"]: r for r in neardup.query(spark, sf).collect()}
    assert {d: r["component_id"] for d, r in out.items()} == want
    assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (d == want[d]) for d, r in out.items())


def test_toxicity_on_held_out_labels(spark):
    """At least four of five toxic held-out texts of sf0.1 are caught; at most one in forty clean ones is rejected."""
    sf = f"{DATA}/sf0.1"
    out = toxicity.query(spark, sf).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, max(toxic) AS toxic FROM '{sf}/labels.parquet' GROUP BY ALL").df()
    both = out[out.held_out].merge(labels, on="doc_id")
    caught, rejected = both[both.toxic == 1].predicted.mean(), both[both.toxic == 0].predicted.mean()
    print(f"caught {caught:.3f}, clean rejected {rejected:.3f}")
    assert caught >= 0.8 and rejected <= 0.025
    assert (out.predicted == (out.score >= 0.5)).all() and (out.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out.doc_id]).all()


def test_pipeline_stage_by_stage(spark):
    """Each stage on what the one before kept, against plain versions of what it has to do."""
    docs = common.table(spark, SF, "documents")
    given = docs.toPandas()
    clean = common.stored(corpus_pipeline.toxic(spark, docs, SF))
    assert clean.columns == docs.columns
    scores = toxicity.query(spark, SF).toPandas().set_index("doc_id")
    assert sorted(clean.toPandas().doc_id) == sorted(d for d in given.doc_id if scores.predicted[d] == 0)

    kept = common.stored(corpus_pipeline.near_duplicates(spark, clean, SF))
    rows = clean.toPandas()
    want = components_by_loop({d: shingles(t) for d, t in zip(rows.doc_id, rows.text, strict=True)}, 80)
    assert kept.columns == docs.columns and sorted(kept.toPandas().doc_id) == sorted(d for d, c in want.items() if d == c)

    cut = common.stored(corpus_pipeline.passages(spark, kept, SF))
    before, after = (t.toPandas().set_index("doc_id") for t in (kept, cut))
    assert cut.columns == docs.columns and sorted(before.index) == sorted(after.index)
    found = substrings.merged_passages(substrings.duplicate_passages(kept)).toPandas()
    for d, text in before.text.items():
        spans = [] if pd.isna(d) else sorted(zip(found[found.doc_id == d].start_word, found[found.doc_id == d].n_words, strict=True))
        gone = {i for a, n in spans for i in range(a, a + n)}
        assert [w for i, w in enumerate(words_of(text)) if i not in gone] == words_of(after.text[d])
    seen: set = set()
    for d in sorted(after.index):
        words = words_of(after.text[d])
        own = {tuple(words[i : i + 50]) for i in range(len(words) - 49)}
        assert not own & seen
        seen |= own

    packed = corpus_pipeline.packed(spark, cut, SF).toPandas()
    assert set(packed.doc_id) == set(after.index) and packed.groupby("sequence_id").length.sum().max() <= 1024
    whole = corpus_pipeline.run(spark, SF).toPandas()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole[columns].itertuples(index=False))) == sorted(map(tuple, packed[columns].itertuples(index=False)))
