"""Tests of contracts named in the second verdict: code points of the codec, empty vectors, whole digests."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxelspring.llm import bpe, chat, neighbours, substrings, toxicity
from voxelspring.llm.common import words_of

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    return own


def test_code_points_are_the_librarys(library):
    """All but those of the large blocks of ideographs, syllables, private use and unassigned planes, of which a sample."""
    codec = bpe.codec(PATH)
    spans = [(0x80, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x20000), (0xE0000, 0xE0200)]
    codes = [i for a, b in spans for i in range(a, b)] + list(range(0x3400, 0x110000, 4001))
    points = [chr(i) for i in codes if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 20_000):
        texts = [f"ab{c}c 1{c} {c}'s A{c}́" for c in points[at : at + 20_000]]
        for text, theirs in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert codec.encode(text) == theirs.ids, ascii(text)
    assert len(codec.odd) > 1000


def test_digests_of_a_whole_table(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.add((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert set(map(tuple, bpe.query(spark, SF).collect())) == want


def test_empty_vectors_take_part(spark, tmp_path):
    rows = [(100, [1.0, -1.0]), (7, []), (200, []), (8, [0.5, 0.5]), (9, None), (10, [None, 1.0]), (11, [float("nan"), 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = sorted(map(tuple, neighbours.query(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()))
    assert found == [(100, 1, 7, 0), (100, 2, 8, 0), (100, 3, 200, 0), (200, 1, 7, 0), (200, 2, 8, 0), (200, 3, 100, 0)]


def near_pairs(texts: dict[int, list[bytes]]) -> set[tuple[int, int]]:
    """(later, earlier) documents: 46 shingles in a row of the later one, of which 37 lie within 60 places of the
    earlier one. Candidates come from an index of all shingles."""
    at: dict[tuple, dict[int, list[int]]] = {}
    for doc, words in texts.items():
        for i in range(len(words) - 4):
            at.setdefault(tuple(words[i : i + 5]), {}).setdefault(doc, []).append(i)
    shared: Counter = Counter()
    for holders in at.values():
        docs = sorted(holders)
        shared.update((b, a) for i, a in enumerate(docs) for b in docs[i + 1 :])
    found = set()
    for (doc, ref), n in shared.items():
        if n < 37 or len(texts[doc]) < 50 or len(texts[ref]) < 50:
            continue
        places = [at[tuple(texts[doc][i : i + 5])].get(ref) for i in range(len(texts[doc]) - 4)]
        hits = np.cumsum([0, *(p is not None for p in places)])
        for i in np.flatnonzero(hits[46:] - hits[:-46] >= 37)[:200].tolist():
            first = sorted(p for own in places[i : i + 46] if own for p in own[:3])
            if any(np.searchsorted(first, p + 60) - k >= 37 for k, p in enumerate(first)):
                found.add((doc, ref))
                break
    return found


def recall_of_classes(spark, rows: list[tuple[int, str]]) -> tuple[int, float]:
    """How many near pairs there are, and of how many both documents are in one class of passages."""
    truth = near_pairs({i: words_of(t) for i, t in rows if t})
    members: dict[int, set[int]] = {}
    for r in substrings.linked_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        for doc in (r["doc_id"], r["ref_doc_id"], r["class_doc_id"]):
            members.setdefault(doc, set()).add(r["class_id"])
    return len(truth), sum(bool(members.get(a, set()) & members.get(b, set())) for a, b in truth) / max(1, len(truth))


def test_near_repeats_of_a_whole_table_are_in_one_class(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n, recall = recall_of_classes(spark, rows)
    print(f"near pairs {n}, in one class {recall:.4f}")
    assert n > 100 and recall >= 0.9


@pytest.mark.parametrize(("copies", "changed"), [(40, 1), (40, 2), (200, 2)])
def test_near_copies_in_fresh_text_are_in_one_class(spark, copies, changed):
    draw = random.Random(copies + changed)
    word = lambda: f"w{draw.randrange(50_000)}"
    base, rows = [word() for _ in range(100)], []
    for doc in range(copies):
        passage = list(base)
        for k in draw.sample(range(100), changed):
            passage[k] = word()
        before, after = ([word() for _ in range(draw.randrange(30, 200))] for _ in "ba")
        rows.append((doc, " ".join(before + passage + after)))
    n, recall = recall_of_classes(spark, rows + [(900 + i, " ".join(word() for _ in range(300))) for i in range(5)])
    print(f"{copies} copies, {changed} changed: near pairs {n}, in one class {recall:.4f}")
    assert n >= copies and recall >= 0.9


def test_classes_tell_passages_apart(spark):
    """Two passages that meet in one document are two classes; what overlaps is one."""
    words = [[f"{k}{i}" for i in range(60)] for k in "ab"]
    fresh = lambda k: [f"x{k}_{i}" for i in range(30)]
    texts = [words[0] + fresh(1), words[1] + fresh(2), words[0] + fresh(3) + words[1], fresh(4) + words[1]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9, None), (10, "")]
    found = {(r["doc_id"], r["start_word"]): (r["class_doc_id"], r["class_members"]) for r in substrings.linked_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(2, 0): (0, 2), (2, 90): (1, 3), (3, 30): (1, 3)}
    assert substrings.linked_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_training_reads_whole_texts_and_keeps_both_classes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "Model", lambda texts, labels, bags: (labels, bags))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    long = " ".join(f"unit{i}" for i in range(6000))
    rows = [(ids[0], long)] + [(ids[1], f"again {k}") for k in range(30)] + [(i, "plain") for i in ids[2:]]
    marks = [(i, int(i in ids[2:4])) for i in ids]
    labels, bags = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"), sample=10)
    assert labels.count(1) == 2 and 0 < labels.count(0) <= 10
    labels, bags = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"), sample=500)
    assert len(labels) == len(rows) and max(map(len, bags)) >= 6000


def test_a_chain_of_many_calls_is_ordered_in_a_minute(spark):
    n = 30_000
    calls = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "0 AS place", "CAST(id AS string) AS call_id", "IF(id = 0, array(), array(CAST(id - 1 AS string))) AS depends_on")
    began = time.time()
    found = {int(r["call_id"]): r["level"] for r in chat.levels(calls).collect()}
    assert found == {i: i for i in range(n)} and time.time() - began < 60


def test_levels_over_blocks_equal_those_of_a_whole_conversation(spark):
    draw, rows = random.Random(8), []
    for conv in range(3):
        ids = [f"c{i}" for i in range(60)]
        for i, c in enumerate(ids):
            needs = [ids[draw.randrange(max(1, i))] for _ in range(draw.randrange(3)) if i]
            needs += [draw.choice(ids)] if draw.random() < 0.04 else []
            needs += ["nobody"] if draw.random() < 0.05 else []
            rows.append((conv, i, 0, c, needs))
    rows += [(9, 0, 0, "x", ["y"]), (9, 1, 0, "y", ["x"]), (9, 2, 0, "z", ["y", "q", "q"]), (9, 3, 0, "free", [])]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, place int, call_id string, depends_on array<string>")
    whole = sorted(map(tuple, chat.levels(calls).collect()), key=str)
    assert sorted(map(tuple, chat.levels_by_rounds(calls, 7).collect()), key=str) == whole
    assert {r[1]: r[2:] for r in whole if r[0] == 9} == {"x": (None, 0), "y": (None, 0), "z": (None, 1), "free": (0, 0)}
