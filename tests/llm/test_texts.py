"""Codec, packing, media, kernels and windows against brute force, without Spark."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelspring.llm import bpe, chat, lm, media, neardup, neighbours, packing, substrings, toxicity, urls


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abcXYZ 019'’s re\t\n\x1c\x85éÀßΣςİ漢😀\u0301!?.,<|>"), max_size=60))
def test_bpe_equals_the_library(word_library, text):
    ids = word_library.encode(text, add_special_tokens=False).ids
    own = bpe.codec(bpe.default_vocabulary())
    assert own.encode(text) == ids
    assert own.decode(ids) == word_library.decode(ids, skip_special_tokens=False)


def test_bpe_special_tokens_and_long_words(word_library):
    own = bpe.codec(bpe.default_vocabulary())
    for text in (None, "", "a<|endoftext|>b <|startoftext|>", "x" * 5000, "<|endoftext|>" * 3):
        assert own.encode(text) == word_library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_places_every_piece_once(counts):
    plan = packing.Plan(dict(counts), 64)
    fill = np.zeros((plan.bins, 64), dtype=int)
    seen = {n: set() for n in counts}
    for length, rank, pieces, each, offset, base in plan.runs:
        for i in range(pieces):
            seen[length].add(rank + i)
            at = offset + i % each * length
            fill[base + i // each, at : at + length] += 1
    assert fill.max(initial=0) <= 1
    assert all(seen[n] == set(range(k)) for n, k in counts.items())
    # no gaps: what is filled is a prefix
    assert all((row[: row.sum()] == 1).all() for row in fill)
    # the volume alone bounds from below too loosely: five pieces of 33 of 64 need five sequences. The
    # bound over all splits is at least 2/3 of the optimum; best-fit takes at most 11/9 of that + 2/3
    low = max(split_bound(counts, 64, small) for small in range(33))
    assert max(low, plan.lower_bound()) <= plan.bins <= 11 / 6 * low + 2 / 3


def split_bound(counts, capacity, small):
    """Martello and Toth's bound that leaves pieces below `small` aside."""
    big = sum(k for n, k in counts.items() if n > capacity - small)
    half = {n: k for n, k in counts.items() if capacity // 2 < n <= capacity - small}
    rest = sum(n * k for n, k in counts.items() if small <= n <= capacity // 2)
    room = sum((capacity - n) * k for n, k in half.items())
    return big + sum(half.values()) + max(0, -(-(rest - room) // capacity))


def test_plan_of_pieces_over_half_takes_one_sequence_each():
    assert packing.Plan({33: 5}, 64).bins == 5


@settings(max_examples=40, deadline=None)
@given(lengths=st.lists(st.integers(2, 12), min_size=1, max_size=7))
def test_reduction_keeps_an_optimum(lengths):
    def fewest(left, room, bins):
        if not left:
            return bins
        x, rest = left[0], left[1:]
        tries = {r for r in room if r >= x}
        out = fewest(rest, sorted([*room, 12 - x]), bins + 1)
        for r in tries:
            other = list(room)
            other.remove(r)
            out = min(out, fewest(rest, sorted([*other, r - x]), bins))
        return out

    plan = packing.Plan.__new__(packing.Plan)
    plan.capacity, plan.runs, plan.bins = 12, [], 0
    plan.left, plan.used = np.bincount(lengths, minlength=13), np.zeros(13, dtype=np.int64)
    while plan._reduce():
        pass
    rest = [n for n in range(12, 0, -1) for _ in range(int(plan.left[n]))]
    assert plan.bins + fewest(rest, [], 0) == fewest(sorted(lengths, reverse=True), [], 0)


def test_media_round_trips():
    rng = np.random.default_rng(1)
    for shape in ((1, 64), (37, 64), (5, 3)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(media.encode_pgm(image)) == image).all()
        assert (media.decode(media.encode_bmp(image)) == image).all()
        small = media.area_resize(image, 4, 3)
        big = np.kron(image.astype(float), np.ones((4, 3))).reshape(4, shape[0], 3, shape[1]).mean((1, 3))
        assert np.abs(small - big).max() <= 0.5 + 1e-6
    assert (media.decode(b"P3\n# c\n1 1 255\n1 2 3\n") == [[[1, 2, 3]]]).all()
    assert (media.decode(b"P1 2 1\n01") == [[255, 0]]).all()
    assert (media.decode(b"P4 2 1\n\x40") == [[255, 0]]).all()
    assert media.stored_form(None)[0] == 0 and media.decode(media.stored_form("")[1]).shape == (1, 64)
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_tall_images_are_summed_in_bands():
    image = np.random.default_rng(2).integers(0, 256, (media.BAND + 777, 64)).astype(np.uint8)
    whole = np.kron(image.astype(float).reshape(-1, 64).T, np.ones(8)).reshape(64, 8, -1).mean(2).T.reshape(8, 64)
    assert np.abs(media.area_resize(image, 8, 64) - whole).max() <= 0.5 + 1e-6


def test_string_kernel():
    from itertools import combinations

    def brute(s, t):
        return sum(
            toxicity.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
            for i in combinations(range(len(s)), 3)
            for j in combinations(range(len(t)), 3)
            if i[2] - i[0] < toxicity.SPAN and j[2] - j[0] < toxicity.SPAN and all(s[a] == t[b] for a, b in zip(i, j, strict=True))
        )

    for s, t in (("idiot", "idxiot"), ("abcab", "bcaab"), ("aaaa", "aaa"), ("abc", "xyz")):
        assert toxicity.Kernel([t]).values([s])[0, 0] == pytest.approx(brute(s, t) / (brute(s, s) * brute(t, t)) ** 0.5)


def test_toxicity_tolerates_insertions():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    clean = [" ".join(rng.choice(words, 30)) for _ in range(150)]
    toxic = [f"{a} {w} {b}" for a, b, w in zip(clean[:60], clean[60:120], ["blockhead", "dumbkopf", "gitface"] * 20, strict=True)]
    model = toxicity.Model(clean + toxic, [0] * 150 + [1] * 60)
    s = model.scores([clean[0], toxic[0], "you blo.ckhead", "a b l o c k h e a d", "", None])
    assert s[0] < 0.5 and s[1] > 0.5 and s[2] > 0.5 and s[3] > 0.5 and s[4] == s[5] < 0.5
    assert (toxicity.Model([], []).scores(["a"]) == 0).all() and (toxicity.Model(["a"], [1]).scores(["a"]) == 1).all()


def test_windows_hold_every_passage_once():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 19, 20, 150)]
    texts.append(np.tile(texts[0][:7], 12))  # ties
    block = substrings.Block(texts)
    keys, places = substrings.windows(block, 20, functions=1)
    begin = np.r_[0, np.cumsum(block.counts)]
    mixed = substrings.function_hashes(block.shingles, 0)
    want = set()
    for i, t in enumerate(texts):
        want |= {int(begin[i]) + a + int(mixed[begin[i] + a : begin[i] + a + 20].argmin()) for a in range(len(t) - 19)}
    assert sorted(want) == places.tolist() and (keys == substrings.function_keys(mixed[places], 0)).all()


def test_hot_keys_are_passed_over():
    """Each run of 20 has a window by its smallest hash that isn't hot, or, with none, is a key itself."""
    rng = np.random.default_rng(14)
    texts = [rng.integers(0, 60, n).astype(np.uint64) for n in (120, 15, 90)]
    block = substrings.Block(texts)
    h = substrings.function_hashes(block.shingles, 0)
    own = substrings.function_keys(h, 0)
    values = np.unique(block.shingles)
    hot_values = values[rng.random(len(values)) < 0.8]
    hot = np.unique((substrings.function_keys(substrings.function_hashes(hot_values, 0), 0) >> np.uint64(32)).astype(np.uint32))
    is_hot = np.isin(block.shingles, hot_values)
    keys, _, places = substrings.open_rows(block, 20, 1, hot)
    every, want = substrings.runs(block.shingles, 20), set()
    for a in np.flatnonzero(block.runs_inside(20)):
        if is_hot[a + h[a : a + 20].argmin()]:
            rest = np.flatnonzero(~is_hot[a : a + 20])
            # the run itself is a key where the smallest hash is hot
            want.add((int(substrings.mix64(every[a : a + 1])[0]), int(a)))
            if len(rest):
                at = a + rest[h[a + rest].argmin()]
                want.add((int(own[at]), int(at)))
    assert set(zip(keys.tolist(), places.tolist(), strict=True)) == want


def test_passages_bridge_small_edits():
    words = np.random.default_rng(5).integers(1, 2**32, 200).astype(np.uint32)
    edited = words.copy()
    edited[60] = 7
    found = substrings.passages([edited, words[:49], words, words[:3]], [words, words, words[150:], words], 5, 50, 0.8)
    assert found[0][0][:2] == (0, 200) and found[1] == [] and found[2] == [(150, 50, 1.0, 0, 50)] and found[3] == []
    assert substrings.cut_out("a b  c d", [(1, 2)]) == "a d" and substrings.cut_out("a b", [(0, 2)]) == ""


def test_filter_reads_levels_back():
    h = lm.mix64(np.arange(5000, dtype=np.uint64))
    counts = np.arange(1, 5001)
    own = lm.Filter.of(h, counts)
    found = own.counts(h)
    assert ((found >= counts / 2) & (np.floor(np.log2(counts)) <= np.log2(found))).all()
    assert (own.counts(lm.mix64(np.arange(10_000, 20_000, dtype=np.uint64))) > 0).mean() < 0.05


def test_block_search_is_exact(monkeypatch):
    monkeypatch.setattr(neighbours, "STEP", 16)
    rng = np.random.default_rng(6)
    v, q = rng.integers(-50, 50, (700, 8)), rng.integers(-50, 50, (5, 8))
    pivots = neighbours.Pivots(v[:300], float((v**2).sum(axis=1).max()), 16)
    ids = np.arange(700)
    scores = np.sort(v @ q.T, axis=0)[::-1]
    for least in (np.full(5, -np.inf), scores[9].astype(float)):
        i, j, s, seen = neighbours.best_in_block(q, np.arange(5) + 1000, pivots.of_queries(q), least, v, ids, ids, pivots.of_vectors(v), pivots.top2, 10)
        assert seen < 5 * 700
        for k in range(5):
            want = sorted(((-int(a), int(b)) for a, b in zip(v @ q[k], ids, strict=True)))[:10]
            assert [(-int(a), int(b)) for a, b in zip(s[i == k], j[i == k], strict=True)] == want


def test_near_duplicate_parts():
    a = neardup.shingle_set("a b c d e f")
    assert len(a) == 2 and len(neardup.shingle_set("a b")) == 1 and len(neardup.shingle_set(" \n")) == 0
    assert (neardup.shingle_set("A b C d E f") == a).all()
    seeds = neardup.minhash_seeds()
    assert (neardup.signature(a, seeds) == neardup.signature(a, seeds)).all()
    assert neardup.table_keys(neardup.signature(a, seeds)[None], neardup.GROUPS, neardup.WIDTH).shape == (1, 64)


def test_urls_and_schemas():
    x = np.random.default_rng(7).random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((urls.Trees().fit(x, y).predict(x) > 0.5) == y).mean() > 0.95
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}}, "additionalProperties": False}
    assert chat.faults({"a": 1}, schema) == []
    assert chat.faults({"a": 0, "b": 1}, schema) == ["$.a: below 1", "$.b: unknown"]
    assert chat.faults({"a": True}, schema) == ["$.a: not integer"] and chat.faults({}, schema) == ["$.a: missing"]
    assert chat.canonical({"b": "é", "a": [1, None]}) == '{"a":[1,null],"b":"é"}'


def test_every_oracle_is_sql_of_a_query():
    from voxelspring.llm.registry import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    assert all(isinstance(sql, str) for sql in ORACLES.values())
