"""Cross-tokenizer alignment against the libraries and plain loops."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from voxelspring.llm import alignment

SF = "/root/testdata/sf0.001/documents.parquet"
ODD = [None, "", " ", "  ", "a ", " a  b ", "\n\tx\n", "<s> </s> <unk> <0x41> <|endoftext|>", "▁x", "é ñ\U0001f600", "a\x00b", "x" * 4000, " " * 3000 + "y", "ก́ 中文", "it's 12,345.67"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def plain(text, libraries) -> tuple[list[int], list[int], list[tuple[list[int], list[int]]], list[tuple[int, int]]]:
    """Ids of both, groups of ids, and linked ids, by walking over both sequences."""
    a, b = libraries
    if not text:
        return [], [], [], []
    whole = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], [], []
    groups, links, i, j, at_a, at_b, own_a, own_b = [], [], 0, 0, 0, 0, [], []
    while i < len(ids_a) or j < len(ids_b):
        if at_a <= at_b:
            at_a, i = at_a + len(bytes_a[i]), i + 1
            own_a.append(ids_a[i - 1])
        else:
            at_b, j = at_b + len(bytes_b[j]), j + 1
            own_b.append(ids_b[j - 1])
        if at_a == at_b and own_a and own_b:
            groups.append((own_a, own_b))
            links.append((own_a[-1], own_b[-1]))
            own_a, own_b = [], []
    return ids_a, ids_b, groups, links


def plain_rows(rows, libraries) -> list[tuple]:
    found = [(doc_id, *plain(text, libraries)) for doc_id, text in rows]
    counts = Counter(link for *_, links in found for link in links)
    best: dict[int, int] = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def test_whole_table_equals_the_libraries(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet(SF).select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.query(spark, SF.rsplit("/", 1)[0]).collect()), key=str) == plain_rows(rows, libraries)


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 0])
def test_odd_texts_and_both_ways(spark, libraries, most_pairs):
    draw = random.Random(4)
    made = ["".join(draw.choices("ab '1.\n\té中▁ X", weights=[9, 9, 9, 2, 3, 2, 1, 1, 1, 1, 0.1, 1, 2], k=draw.randrange(80))) for _ in range(200)]
    rows = [*enumerate(ODD + made), (3, "same id"), (3, "same id"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, code string, row int")
    assert sorted(map(tuple, alignment.aligned(docs, most_pairs=most_pairs).collect()), key=str) == plain_rows(rows, libraries)
    assert alignment.aligned(spark.createDataFrame([], docs.schema), most_pairs=most_pairs).count() == 0


def test_kinds_of_links():
    draw = np.random.default_rng(3)
    for _ in range(200):
        n = int(draw.integers(1, 40))
        a, b = (np.append(np.flatnonzero(draw.random(n - 1) < 0.5) + 1, n) for _ in "ab")
        spans = [list(zip(np.concatenate([[0], e[:-1]]).tolist(), e.tolist(), strict=True)) for e in (a, b)]
        both = sorted(set(a.tolist()) & set(b.tolist()))
        group = [np.searchsorted(both, [e for _, e in s]).tolist() for s in spans]
        for links, holds in (
            ("ends", lambda i, j: spans[0][i][1] == spans[1][j][1]),
            ("overlaps", lambda i, j: max(spans[0][i][0], spans[1][j][0]) < min(spans[0][i][1], spans[1][j][1])),
            ("groups", lambda i, j: group[0][i] == group[1][j]),
        ):
            shared, (left, right) = alignment.linked(a, b, links)
            want = [(i, j) for i in range(len(a)) for j in range(len(b)) if holds(i, j)]
            assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == want and shared.tolist() == both


def test_the_alignment_itself(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    one, none = alignment.alignments(docs).orderBy("doc_id").collect()
    assert one.ends_a[-1] == one.ends_b[-1] == one.shared_ends[-1] == len(" hello world") and one.link_a[-1] == len(one.ids_a) - 1
    assert none.ids_a == [] and none.link_b == []
