"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest

from voxelspring.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx long, part int"


def hexed(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text) -> str:
    return hexed(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(row: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top, and for each leaf the (left, right) siblings level by level."""
    ways, at = [[] for _ in row], list(range(len(row)))
    while len(row) > 1:
        for leaf, i in enumerate(at):
            group = i - i % 3
            ways[leaf].append(("".join(row[group:i]), "".join(row[i + 1 : group + 3])))
        at = [i // 3 for i in at]
        row = [hexed(*row[k : k + 3]) for k in range(0, len(row), 3)]
    return row[0], ways


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0], leaf_of(*r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        own = sorted(by_source[source], key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
        trees.append((own, *plain_tree([t[1] for t in own])))
    root, last = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, ways), end in zip(trees, last, strict=True):
        for (doc_id, leaf, r), way in zip(own, ways, strict=True):
            now = leaf
            if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 2 == 0 and r[4] is not None:
                now = leaf_of(*r[:4], r[4].replace("\n", ""))
            for left, right in way + end:
                now = hexed(left, now, right)
            out.append((doc_id, leaf, subroot, root, hexed(*(a + b for a, b in way + end)), now, now == root))
    return sorted(out, key=str)


def rows_of_sources() -> list[tuple]:
    sizes = {None: 5, "": 1, "a": 31, "b": 2, "Z": 27, "é": 3, "\U00010000": 4, "￿": 10, **{f"s{i:02}": 1 for i in range(12)}}
    rows, doc_id = [], -3
    for source, n in sizes.items():
        for k in range(n):
            text = [None, "", "one\ntwo\n", "plain é", "\n"][doc_id % 5]
            rows.append((doc_id, source, None if k % 3 else "en", None if k % 4 == 1 else k, text))
            doc_id += 1
    return rows + [rows[7], rows[7], (None, "a", None, None, "x\n"), (None, None, "x", 3, None)]


@pytest.mark.parametrize(("block", "climb"), [(1, 1), (2, 1), (6, 6)])
def test_equals_a_plain_tree(spark, block, climb):
    rows = rows_of_sources()
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)
    found = merkle.manifest(docs, block=block, climb=climb)
    assert sorted(map(tuple, found.collect()), key=str) == plain_manifest(rows)


def test_one_row_and_none(spark):
    row = (9, None, None, None, None)
    one = merkle.manifest(spark.createDataFrame([(*row, None, None, None)], SCHEMA)).collect()
    assert [tuple(r) for r in one] == plain_manifest([row]) and one[0].leaf == one[0].root == one[0].folded_root
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_any_run_of_leaves_grows_whole():
    """Subtrees of runs of a cut tree tile it, and blocks put together give the tops of the whole tree."""
    for n in range(1, 40):
        leaves = [hexed(str(i)).encode() for i in range(n)]
        for cut in range(n + 1):
            parts = [*merkle.grown(0, leaves[:cut], n, 2), *merkle.grown(cut, leaves[cut:], n, 2)]
            assert sum(min((i + 1) * 3**level, n) - i * 3**level for level, i, _, _ in parts) == n
