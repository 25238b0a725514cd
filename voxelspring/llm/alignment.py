"""Alignment of two tokenizers over the same bytes.

A text's tokens have the byte offsets at which they end. The union of both tokenizers' ends cuts the text
into elementary intervals; a binary search gives each interval its token on either side, so an interval
is one overlap. Ends that both share close groups. Links are chosen from these: tokens that end together,
tokens that overlap, or every pair of a group, its product.

A scan of the texts encodes them once and keeps for each text its distinct linked id pairs with their
numbers. Pairs are counted over the corpus by partial sums; there can be no more than ids times ids.
Where the counted pairs are few enough (`most_pairs`), every task looks them up in a broadcast copy;
beyond that they are joined by a shuffle.

Defined results: texts that are null or empty, or whose tokens don't spell a space and the text (as where
U+2581 stands in it), have no tokens, zero counts and '' for groups_sha256; strings of special tokens
are plain text; a null doc_id stays null and rows with the same doc_id are texts of their own; an empty
table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspring.llm.common import as_batch, rows_of, stored, table
from voxelspring.llm.packing import LONG_RUN

LINKS = ("ends", "overlaps", "groups")
#: Distinct id pairs that are broadcast, at 13 bytes each.
MOST_PAIRS = 4_000_000
#: Pairs that a task sums before it hands them on.
TOGETHER = 4_000_000


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Side:
    """A tokenizer: encode gives the ids of a space and the text, or None where they don't spell it;
    spelled has the bytes of each id."""

    encode: object
    spelled: list[bytes]
    lengths: np.ndarray


def _side(encode, spelled: list[bytes]) -> Side:
    return Side(encode, spelled, np.array([len(b) for b in spelled], np.int64))


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """A byte-level BPE file of the tokenizers library. The merges run in an encoder with the same ranks;
    texts with very long runs go to the library itself."""
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(path).to_str())
    if spec["normalizer"] is not None or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError("not a plain byte-level vocabulary")
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    own.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable}
    shown |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    spelled = [b""] * (1 + max(max(ranks.values()), *(t["id"] for t in spec["added_tokens"])))
    for token, i in ranks.items():
        spelled[i] = token
    for t in spec["added_tokens"]:
        spelled[t["id"]] = t["content"].encode()

    def encode(text: str) -> np.ndarray:
        text = " " + text
        if LONG_RUN.search(text):
            ids = np.array(own.encode(text, add_special_tokens=False).ids, np.int64)
        else:
            ids = fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        # merges join bytes in their order, so bytes could only be missing
        return ids if lengths[ids].sum() == len(text.encode()) else None

    lengths = np.array([len(b) for b in spelled], np.int64)
    return _side(encode, spelled)


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """A sentencepiece model, which adds the space itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelled = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(text: str) -> np.ndarray | None:
        ids = model.encode(text, num_threads=1)
        return np.array(ids, np.int64) if b"".join(itemgetter(*ids, 0)(spelled)[:-1]) == b" " + text.encode() else None

    return _side(encode, spelled)


@dataclass(frozen=True)
class Aligned:
    """ids: of both sides; ends: byte offsets after each token; shared: ends that close groups; links:
    places of linked tokens on both sides."""

    ids: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    shared: np.ndarray
    links: tuple[np.ndarray, np.ndarray]


NOTHING = np.zeros(0, np.int64)


def linked(ends_a: np.ndarray, ends_b: np.ndarray, links: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(ends that both share, places of the linked tokens) of two token sequences over the same bytes."""
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    both = (ends_a[a] == cuts) & (ends_b[b] == cuts)
    shared = cuts[both]
    if links == "overlaps":
        return shared, (a, b)
    if links == "ends":
        return shared, (a[both], b[both])
    last_a, last_b = a[both] + 1, b[both] + 1
    first_a, first_b = np.concatenate([[0], last_a[:-1]]), np.concatenate([[0], last_b[:-1]])
    wide, high = last_b - first_b, last_a - first_a
    n = wide * high
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    across = np.repeat(wide, n)
    return shared, (np.repeat(first_a, n) + nth // across, np.repeat(first_b, n) + nth % across)


def align(text: str | None, a: Side, b: Side, links: str = "ends") -> Aligned:
    if text:
        ids = a.encode(text), b.encode(text)
        if ids[0] is not None and ids[1] is not None:
            ends = tuple(np.cumsum(s.lengths[own]) for s, own in zip((a, b), ids, strict=True))
            return Aligned(ids, ends, *linked(*ends, links))
    return Aligned((NOTHING, NOTHING), (NOTHING, NOTHING), NOTHING, (NOTHING, NOTHING))


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None, links: str = "ends") -> DataFrame:
    """The alignment itself: (doc_id, ids_a, ids_b, ends_a, ends_b, shared_ends, link_a, link_b), where
    link_a and link_b are places of tokens from 0."""
    path_a, path_b = paths or default_paths()
    names = ("ids_a", "ids_b", "ends_a", "ends_b", "shared_ends", "link_a", "link_b")

    def run(batches):
        a, b = byte_level(path_a), pieces(path_b)
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            found = align(text, a, b, links)
            values = (*found.ids, *found.ends, found.shared, *found.links)
            yield as_batch({"doc_id": ([doc_id], pa.int64())} | {n: ([v], pa.list_(pa.int64())) for n, v in zip(names, values, strict=True)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} array<long>" for n in names))


class Spelling:
    """The text of a grouping: decimal ids of a group, `a1,a2|b1,b2`, groups apart by `;`."""

    def __init__(self, a: Side, b: Side):
        n, m = len(a.spelled), len(b.spelled)
        self.size, self.start = (n, m), (0, n, 2 * n, 2 * n + m)
        self.parts = [f"{i}{sep}".encode() for k, sep in ((n, ","), (n, "|"), (m, ","), (m, ";")) for i in range(k)]

    def text(self, found: Aligned) -> bytes:
        sides = []
        for side, (ids, ends) in enumerate(zip(found.ids, found.ends, strict=True)):
            closes = np.isin(ends, found.shared, assume_unique=True)
            group = np.cumsum(closes) - closes
            sides.append((ids + np.where(closes, self.start[2 * side + 1], self.start[2 * side]), group))
        (code_a, group_a), (code_b, group_b) = sides
        # where each token comes when groups follow each other, side a before side b
        groups = len(found.shared)
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=groups))])
        upto_a = np.cumsum(np.bincount(group_a, minlength=groups))
        out = np.empty(len(code_a) + len(code_b), np.int64)
        out[np.arange(len(code_a)) + before_b[group_a]] = code_a
        out[np.arange(len(code_b)) + upto_a[group_b]] = code_b
        return b"".join(itemgetter(*out.tolist())(self.parts))[:-1]


FIRST = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def _encoded(docs: DataFrame, paths: tuple[str, str], links: str) -> DataFrame:
    """A row for each text with its distinct linked pairs: codes (id of a, times the ids of b, plus id of
    b) and how often, as 4-byte numbers."""
    path_a, path_b = paths
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
    names = [f.split()[0] for f in FIRST.split(", ")]

    def run(batches):
        a, b = byte_level(path_a), pieces(path_b)
        spelling, out, size = Spelling(a, b), [], 0
        for row, doc_id, text in rows_of(batches, "row", "doc_id", "text"):
            found = align(text, a, b, links)
            pairs = found.ids[0][found.links[0]] * len(b.spelled) + found.ids[1][found.links[1]]
            codes, times = np.unique(pairs.astype("<u4"), return_counts=True)
            groups = sha256(spelling.text(found)).hexdigest() if len(found.shared) else ""
            out.append((row, doc_id, len(found.ids[0]), len(found.ids[1]), len(found.shared), len(pairs), groups, codes.tobytes(), times.astype("<u4").tobytes()))
            size += 8 * len(codes)
            if size > 4 << 20 or len(out) == 5000:
                yield as_batch(dict(zip(names, zip(zip(*out, strict=True), kinds, strict=True), strict=True)))
                out, size = [], 0
        if out:
            yield as_batch(dict(zip(names, zip(zip(*out, strict=True), kinds, strict=True), strict=True)))

    if len(byte_level(path_a).spelled) * len(pieces(path_b).spelled) >= 1 << 32:
        raise ValueError("more id pairs than 4-byte numbers")
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(own.mapInArrow(run, FIRST))


def _numbers(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u4").astype(np.int64)


def pair_counts(encoded: DataFrame, ids_b: int) -> DataFrame:
    """(code, n, best): links that hold each pair over all texts; best: no other pair of its b has more."""

    def summed(batches):
        def merged(codes, times):
            codes, at = np.unique(np.concatenate(codes), return_inverse=True)
            return codes, np.bincount(at, np.concatenate(times), len(codes)).astype(np.int64)

        codes, times, n = [], [], 0
        for batch in batches:
            codes.append(_numbers(batch.column("codes").to_pylist()))
            times.append(_numbers(batch.column("times").to_pylist()))
            n += len(codes[-1])
            if n > TOGETHER:
                own = merged(codes, times)
                codes, times, n = [own[0]], [own[1]], 0
                if len(own[0]) > TOGETHER // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1])], names=["code", "n"])
                    codes, times = [], []
        if codes:
            own = merged(codes, times)
            yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1])], names=["code", "n"])

    counts = encoded.select("codes", "times").mapInArrow(summed, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.col("code") % ids_b))
    return stored(counts.withColumn("best", F.col("n") == top))


def _looked_up(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts by a broadcast copy of all pairs."""
    found = counts.orderBy("code").toArrow()
    copy = encoded.sparkSession.sparkContext.broadcast((found.column("code").to_numpy().astype(np.uint32), found.column("n").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)))
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links")

    def run(batches):
        known, n, best = copy.value
        for batch in batches:
            codes, times = (batch.column(c).to_pylist() for c in ("codes", "times"))
            sums, bests = [], []
            for c, t in zip(codes, times, strict=True):
                at, t = np.searchsorted(known, np.frombuffer(c, "<u4")), np.frombuffer(t, "<u4").astype(np.int64)
                sums.append(int(n[at] @ t))
                bests.append(int(t[best[at]].sum()))
            values = [*(batch.column(c) for c in columns), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(values, names=[*columns, "n_best", "count_sum", "groups_sha256"])

    return encoded.drop("row").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _joined(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts by a join on the pair; a pair has one row for each text at most."""

    def spread(batches):
        for batch in batches:
            for row, codes, times in rows_of([batch], "row", "codes", "times"):
                own = _numbers([codes])
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row)), pa.array(own), pa.array(_numbers([times]))], names=["row", "code", "times"])

    each = encoded.select("row", "codes", "times").mapInArrow(spread, "row long, code long, times long").join(counts, "code")
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return encoded.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, links: str = "ends", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text; the last two
    counts weigh its links by how often the corpus has them."""
    paths = paths or default_paths()
    encoded = _encoded(docs, paths, links)
    counts = pair_counts(encoded, len(pieces(paths[1]).spelled))
    return (_looked_up if counts.count() <= most_pairs else _joined)(encoded, counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
