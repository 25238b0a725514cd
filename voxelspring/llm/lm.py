"""Language-model scoring from a log-frequency Bloom filter of n-gram counts.

Training counts words and word pairs (each text ends with an end token; a pair's first member may be
the start of a text). Tasks count their own texts first and hand sorted arrays of hashes and counts
to shards, so a frequent word costs an entry for each task. A shard sums them and inserts each
pair's hash with the levels 1..q, q = 1 + floor(log2 count), into its part of the filter. A count is
read back by probing level after level until one is missing; it is taken as the middle of its level.

The model is log10 of (1 - w) * base(v) + w * c(u, v) / c(u), with w = WEIGHT * c(u) / (c(u) + HALF)
and the counts of pairs from the filter (at most c(u) and c(v)); base is the add-one unigram
probability that is also reported by itself. Word counts are kept exactly, as the base needs them.

Filter and word counts go to the workers by broadcast while they stay under `broadcast_limit`
bytes. Beyond it the same filter is probed where its shards are: chunks of texts send their
distinct hashes to the shards, as compressed differences, and get the levels back. Both ways give
the same scores.

Defined results: a null text is the empty text and has the end token alone; a null doc_id counts as
the empty text when rows are dealt into training and held-out; repeated rows count again; without
training rows all counts are 0; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspring.llm.common import crc_bucket, mix64, shuffle_partitions, stored, table, word_hashes, words_of

WEIGHT, HALF = 0.5, 10.0
#: Bits of the filter for each entry, and probes for each.
BITS, PROBES = 10, 4
MAX_LEVEL = 48
BROADCAST_LIMIT = 256 << 20
#: Tokens counted at once by a task, tokens in a chunk of the sharded way, entries in a shard.
FLUSH, CHUNK, SHARD = 1_200_000, 1_200_000, 1_000_000
END = np.uint64(0x1F3D5B79)
START = np.uint64(0x2E4C6A88)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words and of the end token."""
    return np.append(word_hashes(words_of(text)), END)


def pairs(of: np.ndarray) -> np.ndarray:
    """A hash for each token with the one before it."""
    before = np.concatenate([[START], of[:-1]]).astype(np.uint64)
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + (of ^ (of >> np.uint64(31))))


#: Low bits of a pair's place that tell it from others of its shard; its shard lies above them.
PLACE = np.uint64(32)
KEY = np.uint64((1 << 32) - 1)


def places(of: np.ndarray, shards: int) -> np.ndarray:
    """For each pair hash its shard and, below, the 32 bits by which the shard knows it. Shards grow in number
    with the texts and hold about SHARD pairs, so a new pair has the bits of another in one case of 4,000 at
    most; the filter itself errs in one of 80."""
    h = mix64(of)
    return ((h >> PLACE) % np.uint64(shards)) << PLACE | (h & KEY)


def cut(sorted_places: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's places begin, and the end."""
    return np.searchsorted(sorted_places, np.arange(shards + 1, dtype=np.uint64) << PLACE)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def loosened(data: bytes) -> bytes:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def planes(of: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: the high ones compress well."""
    return of.view(np.uint8).reshape(len(of), of.itemsize).T.tobytes()


def numbers(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def packed(of: np.ndarray, kind: type = np.uint32) -> bytes:
    """Sorted numbers, as their differences: places of one shard without the shard, or word hashes (uint64)."""
    return squeezed(planes(np.diff(of.astype(kind), prepend=kind(0))))


def unpacked(data: bytes, shard: int | None = None) -> np.ndarray:
    """What packed() had: places of the shard, or without one word hashes."""
    if shard is None:
        return np.cumsum(numbers(loosened(data), np.uint64), dtype=np.uint64)
    return np.uint64(shard) << PLACE | np.cumsum(numbers(loosened(data), np.uint32), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte for each count; those from 255 on follow in full."""
    return squeezed(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes())


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    data = loosened(data)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data[n:], np.int64)
    return out


def middle(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for; 0 for none."""
    levels = levels.astype(np.int64)
    return np.where(levels > 0, (np.exp2(np.maximum(levels, 1) - 1.0) + np.exp2(np.maximum(levels, 1) * 1.0) - 1) / 2, 0.0)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((mix64(hashes) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def by_shard(words: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct words by shard, and in it by hash, and where each shard's begin."""
    to = shard_of(words, shards)
    order = np.lexsort((words, to))
    return order, np.searchsorted(to[order], np.arange(shards + 1))


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return hashes.astype(np.uint64), counts.astype(np.int64)
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    at = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    return hashes[at], np.add.reduceat(counts.astype(np.int64), at)


def positions(hashes: np.ndarray, level: int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    h = mix64(hashes + np.uint64((level * 0x632BE59BD9B4E019 + probe * 0xD6E8FEB86659FD93) % 2**64))
    return (h % np.asarray(bits, dtype=np.uint64)).astype(np.int64)


class Filter:
    """Bits of one shard, or of all with `offset` and `size` of each in bits; then places tell the shard."""

    def __init__(self, bits: np.ndarray, offset: np.ndarray, size: np.ndarray):
        self.bits, self.offset, self.size = bits, offset, size

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray) -> Filter:
        levels = np.minimum(1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64), MAX_LEVEL)
        size = max(64, -(-int(levels.sum()) * BITS // 8) * 8)
        marks = np.zeros(size, dtype=np.uint8)
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = hashes[levels >= level]
            for probe in range(PROBES):
                marks[positions(own, level, probe, size)] = 1
        return cls(np.packbits(marks, bitorder="little"), np.zeros(1, np.int64), np.array([size]))

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's level; 0 where the first is missing."""
        shards = (hashes >> PLACE).astype(np.int64) if len(self.size) > 1 else np.zeros(len(hashes), np.int64)
        level_of = np.zeros(len(hashes), dtype=np.int64)
        left = np.arange(len(hashes))
        for level in range(1, MAX_LEVEL + 1):
            for probe in range(PROBES):
                at = self.offset[shards[left]] + positions(hashes[left], level, probe, self.size[shards[left]])
                left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not len(left):
                break
            level_of[left] = level
        return level_of

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """The middle of each hash's level; 0 where the first level is missing."""
        return middle(self.levels(hashes))


def lookup(hashes: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, counts[at], 0)


def score(words: np.ndarray, cv: np.ndarray, cu: np.ndarray, cuv: np.ndarray, total: int, distinct: int) -> tuple[float, float]:
    base = (cv + 1.0) / (total + distinct + 1.0)
    weight = WEIGHT * cu / (cu + HALF)
    after = np.where(cu > 0, np.minimum(cuv, np.minimum(cu, cv)) / np.maximum(cu, 1), 0.0)
    return float(np.log10(base).sum()), float(np.log10((1 - weight) * base + weight * after).sum())


class Model:
    """Shards of the filter and of the word counts. shards: table (shard, words, counts, bits, size)."""

    def __init__(self, shards: DataFrame, count: int):
        self.shards, self.count = shards, count
        found = shards.agg(F.sum("distinct"), F.sum("total"), F.sum("texts"), F.sum(16 * F.col("distinct") + F.octet_length("bits"))).first()
        self.distinct, self.total, self.texts, self.bytes = (int(x or 0) for x in found)

    def gathered(self) -> tuple[np.ndarray, np.ndarray, Filter]:
        """All shards in driver memory; only for models under the broadcast limit."""
        size = np.full(self.count, 64, dtype=np.int64)
        for r in self.shards.select("shard", "size").collect():
            size[r["shard"]] = r["size"]
        offset = np.r_[0, np.cumsum(size)]
        # filled in place, so that the driver never holds the model twice
        bits = np.zeros(int(offset[-1]) // 8, dtype=np.uint8)
        words, counts, at = np.zeros(self.distinct, np.uint64), np.zeros(self.distinct, np.int64), 0
        for r in self.shards.select("shard", "words", "counts", "bits").toLocalIterator():
            own = unpacked(r["words"])
            words[at : at + len(own)], counts[at : at + len(own)] = own, unpacked_counts(r["counts"], len(own))
            at += len(own)
            begin = int(offset[r["shard"]]) // 8
            bits[begin : begin + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
        order = np.argsort(words)
        return words[order], counts[order], Filter(bits, offset[:-1], size)


def train(texts: DataFrame) -> Model:
    """texts: one column, text."""
    spark = texts.sparkSession
    characters = int(texts.agg(F.sum(F.length("text"))).first()[0] or 0)
    shards = max(shuffle_partitions(spark), -(-characters // (6 * SHARD)))

    def counted(batches):
        kept: list[np.ndarray] = []

        def flush():
            h, c = np.unique(np.concatenate(kept), return_counts=True)
            order, edges = by_shard(h, shards)
            rows = [(s, 0, packed(h[order[a:b]], np.uint64), packed_counts(c[order[a:b]])) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            h, c = np.unique(places(np.concatenate([pairs(t) for t in kept]), shards), return_counts=True)
            edges = cut(h, shards)
            rows += [(s, 1, packed(h[a:b]), packed_counts(c[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "kind", "hashes", "counts"])

        n = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                kept.append(tokens(text))
                n += len(kept[-1])
                if n >= FLUSH:
                    n = 0
                    yield flush()
        if kept:
            yield flush()

    def merged(t: pa.Table) -> pa.Table:
        parts: dict[int, list] = {0: [], 1: []}
        shard = t.column("shard")[0].as_py()
        for kind, h, c in zip(*(t.column(n).to_pylist() for n in ("kind", "hashes", "counts")), strict=True):
            h = unpacked(h, shard if kind else None)
            parts[kind].append((h, unpacked_counts(c, len(h))))
        (w, wc), (p, pc) = (summed(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts[k])]), np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts[k])])) for k in (0, 1))
        own = Filter.of(p, pc)
        return pa.table({"shard": t.column("shard")[:1], "words": pa.array([packed(w, np.uint64)], pa.binary()), "counts": pa.array([packed_counts(wc)], pa.binary()), "bits": pa.array([own.bits.tobytes()], pa.binary()), "size": pa.array([int(own.size[0])], pa.int64()), "distinct": pa.array([len(w)], pa.int64()), "total": pa.array([int(wc.sum())], pa.int64()), "texts": pa.array([int(lookup(np.array([END]), w, wc)[0])], pa.int64())})

    made = texts.select(F.col("text").cast("string")).mapInArrow(counted, "shard long, kind long, hashes binary, counts binary").groupBy("shard").applyInArrow(merged, "shard long, words binary, counts binary, bits binary, size long, distinct long, total long, texts long")
    return Model(stored(made), shards)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def rows_scored(ids, held, docs: list[np.ndarray], cv: np.ndarray, cuv: np.ndarray, total: int, distinct: int, texts: int) -> list[list]:
    out: list[list] = [[] for _ in NAMES]
    at = 0
    for doc_id, h, words in zip(ids, held, docs, strict=True):
        n = len(words)
        own = cv[at : at + n]
        base, full = score(words, own, np.concatenate([[texts], own[:-1]]), cuv[at : at + n], total, distinct)
        for to, value in zip(out, (doc_id, h, n, int((own > 0).sum()), total, base, full), strict=True):
            to.append(value)
        at += n
    return out


def score_by_broadcast(docs: DataFrame, model: Model) -> DataFrame:
    sent, shards = docs.sparkSession.sparkContext.broadcast((*model.gathered(), model.total, model.distinct, model.texts)), model.count

    def run(batches):
        words, counts, pair_filter, total, distinct, texts = sent.value
        for batch in batches:
            for a in range(0, len(batch), 1_000):
                part = batch.slice(a, 1_000)
                own = [tokens(t) for t in part.column("text").to_pylist()]
                flat = np.concatenate(own)
                unique, back = np.unique(flat, return_inverse=True)
                cv = lookup(unique, words, counts)[back]
                both = places(np.concatenate([pairs(t) for t in own]), shards)
                out = rows_scored(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), own, cv, pair_filter.counts(both), total, distinct, texts)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, TYPES, strict=True)], names=NAMES)

    return docs.mapInArrow(run, SCHEMA)


def score_by_shards(docs: DataFrame, model: Model) -> DataFrame:
    """Chunks of texts ask the shards for the counts of their distinct hashes. A chunk's texts, as places in its
    list of words, go along with the questions, so nothing is stored or made twice on the way."""
    shards, total, distinct, texts = model.count, model.total, model.distinct, model.texts
    fields = "chunk long, shard long, kind long, first binary, second binary"
    names, types = ["chunk", "shard", "kind", "first", "second"], (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def asked(batches):
        """Of each chunk: questions (kind 0 words, 1 pairs), by shard and within it in order, and its texts
        (kind 2, to any shard): ids, and the place of each token in the list of words."""
        made, task, ids, held, own, n = 0, TaskContext.get().partitionId(), [], [], [], 0

        def flush():
            chunk = (task << 32) + made
            words, back, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            order, edges = by_shard(words, shards)
            rows = [(chunk, s, 0, packed(words[order[a:b]], np.uint64), b"") for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            # places in the list of words, frequent ones first: most are small numbers then
            first = np.argsort(-often[order], kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order[first]] = np.arange(len(words))
            text = planes(first.astype(np.uint32)) + planes(rank[back])
            both = np.unique(places(np.concatenate([pairs(t) for t in own]), shards))
            edges = cut(both, shards)
            rows += [(chunk, s, 1, packed(both[a:b]), b"") for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            head = np.array([[-1 if i is None else i, i is None, bool(h), len(t)] for i, h, t in zip(ids, held, own, strict=True)], dtype=np.int64)
            return batch_of([*rows, (chunk, chunk % shards, 2, head.tobytes(), len(words).to_bytes(4, "little") + squeezed(text))])

        for batch in batches:
            for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                ids.append(i), held.append(h), own.append(tokens(t))
                n += len(own[-1])
                if n >= CHUNK:
                    yield flush()
                    made, ids, held, own, n = made + 1, [], [], [], 0
        if own:
            yield flush()

    def answered(key, questions: pa.Table, shard: pa.Table) -> pa.Table:
        """Words with their counts, levels of pairs; texts pass."""
        if not len(questions):
            return questions
        nth = key[0].as_py()
        words, counts, own = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        if len(shard):
            words = unpacked(shard.column("words")[0].as_py())
            counts = unpacked_counts(shard.column("counts")[0].as_py(), len(words))
            own = Filter(np.frombuffer(shard.column("bits")[0].as_py(), np.uint8), np.zeros(1, np.int64), np.array([shard.column("size")[0].as_py()]))
        out, also = [], questions.column("second").to_pylist()
        for i, (kind, data) in enumerate(zip(questions.column("kind").to_pylist(), questions.column("first").to_pylist(), strict=True)):
            if kind == 0:
                also[i] = squeezed(planes(lookup(unpacked(data), words, counts).astype(np.int64)))
            elif kind == 1:
                h = unpacked(data, nth)
                data = squeezed((np.zeros(len(h)) if own is None else own.levels(h)).astype(np.uint8).tobytes())
            out.append(data)
        return questions.set_column(3, "first", pa.array(out, pa.binary())).set_column(4, "second", pa.array(also, pa.binary()))

    def finished(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("kind", "shard", "first", "second")), strict=True), key=lambda r: r[:2])
        first, second = next(r[2:] for r in rows if r[0] == 2)
        head = np.frombuffer(first, np.int64).reshape(-1, 4)
        n, text = int.from_bytes(second[:4], "little"), loosened(second[4:])
        # answers, by shard, are in the order of by_shard() and of distinct pairs
        words, counts = (np.concatenate(x) for x in zip(*((unpacked(r[2]), numbers(loosened(r[3]), np.int64)) for r in rows if r[0] == 0), strict=True))
        levels = np.frombuffer(b"".join(loosened(r[2]) for r in rows if r[0] == 1), np.uint8)
        back = numbers(text[: 4 * n], np.uint32)[numbers(text[4 * n :], np.uint32)]
        flat, ends = words[back], np.cumsum(head[:, 3])
        both = np.concatenate([pairs(flat[e - k : e]) for e, k in zip(ends, head[:, 3], strict=True)])
        at = np.unique(places(both, shards), return_inverse=True)[1]
        cv = counts[back].astype(np.float64)
        out = rows_scored([None if r[1] else int(r[0]) for r in head], [bool(r[2]) for r in head], [np.empty(k) for k in head[:, 3]], cv, middle(levels)[at], total, distinct, texts)
        return pa.table([pa.array(v, t) for v, t in zip(out, TYPES, strict=True)], names=NAMES)

    rows = docs.mapInArrow(asked, fields)
    answers = rows.groupBy("shard").cogroup(model.shards.select("shard", "words", "counts", "bits", "size").groupBy("shard")).applyInArrow(answered, fields)
    return answers.groupBy("chunk").applyInArrow(finished, SCHEMA)


def score_documents(docs: DataFrame, buckets: int = 7, held_bucket: int = 2, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (crc_bucket("doc_id", buckets) == held_bucket).alias("held_out"))
    model = train(own.where(~F.col("held_out")).select("text"))
    return (score_by_broadcast if model.bytes <= broadcast_limit else score_by_shards)(own, model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
