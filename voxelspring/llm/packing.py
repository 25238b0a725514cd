"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

The texts are tokenised and cut into pieces in one scan. The instance is then the count of pieces
of each length, of which there are at most `capacity`, so the driver solves it whole: its size
depends on the capacity and not on the corpus. Runs of equal pieces are packed at once, which
gives the plan the same bound. Every piece finds its place from its rank among those of its length.

Defined results: a null text is the empty text and has one piece with the end token alone; a
repeated row is packed again; a null doc_id stays null; an empty table gives no rows; further
columns of the input don't matter.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspring.llm.common import rows_of, stored, table

CAPACITY = 1024
END_ID = 2
#: Longer runs without (or of) white space go to the library whose merges take n log n steps.
LONG_RUN = re.compile(r"\S{1500}|\s{1500}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids, as the tokenizers library gives them for this file.

    The ranks are read from that file and handed to a faster encoder of the same kind; texts with
    very long runs, and files of another shape, are encoded by the library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()

    def slow(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    spec = json.loads(own.to_str())
    model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or model["end_of_word_suffix"] or model["unk_token"]:
        return slow
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if LONG_RUN.search(text):
            return slow(text)
        return fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)

    return encode


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece, with the task that made it and its rank there among equal lengths."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("chunk", pa.int64()), ("local_rank", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        encode, chunk = encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        out = [[] for _ in fields[:5]]
        ranks = []
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
            count = -(-len(ids) // capacity)
            cut = len(ids) - capacity * (count - 1)
            edges = [0, *range(cut, len(ids) + 1, capacity)]
            for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                for to, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                    to.append(value)
                ranks.append(int(seen[b - a]))
                seen[b - a] += 1
            if len(ranks) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip([*out, [chunk] * len(ranks), ranks], fields, strict=True)], schema=schema)
                out, ranks = [[] for _ in fields[:5]], []
        if ranks:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip([*out, [chunk] * len(ranks), ranks], fields, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, local_rank long")


class Plan:
    """Runs of equal pieces: those of `length` with ranks from `rank` on fill `bins` sequences from
    `base` on, `each` in a sequence, the first of them at `offset`."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.runs, self.bins = capacity, [], 0
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, dtype=np.int64)
        self.items, self.tokens = int(self.left.sum()), int((self.left * np.arange(capacity + 1)).sum())
        while self._reduce():
            pass
        self.fixed = self.bins
        self._best_fit()

    def _emit(self, pattern: list[tuple[int, int]], bins: int) -> None:
        offset = 0
        for length, each in pattern:
            self.runs.append((length, int(self.used[length]), bins * each, each, offset, self.bins))
            self.used[length] += bins * each
            self.left[length] -= bins * each
            offset += length * each
        self.bins += bins

    def _largest(self, most: int, taken: tuple[int, ...] = ()) -> int:
        """The largest length up to `most` of which a piece is left besides those taken; 0: none."""
        while most > 0 and self.left[most] - taken.count(most) <= 0:
            most -= 1
        return most

    def _fits(self, room: int, taken: int) -> int:
        """How many of the smallest other pieces fit in `room`, counted up to 3."""
        count = total = 0
        for length in np.flatnonzero(self.left[: room + 1]):
            more = min(int(self.left[length]) - (length == taken), (room - total) // int(length), 3 - count)
            if more <= 0 and self.left[length] - (length == taken) > 0:
                break
            count, total = count + max(0, more), total + max(0, more) * int(length)
            if count >= 3:
                break
        return count

    def _dominating(self, j: int) -> list[int] | None:
        """Pieces that, put with a piece of length j, make a sequence that dominates every other
        one with such a piece: each part of the other's content can be moved into a piece of this
        one that is as long, so some optimum holds it. None if no set of up to three pieces is
        shown to do so."""
        room = self.capacity - j
        k = self._fits(room, j)
        if k == 0:
            return []
        best = self._largest(room, (j,))
        if k == 1 or best == room:
            return [best]
        if k > 2:
            return None
        pair, low, a = (0, 0), 0, best
        while a > 0:
            b = self._largest(min(a, room - a), (j, a))
            if b:
                pair, low = max(pair, (a + b, a)), max(low, b)
            a = self._largest(a - 1, (j,))
        if best >= pair[0]:
            return [best]
        a, b = pair[1], pair[0] - pair[1]
        # {j, x, y}: x goes with a, which is the largest that fits, and y with b if none is longer
        return [a, b] if a == best and low <= b else None

    def _reduce(self) -> bool:
        """One pass of the reduction from the longest piece down; True if it fixed anything."""
        before = self.bins
        for j in range(self.capacity, 0, -1):
            while self.left[j] > 0 and (found := self._dominating(j)) is not None:
                each: dict[int, int] = {}
                for length in [j, *found]:
                    each[length] = each.get(length, 0) + 1
                # removing copies only takes alternatives away, so the set goes on dominating
                self._emit(list(each.items()), min(int(self.left[x]) // n for x, n in each.items()))
        return self.bins > before

    def _best_fit(self) -> None:
        """Best fit, longest first, over groups of equally filled sequences."""
        groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

        def put(pattern, bins):
            if bins:
                groups.setdefault(self.capacity - sum(x * n for x, n in pattern), []).append((pattern, bins))

        for length in range(self.capacity, 0, -1):
            n = int(self.left[length])
            while n:
                room = min((r for r in groups if r >= length), default=None)
                if room is None:
                    pattern, bins, room = [], n, self.capacity
                else:
                    pattern, bins = groups[room].pop()
                    if not groups[room]:
                        del groups[room]
                most = room // length
                full = min(bins, n // most)
                put([*pattern, (length, most)], full)
                n -= full * most
                if full < bins and n:
                    put([*pattern, (length, n)], 1)
                    full, n = full + 1, 0
                if pattern:
                    put(pattern, bins - full)
        for same in list(groups.values()):
            for pattern, bins in same:
                self._emit(pattern, bins)

    def lower_bound(self) -> int:
        return -(-self.tokens // self.capacity)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    spark = docs.sparkSession
    made = stored(pieces(docs, vocabulary or default_vocabulary(), capacity, end_id))
    counts = made.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most `capacity` rows, whatever the size of the corpus
    plan = Plan({r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    runs = np.array(sorted(plan.runs) or [(0,) * 6], dtype=np.int64)
    shift = np.int64(1) << 50
    sent = spark.sparkContext.broadcast((runs[:, 0] * shift + runs[:, 1], runs))

    def place(batches):
        keys, runs = sent.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("local_rank").to_numpy() + batch.column("base").to_numpy()
            run = runs[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 5] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return made.join(bases, ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", "local_rank", "base").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
