"""MinHash near-duplicate detection with tensored banding, every link confirmed on full sets.

Two collections of m hash groups, each of r minhashes, make m * m table keys: every pair of a group
from the first with one from the second. So 2 * m * r minhashes serve m * m tables of 2 * r hashes
each, where banding them one by one would need m * m * 2 * r. Two sets of similarity s meet in some
table unless all groups of one collection differ, at most 2 * (1 - s^r)^m: 7.0e-5 at 0.85 with the
8 groups of 2 here, and 9.5e-6 at 0.80 with 12 groups of 2. An exact check on the full sets follows.

Rows with the same set are one row until the end. A table's bucket isn't expanded into pairs:

* each task first folds its own equal keys, so a frequent key costs a row for each task;
* the members of a bucket are tested against one of them, the same in every bucket of the group
  (the member with the smallest hash);
* buckets that then lie in one component are done. The documents of the others form clouds, joined
  by common buckets. A cloud is compared as a whole or bucket by bucket (equal buckets once),
  whichever takes fewer comparisons. In such a part, every document outside its largest component
  meets every one of the part, block by block: longer signatures in a matrix comparison first, then
  the full sets of the documents that it leaves, with a union-find that skips what is joined by
  then. A block hands on the links that join something, at most one for each of its documents, so
  no pairs are spread out as rows.

Defined results: a null or empty text, or one of white space alone, has an empty set and is linked
with nothing; a repeated row gets the same result again, and rows that share a doc_id but not their
text also share the links of that id; a row with a null doc_id is linked with nothing, its component
is null and it is kept; an empty table gives no rows; further columns of the input don't matter.
"""

from __future__ import annotations

from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspring.llm.common import drop_stored, mix64, rows_of, shingle_hashes, shuffle_partitions, stored, table, word_hashes, words_of
from voxelspring.operators.graph import components

SHINGLE = 5
#: Percent of the union that the intersection must reach.
PERCENT = 85
GROUPS, WIDTH = 8, 2
SEED = 0x5DEECE66D
#: Keys in a shard of the tables, about.
SHARD_KEYS = 1_000_000
#: Documents in a block of a cloud.
BLOCK = 256
#: Minhashes in a block's comparison.
LONG = 256
#: The share of similar pairs that may fail to agree in enough minhashes to be compared in full.
ODDS = 2.5e-7


def least_agreeing(count: int, percent: int, odds: float = ODDS) -> int:
    """Of `count` minhashes, how many must agree: at a similarity of `percent`, fewer do with a
    probability of at most `odds`."""
    p, below = percent / 100, 0.0
    for k in range(count + 1):
        below += comb(count, k) * p**k * (1 - p) ** (count - k)
        if below > odds:
            return k
    return count


def minhash_seeds(groups: int = GROUPS, width: int = WIDTH) -> np.ndarray:
    return mix64(np.arange(1, 2 * groups * width + 1, dtype=np.uint64) * np.uint64(SEED))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), size))


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed, the upper half of the smallest of all shingles' hashes."""
    odd, offset = (seeds | np.uint64(1))[:, None], mix64(seeds)[:, None]
    best = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 2048):
        # the shingles are well mixed, so multiplying by an odd number permutes them well enough
        np.minimum(best, (shingles[None, a : a + 2048] * odd + offset).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, size: int, groups: int, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes) and sig of each row."""

    def run(batches):
        seeds = minhash_seeds(groups, width)
        names = ["doc_id", "n_shingles", "set_key", "sig"]
        out: list[list] = [[], [], [], []]
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            own = shingle_set(text, size)
            row = (doc_id, len(own), blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None, signature(own, seeds).tobytes() if len(own) else None)
            for to, value in zip(out, row, strict=True):
                to.append(value)
            if len(out[0]) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)
                out = [[], [], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def table_keys(sigs: np.ndarray, groups: int, width: int) -> np.ndarray:
    """(documents, groups * groups) keys: each pair of a hash group of either collection."""
    parts = np.full((len(sigs), 2 * groups), SEED, dtype=np.uint64)
    for w in range(width):
        parts = mix64(parts * np.uint64(0x9E3779B97F4A7C15) + sigs[:, w::width].astype(np.uint64))
    first, second = parts[:, :groups], parts[:, groups:]
    tables = np.arange(groups * groups, dtype=np.uint64).reshape(groups, groups)
    return mix64(first[:, :, None] + (second[:, None, :] << np.uint64(1)) + tables[None] * np.uint64(SEED)).reshape(len(sigs), -1)


def fold(keys: np.ndarray, docs: np.ndarray):
    """First row of each key, in the order (key, doc), and which of the rows share their key."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    alone = new & np.r_[new[1:], True] if len(keys) else new
    return keys, docs, new, ~alone


def memberships(unique: DataFrame, count: int, groups: int, width: int) -> DataFrame:
    """(key, doc) for every key that two or more documents have."""
    spark = unique.sparkSession
    shards = max(shuffle_partitions(spark), -(-count * groups * groups // SHARD_KEYS))

    def keyed(batches):
        """Blobs by shard. Of a key that this task has more than once, one row goes to the key's
        shard; the others are known to be members and go anywhere."""
        for batch in batches:
            docs = batch.column("rep").to_numpy()
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(docs), -1)
            per = groups * groups
            for a in range(0, len(docs), 20_000):
                keys, ids, new, shared = fold(table_keys(sigs[a : a + 20_000], groups, width).reshape(-1), np.repeat(docs[a : a + 20_000], per))
                shard = (keys >> np.uint64(20)) % np.uint64(shards)
                spread = mix64(ids.view(np.uint64) ^ keys) % np.uint64(shards)
                to = np.where(new, shard, spread).astype(np.int64)
                order = np.argsort(to, kind="stable")
                at = np.r_[np.flatnonzero(np.r_[True, np.diff(to[order]) > 0]), len(order)]
                pick = [order[x:y] for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(to[p[0]]) for p in pick], pa.int64()), *(pa.array([x[p].tobytes() for p in pick], pa.binary()) for x in (keys, ids, new.astype(np.uint8), shared.astype(np.uint8)))],
                    names=["shard", "keys", "docs", "first", "shared"],
                )

    def grouped(t: pa.Table) -> pa.Table:
        keys, ids = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("keys", np.uint64), ("docs", np.int64)))
        first, shared = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).astype(bool) for c in ("first", "shared"))
        # a document is listed once for a key, so equal keys are different documents
        order = np.argsort(keys[first], kind="stable")
        k, d, s = keys[first][order], ids[first][order], shared[first][order]
        same = np.zeros(len(k) + 1, dtype=bool)
        same[1:-1] = k[1:] == k[:-1]
        keep = same[1:] | same[:-1] | s
        return pa.table({"key": np.concatenate([k[keep], keys[~first]]).view(np.int64), "doc": np.concatenate([d[keep], ids[~first]])})

    return unique.select("rep", "sig").mapInArrow(keyed, "shard long, keys binary, docs binary, first binary, shared binary").groupBy("shard").applyInArrow(grouped, "key long, doc long")


def confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, agree: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def close(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1)) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= agree))

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sigs.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    b = sigs.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    # the smaller set is at most the intersection, the larger at least the union
    sized = pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    near = sized.select("a", "b", "sa", "sb").mapInArrow(close, "a long, b long")
    full = near.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb")), "b")
    return full.select("a", "b", "xa", "xb").mapInArrow(similar, "a long, b long")


def long_seeds() -> np.ndarray:
    return mix64(np.arange(1, LONG + 1, dtype=np.uint64) * np.uint64(SEED) ^ np.uint64(0xA5A5))


def possible_pairs(sx: np.ndarray, sy: np.ndarray, nx: np.ndarray, ny: np.ndarray, differ: np.ndarray, agree: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of `differ` have sizes and signatures that allow a link, and in how many minhashes
    each pair agrees."""
    same = np.stack([(row == sy).sum(axis=1) for row in sx])
    low, high = np.minimum(nx[:, None], ny[None]), np.maximum(nx[:, None], ny[None])
    return differ & (low * 100 >= high * percent) & (same >= agree), same


def similar_pairs(x: list[np.ndarray], y: list[np.ndarray], differ: np.ndarray, agree: float, percent: int, joined) -> list[tuple[int, int]]:
    """(i, j) of similar sets x[i], y[j] that join something: joined(i, j) says whether they are
    joined already and joined(i, j, True) joins them. differ: which pairs are to be looked at."""
    seeds = long_seeds()
    sx, sy = (np.stack([signature(s, seeds) for s in sets]).astype(np.uint16) for sets in (x, y))
    nx, ny = (np.array([len(s) for s in sets], dtype=np.int64) for sets in (x, y))
    possible, same = possible_pairs(sx, sy, nx, ny, differ, agree, percent)
    i, j = np.nonzero(possible)
    out = []
    for at in np.argsort(-same[i, j], kind="stable"):
        a, b = int(i[at]), int(j[at])
        if joined(a, b):
            continue
        both = np.concatenate([x[a], y[b]])
        both.sort(kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        if 100 * shared >= percent * (len(both) - shared):
            joined(a, b, True)
            out.append((a, b))
    return out


def long_signatures(sets: DataFrame) -> DataFrame:
    """rep, n_shingles and LONG minhashes (two bytes each) of each full set."""

    def run(batches):
        seeds = long_seeds()
        for batch in batches:
            own = [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
            sigs = [signature(s, seeds).astype(np.uint16).tobytes() for s in own]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([len(s) for s in own], pa.int64()), pa.array(sigs, pa.binary())], names=["rep", "n_shingles", "long"])

    return sets.select("rep", "shingles").mapInArrow(run, "rep long, n_shingles long, long binary")


def cloud_of(still: DataFrame) -> DataFrame:
    """(doc, label, cloud): documents that common buckets join, directly or through others, have one cloud."""
    first = still.groupBy("key").agg(F.min("doc").alias("a"))
    star = stored(still.join(first, "key").groupBy("a", F.col("doc").alias("b")).agg(F.first("label").alias("label")))
    # one edge for each document first, to the smallest of its buckets' first ones; what that leaves
    # apart is joined over the few labels it gives
    forest = components(star.groupBy("b").agg(F.min("a").alias("a")))
    rough = stored(star.select(F.col("b").alias("doc"), "label").distinct().join(forest.select(F.col("node").alias("doc"), F.col("label").alias("tree")), "doc", "left").withColumn("tree", F.coalesce("tree", "doc")))
    a, b = (rough.select(F.col("doc").alias(c), F.col("tree").alias(f"t{c}")) for c in "ab")
    across = components(star.join(a, "a").join(b, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
    own = stored(rough.join(across.select(F.col("node").alias("tree"), F.col("label").alias("whole")), "tree", "left").select("doc", "label", F.coalesce("whole", "tree").alias("cloud")))
    drop_stored(star, rough)
    return own


def parts_of(still: DataFrame, own: DataFrame) -> DataFrame:
    """(cloud, part, doc, label, n, top, main): what is compared with one another. A cloud is one part
    (number 0), or each of its different buckets is one (numbered by key), whichever makes fewer
    comparisons. n: documents of the part, top: those of its largest component, main."""
    content = still.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("h"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("i"))
    different = content.groupBy("n", "h", "i").agg(F.min("key").alias("key")).select("key")
    buckets = still.join(different, "key", "left_semi").join(own.select("doc", "cloud"), "doc")
    both = stored(
        own.select("cloud", F.lit(0).cast("long").alias("part"), F.lit(True).alias("whole"), "doc", "label").union(buckets.select("cloud", F.col("key").alias("part"), F.lit(False).alias("whole"), "doc", "label"))
    )
    unit = ["cloud", "whole", "part"]
    sizes = both.groupBy(*unit, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*unit).agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("label", F.struct("n", "label")).alias("main"))
    pairs = F.col("n").cast("double") * (F.col("n") - F.col("top"))
    cost = sizes.groupBy("cloud").agg(F.sum(F.when(F.col("whole"), pairs)).alias("one"), F.sum(F.when(~F.col("whole"), pairs)).alias("many"))
    wanted = sizes.join(cost.select("cloud", (F.col("one") <= F.col("many")).alias("whole")), ["cloud", "whole"])
    out = stored(both.join(wanted, unit).select("cloud", "part", "doc", "label", "n", "top", "main"))
    drop_stored(both)
    return out


def clouds(still: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between documents of unresolved buckets. still: (key, doc, label).

    Blocks of a part meet as tiles, twice: long signatures tell which documents of a tile have a possible
    partner in it, and only those documents' full sets go to the tile."""
    own = cloud_of(still)
    parts = parts_of(still, own)
    long = stored(long_signatures(sets.join(own.select(F.col("doc").alias("rep")), "rep", "left_semi")))
    every = parts.join(long.withColumnRenamed("rep", "doc"), "doc")
    a_blocks, b_blocks = (F.ceil(c / block).cast("int") for c in (F.col("n") - F.col("top"), F.col("n")))
    turn = F.xxhash64("doc")
    tile = ["cloud", "part", "p", "q"]

    def copies(others, place):
        return F.transform(F.sequence(F.lit(0), others - 1), place)

    as_left = copies(b_blocks, lambda q: F.struct(F.pmod(turn, a_blocks).cast("int").alias("p"), q.alias("q"), F.lit(True).alias("is_left")))
    as_right = copies(a_blocks, lambda p: F.struct(p.alias("p"), F.pmod(turn, b_blocks).cast("int").alias("q"), F.lit(False).alias("is_left")))
    places = F.when(F.col("label") != F.col("main"), F.concat(as_left, as_right)).otherwise(as_right)
    dealt = every.where("n > top").withColumn("at", F.explode(places)).select("cloud", "part", "at.*", "doc", "label", "n_shingles", "long")
    agree = least_agreeing(LONG, percent)

    def sides(t: pa.Table) -> tuple[pa.Table, pa.Table]:
        return t.filter(t.column("is_left")), t.filter(pc.invert(t.column("is_left")))

    def meet(t: pa.Table) -> pa.Table:
        rows = []
        a, b = sides(t)
        if len(a) and len(b):
            (sx, sy) = (np.frombuffer(b"".join(t.column("long").to_pylist()), np.uint16).reshape(len(t), -1) for t in (a, b))
            (da, la, na), (db, lb, nb) = ([t.column(c).to_numpy() for c in ("doc", "label", "n_shingles")] for t in (a, b))
            possible = possible_pairs(sx, sy, na, nb, la[:, None] != lb[None], agree, percent)[0]
            at = a.column("cloud")[0].as_py(), a.column("part")[0].as_py(), a.column("p")[0].as_py(), a.column("q")[0].as_py()
            for is_left, docs, labels, axis in ((True, da, la, 1), (False, db, lb, 0)):
                found = dict(zip(docs[possible.any(axis=axis)].tolist(), labels[possible.any(axis=axis)].tolist(), strict=True))
                rows += [(*at, is_left, d, l) for d, l in found.items()]
        names = [*tile, "is_left", "doc", "label"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    near = stored(dealt.groupBy(*tile).applyInArrow(meet, "cloud long, part long, p int, q int, is_left boolean, doc long, label long"))

    def confirm(t: pa.Table) -> pa.Table:
        a, b = sides(t)
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        x, y = ([np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()] for t in (a, b))
        (da, la), (db, lb) = ([t.column(c).to_numpy() for c in ("doc", "label")] for t in (a, b))
        root: dict[int, int] = {}

        def find(v):
            while (up := root.get(v, v)) != v:
                root[v] = root.get(up, up)
                v = up
            return v

        def joined(i, j, now=False):
            p, q = find(int(la[i])), find(int(lb[j]))
            if now and p != q:
                root[max(p, q)] = min(p, q)
            return p == q

        found = similar_pairs(x, y, la[:, None] != lb[None], agree, percent, joined)
        return pa.table({"a": pa.array([int(da[i]) for i, _ in found], pa.int64()), "b": pa.array([int(db[j]) for _, j in found], pa.int64())})

    full = near.join(sets.select(F.col("rep").alias("doc"), "shingles"), "doc")
    links = stored(full.select(*tile, "is_left", "doc", "label", "shingles").groupBy(*tile).applyInArrow(confirm, "a long, b long"))
    drop_stored(own, parts, long, near)
    return links


def link(members: DataFrame, sigs: DataFrame, sets: DataFrame, agree: int, percent: int) -> DataFrame:
    """(node, label) of all documents that some confirmed link joins."""
    first = members.groupBy("key").agg(F.min_by("doc", F.struct(F.xxhash64("doc"), "doc")).alias("b"))
    pairs = members.join(first, "key").where("doc <> b").select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).distinct()
    links = stored(confirmed(pairs, sigs, sets, agree, percent))
    labels = components(links)
    at = members.join(labels, members.doc == labels.node, "left").select("key", "doc", F.coalesce("label", "doc").alias("label"))
    open_keys = at.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    still = stored(at.join(open_keys, "key", "left_semi"))
    more = clouds(still, sets, percent)
    if more.limit(1).count():
        drop_stored(labels)
        labels = components(links.union(more))
    drop_stored(links, still, more)
    return labels


def cluster(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, groups: int = GROUPS, width: int = WIDTH, agree: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs. agree: minhashes in which
    two documents must agree before their full sets are compared."""
    agree = least_agreeing(2 * groups * width, percent) if agree is None else agree
    made = stored(signatures(docs, size, groups, width))
    usable = made.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    unique = stored(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")))
    count = unique.count()
    members = stored(memberships(unique, count, groups, width))
    wanted = members.select(F.col("doc").alias("doc_id")).distinct()

    def full(batches):
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(full, "rep long, shingles binary")
    if made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        sets = sets.groupBy("rep", F.sha2("shingles", 256)).agg(F.first("shingles").alias("shingles")).select("rep", "shingles")
    sets = stored(sets)
    labels = link(members, unique.select("rep", "sig", "n_shingles"), sets, agree, percent)
    drop_stored(members, sets)
    by_set = unique.join(labels, unique.rep == labels.node, "left").select("set_key", F.coalesce("label", "rep").alias("found"))
    component = F.coalesce("found", "doc_id")
    out = made.join(by_set, "set_key", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """docs without those that have a smaller id in their component; all columns stay, as do rows
    with a null id and all rows that repeat the smallest id."""
    gone = cluster(docs, **parameters).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"), percent=85)
