"""Merkle manifest of a dataset: a digest for each row, a tree for each source, a tree over the sources,
and for each row the proof that leads from its leaf to the root.

Leaves are hashed where the rows lie, and from then on only digests move. They are sorted by ranges of
(source, doc_id) into a checkpointed table whose partitions stay as they are, so a leaf's place in its
source is its place in the partition plus an offset, and there is one offset for each partition. Each
partition builds the complete aligned subtrees of its leaves, up to `block` levels. What is ragged at
its edges goes by coordinate to the block it belongs to; blocks rise in rounds of `climb` levels, whose
groups hold at most 3 ** climb nodes, to the subroots and on to the root. The siblings on the way come
back down by the same coordinates and meet the leaves of a block, of which there are at most 3 ** block.

Defined results: nulls are `-` in a leaf; rows with the same doc_id are all leaves, ordered by their
digests; a null doc_id comes first in its source and counts as the empty text for crc32; a null source
is a source of its own and the first; a null text has nothing to delete; an empty table gives no rows;
further columns of the input don't matter; columns that are missing count as null.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspring.llm.common import checkpointed, crc_bucket, rows_of, stored, table

ARITY = 3
#: Levels that are built inside a block of leaves, and levels that a round above the blocks adds.
BLOCK, CLIMB = 6, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "lefts array<string>, rights array<string>"


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def _field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(values: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(values[f]) for f in FIELDS]).cast("binary"), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, changed): changed is the leaf after tampering, null where a row isn't tampered with."""
    values = {f: F.col(f) if f in docs.columns else F.lit(None).cast("string") for f in FIELDS}
    own = docs.select(*[v.alias(f) for f, v in values.items()])
    values = {f: F.col(f) for f in FIELDS}
    without = values | {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    changed = F.when(crc_bucket("doc_id", 2) == 0, _leaf(without))
    return own.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), _leaf(values).alias("leaf"), changed.alias("changed"))


def _placed(leaves: DataFrame) -> DataFrame:
    """Sorted leaves with what their partition must know: the place of its first leaf in that source
    (start), the number of that source, and how many leaves its last source has (total)."""
    order = ("source", "doc_id", "leaf")
    own = checkpointed(stored(leaves).repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())
    # a row for each partition and source in it; a source's rows are as many as the partitions it spans
    runs = own.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"))
    same = Window.partitionBy("source")
    before = same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(same).alias("total"))
    at = F.struct(F.col("source").isNotNull(), "source")
    edges = runs.groupBy("part").agg(F.min_by("start", at).alias("start"), F.max_by("total", at).alias("total"), F.count_if(F.col("start") == 0).alias("begun"))
    # one row for each partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sid = F.coalesce(F.sum("begun").over(earlier), F.lit(0)) - F.when(F.col("start") > 0, 1).otherwise(0)
    edges = edges.select("part", "start", "total", sid.alias("sid"))
    return own.join(F.broadcast(edges), "part").select("source", "doc_id", "leaf", "changed", "start", "total", "sid")


def _numbered(rows):
    """(sid, idx, doc_id, leaf, changed, total) of a partition's rows in order; total: see _placed."""
    last, sid, idx, begun = None, 0, 0, False
    for source, doc_id, leaf, changed, start, total, first in rows:
        if not begun:
            sid, idx, begun = first, start, True
        elif source != last:
            sid, idx = sid + 1, 0
        last = source
        yield sid, idx, doc_id, leaf, changed, total
        idx += 1


def grown(first: int, row: list[bytes], n: int, most: int):
    """(level, idx, digest, n there) of the largest complete aligned subtrees over neighbouring leaves,
    from place `first` on, of a tree with n leaves; none higher than `most` levels."""
    level = 0
    while row:
        if level == most or n == 1:
            yield from ((level, first + k, d, n) for k, d in enumerate(row))
            return
        end = len(row)
        skip = min(-first % ARITY, end)
        whole = end if first + end == n else max(skip, end - (first + end) % ARITY)
        yield from ((level, first + k, row[k], n) for k in (*range(skip), *range(whole, end)))
        row = [digest(*row[k : k + ARITY]) for k in range(skip, whole, ARITY)]
        first, n, level = (first + skip) // ARITY, -(-n // ARITY), level + 1


NODES = "sid long, block long, level int, idx long, n long, leaves long, digest string"


def _local_nodes(placed: DataFrame, block: int) -> DataFrame:
    """What each partition builds alone. n: nodes of the level, leaves: nodes of level 0 in the source."""
    wide, columns = ARITY**block, ("source", "doc_id", "leaf", "changed", "start", "total", "sid")

    def build(batches):
        out, tops, head, first, row, run, end, total = [], [], None, 0, [], None, 0, 0

        def close(n):
            """Emit the run's nodes, now that its source's size is known."""
            above = -(-n // wide)
            out.extend((run, i, block, i, above, n, d.decode()) for i, d in tops)
            for start, leaves in [head, (first, row)] if head else [(first, row)]:
                out.extend((run, start // wide, level, i, m, n, d.decode()) for level, i, d, m in grown(start, leaves, n, block))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for sid, idx, _, leaf, _, total in _numbered(rows_of(batches, *columns)):
            if sid != run:
                if run is not None:
                    close(end)
                tops, head, first, row, run = [], None, idx, [], sid
            elif idx % wide == 0:
                if len(row) == wide:
                    # a full block has the same top whatever follows
                    tops.append((first // wide, rises(row, wide, block)[0][-1][0]))
                else:
                    head = (first, row)
                first, row = idx, []
            row.append(leaf.hex().encode())
            end = idx + 1
            if len(out) > 20_000:
                yield batch()
                out = []
        if run is not None:
            close(total)
        if out:
            yield batch()

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in NODES.split(", ")]
    return placed.mapInArrow(build, NODES)


def _filled(nodes: DataFrame, block: int) -> DataFrame:
    """The top of each block that lies in several partitions, from the subtrees that these built."""

    def fill(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        n, level, row = rows[0]["leaves"], 0, {}
        while True:
            row |= {r["idx"]: r["digest"].encode() for r in rows if r["level"] == level}
            if level == block or n == 1:
                break
            above: dict[int, list[bytes]] = {}
            for i in sorted(row):
                above.setdefault(i // ARITY, []).append(row[i])
            row, n, level = {i: digest(*parts) for i, parts in above.items()}, -(-n // ARITY), level + 1
        (idx, top), at = row.popitem(), rows[0]
        return pa.table({"sid": [at["sid"]], "idx": [idx], "n": [n], "leaves": [at["leaves"]], "digest": [top.decode()]})

    return nodes.groupBy("sid", "block").applyInArrow(fill, "sid long, idx long, n long, leaves long, digest string")


def _siblings(row: list[bytes], i: int) -> tuple[bytes, bytes]:
    at = i - i % ARITY
    return b"".join(row[at:i]), b"".join(row[i + 1 : at + ARITY])


def rises(row: list[bytes], n: int, levels: int) -> tuple[list[list[bytes]], int]:
    """The levels over a complete aligned run of nodes, itself included, and the count of nodes of the last
    level in the whole tree; `levels` more at most, and none above the tree's top."""
    out = [row]
    while len(out) <= levels and n > 1:
        row, n = [digest(*row[k : k + ARITY]) for k in range(0, len(row), ARITY)], -(-n // ARITY)
        out.append(row)
    return out, n


def way_up(levels: list[list[bytes]], i: int) -> tuple[list[str], list[str]]:
    """What stands left and right of the i-th node of the first level and of those above it, below the last."""
    lefts, rights = [], []
    for row in levels[:-1]:
        left, right = _siblings(row, i)
        lefts.append(left.decode())
        rights.append(right.decode())
        i //= ARITY
    return lefts, rights


def climbed(nodes: DataFrame, climb: int) -> tuple[DataFrame, DataFrame]:
    """From nodes (tree, idx, n, digest), all of a level of their tree, n of them: the tops (tree, digest)
    and the way there for each node (tree, idx, lefts, rights), which a tree of one node doesn't have."""
    wide = ARITY**climb
    schema = f"up boolean, tree long, idx long, n long, digest string, {PATH}"
    kinds = pa.schema([("up", pa.bool_()), ("tree", pa.int64()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))])

    def raise_group(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["idx"])
        tree, first = rows[0]["tree"], rows[0]["idx"]
        levels, n = rises([r["digest"].encode() for r in rows], rows[0]["n"], climb)
        out = [{"up": True, "tree": tree, "idx": first // ARITY ** (len(levels) - 1), "n": n, "digest": levels[-1][0].decode()}]
        for r in rows:
            lefts, rights = way_up(levels, r["idx"] - first)
            out.append({"up": False, "tree": tree, "idx": r["idx"], "lefts": lefts, "rights": rights})
        return pa.Table.from_pylist(out, schema=kinds)

    tops, ways = nodes.where("n = 1").select("tree", "digest"), []
    rising = nodes.where("n > 1")
    while rising.limit(1).count():
        made = stored(rising.groupBy("tree", F.floor(F.col("idx") / wide).alias("to")).applyInArrow(raise_group, schema))
        ways.append(made.where("NOT up").select("tree", "idx", "lefts", "rights"))
        nodes = made.where("up").select("tree", "idx", "n", "digest")
        tops, rising = tops.union(nodes.where("n = 1").select("tree", "digest")), nodes.where("n > 1")
    if not ways:
        return tops, nodes.sparkSession.createDataFrame([], f"tree long, idx long, {PATH}")
    paths = ways.pop()
    for way in reversed(ways):
        further = paths.select("tree", F.col("idx").alias("to"), F.col("lefts").alias("l"), F.col("rights").alias("r"))
        own = way.withColumn("to", F.floor(F.col("idx") / wide))
        paths = stored(_continued(own.join(further, ["tree", "to"], "left")).select("tree", "idx", "lefts", "rights"))
    return tops, paths


def _continued(df: DataFrame) -> DataFrame:
    """lefts and rights followed by l and r where there are any."""
    none = F.array().cast("array<string>")
    return df.withColumns({w: F.concat(F.coalesce(w, none), F.coalesce(m, none)) for w, m in (("lefts", "l"), ("rights", "r"))})


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, block: int = BLOCK, climb: int = CLIMB) -> DataFrame:
    """A row for each document: its leaf, its source's subroot, the root, a digest of its proof, and what
    folding its leaf, tampered with where chosen, with the siblings of the proof gives."""
    placed = _placed(leaves_of(docs))
    wide = ARITY**block
    local = stored(_local_nodes(placed, block))
    whole = (F.col("level") == block) | (F.col("n") == 1)
    tops = local.where(whole).select("sid", "idx", "n", "leaves", "digest").union(_filled(local.where(~whole), block))
    tops = stored(tops)
    subroots, ways = climbed(tops.select(F.col("sid").alias("tree"), "idx", "n", "digest"), climb)
    subroots = stored(subroots)
    sources = subroots.count()
    over = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(sources).cast("long").alias("n"), "digest")
    root, last = climbed(over, climb)
    found = root.first()
    root = F.lit(None if found is None else found["digest"]).cast("string")
    # for each block of leaves all that stands beside the way from its top to the root
    ends = subroots.select(F.col("tree").alias("sid"), F.col("digest").alias("subroot"))
    ends = ends.join(last.select(F.col("idx").alias("sid"), F.col("lefts").alias("l"), F.col("rights").alias("r")), "sid", "left")
    blocks = tops.select("sid", F.col("idx").alias("block"), "leaves").join(ways.select(F.col("tree").alias("sid"), F.col("idx").alias("block"), "lefts", "rights"), ["sid", "block"], "left")
    blocks = _continued(blocks.join(ends, "sid")).select("sid", "block", "leaves", "subroot", root.alias("root"), "lefts", "rights")

    names = ("source", "doc_id", "leaf", "changed", "start", "total", "sid")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def number(batches):
        kept: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), kinds, strict=True)], names=["sid", "idx", "doc_id", "leaf", "changed"])

        for sid, idx, doc_id, leaf, changed, _ in _numbered(rows_of(batches, *names)):
            kept.append((sid, idx, doc_id, leaf, changed))
            if len(kept) == 10_000:
                yield batch()
                kept = []
        if kept:
            yield batch()

    def prove(leaves: pa.Table, way: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("idx")
        to = way.to_pylist()[0]
        row = [d.hex().encode() for d in leaves.column("leaf").to_pylist()]
        levels, _ = rises(row, to["leaves"], block)
        tail = [(a.encode(), b.encode()) for a, b in zip(to["lefts"], to["rights"], strict=True)]
        tail_text = b"".join(a + b for a, b in tail)
        proofs, folded = [], []
        for i, changed in enumerate(leaves.column("changed").to_pylist()):
            now, beside, at = row[i] if changed is None else changed.hex().encode(), [], i
            for level in levels[:-1]:
                left, right = _siblings(level, at)
                now, at = digest(left, now, right), at // ARITY
                beside += (left, right)
            for left, right in tail:
                now = digest(left, now, right)
            proofs.append(digest(*beside, tail_text).decode())
            folded.append(now.decode())
        n = len(row)
        return pa.table({"doc_id": leaves.column("doc_id"), "leaf": [d.decode() for d in row], "subroot": [to["subroot"]] * n, "root": [to["root"]] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [f == to["root"] for f in folded]})

    numbered = placed.mapInArrow(number, "sid long, idx long, doc_id long, leaf binary, changed binary").withColumn("block", F.floor(F.col("idx") / wide))
    return numbered.groupBy("sid", "block").cogroup(stored(blocks).groupBy("sid", "block")).applyInArrow(prove, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _field_sql(name: str, value: str | None = None) -> str:
    value = value or f"CAST({name} AS VARCHAR)"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def _leaf_sql(text: str | None = None) -> str:
    return "sha256(" + " || ".join(_field_sql(f, text if f == "text" else None) for f in FIELDS) + ")"


#: crc32 bit by bit: each byte of the text, which has digits and a sign alone, is followed by seven zeros.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"""
_BESIDE = "coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN {}), '')"


def _tree_sql(name: str, leaves: str) -> str:
    """All nodes of the trees over leaves (tree, idx, n, digest) with what stands left and right of each."""
    return f"""{name}u(tree, level, idx, n, digest) AS (
    SELECT tree, 0, idx, n, digest FROM {leaves}
    UNION ALL SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name}u WHERE n > 1 GROUP BY tree, level, idx // 3, n),
  {name} AS MATERIALIZED (SELECT *, {_BESIDE.format("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS l, {_BESIDE.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS r FROM {name}u)"""


def _fold_sql(name: str, tree: str, start: str) -> str:
    """Each row (key, tree, idx, now, proof) of start taken up its tree."""
    return f"""{name}f(key, tree, level, idx, n, now, proof) AS (
    SELECT s.key, s.tree, 0, s.idx, t.n, s.now, s.proof FROM {start} s JOIN {tree} t ON t.tree = s.tree AND t.level = 0 AND t.idx = s.idx
    UNION ALL SELECT f.key, f.tree, f.level + 1, f.idx // 3, (f.n + 2) // 3, sha256(t.l || f.now || t.r), f.proof || t.l || t.r
      FROM {name}f f JOIN {tree} t ON t.tree = f.tree AND t.level = f.level AND t.idx = f.idx WHERE f.n > 1),
  {name} AS MATERIALIZED (SELECT key, tree, now, proof FROM {name}f WHERE n = 1)"""


_TEXT = "CAST(text AS VARCHAR)"
_WITHOUT = "replace(text, chr(10), '')"
ORACLE = f"""WITH RECURSIVE d AS MATERIALIZED (
    SELECT row_number() OVER () AS key, doc_id, source, {_leaf_sql()} AS leaf, {_leaf_sql(_WITHOUT)} AS changed, coalesce({_CRC}, 0) % 2 = 0 AS tampered FROM documents),
  s AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
  p AS MATERIALIZED (SELECT d.*, s.tree, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY s.tree) AS n
    FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source),
  l1 AS (SELECT tree, idx, n, leaf AS digest FROM p), {_tree_sql("t1", "l1")},
  b1 AS (SELECT key, tree, idx, CASE WHEN tampered THEN changed ELSE leaf END AS now, '' AS proof FROM p), {_fold_sql("f1", "t1", "b1")},
  subroots AS MATERIALIZED (SELECT tree, digest FROM t1 WHERE n = 1),
  l2 AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS n, digest FROM subroots), {_tree_sql("t2", "l2")},
  b2 AS (SELECT key, 0 AS tree, tree AS idx, now, proof FROM f1), {_fold_sql("f2", "t2", "b2")}
  SELECT p.doc_id, p.leaf, subroots.digest AS subroot, t2.digest AS root, sha256(f2.proof) AS proof_sha256, f2.now AS folded_root, f2.now = t2.digest AS verified
  FROM p JOIN subroots USING (tree) JOIN f2 USING (key) JOIN t2 ON t2.n = 1"""
