"""Exact top-k search with a pivot table.

Vectors become integers, floor(scale * x), and the score is their inner product. One more
coordinate, the root of what a vector's squared norm lacks to the largest one, makes the distance
to a query fall as the score rises: d^2 = M^2 + |q|^2 - 2 score. Each vector keeps its distances to
the pivots (chosen far apart from a bounded sample). By the triangle inequality the largest
difference between a query's and a vector's pivot distances bounds their distance from below.

Vectors are dealt into cells by their nearest pivot, cells into blocks of bounded size. Of each cell
the smallest and largest distance to each pivot are known: a table with as many rows as pivots. A
first pass searches one block of the cell nearest to each query; the k-th score there is a threshold.
Before the second pass moves anything, cells whose bound lies below the threshold leave. In each
block, candidates are evaluated in the order of their bound, until no bound left can beat, or tie
with, the threshold or the k-th score found; scores are exact integers, so the result is exact.

Defined results: a vector that is null or holds a null or non-finite component, and a row
with a null id, take no part. Every other row counts, so rows that repeat an id are candidates of
each other, and queries each for itself. Of vectors of different lengths, the components that one
lacks count as 0, so an empty vector scores 0 with all. Ties go to the smaller id. An empty table gives no rows. Further columns of the
input don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspring.llm.common import stored, table

PIVOTS, PIVOT_SAMPLE = 64, 2_000
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Candidates evaluated between two looks at the bound.
STEP = 512


def integers(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """row (any number of its own), id, v (array<long>)."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & whole)
    return kept.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def matrix(rows: list, width: int) -> np.ndarray:
    """Vectors as rows of `width`, with zeros for what they lack."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` rows, each the farthest from those before it."""
    if len(sample) == 0:
        return sample
    picked, near = [0], np.full(len(sample), np.inf)
    while len(picked) < min(count, len(sample)):
        near = np.minimum(near, np.linalg.norm(sample - sample[picked[-1]], axis=1))
        picked.append(int(near.argmax()))
    return sample[picked]


class Pivots:
    """Distances to the pivots, in the space with one more coordinate. top2: the largest squared norm."""

    def __init__(self, sample: np.ndarray, top2: float, count: int):
        self.top2 = top2
        lifted = np.column_stack([sample.astype(np.float64), self.lift(sample)])
        found = far_apart(lifted, count)
        self.at, self.raised = found[:, :-1], found[:, -1]

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.top2 - (v.astype(np.float64) ** 2).sum(axis=1)))

    def inner(self, v: np.ndarray) -> np.ndarray:
        width = min(v.shape[1], self.at.shape[1])
        return v[:, :width].astype(np.float64) @ self.at[:, :width].T

    def of_vectors(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 * (self.top2 - self.inner(v) - self.lift(v)[:, None] * self.raised)))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.top2 + (q.astype(np.float64) ** 2).sum(axis=1)[:, None] - 2 * self.inner(q)))


def highest(bound: np.ndarray, norm2: np.ndarray | float, top2: float) -> np.ndarray:
    """The highest score that a lower bound of the distance allows, with room for rounding."""
    room = 1e-6 * (np.sqrt(top2 + norm2) + bound)
    return (top2 + norm2 - np.maximum(0, bound - room) ** 2) / 2 + 1e-6 * (top2 + norm2)


def best_in_block(q: np.ndarray, q_rows: np.ndarray, q_table: np.ndarray, least: np.ndarray, v: np.ndarray, v_rows: np.ndarray, v_ids: np.ndarray, v_table: np.ndarray, top2: float, k: int):
    """(query, vector, score, how many were evaluated) of the k best of this block for each query of
    it, by their places; those below the query's `least` score are left out."""
    exact = np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * v.shape[1] < 2**52
    left, right = (v.astype(np.float64), q.astype(np.float64)) if exact else (v, q)
    norms = (q.astype(np.float64) ** 2).sum(axis=1)
    out, evaluated = [], 0
    for i in range(len(q)):
        most = highest(np.abs(v_table - q_table[i]).max(axis=1), norms[i], top2)
        most[v_rows == q_rows[i]] = -np.inf
        able = np.flatnonzero(most >= max(least[i], -1e300))
        order = able[np.argsort(-most[able], kind="stable")]
        found_at, found = np.zeros(0, dtype=np.int64), np.zeros(0)
        for a in range(0, len(order), STEP):
            part = order[a : a + STEP]
            if len(found) >= k and most[part[0]] < found[-1]:
                break
            evaluated += len(part)
            found_at, found = np.concatenate([found_at, part]), np.concatenate([found, left[part] @ right[i]])
            best = np.lexsort((v_ids[found_at], -found))[:k]
            found_at, found = found_at[best], found[best]
        out.append((np.full(len(found), i), found_at, found.astype(np.int64)))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), evaluated


VECTOR = "row long, id long, cell int, v binary, t binary"
HIT = "query_row long, query_id long, vec_id long, score long"
NO_HITS = pa.table({c.split()[0]: pa.array([], pa.int64()) for c in HIT.split(", ")})


def with_table(rows: DataFrame, pivots: Pivots, as_query: bool) -> DataFrame:
    """VECTOR: the distances to the pivots, and the nearest of them as the cell."""

    def run(batches):
        for batch in batches:
            lists = batch.column("v").to_pylist()
            width = max(map(len, lists), default=1)
            v = matrix(lists, width)
            t = (pivots.of_queries if as_query else pivots.of_vectors)(v)
            own = [pa.array([np.array(x, dtype=np.int64).tobytes() for x in lists], pa.binary()), pa.array([x.tobytes() for x in t], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(t.argmin(axis=1).astype(np.int32), pa.int32()), *own], names=["row", "id", "cell", "v", "t"])

    return rows.select("row", "id", "v").mapInArrow(run, VECTOR)


def cell_boxes(vectors: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, smallest and largest distances to the pivots) of each cell: as many rows as pivots."""

    def partial(batches):
        size, low, high = np.zeros(count, np.int64), np.full((count, count), np.inf), np.full((count, count), -np.inf)
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            t = np.frombuffer(b"".join(batch.column("t").to_pylist()), np.float64).reshape(len(cell), -1)
            size += np.bincount(cell, minlength=count)
            np.minimum.at(low, cell, t)
            np.maximum.at(high, cell, t)
        own = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(size[own]), *(pa.array(list(x[own]), pa.list_(pa.float64())) for x in (low, high))], names=["cell", "n", "low", "high"])

    parts = vectors.select("cell", "t").mapInArrow(partial, "cell long, n long, low array<double>, high array<double>")
    merged = parts.groupBy("cell").agg(F.sum("n").alias("n"), *[F.array(*[f(F.col(c)[i]) for i in range(count)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))])
    size, low, high = np.zeros(count, np.int64), np.full((count, count), np.inf), np.full((count, count), -np.inf)
    for r in merged.collect():
        size[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    return size, low, high


def searched(queries: DataFrame, vectors: DataFrame, pivots: Pivots, k: int, query_block: int) -> DataFrame:
    """HIT: the k best of each block (cell, sub) for the queries sent there; queries: VECTOR with sub and
    least, the score below which nothing counts; vectors: VECTOR with sub."""
    top2, sent = pivots.top2, queries.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("chunks"))
    deal = F.pmod(F.xxhash64("row"), F.col("chunks").cast("long")).cast("int")
    left = queries.join(sent, ["cell", "sub"]).withColumn("chunk", deal)
    right = vectors.join(sent, ["cell", "sub"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def unpack(t: pa.Table):
        lists = [np.frombuffer(x, np.int64) for x in t.column("v").to_pylist()]
        table = np.frombuffer(b"".join(t.column("t").to_pylist()), np.float64).reshape(len(lists), -1)
        return lists, t.column("row").to_numpy(), t.column("id").to_numpy(), table

    def tile(q: pa.Table, v: pa.Table) -> pa.Table:
        if not len(q) or not len(v):
            return NO_HITS
        (q_lists, q_rows, q_ids, qt), (v_lists, v_rows, v_ids, vt) = unpack(q), unpack(v)
        width = max(len(x) for x in [*q_lists, *v_lists])
        i, j, score, _ = best_in_block(matrix(q_lists, width), q_rows, qt, q.column("least").to_numpy(), matrix(v_lists, width), v_rows, v_ids, vt, top2, k)
        return pa.table({"query_row": q_rows[i], "query_id": q_ids[i], "vec_id": v_ids[j], "score": score})

    keys = ("cell", "sub", "chunk")
    return left.select(*keys, "row", "id", "v", "t", "least").groupBy(*keys).cogroup(right.select(*keys, "row", "id", "v", "t").groupBy(*keys)).applyInArrow(tile, HIT)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = PIVOTS, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query among all other rows.

    is_query: id column -> condition.
    """
    spark = vectors.sparkSession
    rows = stored(integers(vectors, id_column, vector_column, scale))
    norm2 = F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x)
    top2 = rows.agg(F.max(norm2)).first()[0]
    if top2 is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "row").limit(PIVOT_SAMPLE).select("v").collect()]
    known = Pivots(matrix(sample, max(map(len, sample))), float(top2), pivots)
    count = len(known.at)
    asked = stored(with_table(rows.where(is_query(F.col("id"))), known, True))
    every = stored(with_table(rows, known, False))
    size, low, high = cell_boxes(every, count)
    subs = np.maximum(1, -(-size // vector_block))
    parts_of = F.element_at(F.array(*[F.lit(int(n)) for n in subs]), F.col("cell") + 1)
    blocks = every.withColumn("sub", F.pmod(F.xxhash64("row", F.lit(2)), parts_of.cast("long")).cast("int"))

    def cell_bounds(batch: pa.RecordBatch) -> np.ndarray:
        """The highest score in each cell for each query; below all scores for empty cells."""
        t = np.frombuffer(b"".join(batch.column("t").to_pylist()), np.float64).reshape(len(batch), -1)
        norms = np.array([(np.frombuffer(x, np.int64).astype(np.float64) ** 2).sum() for x in batch.column("v").to_pylist()])
        out = np.full((len(batch), count), -np.inf)
        for c in np.flatnonzero(size):
            out[:, c] = highest(np.maximum(np.maximum(low[c] - t, t - high[c]), 0).max(axis=1), norms, known.top2)
        return out

    def sent_to(own: np.ndarray, batch: pa.RecordBatch, cells: np.ndarray, sub: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        part = batch.take(pa.array(own))
        return pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(cells.astype(np.int32)), part.column("v"), part.column("t"), pa.array(sub.astype(np.int32)), pa.array(least)], names=["row", "id", "cell", "v", "t", "sub", "least"])

    def nearest(batches):
        """One block of the cell with the highest bound, and of equal ones the nearest."""
        for batch in batches:
            if len(batch):
                t = np.frombuffer(b"".join(batch.column("t").to_pylist()), np.float64).reshape(len(batch), -1)
                cell = np.where(size > 0, t, np.inf).argmin(axis=1)
                yield sent_to(np.arange(len(batch)), batch, cell, batch.column("row").to_numpy() % subs[cell], np.full(len(batch), -np.inf))

    def able(batches):
        """Every block of every cell that the threshold doesn't shut out."""
        for batch in batches:
            if len(batch):
                least = np.array([-np.inf if x is None else float(x) for x in batch.column("least").to_pylist()])
                own, cells = np.nonzero(cell_bounds(batch) >= np.maximum(least, -1e300)[:, None])
                repeat = subs[cells]
                sub = np.arange(int(repeat.sum())) - np.repeat(np.cumsum(repeat) - repeat, repeat)
                own, cells = np.repeat(own, repeat), np.repeat(cells, repeat)
                yield sent_to(own, batch, cells, sub, least[own])

    first = searched(asked.mapInArrow(nearest, f"{VECTOR}, sub int, least double"), blocks, known, k, query_block)
    least = stored(ranked(first, k).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("least")))
    told = asked.join(least, "row", "left").select("row", "id", "cell", "v", "t", "least")
    hits = searched(stored(told.mapInArrow(able, f"{VECTOR}, sub int, least double")), blocks, known, k, query_block)
    return ranked(hits, k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


#: The same search by all inner products of different rows; lists are numbered from 1 there.
ORACLE = """
WITH ok AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM ok q JOIN ok c ON c.row <> q.row
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
