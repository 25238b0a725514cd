"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents has on average. The
whole part is taken as it is; the fraction is a probability. Of two documents with fractions, words are
moved from one to the other, in a direction drawn so that neither fraction changes on average, until
one of them is 0 or 1. So a source's words stay what they were, and the documents' own averages too.
Groups of GROUP neighbouring documents leave one fraction each; these meet in groups again, a tree over
the source's documents that leaves one fraction. Where all of a group have the same fraction, each
document, the largest first, is paired with all that are smaller as one, so that a small one is left.

What is left at the end is drawn, which costs up to one document. So that it is a small one, a
source's smallest documents, as many as can take up any other document, are held back: the others come
first, the fraction they leave moves its words to or from all documents held back at once, and these
then have a tree of their own.

Defined results: a null text has no words; documents without words take none and are no part of the
draws; a null source is a source of its own and the last; rows with the same doc_id are documents of
their own; a source without words has target 0; an empty table gives no rows; further columns don't
matter. Draws depend on the rows and the seed alone, not on how they are dealt out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspring.cloud import with_pid
from voxelspring.llm.common import mix64, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_COPIES = 1.5, 2.0
#: Fractions that meet in a group.
GROUP = 256
SEED = 13
WORDS = r"[^\x20\x09-\x0D]+"


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each text."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(sid, source, source_size, target): sources in order of code points, null last, and their words to take.

    A rate for each unit of weight is raised until the sources that stop at `most` times their size and
    those that follow the rate make up the share together; only sums come to the driver.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__last", F.col("source").isNull())
    own = with_pid(own, "__last", "source", name="sid", count=False).drop("__last")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    own = stored(own.withColumn("weight", F.element_at(listed, (F.col("sid") % len(weights) + 1).cast("int"))))
    top = F.col("source_size") * F.lit(float(most))
    everything = own.agg(F.sum("source_size")).first()[0] or 0
    wanted, rate, before = share * everything, 0.0, -1
    while True:
        stops = top <= F.col("weight") * F.lit(rate)
        held, weight, n = own.agg(F.sum(F.when(stops, top).otherwise(0.0)), F.sum(F.when(stops, 0.0).otherwise(F.col("weight"))), F.count_if(stops)).first()
        if n == before or not weight:
            break
        rate, before = (wanted - held) / weight, n
    return own.select("sid", "source", "source_size", F.least(top, F.col("weight") * F.lit(rate)).alias("target"))


def _held_back(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(sid, cut, pool): documents whose size has at most `cut` binary digits are held back; they have
    `pool` words together. The smallest cut at which these could take up the largest other document,
    or else the one that comes nearest to it."""
    bits = F.length(F.bin("size"))
    classes = sizes.where("size > 0").groupBy("source", bits.alias("bits")).agg(F.sum("size").alias("words"), F.max("size").alias("largest"))
    part = F.col("target") / F.col("source_size")
    fraction = part - F.floor(part)
    own = classes.join(targets, classes.source.eqNullSafe(targets.source)).select("sid", "bits", "words", "largest", F.least(fraction, 1 - fraction).alias("room"))
    up = Window.partitionBy("sid").orderBy("bits")
    own = own.select("sid", "bits", "room", F.sum("words").over(up).alias("pool"), F.max("largest").over(up.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    # the last class has none above it, and is taken only if it is the only one
    reach = F.when(F.col("above").isNull(), -1.0).otherwise(F.least(F.lit(1.0), F.col("pool") * F.col("room") / F.col("above")))
    best = F.max_by(F.struct(F.col("bits").alias("cut"), "pool"), F.struct(reach, -F.col("bits"))).alias("best")
    return own.groupBy("sid").agg(best).select("sid", "best.cut", "best.pool")


def draws(seed: int, *numbers) -> np.ndarray:
    """Uniform numbers below 1 from whole numbers."""
    h = np.uint64(seed)
    for n in numbers:
        h = mix64(np.atleast_1d(np.asarray(n, np.int64)).view(np.uint64) + mix64(np.atleast_1d(h)))
    return (h >> np.uint64(11)) / float(1 << 53)


def moved(p: float, size: float, q: float, other: float, u: float) -> tuple[float, float]:
    """p and q after words were moved between the two: one of them is 0 or 1 then."""
    gain, loss = min(size * (1 - p), other * q), min(size * p, other * (1 - q))
    if u * (gain + loss) < loss:
        return (1.0 if gain == size * (1 - p) else p + gain / size), (0.0 if gain == other * q else q - gain / other)
    return (0.0 if loss == size * p else p - loss / size), (1.0 if loss == other * (1 - q) else q + loss / other)


def settle(parts: list[float], sizes: list[float], u) -> int | None:
    """Round the fractions in place, one after the other; returns the one that is left, if any."""
    left = None
    for i, q in enumerate(parts):
        if not 0 < q < 1:
            continue
        if left is None:
            left = i
            continue
        parts[left], parts[i] = moved(parts[left], sizes[left], q, sizes[i], u[i])
        left = next((k for k in (left, i) if 0 < parts[k] < 1), None)
    return left


def settle_alike(parts: list[float], sizes: list[float], u) -> int | None:
    """As settle, for one and the same fraction: each document, the largest first, is paired with all that
    are smaller as one, so that a small one is left."""
    order = sorted(range(len(parts)), key=lambda i: -sizes[i])
    q, rest = parts[0], sum(sizes)
    for nth, i in enumerate(order):
        rest -= sizes[i]
        if 0 < q < 1 and rest:
            parts[i], q = moved(q, sizes[i], q, rest, u[i])
        else:
            parts[i] = q
        if 0 < parts[i] < 1:
            for k in order[nth + 1 :]:
                parts[k] = q
            return i
    return None


COLUMNS = ("sid", "number", "part", "size", "doc_id", "source_size", "target", "whole")
SCHEMA = "sid long, number long, part double, size long, doc_id long, source_size long, target double, whole long"


def _round(units: DataFrame, width: int, seed: int, last: bool = False) -> DataFrame:
    """The units after a round over groups of `width` numbers; with last, what is left is drawn."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("number").select(COLUMNS)
        numbers = group.column("number").to_numpy()
        parts, sizes = group.column("part").to_pylist(), [float(s) for s in group.column("size").to_pylist()]
        left = (settle_alike if len(set(parts)) == 1 else settle)(parts, sizes, draws(seed, width, numbers))
        if last and left is not None:
            parts[left] = float(draws(seed, -1, numbers[left])[0] < parts[left])
        return group.set_column(2, "part", pa.array(parts, pa.float64()))

    return units.select(*COLUMNS).groupBy("sid", F.floor(F.col("number") / F.lit(width)).alias("__group")).applyInArrow(run, SCHEMA)


def _tree(units: DataFrame, count: int, group: int, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """Settled units by round, and at most one for each source that isn't."""
    settled, width = [], 1
    while True:
        width *= group
        units = stored(_round(units, width, seed))
        settled.append(units.where("part IN (0, 1)"))
        units = units.where("part NOT IN (0, 1)")
        if width >= count:
            return settled, units


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): taken words of each document, whole copies of it."""
    sizes = stored(sizes_of(docs))
    targets = stored(source_targets(sizes, weights, share, most))
    held = stored(_held_back(sizes, targets))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of = targets.join(held, "sid", "left").select(F.col("source").alias("of"), "sid", "source_size", "target", "cut", copies.alias("copies"))
    all_ = sizes.join(of, sizes.source.eqNullSafe(F.col("of"))).withColumn("whole", F.floor("copies").cast("long"))
    all_ = all_.withColumn("part", F.when(F.col("size") > 0, F.col("copies") - F.col("whole")).otherwise(0.0))
    plain = all_.where("part = 0").select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size")).alias("taken"))
    back = F.length(F.bin("size")) <= F.col("cut")
    units = with_pid(all_.where("part > 0").withColumn("back", back), "sid", "back", "doc_id", "size", name="number", count=False)
    units = stored(units.select(*COLUMNS, "back"))
    count = units.count()
    settled, rest = _tree(units.where("NOT back"), count, group, seed)
    # the fraction that is left moves its words to or from all that is held back
    pools = units.where("back").groupBy("sid").agg(F.sum("size").alias("pool"), F.first("part").alias("pool_part"))

    def shared(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["part"], r["pool_part"] = moved(r["part"], float(r["size"]), r["pool_part"], float(r.pop("pool")), float(draws(seed, 0, r["number"])[0]))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(f.name, f.type) for f in batch.schema if f.name != "pool"]))

    given = stored(rest.join(pools, "sid").select(*COLUMNS, "pool_part", "pool").mapInArrow(shared, SCHEMA + ", pool_part double"))
    alone = rest.join(pools, "sid", "left_anti")
    changed = units.where("back").drop("back").join(given.select("sid", "pool_part"), "sid", "left").withColumn("part", F.coalesce("pool_part", "part"))
    more, left = _tree(changed, count, group, seed)
    ends = _round(alone.union(given.select(*COLUMNS)).union(left), max(count, 1), seed, last=True)
    parts = reduce(DataFrame.union, [*settled, *more, ends])
    taken = ((F.col("whole") + F.col("part").cast("long")) * F.col("size")).alias("taken")
    return parts.select("doc_id", "size", "source_size", "target", taken).union(plain)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def targets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the mix but the draws: sizes and targets of every document."""
    sizes = stored(sizes_of(table(spark, sf_dir, "documents")))
    targets = source_targets(sizes).withColumnRenamed("source", "of")
    return sizes.join(targets, sizes.source.eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


TARGETS_ORACLE = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
  w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight FROM s),
  o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source) AS nth FROM w),
  c AS (SELECT *, (1.5 * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY nth DESC) AS rate FROM o),
  r AS (SELECT arg_min(rate, nth) AS rate FROM c WHERE rate * weight <= 2 * source_size)
  SELECT doc_id, size, source_size, round(least(2.0 * source_size, weight * r.rate)::DOUBLE, 4) AS target FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source, r"""
