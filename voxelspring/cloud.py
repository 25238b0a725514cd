"""The point cloud as a DataFrame: pid, x, y, z and any attributes on the same row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspring.storage import stored

XYZ = ("x", "y", "z")

#: Rows of a range that a task sorts, about; a task's memory goes with them, some 250 bytes a row.
RANGE = 1 << 20


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """df dealt out by ranges of an order and sorted within them. Ranges are as many as shuffle partitions, or more
    where these would get more than RANGE rows each, so that a task does not grow with the table."""
    least = -(-df.count() // RANGE)
    more = least > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(least, *order) if more else df.repartitionByRange(*order)).sortWithinPartitions(*order)


def with_pid(df: DataFrame, *order: str, name: str = "pid", kept: list[Column | str] | None = None, count: bool = True) -> DataFrame:
    """df with a dense number from 0 in the given order, as a stored table. kept: the columns that are stored,
    all without it; columns that only order need not be. count: count the rows first, which bounds a task's
    part but is another run of df; without it ranges are as many as shuffle partitions.

    Rows are dealt out by ranges of the whole order, so no key is too frequent for a task, and sorted
    where they are. A row's number is that of the rows in earlier partitions plus its place in its own;
    what is counted over partitions has a row for each partition.
    """
    at = F.monotonically_increasing_id()  # the partition above bit 33, the place in it below
    ordered = in_ranges(df, *order) if count else df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ordered.select(*(df.columns if kept is None else kept), at.alias("__at")))
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), part == F.col("__part")).withColumn(name, F.col("__start") + place).drop("__at", "__part", "__start")


def lines_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large test cloud: quantity, price and discount of line items as coordinates."""
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    columns = [*order, "l_discount", "l_tax", "l_returnflag"]
    cls = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(6)
    kept = [
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        ((F.col("l_discount") + F.col("l_tax")) * 100 + 0.0).alias("z"),
        cls.cast("int").alias("cls"),
        (F.col("l_quantity") / 50).alias("r"),
        (F.col("l_discount") * 10).alias("g"),
        (F.col("l_tax") * 12.5).alias("b"),
    ]
    numbered = with_pid(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns), *order, kept=kept)
    return numbered.select("pid", *XYZ, "cls", "r", "g", "b")


def vectors_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small test cloud: the first three components of each vector."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    components = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(XYZ)]
    return df.select(F.col("vec_id").alias("pid"), *components, F.col("label").alias("cls"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, and negative zero cleared, for comparing with other engines, whose last
    digits differ; the small addend keeps values that end in a 5 on one side."""

    def of(name: str, kind: str) -> Column:
        return (F.round(F.col(name) + F.lit(1e-9), digits) + F.lit(0.0)).alias(name) if kind == "double" else F.col(name)

    return df.select(*[of(c, t) for c, t in df.dtypes])


def bounds(df: DataFrame) -> DataFrame:
    """One row: minx, maxx, miny, maxy, minz, maxz."""
    return df.agg(*[f(c).alias(f"{f.__name__}{c}") for c in XYZ for f in (F.min, F.max)])


def squared_distance(a: tuple, b: tuple) -> Column:
    return sum((((p - q) * (p - q)) for p, q in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))
