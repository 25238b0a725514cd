"""Delimited clouds and OBJ meshes through Spark's own text readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspring.cloud import with_pid
from voxelspring.functions import rescaled
from voxelspring.operators import polygon
from voxelspring.sources.files import local_path, ordered_lines
from voxelspring.sources.onefile import placed_lines, write_at


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str = ";") -> DataFrame:
    """A file with a header; types come from the schema, or are inferred without one."""
    reader = spark.read.option("sep", sep).option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_whitespace(spark: SparkSession, path: str, columns: list[str], skip: int = 1) -> DataFrame:
    """Columns of numbers between white space, as doubles; the first `skip` lines of each file go."""
    lines = ordered_lines(spark, path)
    if skip:
        heads = lines.where("split = 0").groupBy("file").agg(F.min("at").alias("head"))
        lines = lines.join(F.broadcast(heads), "file").where((F.col("split") > 0) | (F.col("at") >= F.col("head") + skip))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.trim("value") != "").select(*[parts[i].cast("double").alias(c) for i, c in enumerate(columns)])


def table_to_cloud(df: DataFrame, xyz=("X", "Y", "Z"), rgb=("R", "G", "B"), depth: int = 255) -> DataFrame:
    """Named columns of a table as x, y, z and, where there are any, colours as fractions."""
    colors = [rescaled(F.col(c), depth).alias(n) for n, c in zip("rgb", rgb or (), strict=False)]
    return df.select(*[F.col(c).cast("double").alias(n) for n, c in zip("xyz", xyz, strict=True)], *colors)


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a mesh in one file, numbered from 1 in its order; of a face's references the
    vertex counts, negative ones count back from the last vertex before the face, and faces with more
    than three corners become fans. The file is read in parts and numbered by ranges."""
    parts = F.split(F.trim("value"), r"\s+")
    kept = ordered_lines(spark, path).select("split", "at", parts.alias("parts")).where(parts[0].isin("v", "f"))
    kept = with_pid(kept, "split", "at", name="line").select("line", "parts")
    vertices = with_pid(kept.where("parts[0] = 'v'"), "line", name="nth")
    faces = with_pid(kept.where("parts[0] = 'f' AND size(parts) > 3"), "line", name="nth")
    # a face's own vertices are those before it: all lines before it but faces
    all_faces = with_pid(kept.where("parts[0] = 'f'").select("line"), "line", name="earlier")
    faces = faces.join(all_faces, "line").withColumn("before", F.col("line") - F.col("earlier"))
    refs = F.transform(F.slice("parts", 2, F.size("parts") - 1), lambda t: F.split(t, "/")[0].cast("long"))
    faces = faces.withColumn("refs", refs).withColumn("c", F.expr("transform(refs, r -> if(r < 0, before + r + 1, r))"))
    fans = faces.select("nth", "c", F.explode(F.sequence(F.lit(1), F.size("c") - 2)).alias("i"))
    fans = with_pid(fans, "nth", "i", name="place")
    corners = [F.col("c")[0].alias("v1"), F.element_at("c", F.col("i") + 1).alias("v2"), F.element_at("c", F.col("i") + 2).alias("v3")]
    points = [F.col("parts")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")]
    return vertices.select((F.col("nth") + 1).alias("vid"), *points), fans.select((F.col("place") + 1).alias("fid"), *corners)


def write_text(df: DataFrame, path: str, digits: int | None = 4, sep: str = ";", integers: tuple[str, ...] = ()) -> None:
    """Every column with the given number of decimals (None: in full), without a header; columns named
    in `integers` are written as such."""
    df.select(*text_columns(df, digits, integers)).write.mode("overwrite").option("sep", sep).option("header", False).csv(path)


def write_one_text(df: DataFrame, path: str, *order: str, columns: tuple[str, ...] | None = None, digits: int | None = 4, sep: str = ";", integers: tuple[str, ...] = ()) -> int:
    """As write_text of some or all columns, but one file in the given order; returns its bytes. Every task writes its lines in
    their place, so path must be one that open() takes on all executors."""
    own = local_path(path)
    if own is None:
        raise ValueError("executors write with open(); give a path that they share, or use write_text")
    line = F.concat_ws(sep, *text_columns(df.select(*(columns or df.columns)), digits, integers)).alias("line")
    placed, size = placed_lines(df.select(line, *[F.col(c).alias(f"__{c}") for c in order]), *[f"__{c}" for c in order])
    write_at(placed, own, b"", size)
    return size


def text_columns(df: DataFrame, digits: int | None = 4, integers: tuple[str, ...] = ()):
    def written(c: str):
        return F.col(c).cast("string") if digits is None or c in integers else F.format_string(f"%1.{digits}f", F.col(c).cast("double"))

    return [written(c).alias(c) for c in df.columns]


def corner_lines(ring: DataFrame, in_order: bool = True, digits: int | None = None) -> DataFrame:
    """(ord, line): the corners of one ring as text of x and y with nine decimals, in angular order or, as
    they were picked, by pid."""
    if in_order:
        ring = polygon.sorted_ring(ring, digits=digits)
    else:
        ring = with_pid(ring, "pid", name="ord").withColumn("ord", F.col("ord").cast("int"))
    x, y = text_columns(ring.select("x", "y"), 9)
    return ring.select("ord", F.concat_ws(";", x, y).alias("line"))


def write_corners(ring: DataFrame, path: str, in_order: bool = True) -> None:
    """The corners in their order, as one text file in a folder: a ring's corners are few."""
    corner_lines(ring, in_order).coalesce(1).sortWithinPartitions("ord").select("line").write.mode("overwrite").text(path)
