"""Queries over the driver's tables and the equivalent DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspring import functions as X
from voxelspring import sources
from voxelspring.cloud import bounds, lines_cloud, rounded, vectors_cloud
from voxelspring.operators import blocks, cluster, generate, kmeans, neighbors, normals, plane, polygon, select, voxel
from voxelspring.plans import sql, table_functions
from voxelspring.plans.sql import RGB, XYZ
from voxelspring.plans.sql import rounded as R
from voxelspring.sources.files import numbered_lines
from voxelspring.sources.text import text_columns, write_one_text
from voxelspring.storage import Kept, drop_stored, shared_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Large clouds, numbered once for each session and state of their table, along the numbers and along the Z-order.
_kept = Kept()

POI, RADIUS, SIZE = (25.0, 50.0, 9.0), 50.0, 6.0
IDS = (3, 14, 15, 92, 65, 35, 89)
BALL = f"(x-25.0)*(x-25.0)+(y-50.0)*(y-50.0)+(z-9.0)*(z-9.0) <= {RADIUS * RADIUS}"
#: Plane distance, hypotheses, planes of the two loops; the last two as the reference has them.
T, ITERATIONS, PLANES, REFINED = 0.05, 1000, 10, 20
EPS, LEAST = 0.05, 5
#: Lloyd's rounds at most, in both engines; the test clouds need fewer.
ROUNDS = 100


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made() -> DataFrame:
        numbered = lines_cloud(spark, sf_dir)
        out = stored(numbered)
        drop_stored(numbered)
        return out

    return _kept.get(spark, f"{sf_dir}/lineitem.parquet", "lines", made)


def _line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cloud in Z-order, with the numbers of blocks."""
    return _kept.get(spark, f"{sf_dir}/lineitem.parquet", "index", lambda: blocks.z_ordered(_lines(spark, sf_dir)))


def _line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = lambda: blocks.packed(_line_index(spark, sf_dir).select("pid", "x", "y", "z", "block"))
    return _kept.get(spark, f"{sf_dir}/lineitem.parquet", "blocks", points)


def query(name: str, oracle: str | None = None, view: str | None = None, digits: int = 6):
    """Register a query. view: the cloud it takes: L, the same in Z-order (Z), or E; without one it takes
    (spark, sf_dir) itself."""

    def register(f):
        if view is None:
            QUERIES[name] = f
        else:
            make = {"L": _lines, "Z": _line_index, "E": vectors_cloud}[view]
            QUERIES[name] = lambda spark, sf_dir: rounded(f(make(spark, sf_dir)), digits)
        if oracle is not None and view is None:
            ORACLES[name] = oracle
        elif oracle is not None:
            cloud = sql.E_SQL if view == "E" else sql.L_SQL
            ORACLES[name] = f"WITH RECURSIVE {cloud}{oracle if oracle.startswith(',') else ' ' + oracle}"
        return f

    return register


def columns(expressions: dict) -> list:
    return [e.alias(n) for n, e in expressions.items()]


def xyz() -> tuple:
    return tuple(map(F.col, "xyz"))


def rgb() -> tuple:
    return tuple(map(F.col, "rgb"))


# --- scans, filters, columns


@query("scan_points", f"SELECT pid, {XYZ}, cls, {RGB} FROM L", "L")
def _scan(c):
    return c


@query("filter_above_mean_z", f"SELECT pid, {XYZ}, cls FROM L WHERE z > (SELECT avg(z) FROM L)", "L")
def _above_mean(c):
    return select.above_mean(c).select("pid", "x", "y", "z", "cls")


@query("filter_class", f"SELECT pid, {XYZ}, cls FROM L WHERE cls = 6", "L")
def _of_class(c):
    return select.of_class(c, 6).select("pid", "x", "y", "z", "cls")


@query("distinct_classes", "SELECT DISTINCT cls FROM L", "L")
def _classes(c):
    return c.select("cls").distinct().orderBy("cls")


CLASS_CASES = ", ".join(
    R(f"CAST(CASE cls WHEN 1 THEN {a} WHEN 2 THEN {b} WHEN 6 THEN {c} WHEN 9 THEN {d} WHEN 26 THEN {e} ELSE 0 END AS DOUBLE)", n)
    for n, a, b, c, d, e in (("r", 0.611, 0.8, 0.901, 0.564, 0.694), ("g", 0.8, 0.67, 0.419, 0.85, 0.662), ("b", 0.521, 0.521, 0.431, 0.913, 0.698))
)


@query("class_to_color", f"SELECT pid, cls, {CLASS_CASES} FROM L", "L")
def _class_colors(c):
    return c.select("pid", "cls", *columns(X.class_color(F.col("cls"))))


@query("class_red_black", "SELECT pid, CAST(CASE WHEN cls = 6 THEN 1 ELSE 0 END AS DOUBLE) AS r, 0.0::DOUBLE AS g, 0.0::DOUBLE AS b FROM L", "L")
def _red_black(c):
    return c.select("pid", *columns(X.red_black(F.col("cls"))))


@query("select_ids", f"SELECT pid, {XYZ} FROM L WHERE pid IN {IDS}", "L")
def _select_ids(c):
    return select.by_ids(c, IDS).select("pid", "x", "y", "z")


@query("select_ids_inverted", f"SELECT pid, {XYZ} FROM L WHERE pid NOT IN {IDS}", "L")
def _select_others(c):
    return select.by_ids(c, IDS, invert=True).select("pid", "x", "y", "z")


@query("radius_query", f"SELECT pid, {XYZ} FROM L WHERE {BALL}", "L")
def _radius(c):
    return select.within(c, POI, RADIUS).select("pid", "x", "y", "z")


@query("radius_query_z_order", f"SELECT pid, {XYZ} FROM L WHERE (x-20.0)*(x-20.0)+(y-30.0)*(y-30.0)+(z-6.0)*(z-6.0) <= 16.0", "Z")
def _small_radius(c):
    return select.within(c, (20.0, 30.0, 6.0), 4.0).select("pid", "x", "y", "z")


MANY_BALLS = f"SELECT p.pid AS a, q.pid AS b, {R(sql.D2, 'd2')} FROM L p JOIN L q ON {sql.D2} <= 2.25 WHERE p.pid % 500 = 0"


@query("radius_query_many", f"WITH {sql.L_SQL} {MANY_BALLS}")
def _many_balls(spark, sf_dir):
    centers = _lines(spark, sf_dir).where("pid % 500 = 0")
    return rounded(neighbors.balls(_line_blocks(spark, sf_dir), centers, 1.5))


RESCALED = ", ".join(R(f"CAST(floor({k} * 255) AS INTEGER) / 255.0::DOUBLE", k) for k in "rgb")


@query("rescale_color", f"SELECT pid, {RESCALED} FROM L", "L")
def _rescale(c):
    return c.select("pid", *[X.rescaled(F.floor(F.col(k) * 255).cast("int"), 255).alias(k) for k in "rgb"])


@query("paint_uniform", "SELECT pid, 1.0::DOUBLE AS r, 0.5::DOUBLE AS g, 0.0::DOUBLE AS b FROM L", "L")
def _paint(c):
    return c.select("pid", *columns(X.uniform(1, 0.5, 0)))


@query("translate", f"SELECT pid, {R('x + 10.0', 'x')}, {R('y - 5.0', 'y')}, {R('z + 2.5', 'z')} FROM L", "L")
def _translate(c):
    return select.translate(c, 10, -5, 2.5).select("pid", "x", "y", "z")


@query("decimate", f"SELECT pid, {XYZ} FROM L WHERE pid % 160 = 0", "L")
def _decimate(c):
    return select.decimate(c, 160).select("pid", "x", "y", "z")


@query("decimate_ranked", f", K AS (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS rn FROM L WHERE cls = 6) SELECT pid, {XYZ} FROM K WHERE rn % 160 = 0", "L")
def _decimate_ranked(c):
    return select.decimate(select.of_class(c, 6), 160, dense=False).select("pid", "x", "y", "z")


@query("merge_clouds", f"SELECT pid, {XYZ} FROM L WHERE cls = 1 UNION ALL SELECT pid, {XYZ} FROM L WHERE cls = 6", "L")
def _merge(c):
    return select.merge(select.of_class(c, 1), select.of_class(c, 6)).select("pid", "x", "y", "z")


@query("point_count", "SELECT count(*) AS n FROM L", "L")
def _count(c):
    return c.agg(F.count(F.lit(1)).alias("n"))


PLANE_DISTANCE = "(0.5*x - 0.25*y + 1.0*z + 2.0) / sqrt(0.5*0.5 + 0.25*0.25 + 1.0)"
VECTORS = ", ".join(
    R(e, n)
    for e, n in (
        ("y*b-z*g", "cx"), ("z*r-x*b", "cy"), ("x*g-y*r", "cz"), ("x*r+y*g+z*b", "dot"),
        ("sqrt(x*x+y*y+z*z)", "len"), ("atan2(x-25.0, y-50.0)", "bearing"),
    )
)


@query("vector_columns", f"SELECT pid, {VECTORS} FROM L", "L")
def _vectors(c):
    cross = dict(zip(("cx", "cy", "cz"), X.cross(xyz(), rgb()), strict=True))
    bearing = X.bearing(F.col("x"), F.col("y"), F.lit(25.0), F.lit(50.0))
    return c.select("pid", *columns(cross | {"dot": X.dot(xyz(), rgb()), "len": X.norm(xyz()), "bearing": bearing}))


@query("export_text", "SELECT pid, printf('%1.4f', x) AS x, printf('%1.4f', z) AS z, printf('%1.4f', cls::DOUBLE) AS cls FROM L", "L")
def _export(c):
    return c.select("pid", *text_columns(c.select("x", "z", "cls"), 4))


@query("plane_text", "SELECT printf('%.2fx + %.2fy + %.2fz + %.2f = 0', r, g, r - g, x) AS plane, pid FROM L", "L")
def _plane_text(c):
    return c.select("pid", X.plane_text((F.col("r"), F.col("g"), F.col("r") - F.col("g"), F.col("x"))).alias("plane"))


@query("ply_round_trip", f"SELECT pid, {XYZ} FROM L", "L")
def _ply_round_trip(c):
    path = f"{shared_dir(c.sparkSession)}/cloud-{uuid.uuid4().hex}.ply"
    sources.write_ply(c.select("pid", "x", "y", "z"), path)
    return sources.read_ply(c.sparkSession, path)


@query("text_round_trip", f"SELECT CAST(pid AS DOUBLE) AS pid, {XYZ} FROM L", "L")
def _text_round_trip(c):
    path = f"{shared_dir(c.sparkSession)}/cloud-{uuid.uuid4().hex}"
    sources.write_text(c.select("pid", "x", "y", "z"), path, None, sep=" ")
    return sources.read_whitespace(c.sparkSession, path, ["pid", "x", "y", "z"], skip=0)


@query("export_one_file", "SELECT pid AS nth, printf('%1.4f;%1.4f;%1.4f', x, z, cls::DOUBLE) AS line FROM L", "L")
def _one_file(c):
    path = f"{shared_dir(c.sparkSession)}/cloud-{uuid.uuid4().hex}.xyz"
    write_one_text(c, path, "pid", columns=("x", "z", "cls"))
    return numbered_lines(c.sparkSession, path).select("nth", F.col("value").alias("line"))


# --- voxels

PER_AXIS = ", ".join(f"CAST(ceil((max({c})-min({c}))/{SIZE}) AS BIGINT) AS n{c}" for c in "xyz")
IN_VOXELS = f", {sql.voxels('L', SIZE)}"
IN_CENTRED_VOXELS = f", {sql.voxels('L', SIZE, SIZE / 2)}"


@query("voxels_per_axis", f"SELECT {PER_AXIS} FROM L", "L")
def _per_axis(c):
    return voxel.voxels_per_axis(c, SIZE)


@query("bounds", f"SELECT {', '.join(R(f'{f}({c})', f + c) for c in 'xyz' for f in ('min', 'max'))} FROM L", "L")
def _bounds(c):
    return bounds(c)


LOW = f"SELECT * FROM (SELECT 'low' AS kind, pid, {XYZ} FROM L ORDER BY L.z, pid LIMIT 1)"
HIGH = f"SELECT * FROM (SELECT 'high' AS kind, pid, {XYZ} FROM L ORDER BY L.z DESC, pid LIMIT 1)"


@query("low_high_points", f"{LOW} UNION ALL {HIGH}", "L")
def _low_high(c):
    return select.low_high(c)


@query("voxel_counts", f"{IN_VOXELS} SELECT vx, vy, vz, count(*) AS n FROM V GROUP BY ALL", "L")
def _voxel_counts(c):
    return voxel.voxel_counts(c, SIZE)


@query("voxel_barycenter", f"{IN_VOXELS} SELECT vx, vy, vz, count(*) AS n, {', '.join(R(f'avg({c})', c) for c in 'xyz')} FROM V GROUP BY vx, vy, vz", "L")
def _barycenters(c):
    return voxel.barycenters(c, SIZE)


BEST_POINT = f"""{IN_VOXELS}, M AS (SELECT vx, vy, vz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM V GROUP BY ALL),
  N AS (SELECT V.*, round((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz), 9) AS d2 FROM V JOIN M USING (vx, vy, vz)),
  K AS (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY d2, pid) AS rn FROM N)
  SELECT vx, vy, vz, pid, {XYZ} FROM K WHERE rn = 1"""


@query("voxel_best_point", BEST_POINT, "L")
def _best_point(c):
    return voxel.subsample(c, SIZE, digits=9)


@query("voxel_members", f"{IN_VOXELS} SELECT vx, vy, vz, pid, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY pid) AS rank FROM V", "L")
def _members(c):
    return voxel.member_rows(c, SIZE).select("vx", "vy", "vz", "pid", "rank")


MEMBER_LISTS = "SELECT vx, vy, vz, CAST(count(*) AS INTEGER) AS n, min(pid) AS first, max(pid) AS last, sum(pid)::BIGINT AS total FROM V GROUP BY ALL"


@query("voxel_member_lists", f"{IN_VOXELS} {MEMBER_LISTS}", "L")
def _member_lists(c):
    ids = F.col("points.pid")
    total = F.aggregate(ids, F.lit(0).cast("long"), lambda a, b: a + b)
    return voxel.members(c, SIZE).select("vx", "vy", "vz", F.size("points").alias("n"), ids[0].alias("first"), F.element_at(ids, -1).alias("last"), total.alias("total"))


@query("voxel_color", f"{IN_CENTRED_VOXELS} SELECT vx, vy, vz, count(*) AS n, {', '.join(R(f'avg({c})', c) for c in 'rgb')} FROM V GROUP BY vx, vy, vz", "L")
def _voxel_colors(c):
    return voxel.voxel_colors(c, SIZE)


@query("top_voxel", f"{IN_CENTRED_VOXELS}, {sql.TOP_OF_COLUMN} SELECT vx, vy, vz, {RGB} FROM T", "L")
def _top_voxel(c):
    return voxel.top_of_column(voxel.voxel_colors(c, SIZE))


COVERAGE = f""", B AS (SELECT pid, x, y, z, CAST(CASE WHEN cls = 6 THEN 1 ELSE 0 END AS DOUBLE) AS r, 0.0 AS g, 0.0 AS b FROM L WHERE {BALL}),
  {sql.voxels('B', SIZE, SIZE / 2)}, {sql.TOP_OF_COLUMN},
  N AS (SELECT count(*) FILTER (NOT (r = 0 AND g = 0 AND b = 0)) AS built, count(*) FILTER (r = 0 AND g = 0 AND b = 0) AS rest FROM T)
  SELECT built, rest, built * 36.0::DOUBLE AS built_area, rest * 36.0::DOUBLE AS rest_area, {R('built / nullif(built + rest, 0)', 'ratio')} FROM N"""


@query("built_coverage", COVERAGE, "L")
def _coverage(c):
    near = select.within(c, POI, RADIUS).withColumns(X.red_black(F.col("cls")))
    return voxel.coverage(voxel.top_of_column(voxel.voxel_colors(near, SIZE)), SIZE)


# --- polygons and meshes

AREA = R("abs(sum(t)) / 2", "area")


@query("polygon_area_unsorted", f", P AS (SELECT pid AS o, x, y FROM E WHERE pid < 12), {sql.SHOELACE} SELECT {AREA} FROM S", "E")
def _area(c):
    return polygon.area(c.where("pid < 12")).select("area")


@query("polygon_area_sorted", f", {sql.SORTED_RING}, {sql.SHOELACE} SELECT {AREA} FROM S", "E")
def _sorted_area(c):
    return polygon.area(polygon.sorted_ring(c.where("pid < 12"), digits=12), "ord").select("area")


@query("export_corners", f", {sql.SORTED_RING} SELECT CAST(o AS INTEGER) - 1 AS ord, printf('%1.9f;%1.9f', x, y) AS line FROM P", "E")
def _corners(c):
    return sources.corner_lines(c.where("pid < 12"), digits=12)


@query("export_corners_unsorted", ", P AS (SELECT row_number() OVER (ORDER BY pid) AS o, x, y FROM E WHERE pid < 12) SELECT CAST(o AS INTEGER) - 1 AS ord, printf('%1.9f;%1.9f', x, y) AS line FROM P", "E")
def _corners_unsorted(c):
    return sources.corner_lines(c.where("pid < 12"), in_order=False)


@query("ring_centroid", f"SELECT {R('avg(x)', 'x')}, {R('avg(y)', 'y')} FROM E WHERE pid < 12", "E")
def _centroid(c):
    return polygon.centroid(c.where("pid < 12"))


@query("mesh_center", f"SELECT {R('avg(p_size)', 'x')}, {R('avg(p_retailprice)', 'y')}, {R('avg(p_partkey % 18)', 'z')} FROM part")
def _mesh_center(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    x, y, z = F.col("p_size").cast("double"), F.col("p_retailprice"), (F.col("p_partkey") % 18).cast("double")
    return rounded(normals.mesh_center(part.select(F.col("p_partkey").alias("vid"), x.alias("x"), y.alias("y"), z.alias("z"))))


TETRA = [(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 2.0)]
FACES = [(1, 3, 2), (1, 2, 4), (1, 4, 3), (2, 3, 4)]


def vertex_normals_sql(weight: str) -> str:
    """weight: what a face's normal is divided by."""
    return f"""WITH v(vid, x, y, z) AS (VALUES {', '.join(map(str, TETRA))}), f(v1, v2, v3) AS (VALUES {', '.join(map(str, FACES))}),
  n AS (SELECT v1, v2, v3, (q.y-p.y)*(s.z-p.z)-(q.z-p.z)*(s.y-p.y) AS a, (q.z-p.z)*(s.x-p.x)-(q.x-p.x)*(s.z-p.z) AS b,
      (q.x-p.x)*(s.y-p.y)-(q.y-p.y)*(s.x-p.x) AS c
    FROM f JOIN v p ON p.vid = v1 JOIN v q ON q.vid = v2 JOIN v s ON s.vid = v3),
  u AS (SELECT unnest([v1, v2, v3]) AS vid, a / {weight} AS a, b / {weight} AS b, c / {weight} AS c FROM n),
  t AS (SELECT vid, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(c)::DOUBLE AS c FROM u GROUP BY vid)
  SELECT CAST(vid AS BIGINT) AS vid, {', '.join(R(f'{k} / sqrt(a*a+b*b+c*c)', n) for k, n in zip('abc', ('nx', 'ny', 'nz'), strict=True))} FROM t"""


def _tetra(spark):
    return spark.createDataFrame(TETRA, "vid long, x double, y double, z double"), spark.createDataFrame(FACES, "v1 long, v2 long, v3 long")


@query("mesh_vertex_normals", vertex_normals_sql("1"))
def _vertex_normals(spark, sf_dir):
    return rounded(normals.vertex_normals(*_tetra(spark)))


@query("mesh_vertex_normals_even", vertex_normals_sql("sqrt(a*a+b*b+c*c)"))
def _vertex_normals_even(spark, sf_dir):
    return rounded(normals.vertex_normals(*_tetra(spark), weighted=False))


@query("sphere_mesh", f"{sql.SPHERE} SELECT CAST(vid AS BIGINT) AS vid, {XYZ} FROM v")
def _sphere(spark, sf_dir):
    return rounded(generate.sphere_mesh(spark)[0])


@query("sphere_mesh_center", f"{sql.SPHERE} SELECT {R('avg(x)', 'x')}, {R('avg(y)', 'y')}, {R('avg(z)', 'z')} FROM v")
def _sphere_center(spark, sf_dir):
    return rounded(normals.mesh_center(generate.sphere_mesh(spark)[0]))


@query("generate_shapes")
def _shapes(spark, sf_dir):
    return rounded(generate.shapes(spark, 10000, 8, 7))


# --- table functions in SQL text


@query("sql_subsampling", BEST_POINT.replace("SELECT vx, vy, vz, pid,", "SELECT vx + vy * 1000 + vz * 1000000 AS voxel, pid,"), "L")
def _sql_subsampling(c):
    table_functions.register(c)
    return c.sparkSession.sql("SELECT vx + vy * 1000 + vz * 1000000 AS voxel, pid, x, y, z FROM grid_subsampling(6.0)")


@query("sql_plane_segment", f"SELECT cls, count(*) AS n, count(*) FILTER (abs({PLANE_DISTANCE}) <= 20) AS inliers FROM L WHERE {BALL} GROUP BY cls", "L")
def _sql_segment(c):
    table_functions.register(c)
    text = f"""SELECT cls, count(*) AS n, count_if(is_inlier) AS inliers FROM plane_segment(0.5, -0.25, 1.0, 2.0, 20.0)
      WHERE {BALL} GROUP BY cls"""
    return c.sparkSession.sql(text)


@query("sql_ring", f", {sql.SORTED_RING} SELECT CAST(o AS INTEGER) - 1 AS ord, {R('x')}, {R('y')} FROM P", "E")
def _sql_ring(c):
    table_functions.register(c)
    return c.sparkSession.sql("SELECT ord, x, y FROM sorted_ring(0, 11)")


# --- planes

E_HYPOTHESES, L_HYPOTHESES = sql.hypotheses("E", "H", ITERATIONS), sql.hypotheses("L", "H", ITERATIONS)


@query("plane_distance", f"SELECT pid, {R(PLANE_DISTANCE, 'distance')} FROM L", "L")
def _plane_distance(c):
    return c.select("pid", X.plane_distance(xyz(), tuple(map(F.lit, (0.5, -0.25, 1.0, 2.0)))).alias("distance"))


SCORES = f"S AS (SELECT it, a, b, c, d, count(*) FILTER (abs({sql.DISTANCE}) <= {T}) AS n FROM E, H GROUP BY ALL)"


@query("ransac_hypotheses", f", {E_HYPOTHESES}, {SCORES} SELECT it, {sql.ABCD}, n FROM S", "E")
def _hypotheses(c):
    return plane.score(c, plane.hypotheses(c, ITERATIONS), T)


@query("ransac_plane", f"WITH {sql.L_SQL}, {L_HYPOTHESES}, {sql.best('L', 'H', 'B', T)} SELECT it, {sql.ABCD}, n FROM B")
def _ransac(spark, sf_dir):
    return rounded(plane.ransac_plane(_lines(spark, sf_dir), T, ITERATIONS, blocks=_line_blocks(spark, sf_dir)))


@query("multi_plane_line", f", LX AS (SELECT pid, x, y, z FROM L), {sql.multi_plane(2, T, 100, cloud='LX')} SELECT pid, segment FROM Y", "L")
def _multi_plane_line(c):
    return plane.multi_plane(c.select("pid", "x", "y", "z"), 2, T, 100)[1].select("pid", "segment")


@query("ransac_segment", f", {E_HYPOTHESES}, {sql.best('E', 'H', 'B', T)} SELECT pid, abs({sql.DISTANCE}) <= {T} AS is_inlier FROM E, B", "E")
def _segment(c):
    return plane.segment(c, T, ITERATIONS).select("pid", "is_inlier")


AUTO = f"{sql.neighbours('NB', own=False)}, TH AS MATERIALIZED (SELECT avg(sqrt(d2)) AS t FROM NB WHERE rank <= 7)"


@query("ransac_auto", f", {AUTO}, {E_HYPOTHESES}, {sql.best('E', 'H', 'B', '(SELECT t FROM TH)')} SELECT it, {sql.ABCD}, n FROM B", "E")
def _auto(c):
    return plane.ransac_plane(c, "auto", ITERATIONS)


@query("multi_plane", f", {sql.multi_plane(PLANES, T, ITERATIONS)} SELECT pid, segment FROM Y", "E")
def _multi_plane(c):
    return plane.multi_plane(c, PLANES, T, ITERATIONS)[1].select("pid", "segment")


@query("plane_palette", f", {sql.multi_plane(PLANES, T, ITERATIONS)} SELECT pid, {sql.palette('segment', X.TAB20)} FROM Y", "E")
def _plane_palette(c):
    found = plane.multi_plane(c, PLANES, T, ITERATIONS)[1]
    return found.select("pid", *columns(X.palette_color(F.col("segment"), X.TAB20)))


@query("refined_planes", sql.refined_planes(REFINED, T, ITERATIONS, 0.1, LEAST), "E")
def _refined(c):
    return plane.refined_planes(c, REFINED, T, ITERATIONS, 0.1, LEAST).select("pid", "segment")


# --- neighbours

NEAR = f", {sql.neighbours('NB', own=False)}"
HYBRID = sql.neighbours("HY", f"{sql.D2} <= 0.1*0.1")


@query("knn", f"{NEAR} SELECT a, b, rank, {R('sqrt(d2)', 'distance')} FROM NB WHERE rank <= 7", "E")
def _knn(c):
    return neighbors.knn(c, 8).select("a", "b", "rank", F.sqrt("d2").alias("distance"))


@query("knn_line", f""", K AS (SELECT p.pid AS a, q.pid AS b, {sql.D2} AS d2 FROM L p JOIN L q ON p.pid <> q.pid WHERE p.pid % 200 = 0),
  N AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY d2, b) AS INTEGER) AS rank FROM K)
  SELECT a, b, rank, {R('sqrt(d2)', 'distance')} FROM N WHERE rank <= 7""", "L")
def _knn_line(c):
    return neighbors.knn(c, 8, asked=F.col("pid") % 200 == 0).select("a", "b", "rank", F.sqrt("d2").alias("distance"))


@query("mean_spacing", f"{NEAR} SELECT {R('avg(sqrt(d2))', 'spacing')} FROM NB WHERE rank <= 7", "E")
def _spacing(c):
    return neighbors.mean_spacing(c, 8)


@query("hybrid_neighbors", f", {HYBRID} SELECT a, b, rank FROM HY WHERE rank <= 16", "E")
def _hybrid(c):
    return neighbors.hybrid(c, 0.1, 16).select("a", "b", "rank")


@query("eps_pairs", f"SELECT p.pid AS a, q.pid AS b FROM E p JOIN E q ON {sql.D2} <= 0.05*0.05", "E")
def _eps_pairs(c):
    return neighbors.radius_pairs(c, c, 0.05).select("a", "b")


@query("normals_hybrid", f", {HYBRID}, {sql.normals('HY', 16)}", "E", digits=5)
def _normals(c):
    return normals.point_normals(c, 0.1, 16)


@query("normals_default", f", {sql.neighbours('NN')}, {sql.normals('NN', 30)}", "E", digits=5)
def _default_normals(c):
    return normals.point_normals(c)


# --- clusters

DB = ", " + sql.dbscan("E", "D", EPS, LEAST)


@query("dbscan_labels", f"{DB} SELECT pid, label FROM D", "E")
def _dbscan(c):
    return cluster.dbscan(c, EPS, LEAST)


@query("cluster_sizes", f"{DB} SELECT label, count(*) AS n FROM D GROUP BY label", "E")
def _sizes(c):
    return cluster.cluster_sizes(cluster.dbscan(c, EPS, LEAST))


@query("largest_cluster", f"{DB} SELECT label, count(*) AS n FROM D GROUP BY label ORDER BY n DESC, label LIMIT 1", "E")
def _largest(c):
    return cluster.largest_cluster(cluster.dbscan(c, EPS, LEAST))


@query("cluster_count", f"{DB} SELECT count(DISTINCT label) AS clusters FROM D WHERE label >= 0", "E")
def _cluster_count(c):
    return cluster.cluster_count(cluster.dbscan(c, EPS, LEAST))


@query("label_split", f"{DB} SELECT pid, label >= 0 AS kept FROM D", "E")
def _label_split(c):
    return cluster.dbscan(c, EPS, LEAST).select("pid", (F.col("label") >= 0).alias("kept"))


def painted(labels: DataFrame, colors: tuple) -> DataFrame:
    top = F.broadcast(labels.agg(F.max("label").alias("top")))
    return labels.crossJoin(top).select("pid", *columns(X.label_color(F.col("label"), F.col("top"), colors)))


@query("label_palette", DB + sql.label_palette("D", X.TAB20), "E")
def _label_palette(c):
    return painted(cluster.dbscan(c, EPS, LEAST, dense=True), X.TAB20)


RESIDUAL = f", {sql.multi_plane(1, T, ITERATIONS, rows=False)}, {sql.dbscan('F0', 'D', EPS, LEAST)}"


def _residual(c):
    return plane.multi_plane(c, 1, T, ITERATIONS)[1].where("segment < 0")


@query("residual_clusters", f"{RESIDUAL} SELECT pid, label FROM D", "E")
def _residual_clusters(c):
    return cluster.dbscan(_residual(c), EPS, LEAST)


@query("residual_palette", RESIDUAL + sql.label_palette("D", X.PALETTE), "E")
def _residual_palette(c):
    return painted(cluster.dbscan(_residual(c), EPS, LEAST, dense=True), X.PALETTE)


@query("wcss_k1", f"SELECT {R('var_pop(x)*count(*) + var_pop(y)*count(*) + var_pop(z)*count(*)', 'wcss')} FROM E", "E")
def _wcss(c):
    return cluster.total_squares(c, ["x", "y", "z"])


def _first_three(c, names: str):
    return c.where("pid < 3").select(F.col("pid").alias("label"), *names)


@query("kmeans_fixed_init", f"{sql.lloyd('E', 'xyz', 3)} SELECT pid, label FROM A3", "E")
def _lloyd(c):
    return cluster.lloyd(c, list("xyz"), _first_three(c, "xyz"), 3, 9).select("pid", "label")


@query("wcss_k3", f"{sql.lloyd('E', 'xyz', 3)} SELECT {R('sum(d2)', 'wcss', 5)} FROM A3", "E", digits=5)
def _wcss_of_three(c):
    return cluster.inertia(cluster.lloyd(c, list("xyz"), _first_three(c, "xyz"), 3, 9))


@query("kmeans_six_features", f"{sql.lloyd('L', 'xyzrgb', 2)} SELECT pid, label FROM A2", "L")
def _six_features(c):
    return cluster.lloyd(c, list("xyzrgb"), _first_three(c, "xyzrgb"), 2, 9).select("pid", "label")


def _kmeans_sql(cloud: str, columns: str, k: int, seed: int, numbers: list[int] | None = None) -> str:
    return sql.kmeans(cloud, columns, numbers or [k], [kmeans.draw(seed, i) for i in range(k)], ROUNDS)


@query("kmeans_six_ml", f"{_kmeans_sql('L', 'xyzrgb', 3, 0)} SELECT pid, CAST(label AS INTEGER) AS label FROM A", "L")
def _six_ml(c):
    return cluster.kmeans(c, list("xyzrgb"), 3, 0, ROUNDS, 9)[0]


@query("kmeans_ml", f"{_kmeans_sql('E', 'xy', 2, 42)} SELECT pid, CAST(label AS INTEGER) AS label FROM A", "E")
def _kmeans(c):
    return cluster.kmeans(c, ["x", "y"], 2, 42, ROUNDS, 9)[0]


@query("elbow", f"{_kmeans_sql('E', 'xyz', 19, 42, list(range(1, 20)))} SELECT CAST(k AS INTEGER) AS k, {R('sum(d2)', 'wcss', 5)} FROM A GROUP BY k", "E", digits=5)
def _elbow(c):
    return cluster.elbow(c, ["x", "y", "z"], 19, 42, ROUNDS, 9)
