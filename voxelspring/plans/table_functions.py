"""Table functions for SQL text over a cloud: they are expanded into the query's own plan, so filters and
columns reach the scan, and no row leaves the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = "pid BIGINT, x DOUBLE, y DOUBLE, z DOUBLE"
VOXEL = "vx BIGINT, vy BIGINT, vz BIGINT"


def _functions(view: str) -> dict[str, str]:
    keys = ", ".join(f"CAST(floor(({c} - low{c}) / size) AS BIGINT) AS v{c}" for c in "xyz")
    low = ", ".join(f"min({c}) AS low{c}" for c in "xyz")
    keyed = f"SELECT pid, x, y, z, {keys} FROM {view} CROSS JOIN (SELECT {low} FROM {view})"
    means = ", ".join(f"avg({c}) AS m{c}" for c in "xyz")
    d2 = "round((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), 9)"
    return {
        # one real point for each occupied voxel, the nearest to the barycentre
        "grid_subsampling": f"""(size DOUBLE) RETURNS TABLE ({VOXEL}, {POINT}) RETURN
            WITH k AS ({keyed}), m AS (SELECT vx, vy, vz, {means} FROM k GROUP BY vx, vy, vz),
              b AS (SELECT vx, vy, vz, min_by(struct(pid, x, y, z), struct({d2}, pid)) AS p FROM k JOIN m USING (vx, vy, vz) GROUP BY vx, vy, vz)
            SELECT vx, vy, vz, p.pid, p.x, p.y, p.z FROM b""",
        "voxel_counts": f"(size DOUBLE) RETURNS TABLE ({VOXEL}, n BIGINT) RETURN WITH k AS ({keyed}) SELECT vx, vy, vz, count(*) FROM k GROUP BY vx, vy, vz",
        "points_within": f"""(cx DOUBLE, cy DOUBLE, cz DOUBLE, radius DOUBLE) RETURNS TABLE ({POINT}) RETURN
            SELECT pid, x, y, z FROM {view} WHERE x BETWEEN cx - radius AND cx + radius AND y BETWEEN cy - radius AND cy + radius
              AND z BETWEEN cz - radius AND cz + radius AND (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) <= radius * radius""",
        # whether each point is within the threshold of ax + by + cz + d = 0; a point's place and class come along,
        # so that filters and groups on them need no join of the whole cloud
        "plane_segment": f"""(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, threshold DOUBLE)
            RETURNS TABLE (pid BIGINT, distance DOUBLE, is_inlier BOOLEAN, x DOUBLE, y DOUBLE, z DOUBLE, cls INT) RETURN
            SELECT pid, e, abs(e) <= threshold, x, y, z, cls FROM (SELECT *, (a * x + b * y + c * z + d) / sqrt(a * a + b * b + c * c) AS e FROM {view})""",
        # a ring's corners by falling bearing about their mean, from 0, and the area that they enclose then
        "sorted_ring": f"""(low BIGINT, high BIGINT) RETURNS TABLE (ord INT, pid BIGINT, x DOUBLE, y DOUBLE) RETURN
            WITH r AS (SELECT pid, x, y FROM {view} WHERE pid BETWEEN low AND high), m AS (SELECT avg(x) AS mx, avg(y) AS my FROM r)
            SELECT CAST(row_number() OVER (ORDER BY round(atan2(x - mx, y - my), 12) DESC, pid) - 1 AS INT), pid, x, y FROM r CROSS JOIN m""",
    }


def register(cloud: DataFrame, view: str = "points") -> list[str]:
    """Make a cloud (pid, x, y, z) and the functions over it known, with cls where it has one, to its session's SQL under `view` and
    their own names; returns these. A later call puts another cloud in their place."""
    spark = cloud.sparkSession
    cls = F.col("cls").cast("int") if "cls" in cloud.columns else F.lit(None).cast("int").alias("cls")
    cloud.select("pid", "x", "y", "z", cls).createOrReplaceTempView(view)
    made = _functions(view)
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return [*made]
