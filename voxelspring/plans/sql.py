"""Pieces of DuckDB SQL for the checks: the test clouds, voxels, planes, clusters, normals."""

from __future__ import annotations

L_SQL = """L AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pid,
         l_quantity AS x, l_extendedprice/1000 AS y, (l_discount + l_tax)*100 + 0.0 AS z,
         CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 6 END AS INTEGER) AS cls,
         l_quantity/50 AS r, l_discount*10 AS g, l_tax*12.5 AS b
  FROM lineitem)"""
E_SQL = """E AS MATERIALIZED (
  SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label AS cls
  FROM embeddings)"""


def rounded(expression: str, name: str | None = None, digits: int = 6) -> str:
    """As cloud.rounded: the small addend keeps values that end in a 5 on one side."""
    return f"round({expression} + 1e-9, {digits}) + 0.0 AS {name or expression}"


XYZ = ", ".join(rounded(c) for c in "xyz")
RGB = ", ".join(rounded(c) for c in "rgb")
ABCD = ", ".join(rounded(c) for c in "abcd")
D2 = "(p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)"
DISTANCE = "(a*x+b*y+c*z+d)"


def voxels(cloud: str, size: float, shift: float = 0.0, name: str = "V") -> str:
    keys = ", ".join(f"CAST(floor(({c} - (min{c} - {shift})) / {size}) AS BIGINT) AS v{c}" for c in "xyz")
    low = f"SELECT min(x) AS minx, min(y) AS miny, min(z) AS minz FROM {cloud}"
    return f"{name} AS MATERIALIZED (SELECT t.*, {keys} FROM {cloud} t, ({low}))"


TOP_OF_COLUMN = """C AS (SELECT vx, vy, vz, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM V GROUP BY vx, vy, vz),
  T AS (SELECT vx, vy, max(vz) AS vz, arg_max(r, vz) AS r, arg_max(g, vz) AS g, arg_max(b, vz) AS b FROM C GROUP BY vx, vy)"""
SHOELACE = """S AS (
  SELECT o, x * coalesce(lead(y) OVER (ORDER BY o), first_value(y) OVER (ORDER BY o))
            - coalesce(lead(x) OVER (ORDER BY o), first_value(x) OVER (ORDER BY o)) * y AS t
  FROM P)"""
SORTED_RING = """Q AS (SELECT * FROM E WHERE pid < 12),
  A AS (SELECT *, round(atan2(x - (SELECT avg(x) FROM Q), y - (SELECT avg(y) FROM Q)), 12) AS angle FROM Q),
  P AS (SELECT row_number() OVER (ORDER BY angle DESC, pid) AS o, x, y FROM A)"""


def hypotheses(cloud: str, name: str, iterations: int) -> str:
    """PLANES of the cloud: it, a, b, c, d."""
    draws = f"""SELECT i, (i*7919+13)%n AS s1, ((i*7919+13)%n + 1 + (i*104729+17)%(n-1))%n AS s2, (i*1299709+29)%n AS s3
    FROM {name}n, range(1, {iterations + 1}) t(i) WHERE n >= 3"""
    return f"""{name}k AS MATERIALIZED (SELECT x, y, z, row_number() OVER (ORDER BY pid) - 1 AS rn FROM {cloud}),
  {name}n AS MATERIALIZED (SELECT count(*) AS n FROM {cloud}),
  {name}d AS MATERIALIZED ({draws}),
  {name}p AS (SELECT i, p.x AS px, p.y AS py, p.z AS pz, (q.y-p.y)*(s.z-p.z)-(q.z-p.z)*(s.y-p.y) AS nx,
      (q.z-p.z)*(s.x-p.x)-(q.x-p.x)*(s.z-p.z) AS ny, (q.x-p.x)*(s.y-p.y)-(q.y-p.y)*(s.x-p.x) AS nz
    FROM {name}d JOIN {name}k p ON p.rn = s1 JOIN {name}k q ON q.rn = s2 JOIN {name}k s ON s.rn = s3 WHERE s3 <> s1 AND s3 <> s2),
  {name}l AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS len FROM {name}p),
  {name}u AS (SELECT i AS it, px, py, pz, nx/len AS a, ny/len AS b, nz/len AS c FROM {name}l WHERE len > 0),
  {name} AS MATERIALIZED (SELECT it, a, b, c, -(a*px+b*py+c*pz) AS d FROM {name}u)"""


def best(cloud: str, planes: str, name: str, threshold: float | str) -> str:
    near = f"SELECT it, a, b, c, d, count(*) AS n FROM (SELECT x, y, z FROM {cloud}), {planes} WHERE abs({DISTANCE}) <= {threshold} GROUP BY ALL"
    return f"{name} AS MATERIALIZED ({near} ORDER BY n DESC, it LIMIT 1)"


def multi_plane(planes: int, threshold: float, iterations: int, rows: bool = True, cloud: str = "E") -> str:
    """Planes fitted one after the other; F<planes - 1> is what is left. With rows, ends in the query."""
    parts = []
    for i in range(planes):
        parts += [hypotheses(cloud, f"H{i}", iterations), best(cloud, f"H{i}", f"B{i}", threshold)]
        parts.append(f"I{i} AS MATERIALIZED (SELECT {cloud}.*, coalesce(abs({DISTANCE}) <= {threshold}, false) AS near FROM {cloud} LEFT JOIN B{i} ON true)")
        parts.append(f"F{i} AS MATERIALIZED (SELECT pid, x, y, z FROM I{i} WHERE NOT near)")
        cloud = f"F{i}"
    found = [f"SELECT pid, CAST({i} AS INTEGER) AS segment FROM I{i} WHERE near" for i in range(planes)]
    found.append(f"SELECT pid, CAST(-1 AS INTEGER) AS segment FROM {cloud}")
    return ", ".join(parts) + (f", Y AS ({' UNION ALL '.join(found)})" if rows else "")


def dbscan(cloud: str, name: str, eps: float, least: int) -> str:
    return f"""{name}e AS MATERIALIZED (SELECT p.pid AS a, q.pid AS b FROM {cloud} p JOIN {cloud} q ON {D2} <= {eps}*{eps}),
  {name}c AS MATERIALIZED (SELECT a AS pid FROM {name}e GROUP BY a HAVING count(*) >= {least}),
  {name}k AS MATERIALIZED (SELECT a, b FROM {name}e WHERE a IN (SELECT pid FROM {name}c) AND b IN (SELECT pid FROM {name}c)),
  {name}r(pid, low) AS (SELECT pid, pid FROM {name}c UNION SELECT k.b, r.low FROM {name}r r JOIN {name}k k ON k.a = r.pid),
  {name}l AS MATERIALIZED (SELECT pid, min(low) AS label FROM {name}r GROUP BY pid),
  {name}m AS MATERIALIZED (SELECT e.a AS pid, min(label) AS label FROM {name}e e JOIN {name}l l ON l.pid = e.b GROUP BY e.a),
  {name} AS MATERIALIZED (SELECT t.pid, coalesce(l.label, m.label, -1) AS label
    FROM {cloud} t LEFT JOIN {name}l l ON l.pid = t.pid LEFT JOIN {name}m m ON m.pid = t.pid)"""


def refined_planes(planes: int, threshold: float, iterations: int, eps: float, least: int) -> str:
    """Rounds of a plane and the largest cluster of its inliers; the others stay in the pool."""
    parts, cloud = [], "E"
    for i in range(planes):
        parts += [hypotheses(cloud, f"H{i}", iterations), best(cloud, f"H{i}", f"B{i}", threshold)]
        parts.append(f"I{i} AS MATERIALIZED (SELECT {cloud}.* FROM {cloud}, B{i} WHERE abs({DISTANCE}) <= {threshold})")
        parts.append(dbscan(f"I{i}", f"D{i}", eps, least))
        top = f"SELECT label FROM D{i} GROUP BY label ORDER BY count(*) DESC, label LIMIT 1"
        parts.append(f"K{i} AS MATERIALIZED (SELECT pid FROM D{i} WHERE label = ({top}))")
        parts.append(f"F{i} AS MATERIALIZED (SELECT pid, x, y, z FROM {cloud} WHERE pid NOT IN (SELECT pid FROM K{i}))")
        cloud = f"F{i}"
    found = [f"SELECT pid, CAST({i} AS INTEGER) AS segment FROM K{i}" for i in range(planes)]
    found.append(f"SELECT pid, CAST(-1 AS INTEGER) AS segment FROM {cloud}")
    return ", " + ", ".join(parts) + " " + " UNION ALL ".join(found)


def palette(index: str, colors: tuple) -> str:
    def channel(i: int) -> str:
        listed = ", ".join(str(c[i]) for c in colors)
        return f"CAST(CASE WHEN {index} < 0 THEN 0 ELSE ([{listed}])[CAST({index} % {len(colors)} + 1 AS BIGINT)] END AS DOUBLE)"

    return ", ".join(rounded(channel(i), n) for i, n in enumerate("rgb"))


def label_palette(labels: str, colors: tuple) -> str:
    """Colours at label / top of the palette, labels counted from 0; black for noise."""
    return f""", M AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS nth FROM (SELECT DISTINCT label FROM {labels} WHERE label >= 0)),
  G AS (SELECT t.pid, coalesce(nth, -1) AS lab FROM {labels} t LEFT JOIN M USING (label)),
  X AS (SELECT pid, CASE WHEN lab < 0 THEN -1
      ELSE least(CAST(floor(lab / (CASE WHEN top > 0 THEN top ELSE 1 END)::DOUBLE * {len(colors)}) AS BIGINT), {len(colors) - 1}) END AS i
    FROM G, (SELECT max(lab) AS top FROM G))
  SELECT pid, {palette('i', colors)} FROM X"""


def lloyd(cloud: str, columns: str, rounds: int, digits: int = 9) -> str:
    """A<rounds>: pid, label, d2 after some rounds from the first three points."""
    d2 = "round(" + "+".join(f"(p.{c}-q.{c})*(p.{c}-q.{c})" for c in columns) + f", {digits})"
    listed = ", ".join(f"p.{c}" for c in columns)
    parts = [f"C0 AS MATERIALIZED (SELECT pid AS label, {', '.join(columns)} FROM {cloud} WHERE pid < 3)"]
    for i in range(rounds + 1):
        parts.append(f"A{i} AS MATERIALIZED (SELECT p.pid, {listed}, arg_min(q.label, ({d2}, q.label)) AS label, min({d2}) AS d2 FROM {cloud} p, C{i} q GROUP BY p.pid, {listed})")
        means = ", ".join(f"coalesce(avg(a.{c}), any_value(c.{c})) AS {c}" for c in columns)
        parts.append(f"C{i + 1} AS MATERIALIZED (SELECT c.label, {means} FROM C{i} c LEFT JOIN A{i} a USING (label) GROUP BY c.label)")
    return ", " + ", ".join(parts)


def kmeans(cloud: str, columns: str, numbers: list[int], draws: list[int], rounds: int, digits: int = 9) -> str:
    """A: k, pid, label, d2 of k-means++ with given draws and Lloyd's rounds for each number of clusters."""
    listed = ", ".join(columns)
    d2 = "+".join(f"(p.{c}-q.{c})*(p.{c}-q.{c})" for c in columns)
    span = "+".join(f"(max({c})-min({c}))*(max({c})-min({c}))" for c in columns)
    parts = [f"kb AS MATERIALIZED (SELECT {span} AS s, count(*) AS n FROM {cloud})"]
    parts.append(f"s0 AS MATERIALIZED (SELECT {listed} FROM (SELECT *, row_number() OVER (ORDER BY pid) - 1 AS rn FROM {cloud}), kb WHERE rn = {draws[0]} % n)")
    parts.append(f"d0 AS MATERIALIZED (SELECT p.pid, {', '.join(f'p.{c}' for c in columns)}, {d2} AS d2 FROM {cloud} p, s0 q)")
    for i, number in enumerate(draws[1:], 1):
        weights = f"SELECT d.*, CAST(floor(d2 / s * {1 << 40}.0::DOUBLE) AS BIGINT) AS w FROM d{i - 1} d, kb"
        sums = f"SELECT *, sum(w) OVER (ORDER BY pid) AS upto, sum(w) OVER () AS total FROM ({weights})"
        parts.append(f"s{i} AS MATERIALIZED (SELECT {listed} FROM ({sums}) WHERE w > 0 AND upto > {number} % total ORDER BY pid LIMIT 1)")
        parts.append(f"d{i} AS MATERIALIZED (SELECT p.* REPLACE (least(p.d2, {d2}) AS d2) FROM d{i - 1} p, s{i} q)")
    seeds = " UNION ALL ".join(f"SELECT {i} AS label, * FROM s{i}" for i in range(len(draws)))
    near = f"round({d2}, {digits})"
    best = f"SELECT q.k, p.pid, {', '.join(f'any_value(p.{c}) AS {c}' for c in columns)}, arg_min(q.label, ({near}, q.label)) AS label FROM {cloud} p, km q GROUP BY q.k, p.pid"
    means = ", ".join(f"coalesce(avg(a.{c}), any_value(c.{c}))" for c in columns)
    parts.append(f"""km(it, k, label, {listed}) AS (SELECT 0, k, label, {listed} FROM ({seeds}), (SELECT unnest({numbers}) AS k) WHERE label < k
    UNION ALL SELECT any_value(c.it) + 1, c.k, c.label, {means} FROM km c LEFT JOIN ({best}) a ON a.k = c.k AND a.label = c.label WHERE c.it < {rounds} GROUP BY c.k, c.label)""")
    parts.append(f"A AS MATERIALIZED (SELECT q.k, p.pid, arg_min(q.label, ({near}, q.label)) AS label, min({d2}) AS d2 FROM {cloud} p, km q WHERE q.it = {rounds} GROUP BY q.k, p.pid)")
    return ", " + ", ".join(parts)


def neighbours(name: str, within: str = "true", own: bool = True) -> str:
    """Ranked neighbours of E under a condition on p and q."""
    order = f"row_number() OVER (PARTITION BY p.pid ORDER BY {D2}, q.pid)"
    return f"{name} AS MATERIALIZED (SELECT p.pid AS a, q.pid AS b, {D2} AS d2, CAST({order} AS INTEGER) AS rank FROM E p JOIN E q ON {within} AND ({own} OR p.pid <> q.pid))"


def normals(pairs: str, most: int, digits: int = 5) -> str:
    """Unit normals from ranked neighbours: the eigenvector of the least eigenvalue in closed form."""
    cov = ", ".join(f"covar_pop({p}, {q}) AS {p}{q}" for p, q in ("xx", "xy", "xz", "yy", "yz", "zz"))
    minors = (
        ("xy*yz - xz*(yy-low)", "xz*xy - (xx-low)*yz", "(xx-low)*(yy-low) - xy*xy"),
        ("xy*(zz-low) - xz*yz", "xz*xz - (xx-low)*(zz-low)", "(xx-low)*yz - xy*xz"),
        ("(yy-low)*(zz-low) - yz*yz", "yz*xz - xy*(zz-low)", "xy*yz - (yy-low)*xz"),
    )
    crosses = ", ".join(f"{{s: pow({a}, 2) + pow({b}, 2) + pow({c}, 2), x: {a}, y: {b}, z: {c}}} AS n{i}" for i, (a, b, c) in enumerate(minors))
    return f"""W AS (SELECT a, x, y, z FROM {pairs} JOIN E ON E.pid = {pairs}.b WHERE rank <= {most}),
  CV AS (SELECT a AS pid, count(*) AS m, {cov} FROM W GROUP BY a),
  C1 AS (SELECT *, (xx+yy+zz)/3 AS mean FROM CV),
  C2 AS (SELECT *, sqrt((pow(xx-mean,2)+pow(yy-mean,2)+pow(zz-mean,2)+2*(pow(xy,2)+pow(xz,2)+pow(yz,2)))/6) AS p FROM C1),
  C3 AS (SELECT *, CASE WHEN p = 0 THEN NULL ELSE (((xx-mean)/p)*(((yy-mean)/p)*((zz-mean)/p)-(yz/p)*(yz/p))
      - (xy/p)*((xy/p)*((zz-mean)/p)-(yz/p)*(xz/p)) + (xz/p)*((xy/p)*(yz/p)-((yy-mean)/p)*(xz/p)))/2 END AS h FROM C2),
  C4 AS (SELECT *, mean + 2*p*cos(acos(greatest(-1.0, least(1.0, h)))/3 + 2*pi()/3) AS low FROM C3),
  C5 AS (SELECT pid, m, {crosses} FROM C4),
  C6 AS (SELECT pid, m, CASE WHEN n0.s >= n1.s AND n0.s >= n2.s THEN n0 WHEN n1.s >= n2.s THEN n1 ELSE n2 END AS v FROM C5),
  C7 AS (SELECT pid, v.x/sqrt(v.s) AS nx, v.y/sqrt(v.s) AS ny, v.z/sqrt(v.s) AS nz FROM C6 WHERE m >= 3 AND v.s > 0),
  C8 AS (SELECT pid, nx, ny, nz, CASE WHEN abs(nz) > 1e-9 THEN sign(nz) WHEN abs(ny) > 1e-9 THEN sign(ny) ELSE sign(nx) END AS g FROM C7)
  SELECT E.pid, {rounded('nx * g', 'nx', digits)}, {rounded('ny * g', 'ny', digits)}, {rounded('nz * g', 'nz', digits)} FROM E LEFT JOIN C8 USING (pid)"""


SPHERE = """WITH v AS (
  SELECT 0 AS vid, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 1.0::DOUBLE AS z UNION ALL SELECT 1, 0.0, 0.0, -1.0 UNION ALL
  SELECT i + 2, sin(a) * cos(t), sin(a) * sin(t), cos(a)
  FROM (SELECT i, (i // 40 + 1) * pi() / 20 AS a, i % 40 * 2 * pi() / 40 AS t FROM range(760) r(i)))"""
