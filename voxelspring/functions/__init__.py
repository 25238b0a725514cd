"""Column expressions: colours, vectors, planes, palettes, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours by class code (red, green, blue); other codes are black. Fixed values.
CLASS_COLORS = {
    1: (0.611, 0.8, 0.521),
    2: (0.8, 0.670, 0.521),
    6: (0.901, 0.419, 0.431),
    9: (0.564, 0.850, 0.913),
    26: (0.694, 0.662, 0.698),
}
BUILDING = 6
#: Twenty qualitative colours (matplotlib's tab20) as 8-bit red, green, blue. Fixed values.
TAB20_HEX = (
    "1f77b4", "aec7e8", "ff7f0e", "ffbb78", "2ca02c", "98df8a", "d62728", "ff9896", "9467bd", "c5b0d5",
    "8c564b", "c49c94", "e377c2", "f7b6d2", "7f7f7f", "c7c7c7", "bcbd22", "dbdb8d", "17becf", "9edae5",
)
TAB20 = tuple(tuple(int(h[i : i + 2], 16) / 255 for i in (0, 2, 4)) for h in TAB20_HEX)
#: Its ten strong colours (tab10).
PALETTE = TAB20[::2]


def rescaled(column: Column, depth: int = 255) -> Column:
    """An integer colour of the given depth (255 or 65535) as a fraction."""
    return column / F.lit(float(depth))


def class_color(cls: Column) -> dict[str, Column]:
    out = {}
    for i, name in enumerate("rgb"):
        column = F.lit(0.0)
        for code, color in CLASS_COLORS.items():
            column = F.when(cls == code, color[i]).otherwise(column)
        out[name] = column
    return out


def red_black(cls: Column) -> dict[str, Column]:
    """Buildings red, the rest black."""
    return {"r": F.when(cls == BUILDING, 1.0).otherwise(0.0), "g": F.lit(0.0), "b": F.lit(0.0)}


def uniform(r: float, g: float, b: float) -> dict[str, Column]:
    return {"r": F.lit(float(r)), "g": F.lit(float(g)), "b": F.lit(float(b))}


def palette_color(index: Column, palette=PALETTE) -> dict[str, Column]:
    """The index-th colour, counted round the palette; black for negative indexes."""
    at = (index % len(palette) + 1).cast("int")
    return {name: F.when(index < 0, 0.0).otherwise(F.element_at(F.array(*[F.lit(c[i]) for c in palette]), at)) for i, name in enumerate("rgb")}


def label_color(label: Column, top: Column, palette=PALETTE) -> dict[str, Column]:
    """The colour at label / top of the palette (top 0 or less counts as 1); black for noise."""
    share = label / F.when(top > 0, top).otherwise(1)
    return palette_color(F.when(label < 0, -1).otherwise(F.least(F.floor(share * len(palette)), F.lit(len(palette) - 1))), palette)


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: tuple) -> Column:
    return F.sqrt(dot(a, a))


def plane_distance(point: tuple, plane: tuple) -> Column:
    """Signed distance of a point to the plane (a, b, c, d)."""
    a, b, c, d = plane
    return (dot(point, (a, b, c)) + d) / F.sqrt(a * a + b * b + c * c)


def unit_plane_distance(point: tuple, plane: tuple) -> Column:
    """The same where (a, b, c) has length 1."""
    return dot(point, plane[:3]) + plane[3]


def bearing(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Angle from +y towards +x."""
    return F.atan2(x - cx, y - cy)


def result_name(path: str, suffix: str) -> str:
    """The file's name up to its first dot, in its folder, with a suffix: the rule for all result files."""
    folder, slash, name = path.rpartition("/")
    return folder + slash + name.split(".")[0] + suffix


def voxel_result_name(path: str, size: float) -> str:
    """The name of a sub-sampled cloud, which tells the size of the voxels."""
    return result_name(path, f"_voxel-best_point_{size:g}.xyz")


def plane_text(plane: tuple) -> Column:
    return F.format_string("%.2fx + %.2fy + %.2fz + %.2f = 0", *plane)
