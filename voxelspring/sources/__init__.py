"""Readers and writers: delimited text, LAS, PLY, OBJ."""

from __future__ import annotations

from voxelspring.sources.las import read_las
from voxelspring.sources.ply import read_ply, write_ply, write_ply_parts
from voxelspring.sources.text import corner_lines, read_delimited, read_obj, read_whitespace, table_to_cloud, write_corners, write_one_text, write_text

__all__ = [
    "corner_lines", "read_delimited", "read_las", "read_obj", "read_ply", "read_whitespace", "table_to_cloud",
    "write_corners", "write_one_text", "write_ply", "write_ply_parts", "write_text",
]
