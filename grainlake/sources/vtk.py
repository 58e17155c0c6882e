"""Grids and topology elements as XML files for 3-D viewers: rectilinear (.vtr) and unstructured (.vtu) grids.

A viewer's file is one document, so rows are streamed to it in order through the driver, a partition at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainlake.functions import lattice
from grainlake.functions.box import AXES, BoxMeta
from grainlake.operators.numbering import numbered
from grainlake.sources import grids
from grainlake.sources.shared import materialise

# Cell types of the format by their number of corners, and corners of each kind of element.
CELL_TYPES = {1: 1, 2: 3, 4: 9}
CELL_WIDTH = {"voxel": 1, "edge": 2, "face": 4}


def _array(out, kind: str, name: str, parts: int, values: Iterable) -> None:
    out.write(f'<DataArray type="{kind}" Name={quoteattr(name)} NumberOfComponents="{parts}" format="ascii">\n')
    for v in values:
        many = v if isinstance(v, (list, tuple)) else (v,)
        out.write(" ".join(f"{x:.9g}" if isinstance(x, float) else f"{x}" for x in many) + "\n")
    out.write("</DataArray>\n")


def _attribute(out, rows: DataFrame, name: str) -> None:
    """A column in the order of the rows: a number, or an array of 3 (vectors, normals) or 9 (matrices, row by row)
    numbers; arrays of 2 are vectors whose third component is 0."""
    values = (r[0] for r in rows.select(name).toLocalIterator())
    kind = rows.schema[name].dataType
    if not isinstance(kind, T.ArrayType):
        _array(out, "Float32" if isinstance(kind, (T.DoubleType, T.FloatType)) else "Int64", name, 1, values)
        return
    first = next(values, None)
    parts = max(3, len(first or ()))

    def full(v: list) -> list[float]:
        if parts not in (3, 9) or len(v) not in (2, parts):
            raise ValueError(f"attribute {name} has {len(v)} components, not 2, 3 or 9 throughout")
        return [float(x) for x in v] + [0.0] * (parts - len(v))

    _array(out, "Float32", name, parts, (full(v) for v in itertools.chain([] if first is None else [first], values)))


def _opening(kind: str, normals: str | None) -> str:
    return f"<{kind} Normals={quoteattr(normals)}>\n" if normals else f"<{kind}>\n"


def _open(path: str | Path, kind: str):
    out = Path(path).open("w", encoding="utf-8")
    out.write(f'<?xml version="1.0"?>\n<VTKFile type="{kind}" version="0.1" byte_order="LittleEndian">\n')
    return out


def write_rectilinear(path: str | Path, grid: DataFrame, box: BoxMeta, attributes: list[str], normals: str | None = None) -> None:
    """A point for each voxel of a dense grid, with attributes; coordinates are where voxels 0 to d-1 begin. Of the
    attributes, ``normals`` is the one that holds unit normals."""
    extent = " ".join(f"0 {d - 1}" for d in box.dim)
    with _open(path, "RectilinearGrid") as out:
        out.write(f'<RectilinearGrid WholeExtent="{extent}"><Piece Extent="{extent}">\n{_opening("PointData", normals)}')
        for name in attributes:
            _attribute(out, grid.select("vid", name).orderBy("vid"), name)
        out.write("</PointData>\n<Coordinates>\n")
        for k, axis in enumerate(AXES):
            o, s = box.world[k], box.spacing[k]
            _array(out, "Float32", axis, 1, ((o - s / 2) + s * i for i in range(box.dim[k])))
        out.write("</Coordinates>\n</Piece></RectilinearGrid></VTKFile>\n")


def corner_points(spark: SparkSession, box: BoxMeta) -> DataFrame:
    """``vid, px, py, pz``: the world points of all corners of the box's voxels, by their numbers in the extended box."""
    wide = box.extended()
    at = wide.base(*(F.col(a) for a in AXES))
    return grids.positions(spark, wide).select("vid", *(p.alias(f"p{a}") for p, a in zip(at, AXES)))


def cells(elements: DataFrame, box: BoxMeta, kind: str) -> DataFrame:
    """``elements(color, key, axis, x, y, z, ...)`` with the corners of each in place of its position: of faces, edges or
    voxels (a point)."""
    at = [F.col(a) for a in AXES]
    corners: dict[str, Column] = {"face": lattice.cell_corners(box, F.col("axis"), *at), "edge": lattice.cell_ends(box, F.col("axis"), *at), "voxel": F.array(box.extended().vid(*at))}
    rest = [c for c in elements.columns if c not in ("color", "key", "axis", *AXES)]
    return elements.select("color", "key", corners[kind].alias("corners"), *rest)


def write_unstructured(path: str | Path, rows: DataFrame, box: BoxMeta, kind: str, attributes: tuple[str, ...] = (), normals: str | None = None) -> None:
    """Cells of ``rows(color, key, axis, x, y, z)`` in the order of color and key, with the attribute ``color`` and others."""
    ordered = materialise(cells(rows, box, kind), "cells").orderBy("color", "key")
    wide, n, width = box.extended(), ordered.count(), CELL_WIDTH[kind]
    with _open(path, "UnstructuredGrid") as out:
        out.write(f'<UnstructuredGrid><Piece NumberOfPoints="{wide.size}" NumberOfCells="{n}">\n<Points>\n')
        points = corner_points(rows.sparkSession, box).orderBy("vid").drop("vid").toLocalIterator()
        _array(out, "Float32", "Points", 3, map(tuple, points))
        out.write("</Points>\n<Cells>\n")
        _array(out, "Int64", "connectivity", 1, (r.corners for r in ordered.select("corners", "color", "key").toLocalIterator()))
        _array(out, "Int64", "offsets", 1, range(width, (n + 1) * width, width))
        _array(out, "UInt8", "types", 1, itertools.repeat(CELL_TYPES[width], n))
        out.write(f"</Cells>\n{_opening('CellData', normals)}")
        for name in ("color", *attributes):
            _attribute(out, ordered, name)
        out.write("</CellData>\n</Piece></UnstructuredGrid></VTKFile>\n")


def _lattice_place(units: DataFrame) -> list[Column]:
    h = [F.col(c) for c in ("hx", "hy", "hz")]
    axis = F.coalesce(lattice.face_axis(*h), lattice.edge_axis(*h))
    return [axis.alias("axis"), *(p.cast("int").alias(a) for p, a in zip(lattice.voxel_of(*h), AXES))]


def element_rows(units: DataFrame, id_col: str, *rest: str) -> DataFrame:
    """``color, key, axis, x, y, z`` (and ``rest``) of lattice units ``id, key, hx, hy, hz``: elements count from 1 in the
    order of their ids, and their units lie in the order of ``key``. Units whose id is null are left out."""
    colors = numbered(units.select(F.col(id_col).alias("_id")).where("_id is not null").distinct(), "_color", "_id")
    held = units.join(colors, F.col(id_col).eqNullSafe(F.col("_id")))
    return held.select((F.col("_color") + 1).alias("color"), "key", *_lattice_place(units), *rest)


def element_list_rows(units: DataFrame, *rest: str) -> DataFrame:
    """The same of units that are elements by themselves, which count from 0 in the order of ``key``."""
    return numbered(units, "color", "key").select("color", "key", *_lattice_place(units), *rest)


def grain_rows(labels: DataFrame, *rest: str) -> DataFrame:
    """``color, key, axis, x, y, z`` of the voxels of grains, which count from 1 in the order of their labels; of kind
    ``voxel``. Voxels without a label are left out."""
    colors = numbered(labels.select(F.col("label").alias("_id")).where("_id is not null").distinct(), "_color", "_id")
    held = labels.join(colors, F.col("label") == F.col("_id"))
    return held.select((F.col("_color") + 1).alias("color"), F.col("vid").alias("key"), F.lit(None).cast("int").alias("axis"), *AXES, *rest)


def vertex_rows(vertices: DataFrame, *rest: str) -> DataFrame:
    """``color, key, axis, x, y, z`` of vertices, a point each, which count from 0 in the order of their numbers."""
    return numbered(vertices, "color", "vid").select("color", F.col("vid").alias("key"), F.lit(None).cast("int").alias("axis"), *AXES, *rest)
