"""Faces, edges and corners of voxels, on the doubled lattice and in the world.

A voxel p lies at 2p. A face lies half a voxel below it on its axis, so one coordinate is odd; an edge has two odd
coordinates and runs along the even one; a corner has three.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .box import BoxMeta

Triple = tuple[Column, Column, Column]

# The corners of a face as a renderer and as the geometry orders them (they differ on the y axis),
# as steps from the voxel's lower corner.
FACE_CELL = {0: ((0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 0, 1)), 1: ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)), 2: ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0))}
FACE_LOOP = {0: FACE_CELL[0], 1: ((0, 0, 0), (0, 0, 1), (1, 0, 1), (1, 0, 0)), 2: FACE_CELL[2]}
# Crossing directions in the order of their codes, 0 to 11: a step forward on the axis named first and one forward
# (plus) or back (minus) on the other.
CROSSINGS = {
    "XYplus": (1, 1, 0), "XYminus": (1, -1, 0), "XZplus": (1, 0, 1), "XZminus": (1, 0, -1),
    "YXplus": (1, 1, 0), "YXminus": (-1, 1, 0), "YZplus": (0, 1, 1), "YZminus": (0, 1, -1),
    "ZXplus": (1, 0, 1), "ZXminus": (-1, 0, 1), "ZYplus": (0, 1, 1), "ZYminus": (0, -1, 1),
}


def _odd(p: Column) -> Column:
    return p.bitwiseAND(1) == 1


def face_place(axis: Column, x: Column, y: Column, z: Column) -> Triple:
    """The doubled-lattice place of the face below a voxel on an axis."""
    return tuple(p * 2 - F.when(axis == k, 1).otherwise(0) for k, p in enumerate((x, y, z)))


def edge_place(axis: Column, x: Column, y: Column, z: Column) -> Triple:
    """The doubled-lattice place of the edge along an axis through a voxel's lower corner."""
    return tuple(p * 2 - F.when(axis == k, 0).otherwise(1) for k, p in enumerate((x, y, z)))


def corner_place(x: Column, y: Column, z: Column) -> Triple:
    return x * 2 - 1, y * 2 - 1, z * 2 - 1


def voxel_of(hx: Column, hy: Column, hz: Column) -> Triple:
    """The voxel that a face, edge or corner is below of: half of each coordinate, rounded up."""
    return tuple(F.shiftright(h + 1, 1) for h in (hx, hy, hz))


def is_face(axis: int, *h: Column) -> Column:
    """Odd on this axis alone."""
    return F.lit(True) & _all(_odd(p) if k == axis else ~_odd(p) for k, p in enumerate(h))


def is_edge(axis: int, *h: Column) -> Column:
    """Even on this axis alone."""
    return F.lit(True) & _all(~_odd(p) if k == axis else _odd(p) for k, p in enumerate(h))


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def face_axis(*h: Column) -> Column:
    """The axis of a face; null where the place isn't one."""
    return F.coalesce(*(F.when(is_face(k, *h), F.lit(k)) for k in range(3)))


def edge_axis(*h: Column) -> Column:
    return F.coalesce(*(F.when(is_edge(k, *h), F.lit(k)) for k in range(3)))


def steps(axes: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """Unit steps both ways along some axes."""
    return [tuple(s if j == k else 0 for j in range(3)) for k in axes for s in (1, -1)]


def moved(place: Triple, step: tuple[int, int, int]) -> Column:
    """A struct of a place a step away."""
    return F.struct(*((p + s).cast("int").alias(n) for p, s, n in zip(place, step, ("hx", "hy", "hz"))))


def cell_corners(box: BoxMeta, axis: Column, x: Column, y: Column, z: Column) -> Column:
    """Numbers of a face's four corners in the extended box, in the renderer's order."""
    wide = box.extended()
    at = {k: F.array(*(wide.vid(x + a, y + b, z + c) for a, b, c in FACE_CELL[k])) for k in range(3)}
    return F.when(axis == 0, at[0]).when(axis == 1, at[1]).otherwise(at[2])


def cell_ends(box: BoxMeta, axis: Column, x: Column, y: Column, z: Column) -> Column:
    """Numbers of an edge's two ends in the extended box."""
    wide, end = box.extended(), lambda k: F.when(axis == k, 1).otherwise(0)
    return F.array(wide.vid(x, y, z), wide.vid(x + end(0), y + end(1), z + end(2)))


def face_plane(box: BoxMeta, axis: Column, x: Column, y: Column, z: Column) -> tuple[Triple, Triple]:
    """The centre of a face and its unit normal."""
    centre = tuple(b + F.when(axis == k, F.lit(0.0)).otherwise(F.lit(s / 2)) for k, (b, s) in enumerate(zip(box.base(x, y, z), box.spacing)))
    return centre, tuple(F.when(axis == k, F.lit(1.0)).otherwise(F.lit(0.0)) for k in range(3))


def face_corners(box: BoxMeta, axis: int, x: Column, y: Column, z: Column) -> list[Triple]:
    """The four corners of a face in the world, one after another around it."""
    return [tuple(b + F.lit(s * d) for b, s, d in zip(box.base(x, y, z), box.spacing, step)) for step in FACE_LOOP[axis]]


def intersection(plane: Triple, normal: Triple, point: Triple, direction: Triple) -> Triple:
    """Where a line meets a plane; null where they are parallel, in the plane too."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    share = F.try_divide(dot(tuple(p - q for p, q in zip(plane, point)), normal), dot(direction, normal))
    return tuple(share * d + p for d, p in zip(direction, point))


def edge_ends(box: BoxMeta, axis: Column, x: Column, y: Column, z: Column) -> tuple[Triple, Triple]:
    """World points at the ends of an edge."""
    return box.base(x, y, z), box.displaced(axis, x, y, z)


def crossing(name: str, x: Column, y: Column, z: Column) -> Triple:
    """The position a crossing step away."""
    return tuple(p + s for p, s in zip((x, y, z), CROSSINGS[name]))


def crossing_code(name: Column) -> Column:
    """The code of a crossing direction; null for other names."""
    return F.array_position(F.array(*map(F.lit, CROSSINGS)), name).cast("int") - 1


def crossing_name(code: Column) -> Column:
    """The crossing direction with a code; null for numbers that are none."""
    return F.get(F.array(*map(F.lit, CROSSINGS)), code)


def crossings(axis: int, x: Column, y: Column, z: Column) -> Column:
    """The four crossing steps forward on an axis, as an array of structs ``code, x, y, z``."""
    mine = [(k, n) for k, n in enumerate(CROSSINGS) if n[0] == "XYZ"[axis]]
    return F.array(*(F.struct(F.lit(k).alias("code"), *(p.cast("int").alias(a) for p, a in zip(crossing(n, x, y, z), "xyz"))) for k, n in mine))
