"""Boxes of voxels: their extent, how serial numbers address them, and how they split and merge."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class BoxMeta:
    """A box in voxels (``origin``, ``dim``) and in the world (``world`` is the centre of voxel 0, ``spacing``)."""

    dim: tuple[int, int, int]
    origin: tuple[int, int, int] = (0, 0, 0)
    world: tuple[float, float, float] = (0.0, 0.0, 0.0)
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)

    @property
    def size(self) -> int:
        """Voxels in the box; extents below 1 are an error."""
        if min(self.dim) < 1:
            raise ValueError(f"a box needs extents of 1 or more, not {self.dim}")
        return self.dim[0] * self.dim[1] * self.dim[2]

    @property
    def bounds(self) -> tuple[int, int, int, int, int, int]:
        """Inclusive bounds: lowest and highest x, y and z."""
        return tuple(v for o, d in zip(self.origin, self.dim) for v in (o, o + d - 1))

    @property
    def minimal(self) -> bool:
        return max(self.dim) <= 1

    def extended(self) -> BoxMeta:
        """One voxel more on each axis, so that every corner of the box has a number."""
        return replace(self, dim=tuple(d + 1 for d in self.dim))

    def lattice(self) -> BoxMeta:
        """The doubled lattice of a box at origin 0: voxels at even places, faces, edges and corners between them."""
        return BoxMeta(tuple(2 * d - 1 for d in self.dim))

    def holds(self, x: int, y: int, z: int) -> bool:
        return all(0 <= p - o < d for p, o, d in zip((x, y, z), self.origin, self.dim))

    def split(self) -> tuple[BoxMeta, BoxMeta] | None:
        """Halves across the longest axis, of equal ones z before y before x; none of a single voxel."""
        if self.size <= 1:
            return None
        axis = max(range(3), key=lambda k: (self.dim[k], k))
        part = self.dim[axis] // 2
        put = lambda values, v: tuple(v if k == axis else old for k, old in enumerate(values))
        return replace(self, dim=put(self.dim, part)), replace(self, origin=put(self.origin, self.origin[axis] + part), dim=put(self.dim, self.dim[axis] - part))

    def merge(self, other: BoxMeta) -> tuple[BoxMeta, int, BoxMeta] | None:
        """The box of two adjacent ones with equal cross-sections, the axis, and the two-voxel wall between them."""
        for axis in range(3):
            rest = [k for k in range(3) if k != axis]
            if any(self.origin[k] != other.origin[k] or self.dim[k] != other.dim[k] for k in rest):
                continue
            for first, second in ((self, other), (other, self)):
                border = first.origin[axis] + first.dim[axis]
                if border == second.origin[axis]:
                    grown = tuple(first.dim[k] + second.dim[k] if k == axis else first.dim[k] for k in range(3))
                    wall = tuple(2 if k == axis else first.dim[k] for k in range(3))
                    at = tuple(border - 1 if k == axis else first.origin[k] for k in range(3))
                    return replace(first, dim=grown), axis, replace(first, origin=at, dim=wall)
        return None

    @staticmethod
    def spanning(a: tuple[int, int, int], b: tuple[int, int, int]) -> BoxMeta:
        """The box with two voxels at opposite corners."""
        return BoxMeta(tuple(1 + abs(p - q) for p, q in zip(a, b)), tuple(map(min, a, b)))

    @staticmethod
    def around(positions: DataFrame) -> BoxMeta:
        """The smallest box with all of ``positions(x, y, z)``; of none a single voxel at 0."""
        row = positions.agg(*(f(a).alias(f"{f.__name__}_{a}") for a in AXES for f in (F.min, F.max))).first()
        low, high = (tuple(row[f"{n}_{a}"] or 0 for a in AXES) for n in ("min", "max"))
        return BoxMeta.spanning(low, high)

    # Column expressions

    def vid(self, x: Column, y: Column, z: Column) -> Column:
        """The serial number of a voxel, x fastest; of positions outside it means nothing."""
        (ox, oy, oz), (dx, dy, _) = self.origin, self.dim
        return (x - ox).cast("long") + (y - oy).cast("long") * dx + (z - oz).cast("long") * (dx * dy)

    def inside(self, x: Column, y: Column, z: Column) -> Column:
        lx, ux, ly, uy, lz, uz = self.bounds
        return x.between(lx, ux) & y.between(ly, uy) & z.between(lz, uz)

    def on_border(self, x: Column, y: Column, z: Column) -> Column:
        """Whether any coordinate is a bound, wherever the others are."""
        lx, ux, ly, uy, lz, uz = self.bounds
        return x.isin(lx, ux) | y.isin(ly, uy) | z.isin(lz, uz)

    def checked_vid(self, x: Column, y: Column, z: Column) -> Column:
        return F.when(self.inside(x, y, z), self.vid(x, y, z))

    def position(self, vid: Column) -> tuple[Column, Column, Column]:
        """x, y and z of a serial number."""
        (ox, oy, oz), (dx, dy, _) = self.origin, self.dim
        rest = vid % (dx * dy)
        return (rest % dx + ox).cast("int"), (F.floor(rest / dx) + oy).cast("int"), (F.floor(vid / (dx * dy)) + oz).cast("int")

    def checked_position(self, vid: Column) -> tuple[Column, Column, Column]:
        """Null for numbers that no voxel of the box has, negative ones too."""
        return tuple(F.when(vid.between(0, self.size - 1), p) for p in self.position(vid))

    def base(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """World coordinates of a voxel's lower corner."""
        return tuple(F.lit(o) + F.lit(s) * (p.cast("double") - 0.5) for o, s, p in zip(self.world, self.spacing, (x, y, z)))

    def base_of(self, vid: Column) -> tuple[Column, Column, Column]:
        """World coordinates of the lower corner of a voxel with a serial number."""
        return self.base(*self.position(vid))

    def centre(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        return tuple(F.lit(o) + F.lit(s) * p.cast("double") for o, s, p in zip(self.world, self.spacing, (x, y, z)))

    def linear(self, axis: int, p: Column) -> Column:
        """The world coordinate at which voxel ``p`` of an axis begins."""
        o, s = self.world[axis], self.spacing[axis]
        return F.lit(o - s / 2) + F.lit(s) * p.cast("double")

    def displaced(self, axis: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """A voxel's lower corner, one spacing further along an axis."""
        return tuple(b + F.when(axis == k, F.lit(s)).otherwise(F.lit(0.0)) for k, (b, s) in enumerate(zip(self.base(x, y, z), self.spacing)))


Triple = tuple[Column, Column, Column]


def add(a: Triple, b: Triple) -> Triple:
    return tuple(p + q for p, q in zip(a, b))


def subtract(a: Triple, b: Triple) -> Triple:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Triple, s: Column | int) -> Triple:
    return tuple(p * s for p in a)


def divide(a: Triple, b: Triple) -> tuple[Triple, Triple]:
    """Quotients, cut towards 0, and remainders, with the sign of what is divided; null where the divisor is 0."""
    quotient = lambda p, q: F.when(q != 0, F.signum(p) * F.signum(q) * F.floor(F.abs(p) / F.abs(q))).cast("long")
    return tuple(quotient(p, q) for p, q in zip(a, b)), tuple(F.when(q != 0, p % q).cast("long") for p, q in zip(a, b))
