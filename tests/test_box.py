from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from grainlake.functions import lattice
from grainlake.functions.box import AXES, BoxMeta
from grainlake.sources import grids

dims = st.tuples(*[st.integers(1, 9)] * 3)
places = st.tuples(*[st.integers(-5, 5)] * 3)


def test_size_and_bounds():
    assert BoxMeta((2, 3, 4)).size == 24 and BoxMeta((2, 3, 4), (1, 0, -1)).bounds == (1, 2, 0, 2, -1, 2)
    box = BoxMeta((10, 10, 10))
    assert box.holds(5, 5, 5) and not box.holds(10, 10, 10)
    with pytest.raises(ValueError):
        BoxMeta((2, 0, 1)).size  # noqa: B018
    assert BoxMeta((1, 1, 1)).minimal and not box.minimal


@given(dims, places)
def test_halves_merge_again(dim, origin):
    box = BoxMeta(dim, origin)
    halves = box.split()
    if box.size == 1:
        assert halves is None
        return
    a, b = halves
    assert a.size + b.size == box.size
    for merged, axis, wall in (a.merge(b), b.merge(a)):
        assert merged == box and wall.dim[axis] == 2 and dim[axis] == max(dim)
    assert a.merge(a) is None and a.merge(BoxMeta(a.dim, tuple(o + 50 for o in a.origin))) is None


def test_ties_split_z_then_y():
    assert BoxMeta((4, 4, 4)).split()[0].dim == (4, 4, 2) and BoxMeta((4, 4, 2)).split()[0].dim == (4, 2, 2)


def test_addresses_round_trip(spark):
    for box in (BoxMeta((3, 4, 5), (-2, 1, 7)), BoxMeta((1, 1, 1)), BoxMeta((7, 1, 2))):
        rows = grids.positions(spark, box)
        x, y, z = (F.col(a) for a in AXES)
        bad = rows.where((box.vid(x, y, z) != F.col("vid")) | ~box.inside(x, y, z) | (box.checked_vid(x, y, z) != F.col("vid")))
        assert rows.count() == box.size and bad.isEmpty()
        outside = spark.createDataFrame([(-1,), (box.size,)], "vid long").select(box.checked_position(F.col("vid"))[0].alias("x"))
        assert all(r.x is None for r in outside.collect())


def test_bounding_boxes(spark):
    df = spark.createDataFrame([(1, 5, -2), (4, 2, 0)], "x int, y int, z int")
    assert BoxMeta.around(df) == BoxMeta((4, 4, 3), (1, 2, -2)) and BoxMeta.around(df.limit(0)) == BoxMeta((1, 1, 1))


def test_lookup_of_a_small_box(spark):
    from grainlake.operators.grains import lookup

    box = BoxMeta((2, 2, 2))
    grid = grids.from_values(spark, box, list(range(1, 9)))
    points = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 2, 2)], "x int, y int, z int")
    got = {(r.x, r.y, r.z): r.value for r in lookup(grid, points, box).collect()}
    assert got == {(0, 0, 0): 1, (1, 0, 0): 2, (0, 1, 0): 3, (0, 0, 1): 5, (2, 2, 2): None}


def test_lattice_and_cells(spark):
    df = spark.createDataFrame([(k, x, 2, 3) for k in range(3) for x in (-1, 0, 1)], "axis int, x int, y int, z int")
    x, y, z, k = F.col("x"), F.col("y"), F.col("z"), F.col("axis")
    face, edge, corner = lattice.face_place(k, x, y, z), lattice.edge_place(k, x, y, z), lattice.corner_place(x, y, z)
    out = df.select("*", F.array(*lattice.voxel_of(*face)).alias("f"), F.array(*lattice.voxel_of(*edge)).alias("e"), F.array(*lattice.voxel_of(*corner)).alias("c"), lattice.face_axis(*face).alias("fa"), lattice.edge_axis(*edge).alias("ea"), lattice.face_axis(*edge).alias("none"))
    for r in out.collect():
        assert r.f == r.e == r.c == [r.x, r.y, r.z] and r.fa == r.ea == r.axis and r.none is None
    box = BoxMeta((2, 2, 2))
    one = spark.createDataFrame([(0, 0, 0, 0)], "axis int, x int, y int, z int")
    assert one.select(lattice.cell_corners(box, k, x, y, z)).first()[0] == [0, 3, 12, 9] and box.extended().dim == (3, 3, 3)
    loop = one.select(*(F.array(*c) for c in lattice.face_corners(box, 1, x, y, z))).first()
    assert [list(c) for c in loop] == [[-0.5, -0.5, -0.5], [-0.5, -0.5, 0.5], [0.5, -0.5, 0.5], [0.5, -0.5, -0.5]]


def test_planes_and_lines(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    met = lattice.intersection(lit(0, 0, 2), lit(0, 0, 1), lit(1, 1, 0), lit(0, 0, 4))
    flat = lattice.intersection(lit(0, 0, 0), lit(0, 0, 1), lit(1, 1, 0), lit(1, 0, 0))
    row = spark.range(1).select(F.array(*met), F.array(*flat)).first()
    assert row[0] == [1.0, 1.0, 2.0] and row[1] == [None] * 3
