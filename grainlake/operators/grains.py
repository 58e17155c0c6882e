"""Grain finding: connected voxels that a predicate says are alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainlake.functions.box import AXES, BoxMeta
from grainlake.operators.components import connected_components
from grainlake.operators.numbering import numbered

Steps = Sequence[tuple[int, int, int]]

#: Forward neighbours, so that each pair is met once.
FORWARD = ((1, 0, 0), (0, 1, 0), (0, 0, 1))


def alike(a: Column, b: Column) -> Column:
    """Equal values; NaN is like nothing, itself included."""
    same = a == b
    return same & ~F.coalesce(F.isnan(a.cast("double")), F.lit(False))


def neighbour_pairs(grid: DataFrame, steps: Steps = FORWARD) -> DataFrame:
    """``vid, value, axis, vid2, value2`` of neighbouring voxels that both exist, the one before the step first.

    ``steps`` are what makes two voxels neighbours, and ``axis`` is a step's place in them; each pair should be met
    once, so of two opposite steps one is enough. Each voxel offers itself to those that a step leads here from; one
    equi-join on the place, no wider than the grid.
    """
    offers = F.array(*(F.struct(F.lit(k).alias("axis"), *((F.col(a) - s).alias(f"{a}_") for a, s in zip(AXES, step))) for k, step in enumerate(steps)))
    far = grid.select(F.col("vid").alias("vid2"), F.col("value").alias("value2"), F.explode(offers).alias("o")).select("vid2", "value2", "o.*")
    near = grid.select("vid", "value", *AXES)
    return near.join(far, [near[a] == far[f"{a}_"] for a in AXES]).select("vid", "value", "axis", "vid2", "value2")


def find_grains(grid: DataFrame, predicate: Callable[[Column, Column], Column] = alike, dense: bool = False, steps: Steps = FORWARD) -> DataFrame:
    """``grid`` with ``label``, the smallest ``vid`` that a voxel reaches over neighbours for which the predicate holds.

    The predicate need not be transitive, and null means no. Without ``dense`` voxels with a null value are left
    out; with it they are grains of their own. Who is a neighbour is up to ``steps``. A column ``label`` of the grid is
    replaced.
    """
    grid = grid.drop("label")
    held = grid.where(F.col("value").isNotNull())
    edges = neighbour_pairs(held, steps).where(predicate(F.col("value"), F.col("value2"))).select(F.col("vid").alias("src"), F.col("vid2").alias("dst"))
    labels = connected_components(edges).withColumnRenamed("id", "vid")
    return (grid if dense else held).join(labels, "vid", "left").withColumn("label", F.coalesce("label", "vid"))


def grain_members(labels: DataFrame) -> DataFrame:
    """``label, voxels``: the sorted members of each grain. A grain is one array, so use ``grain_sizes`` for large ones."""
    return labels.groupBy("label").agg(F.array_sort(F.collect_list("vid")).alias("voxels"))


def grain_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def grain_boxes(labels: DataFrame) -> DataFrame:
    """Inclusive bounds of each grain."""
    return labels.groupBy("label").agg(*(f(a).alias(f"{f.__name__}_{a}") for a in AXES for f in (F.min, F.max)))


def reset_grain_ids(labels: DataFrame, seed: int = 0) -> DataFrame:
    """Labels replaced by a seeded permutation of 0 to n-1; a null label stays null.

    Distinct labels are numbered by ranges of a seeded hash.
    """
    once = labels.select("label").where("label is not null").distinct()
    new = numbered(once.withColumn("_hash", F.xxhash64("label", F.lit(seed))), "_new", "_hash", "label")
    new = new.select(F.col("label").alias("_label"), "_new")
    joined = labels.join(new, F.col("label") == F.col("_label"), "left")
    return joined.withColumn("label", F.col("_new")).drop("_new", "_label")


def lookup(grid: DataFrame, points: DataFrame, box: BoxMeta) -> DataFrame:
    """``points(x, y, z, ...)`` with the ``value`` of the voxel there; null outside of the box or without a voxel."""
    vid = box.checked_vid(*(F.col(a) for a in AXES))
    return points.withColumn("_vid", vid).join(grid.select(F.col("vid").alias("_vid"), "value"), "_vid", "left").drop("_vid")
