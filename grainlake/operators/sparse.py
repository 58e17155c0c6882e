"""Sparse boxes: tables of ``x, y, z, value`` in which a missing row is a missing cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.functions.box import AXES, BoxMeta


def _at() -> list[Column]:
    return [F.col(a) for a in AXES]


def make(cells: DataFrame, box: BoxMeta) -> DataFrame:
    """The cells that lie in the box."""
    return cells.select(*AXES, "value").where(box.inside(*_at()))


def empty(spark: SparkSession, origin: tuple[int, int, int], dim: tuple[int, int, int] = (1, 1, 1), value_type: str = "int") -> tuple[DataFrame, BoxMeta]:
    """A box without cells, by default of one place."""
    return spark.createDataFrame([], f"x int, y int, z int, value {value_type}"), BoxMeta(dim, origin)


def singleton(spark: SparkSession, origin: tuple[int, int, int], value, value_type: str = "int") -> tuple[DataFrame, BoxMeta]:
    """A box of one place, which has a value."""
    return spark.createDataFrame([(*origin, value)], f"x int, y int, z int, value {value_type}"), BoxMeta((1, 1, 1), origin)


def lookup(cells: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with their ``value``, null where there is no cell."""
    return points.join(cells.select(*AXES, "value"), list(AXES), "left")


def adjust(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite cells that exist by ``updates(seq, x, y, z, value)``; of several for a cell the last counts."""
    last = updates.groupBy(*AXES).agg(F.max_by(F.struct("value"), "seq").alias("_new"))
    joined = cells.join(last, list(AXES), "left")
    return joined.select(*AXES, F.when(F.col("_new").isNull(), F.col("value")).otherwise(F.col("_new.value")).alias("value"))


def merge(a: DataFrame, box_a: BoxMeta, b: DataFrame, box_b: BoxMeta) -> tuple[DataFrame, BoxMeta] | None:
    """The cells and the box of two adjacent boxes with equal cross-sections; none if they aren't."""
    merged = box_a.merge(box_b)
    return merged and (a.unionByName(b), merged[0])


def shifted(cells: DataFrame, box: BoxMeta) -> DataFrame:
    """Cells with coordinates from the box's origin."""
    return cells.withColumns({a: F.col(a) - o for a, o in zip(AXES, box.origin)})
