"""Voxel grids and topology tables: made from numbers or tables, kept as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.functions.box import BoxMeta


def positions(spark: SparkSession, box: BoxMeta) -> DataFrame:
    """``vid, x, y, z`` of every voxel of a box, in serial order."""
    x, y, z = box.position(F.col("id"))
    return spark.range(box.size).select(F.col("id").alias("vid"), x.alias("x"), y.alias("y"), z.alias("z"))


def from_values(spark: SparkSession, box: BoxMeta, values: list) -> DataFrame:
    """A grid from a flat list, x fastest."""
    if len(values) != box.size:
        raise ValueError(f"{len(values)} values for {box.size} voxels")
    data = spark.createDataFrame(list(enumerate(values)), "vid long, value " + ("double" if any(isinstance(v, float) for v in values) else "long"))
    x, y, z = box.position(F.col("vid"))
    return data.select("vid", x.alias("x"), y.alias("y"), z.alias("z"), "value")


def from_table(df: DataFrame, box: BoxMeta, x: Column, y: Column, z: Column, value: Column) -> DataFrame:
    """A grid whose voxels are groups of a table's rows; voxels without rows are missing."""
    cells = df.select(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z")).groupBy("x", "y", "z").agg(value.alias("value"))
    return cells.where(box.inside(F.col("x"), F.col("y"), F.col("z"))).select(box.vid(F.col("x"), F.col("y"), F.col("z")).alias("vid"), "x", "y", "z", "value")


def complete(spark: SparkSession, grid: DataFrame, box: BoxMeta) -> DataFrame:
    """A dense grid: voxels without a value get null."""
    return positions(spark, box).join(grid.select("vid", "value"), "vid", "left")


def write_tables(path: str, **tables: DataFrame) -> None:
    """One Parquet table for each level under ``path``; arrays, structs and nulls come back as they went."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
