"""Matrices as coordinate tables ``i, j, val``; the first index is the fastest in serial order. Cells that are missing are 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Shape = tuple[int, int]


def size(shape: tuple[int, ...]) -> int:
    """Cells of a shape of two or three extents."""
    out = 1
    for extent in shape:
        out *= extent
    return out


def position(shape: tuple[int, ...], *at: Column) -> Column:
    """The serial number of a cell, first index fastest."""
    out, width = F.lit(0).cast("long"), 1
    for index, extent in zip(at, shape):
        out, width = out + index.cast("long") * width, width * extent
    return out


def indices(shape: tuple[int, ...], number: Column) -> tuple[Column, ...]:
    """The indices of a serial number."""
    out, width = [], 1
    for k, extent in enumerate(shape):
        whole = F.floor(number / width)
        out.append((whole if k == len(shape) - 1 else whole % extent).cast("int"))
        width *= extent
    return tuple(out)


def places(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """``pos`` and the indices ``i, j`` (and ``k``) of all cells of a shape."""
    return spark.range(size(shape)).select(F.col("id").alias("pos"), *(c.alias(n) for c, n in zip(indices(shape, F.col("id")), "ijk")))


def at(a: DataFrame, cells: DataFrame, shape: Shape) -> DataFrame:
    """``cells(i, j, ...)`` with the ``val`` there, 0 where the matrix has none; cells outside of the shape are errors."""
    outside = ~(F.col("i").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1))
    found = cells.join(a.select("i", "j", "val"), ["i", "j"], "left")
    return found.withColumn("val", F.when(outside, F.raise_error(F.lit(f"a cell outside of {shape}")).cast("double")).otherwise(F.coalesce("val", F.lit(0.0))))


def zero() -> DataFrame:
    """An error, as a zero needs a shape: see ``zeros``."""
    raise ValueError("a zero matrix needs a shape: zeros(spark, shape)")


def one() -> DataFrame:
    """An error, as a one needs a size: see ``identity``."""
    raise ValueError("an identity matrix needs a size: identity(spark, n)")


def generate(spark: SparkSession, shape: Shape, value: Callable[[Column, Column], Column]) -> DataFrame:
    n = F.col("id")
    i, j = (n % shape[0]).cast("int"), F.floor(n / shape[0]).cast("int")
    return spark.range(shape[0] * shape[1]).select(i.alias("i"), j.alias("j")).select("i", "j", value(F.col("i"), F.col("j")).alias("val"))


def from_list(spark: SparkSession, shape: Shape, values: list[float]) -> DataFrame:
    if len(values) != shape[0] * shape[1]:
        raise ValueError(f"{len(values)} values for a {shape} matrix")
    return spark.createDataFrame([(k % shape[0], k // shape[0], float(v)) for k, v in enumerate(values)], "i int, j int, val double")


def zeros(spark: SparkSession, shape: Shape) -> DataFrame:
    return generate(spark, shape, lambda i, j: F.lit(0.0))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return generate(spark, (n, n), lambda i, j: (i == j).cast("double"))


def same_shape(a: Shape, b: Shape) -> None:
    if tuple(a) != tuple(b):
        raise ValueError(f"shapes differ: {a} and {b}")


def combine(a: DataFrame, b: DataFrame, sign: int = 1, shapes: tuple[Shape, Shape] | None = None) -> DataFrame:
    """a + sign b, cell by cell, as one aggregation of both."""
    if shapes:
        same_shape(*shapes)
    both = a.unionByName(b.withColumn("val", F.col("val") * sign))
    return both.groupBy("i", "j").agg(F.sum("val").alias("val"))


def scale(a: DataFrame, s: float) -> DataFrame:
    return a.withColumn("val", F.col("val") * s)


def apply(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return a.withColumn("val", f(F.col("val")))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "val")


def multiply(a: DataFrame, b: DataFrame, shapes: tuple[Shape, Shape] | None = None) -> DataFrame:
    """The matrix product: a join on the inner index and a sum, combined before it is shuffled."""
    if shapes and shapes[0][1] != shapes[1][0]:
        raise ValueError(f"shapes don't fit: {shapes}")
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("val").alias("val2"))
    joined = a.join(right, F.col("j") == F.col("k")).select("i", F.col("j2").alias("j"), (F.col("val") * F.col("val2")).alias("val"))
    return joined.groupBy("i", "j").agg(F.sum("val").alias("val"))


def times_vector(a: DataFrame, v: DataFrame) -> DataFrame:
    """``i, val`` of matrix times column vector ``v(i, val)``."""
    right = v.select(F.col("i").alias("j"), F.col("val").alias("val2"))
    return a.join(right, "j").groupBy("i").agg(F.sum(F.col("val") * F.col("val2")).alias("val"))


def vector_times(v: DataFrame, a: DataFrame) -> DataFrame:
    """``i, val`` of row vector times matrix."""
    return times_vector(transpose(a), v)


def diagonal(a: DataFrame, shape: Shape | None = None) -> DataFrame:
    if shape and shape[0] != shape[1]:
        raise ValueError(f"{shape} isn't square")
    return a.where("i = j").select("i", "val")


def from_diagonal(v: DataFrame) -> DataFrame:
    return v.select("i", F.col("i").alias("j"), "val")


def columns(a: DataFrame) -> DataFrame:
    """``j, vals``: each column as an array in row order."""
    return _lines(a, "j", "i")


def rows(a: DataFrame) -> DataFrame:
    return _lines(a, "i", "j")


def _lines(a: DataFrame, key: str, order: str) -> DataFrame:
    sorted_ = F.array_sort(F.collect_list(F.struct(order, "val")))
    return a.groupBy(key).agg(F.transform(sorted_, lambda c: c["val"]).alias("vals"))


def pretty(a: DataFrame) -> DataFrame:
    """``i, text``: rows with three decimals in scientific notation, as C's printf rounds: by the exact value, ties to the
    even digit, where Java's formatter, and so ``format_string``, rounds ties up. Nulls are left out, and rows of nothing
    else are null."""

    def text(vals):
        return " ".join(f"{v:.3e}" for v in vals if v is not None) or None

    return rows(a).select("i", F.udf(text, "string")("vals").alias("text"))
