"""Vectors as array columns: elementwise operations, products, search and shuffling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same(a: Column, b: Column, out: Column) -> Column:
    """``out`` of vectors of one length, null where one is null, else an error."""
    return F.when(a.isNull() | b.isNull() | (F.size(a) == F.size(b)), out).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("array<double>"))


def add(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda p, q: p + q))


def subtract(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda p, q: p - q))


def pointwise(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda p, q: p * q))


def neg(a: Column) -> Column:
    return F.transform(a, lambda p: -p)


def scale(a: Column, s: Column | float) -> Column:
    return F.transform(a, lambda p: p * s)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)


def binary_search(values: Column, x: Column) -> Column:
    """Where x is in a sorted array or, if it isn't there, belongs, at most the last place; 0 in an empty one.

    The stretch that is left is halved as often as the array's length has binary digits.
    """
    first = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)) + 1)).cast("int"))

    def halved(left: Column, _: Column) -> Column:
        low, high = left["low"], left["high"]
        middle = F.shiftright(low + high, 1)
        below = F.get(values, middle) < x
        open_ = low < high
        return F.struct(F.when(open_ & below, middle + 1).otherwise(low).alias("low"), F.when(open_ & ~below, middle).otherwise(high).alias("high"))

    found = F.aggregate(halvings, first, halved, lambda left: left["low"])
    return F.greatest(F.lit(0), F.least(found, F.size(values) - 1))


def shuffle(values: Column, seed: int) -> Column:
    """A seeded permutation of an array: by a hash of places, so equal lengths are permuted alike."""
    keyed = F.transform(values, lambda v, k: F.struct(F.xxhash64(k, F.lit(seed)).alias("h"), k.alias("k"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda r: r["v"])


def sort_down(*columns: Column) -> Column:
    """Values in descending order, as an array."""
    return F.sort_array(F.array(*columns), asc=False)
