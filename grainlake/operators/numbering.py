"""Numbers in the order of a whole table, without a window over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainlake.sources.shared import materialise


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with ``name``, 0 to n-1 in the order given; rows that tie are numbered in any order.

    Ranges of the order are partitions, each of which counts its own rows; what lies before a partition is a prefix
    sum over one number a partition.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "numbered")
    # Spark's increasing numbers are the partition's number and, in the lower 33 bits, the row's within it.
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    totals = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("_part", before.alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # one row a partition
    out = joined.withColumn(name, F.col("_before") + row).drop("_at", "_part", "_before")
    out._made = [placed]
    return out


def numbered_within(df: DataFrame, name: str, by: list[str], *order: Column | str) -> DataFrame:
    """``df`` with ``name``, 0 to n-1 within each group ``by`` in the order given; groups may be of any size.

    All rows are numbered group by group, and a group's numbers are less the first of them. ``_made`` of what is returned
    are the tables that it reads.
    """
    every = numbered(df, "_number", *by, *order)
    first = every.groupBy(*(F.col(c).alias(f"_of{k}") for k, c in enumerate(by))).agg(F.min("_number").alias("_first"))
    first = materialise(first, "firsts")  # as a table it has a known size, so it is broadcast where it is small
    same = [F.col(c).eqNullSafe(F.col(f"_of{k}")) for k, c in enumerate(by)]
    out = every.join(first, same).withColumn(name, F.col("_number") - F.col("_first")).drop("_number", "_first", *(f"_of{k}" for k in range(len(by))))
    out._made = [*every._made, first]
    return out
