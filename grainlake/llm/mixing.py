"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets of a source, in which the running sums are made; a power of 16.
BUCKET_DIGITS = 3


def walk_key(id_: Column, seed: int = 1) -> Column:
    """What orders the documents of a source in its last walk."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))


def water_fill(sources: DataFrame, weight_col: str, size_col: str, max_epochs: int) -> DataFrame:
    """Add ``target`` to a table of one row a source: the sources share the sum of all sizes by weight, none gets
    more than ``max_epochs`` times its size, and what is above is shared again by weight until none is above.

    In the order of cap over weight the capped sources come first, so prefix sums of caps and weights give the
    level of the first source that keeps its share, which is the level of all after it. Sources without a size
    get 0. The table has as many rows as there are sources.
    """
    w, cap = F.col(weight_col), F.col(size_col) * max_epochs
    order = Window.orderBy((cap / w).asc(), w.asc(), F.col(size_col).asc())
    upto, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    level = (F.col("_all") - (F.col("_caps") - F.col("_cap"))) / (F.col("_weights") - F.col("_upto") + w)
    filled = (
        sources.withColumns({"_cap": cap, "_all": F.sum(size_col).over(whole), "_weights": F.sum(w).over(whole)})
        .withColumns({"_caps": F.sum("_cap").over(upto), "_upto": F.sum(w).over(upto)})
        .withColumn("_level", level)
        .withColumn("_free", F.col("_cap") >= F.col("_level") * w)
        .withColumn("_flat", F.max(F.when(F.col("_free"), F.col("_level"))).over(whole))
    )
    target = F.when(F.col("_free"), F.col("_flat") * w).otherwise(F.col("_cap").cast("double"))
    return filled.withColumn("target", target).drop("_cap", "_all", "_weights", "_caps", "_upto", "_level", "_free", "_flat")


def mix(df: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 1, carry: Column | None = None) -> DataFrame:
    """One row for each row of ``df``: ``doc_id, source, size, source_size, target, whole, part``.

    Sources in code point order, null last, weigh ``weights`` in turn. A source takes each document ``whole``
    times, and walks its documents once more in the order of a seeded hash until its target is met; ``part`` is
    how many units of the document that last walk takes, all, none or, for one document of a source, some.
    Running sums go over hash buckets first, so a source that holds most rows is spread over thousands of groups.

    A null size counts as 0. Null sources are one source. Null ids hash as the empty string; rows that repeat an
    id are documents of their own, and those alike in id and size too are interchangeable. No rows, no rows.
    Other columns are ignored, whatever their names, but for ``carry``, which each row keeps as ``carried`` and which
    orders rows alike in id and size.
    """
    carried = [] if carry is None else [carry.alias("carried")]
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), *carried)
    # A key without nulls, so that joins and windows are dealt out alike.
    named = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    docs = docs.withColumns({"_s": named, "_key": walk_key(F.col("doc_id"), seed)}).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    buckets = docs.groupBy("_s", "_bucket").agg(F.sum("size").alias("_sum"), F.first("source").alias("source"))
    sources = buckets.groupBy("_s").agg(F.sum("_sum").alias("source_size"), F.first("source").alias("source"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*map(F.lit, weights))
    sources = water_fill(sources.withColumn("_weight", F.element_at(turn, (place % len(weights) + 1).cast("int"))), "_weight", "source_size", max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.select("_s", "source_size", "target", whole.alias("whole"))
    plan = plan.withColumn("_last", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    earlier = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("_s", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")).join(plan, "_s")
    here = Window.partitionBy("_s", "_bucket").orderBy("_key", "doc_id", "size", *(["carried"] if carried else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = docs.join(offsets, ["_s", "_bucket"]).withColumn("_start", F.col("_before") + F.sum("size").over(here) - F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_last") - F.col("_start"))).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", "whole", part.alias("part"), *(["carried"] if carried else []))
