"""Segments chained into open and closed sequences."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainlake.operators.components import connected_components
from grainlake.sources.shared import materialise


def chain(segments: list[tuple]) -> list[tuple[str, list[tuple[int, bool]]]]:
    """Sequences of ``(head, tail)`` segments, as (kind, [(place in the list, turned)]).

    A sequence starts with the first segment left and grows at its tail, then at its head, each time by the first
    segment left that shares the end point. It is a loop if its ends are equal. Where more than two segments meet,
    other results are as right.
    """
    at: dict = defaultdict(deque)
    for k, (a, b) in enumerate(segments):
        at[a].append(k)
        if a != b:
            at[b].append(k)
    used = [False] * len(segments)

    def grow(end):
        grown = []
        while True:
            queue = at[end]
            while queue and used[queue[0]]:
                queue.popleft()
            if not queue:
                return grown, end
            k = queue.popleft()
            used[k] = True
            a, b = segments[k]
            turned = a != end
            grown.append((k, turned))
            end = a if turned else b

    out = []
    for k, (a, b) in enumerate(segments):
        if used[k]:
            continue
        used[k] = True
        after, tail = grow(b)
        before, head = grow(a)
        whole = [*((j, not turned) for j, turned in reversed(before)), (k, False), *after]
        out.append(("loop" if head == tail else "open", whole))
    return out


def _met(ends: DataFrame, tolerance: float) -> DataFrame:
    """``end, label`` of end points that are within ``tolerance`` of another one, directly or over others, with the
    smallest point of each such group.

    On a line each point only has to be held against the next one. That lies in the same cell, of the tolerance's
    width, or is the first of the next cell; so points are ordered within cells, and cells meet by their ends.
    """
    points = ends.select(F.explode(F.array("head", "tail")).alias("p")).where("p is not null").distinct()
    celled = points.withColumn("cell", F.floor(F.col("p") / tolerance))
    inner = celled.withColumn("before", F.lag("p").over(Window.partitionBy("cell").orderBy("p"))).where("before is not null")
    borders = celled.groupBy("cell").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    after = borders.select((F.col("cell") - 1).alias("cell"), F.col("first").alias("next"))
    outer = borders.join(after, "cell").where(F.col("next") - F.col("last") <= tolerance)
    links = inner.select(F.col("p").alias("src"), F.col("before").alias("dst")).unionByName(outer.select(F.col("next").alias("src"), F.col("last").alias("dst")))
    return connected_components(links).withColumnRenamed("id", "end")


def _ends(segments: DataFrame, tolerance: float | None) -> DataFrame:
    """Segments with their end points as keys, ``_a`` and ``_b``; with a tolerance those that meet have one key."""
    rows = segments.select("idx", "head", "tail").where("head is not null and tail is not null")
    if not tolerance:
        return rows.withColumns({"_a": F.col("head"), "_b": F.col("tail")})
    met = _met(rows, tolerance)
    for end, key in (("head", "_a"), ("tail", "_b")):
        other = met.select(F.col("end").alias("_end"), F.col("label").alias("_to"))
        rows = rows.join(other, F.col(end) == F.col("_end"), "left").withColumn(key, F.coalesce("_to", end)).drop("_end", "_to")
    return rows


def sort_segments(segments: DataFrame, tolerance: float | None = None) -> DataFrame:
    """``seq, kind, pos, idx, head, tail`` of ``segments(idx, head, tail)``, each turned to fit the one before it.

    Segments that share end points directly or over others are one group. Groups are dealt out whole and lie one after
    another in a partition, which is walked in one pass; a task holds one group at a time. ``seq`` is the smallest idx
    of the sequence. With a ``tolerance`` end points, which are numbers then, also meet where they are no further
    apart than that, or over others that aren't. Rows with a null end are left out.
    """
    ends = materialise(_ends(segments, tolerance), "segment-ends")
    # Nodes of the graph are end points, so it has no more edges than there are segments.
    parts = connected_components(ends, "_a", "_b").withColumnRenamed("id", "_end")
    grouped = ends.join(parts, F.col("_a") == F.col("_end"), "left").withColumn("label", F.coalesce("label", "_a"))
    grouped = grouped.repartition("label").sortWithinPartitions("label", "idx").select("label", "idx", "head", "tail", "_a", "_b")
    kind, number = grouped.schema["head"].dataType.simpleString(), grouped.schema["idx"].dataType.simpleString()
    names = ["seq", "kind", "pos", "idx", "head", "tail"]

    def walk(group: pa.Table) -> tuple[list, list, list, list, list]:
        found = chain(list(zip(group.column("_a").to_pylist(), group.column("_b").to_pylist())))
        seqs, hows, places, rows, turns = [], [], [], [], []
        for how, seq in found:
            first = min(k for k, _ in seq)  # rows are in the order of idx
            seqs += [first] * len(seq)
            hows += [how] * len(seq)
            places += range(len(seq))
            rows += [k for k, _ in seq]
            turns += [t for _, t in seq]
        return seqs, hows, places, rows, turns

    def walked(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [])
        for begin, end in zip(bounds, bounds[1:]):
            for k, (whole, part) in enumerate(zip(out, walk(table.slice(begin, end - begin)))):
                whole += [x + begin for x in part] if k in (0, 3) else part
        seqs, hows, places, rows, turns = out
        head, tail, idx = (table.column(c).combine_chunks().take(pa.array(rows, pa.int64())) for c in ("head", "tail", "idx"))
        turned = pa.array(turns, pa.bool_())
        first = table.column("idx").combine_chunks().take(pa.array(seqs, pa.int64()))
        return pa.RecordBatch.from_arrays([first, pa.array(hows, pa.string()), pa.array(places, pa.int32()), idx, pc.if_else(turned, tail, head), pc.if_else(turned, head, tail)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(0)[0] == batch.column(0)[-1]:
                continue  # one group so far
            table = pa.Table.from_batches(held).combine_chunks()
            bounds = _bounds(table)
            yield walked(table, bounds[:-1])
            held = table.slice(bounds[-2]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield walked(table, _bounds(table))

    return grouped.mapInArrow(run, f"seq {number}, kind string, pos int, idx {number}, head {kind}, tail {kind}")


def _bounds(table: pa.Table) -> list[int]:
    """Where the groups of a table begin, and its length."""
    label = table.column("label").combine_chunks()
    new = pc.not_equal(label.slice(1), label.slice(0, len(label) - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(new) + 1).tolist(), len(label)]


def opens(sequences: DataFrame) -> DataFrame:
    return sequences.where("kind = 'open'")


def loops(sequences: DataFrame) -> DataFrame:
    return sequences.where("kind = 'loop'")


def only(sequences: DataFrame, kind: str) -> DataFrame | None:
    """The one sequence of a kind; none if there isn't exactly one."""
    found = sequences.where(F.col("kind") == kind)
    return found if found.select("seq").distinct().limit(2).count() == 1 else None
