"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainlake.sources.shared import discard, materialise

#: Edges that one task holds at once: of larger graphs, parts of so many are contracted side by side.
AT_ONCE = 2_000_000


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 the smallest one that each reaches over the edges a-b.

    In each round the larger root of every edge hangs itself on the smallest root that it meets, and paths are
    cut short by pointer jumping, until the ends of all edges have one root.
    """
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _stars(batches: list[pa.RecordBatch], whole: bool) -> pa.RecordBatch | None:
    """``u, v`` of each node of some edges and the smallest that it reaches over them; of the smallest itself only if
    the edges are the ``whole`` graph."""
    table = pa.Table.from_batches(batches)
    ends = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks])
    # Ids of any type that Arrow can sort become their ranks.
    if pa.types.is_integer(ends.type):
        values, at = np.unique(ends.to_numpy(), return_inverse=True)
        names = pa.array(values, ends.type)
    else:
        coded = ends.combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names, at = coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]
    n = len(at) // 2
    root = least_reached(len(names), at[:n], at[n:])
    nodes = np.arange(len(names)) if whole else np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(nodes)), names.take(pa.array(root[nodes]))], names=["u", "v"])


def _contracted(graph: DataFrame, at_once: int, whole: bool = False) -> DataFrame:
    """The edges of each partition, ``at_once`` at a time, as stars around the smallest node that each node reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= at_once and not whole:
                yield _stars(held, False)
                held, rows = [], 0
        if rows:
            stars = _stars(held, whole)
            for at in range(0, stars.num_rows, 1 << 16):
                yield stars.slice(at, 1 << 16)

    return graph.mapInArrow(run, graph.schema)


def _pulled(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Each row's ``u`` and ``v`` with ``m``, the smallest of u and all its v.

    Both sides are tables, so that they come straight from their exchanges and adaptive execution can split a hot u.
    """
    rows = materialise(edges, "star-ends")
    least = materialise(rows.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star-centres")
    made += [rows, least]
    return rows.join(least, "u")


def _large_star(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    return _pulled(both, made).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return _pulled(down, made).select(F.explode(linked).alias("e")).select("e.*").where("u <> v").distinct()


def _is_settled(graph: DataFrame) -> bool:
    """Whether the edges are stars: each node hangs on one centre, and no centre on another."""
    ends = F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("centre")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("centre")))
    roles = graph.select(F.inline(ends)).groupBy("id").agg(F.sum("up").alias("up"), F.max("centre").alias("centre"))
    return roles.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("centre") > 0))).isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """``id, label`` of every node with an edge to another node, where ``label`` is the smallest id that it reaches.

    Edges are laid out by ranges of their ends, so that neighbours by number lie together and a hot node's edges lie
    apart, and each task contracts what it holds. Once the edges that are left fit into a task (``at_once``), one task
    finishes. Until then each round is one of alternating large and small stars (Kiveris et al., 2014), which shuffles
    no more rows than there are edges, and a contraction; the number of rounds grows with the logarithm of the graph's
    size, not with its diameter. The result is a table in the shared folder; those of the rounds are taken away.

    Ids may be of any type that can be ordered, but for structs. Loops, repeated edges and edges with a null end count
    for nothing. No edges, no rows.
    """
    graph = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where((F.col(src) != F.col(dst)) & F.col(src).isNotNull() & F.col(dst).isNotNull())
    graph, rounds = materialise(graph, "edges"), 0
    while (rows := graph.count()) > at_once:
        if rounds > max_rounds:
            raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
        made = [graph]
        if rounds:
            if _is_settled(graph):
                break
            graph = _small_star(_large_star(graph, made), made)
            graph = materialise(graph, "edges")
            made.append(graph)
        # As many ranges as keep what one task holds, or more.
        graph = materialise(_contracted(graph.repartitionByRange(-(-rows // at_once) + 1, "u", "v"), at_once), "edges")
        discard(*made)
        rounds += 1
    if rows > at_once:
        leaves, centres = graph.select(F.col("u").alias("id"), F.col("v").alias("label")), graph.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
        found = leaves.unionByName(centres)
    else:
        found = _contracted(graph.coalesce(1), at_once, whole=True).select(F.col("u").alias("id"), F.col("v").alias("label"))
    found = materialise(found, "components")
    discard(graph)
    return found
