"""Markov clustering (van Dongen, 2000) on a matrix table: expand, inflate, prune, until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainlake.operators import matrix
from grainlake.operators.components import connected_components
from grainlake.sources.shared import discard, materialise


def from_edges(edges: DataFrame, src: str = "src", dst: str = "dst", loops: float = 1.0) -> DataFrame:
    """An undirected graph's matrix: weight 1 for each distinct edge, and ``loops`` on the diagonal."""
    both = edges.where(F.col(src) != F.col(dst)).select(F.explode(F.array(F.struct(F.col(src).alias("i"), F.col(dst).alias("j")), F.struct(F.col(dst).alias("i"), F.col(src).alias("j")))).alias("e")).select("e.*").distinct()
    nodes = both.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(loops).alias("val"))
    return both.withColumn("val", F.lit(1.0)).unionByName(nodes)


def normalise(m: DataFrame) -> DataFrame:
    """Columns that sum to 1."""
    return m.join(m.groupBy("j").agg(F.sum("val").alias("_sum")), "j").select("i", "j", (F.col("val") / F.col("_sum")).alias("val"))


def step(m: DataFrame, inflation: float = 2.0, prune: float = 1e-5) -> DataFrame:
    """One round: the square, each value to a power, small ones dropped, columns to sum 1."""
    grown = matrix.multiply(m, m).withColumn("val", F.pow("val", F.lit(inflation)))
    return normalise(normalise(grown).where(F.col("val") > prune))


def power(m: DataFrame, n: int) -> DataFrame:
    """The n-th power, by squaring."""
    out, square, made = None, m, []

    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        made.append(materialise(matrix.multiply(a, b), "power"))
        return made[-1]

    while n:
        if n & 1:
            out = square if out is None else product(out, square)
        n >>= 1
        square = product(square, square) if n else square
    discard(*(t for t in made if t is not out))
    return out


def markov_cluster(edges: DataFrame, inflation: float = 2.0, prune: float = 1e-5, tolerance: float = 1e-6, max_rounds: int = 100) -> DataFrame:
    """``id, cluster``: the smallest id of each node's cluster. Expansion is 2; every round ends in a table, and the
    table before it goes."""
    m = materialise(normalise(from_edges(edges)), "markov")
    for _ in range(max_rounds):
        after = materialise(step(m, inflation, prune), "markov")
        moved = matrix.combine(after, m, -1).agg(F.max(F.abs("val"))).first()[0]
        discard(m)
        m = after
        if (moved or 0.0) <= tolerance:
            break
    found = connected_components(m.where("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst")))
    nodes = m.select(F.col("j").alias("id")).distinct()
    return nodes.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("cluster"))
