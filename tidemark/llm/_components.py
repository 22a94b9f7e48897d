"""Connected components of an edge table, as Spark joins over thin rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def components(edges: DataFrame, into: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """A table (node, root) in ``into`` for every node of ``edges`` (a, b); root is the smallest node that it reaches.

    Each round links every node to the smallest node next to it and then the
    larger neighbours to that one (large-star, small-star), which takes a
    number of rounds that grows with the logarithm of a component's diameter.
    A node with very many edges only ever takes part in partial minima and in
    joins that adaptive execution can split; the minima are written out for
    that, as a join on top of its own aggregate can't be split.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.write(_star(edges.select("a", "b")), "edges0")
    state = None
    for k in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = scratch.write(_star(large), "large")
        scratch.drop("least", f"edges{k - 1}")
        least = scratch.write(now.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = now.join(least.hint("merge"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = scratch.write(_star(small), f"edges{k}")
        scratch.drop("least", "large")
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == state:
            break
        state = sums
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    found = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    out = into.write(found.unionByName(roots), name)
    scratch.drop()
    return out


def _star(edges: DataFrame) -> DataFrame:
    """Edges that point from the larger to the smaller node, each once."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
