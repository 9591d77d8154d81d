"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.llm.common import Workspace


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v. Large star: a node's larger neighbours get its least neighbour; small star: the smaller ones do."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = joined.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, work: Workspace, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge, root the least node of its component.

    Each round is written to the shared folder, so lineage stays short. The number of rounds grows with the
    logarithm of the longest chain; no step gathers a component in one task.
    """
    now = work.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "cc0")
    last = None
    for k in range(1, rounds + 1):
        now = work.keep(_stars(_stars(now, True), False), f"cc{k}")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        work.drop(f"cc{k - 1}")
        if (state.n, state.h) == last:
            break
        last = (state.n, state.h)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
