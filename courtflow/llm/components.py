"""Connected components of an edge table by alternating star contraction.

Each round is two shuffles on node ids with map-side minima; nothing is collected
but a count and a checksum of the edges. A node with very many neighbours costs no
single task: its minimum is pre-aggregated, and its edges meet it in a plain join
that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.shared import stash, unstash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v). large: nodes above u move to u's least neighbour; small: those below and u itself."""
    if large:
        arcs = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges.select("u", "v")
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = arcs.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns a, b); root is the least node of the component.

    Self-loops and repeated edges are harmless; nodes without any edge to another
    node are not returned; an empty table gives an empty one. Nulls are dropped.
    """
    now = stash(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == mark:
            break
        mark, before = (state["n"], state["h"]), now
        now = stash(_star(_star(now, True), False), label)
        unstash(before)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
