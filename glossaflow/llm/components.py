"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.llm.tables import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes of edges ``(x, y)``; the root is the smallest node.

    Each round points every node at its smallest neighbour, follows that pointer
    once more, and contracts the graph, so a star of any size takes one round.
    Nodes at least halve from round to round. No row holds a node's neighbours.
    """
    spark = edges.sparkSession
    left, spent = keep(edges.filter("x <> y").select("x", "y").distinct(), "edges")
    roots, held = None, None
    while roots is None or not left.isEmpty():
        near = (
            left.union(left.select("y", "x")).groupBy("x").agg(F.min("y").alias("low"))
            .select(F.col("x").alias("node"), F.least("x", "low").alias("up"))
        )
        far = near.select(F.col("node").alias("up"), F.col("up").alias("root"))
        step, path = keep(near.join(far, "up").select("node", "root"), "step")
        used = [spent, path]
        if roots is None:
            roots, held = step, path
        else:
            on = step.select(F.col("node").alias("root"), F.col("root").alias("to"))
            moved = roots.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            used.append(held)
            roots, held = keep(moved, "roots")
        x = step.select(F.col("node").alias("x"), F.col("root").alias("u"))
        y = step.select(F.col("node").alias("y"), F.col("root").alias("v"))
        rest = left.join(x, "x").join(y, "y").filter("u <> v")
        left, spent = keep(rest.select(F.col("u").alias("x"), F.col("v").alias("y")).distinct(), "edges")
        drop(spark, *[p for p in used if p != held])
    drop(spark, spent)
    return roots
