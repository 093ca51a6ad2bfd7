"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm._store import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``, root being the smallest node reachable.

    Each round every node takes the smallest root among its neighbours, then the
    root of that root, so chains shrink by halves; rounds end when none changes.
    Each round is written to the shared folder.  Rows with a null end and loops
    are ignored, repeated edges count once; no edges give no rows.
    """
    edges = edges.where("a <> b")
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    label = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}-0")
    step = 0
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        low = label.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("root").alias("up"))
        step += 1
        new = scratch.keep(
            low.join(up, "low", "left").select("node", F.least("low", "up").alias("root"), (F.least("low", "up") != F.col("root")).alias("moved")),
            f"{name}-{step}",
        )
        moved = new.where("moved").limit(1).count()
        label = new.select("node", "root")
        scratch.drop(f"{name}-{step - 1}")
        if not moved:
            scratch.drop(f"{name}-edges")
            return label
