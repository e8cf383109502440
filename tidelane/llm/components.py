"""Connected components of an edge table by repeated contraction.

Each round every node hooks to its smallest neighbour, hooks are shortened by pointer jumping, and
the edges between the roots go on.  All steps are joins and aggregates over tables in the shared
folder; the driver sees only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.storage import Scratch


def _moved(edges: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    p = parent.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return edges.join(p, F.col(column) == F.col("__n"), "left").withColumn(column, F.coalesce("__r", column)).drop("__n", "__r")


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not its own root; root is the smallest node."""
    at = 0
    links = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges0")
    whole: DataFrame | None = None
    while not links.isEmpty():
        parent = scratch.keep(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), f"{label}-hook{at}")
        for jump in range(3):
            parent = scratch.keep(_moved(parent, parent, "root"), f"{label}-jump{at}-{jump}")
        links = _moved(_moved(links, parent, "a"), parent, "b").where("a <> b")
        links = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges{at + 1}")
        whole = parent if whole is None else scratch.keep(_moved(whole, parent, "root").unionByName(parent.join(whole.select("node"), "node", "left_anti")), f"{label}-whole{at}")
        at += 1
    return whole if whole is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
