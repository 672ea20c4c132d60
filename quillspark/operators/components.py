"""Connected components of an edge list by parallel hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import done_with, written


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each node's component, for every node that an edge names.

    Each round hooks every node to its smallest neighbour, shortcuts the parents by joining the parent
    table to itself, and contracts the edges to those between different parents; the edges shrink at
    least by half a round, and a node that a third of the edges name is one row of the parent table.
    Nodes may be of any type with an order. Self-loops give a node its own component, null ends are
    dropped, an empty table gives an empty one. Each round is a table in the shared folder.
    """
    kind = edges.schema[a].dataType
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = written(pairs.distinct())
    label: DataFrame | None = None
    for _ in range(rounds):
        both = now.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(now.select(F.col("v").alias("node"), F.col("u").alias("near")))
        first = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("parent")))
        parent = first
        for _ in range(2):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("upper"))
            parent = parent.join(up, "parent").select("node", F.col("upper").alias("parent"))
        parent = written(parent)
        done_with(first)
        if label is None:
            label, last = written(parent.select("node", F.col("parent").alias("component"))), None
        else:
            step = parent.select(F.col("node").alias("component"), "parent")
            last, label = label, written(label.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        pu, pv = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu")), parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        left = written(now.join(pu, "u").join(pv, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        done_with(last, now, parent)
        now = left
        if now.isEmpty():
            done_with(now)
            return label
    raise RuntimeError(f"the components did not settle in {rounds} rounds of {kind}")
