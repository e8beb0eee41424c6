"""Connected components of a links table, without collecting it.

Every node points to the smallest node among itself and its neighbours, and
pointers are followed to their roots. The roots then stand for their nodes: links
are renamed, those inside one root are dropped, and the rest goes on. Each round
at least halves the nodes that still have links, so that links of a large class
are joined once and not in every round. Each step is written to the shared
scratch folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import land


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``links`` (``a, b``); the smallest node names a class."""
    edges = land(_distinct(links), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        roots = _roots(edges)
        if labels is None:
            labels = roots
        else:
            step = roots.toDF("label", "root")
            labels = land(labels.join(step, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        for side in ("a", "b"):
            edges = edges.join(roots.toDF(side, f"root_{side}"), side)
        edges = land(_distinct(edges.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b")), "edges")
    return labels


def _distinct(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """Landed ``node, label``: the end of every node's way to ever smaller neighbours."""
    sides = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    near = edges.select(sides.alias("s")).select(F.col("s.a").alias("node"), F.col("s.b").alias("near"))
    labels = land(near.groupBy("node").agg(F.least("node", F.min("near")).alias("label")), "labels")
    while True:
        # Roots point to themselves and need no further step.
        ahead = labels.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("far"))
        followed = labels.join(ahead, "label", "left")
        moved = land(followed.select("node", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("on")), "labels")
        if moved.filter("on").isEmpty():
            return labels
        labels = moved.select("node", "label")
