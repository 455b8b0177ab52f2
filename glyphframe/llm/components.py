"""Connected components of links between documents, for any number of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    No edges: no rows. Loops, repeated edges and edges with a null end change nothing. See graph.components for the rounds.
    """
    known = edges.where("a is not null and b is not null").select(F.lit(0).alias("graph"), F.col("a").alias("src"), F.col("b").alias("dst"))
    return graph.components(known).select("node", F.col("component").alias("root"))
