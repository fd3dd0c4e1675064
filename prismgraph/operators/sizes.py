"""Which graphs of an edge table fit a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgraph.scratch import Scratch

#: Edges of a graph that one task may hold (as Python objects some 0.2 GB).
EDGES_IN_TASK = 250_000


def large_graphs(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The gid of each graph with more rows than fit a task; None where there are none."""
    large = scratch.write(edges.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > EDGES_IN_TASK).select("gid"), "large")
    return None if large.isEmpty() else large
