"""Connected components as DataFrame rounds (large star, small star), for edge tables of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Write = Callable[[DataFrame, str], DataFrame]
#: Edges that a task contracts at a time.
EDGES_AT_ONCE = 200_000


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest one that the edges (left, right) connect each with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some edges at a time become stars around the smallest node of what they connect: no more rows, and far fewer rounds
    where neighbours come together."""
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        a, b = (pa.chunked_array([x.column(i) for x in held]).combine_chunks() for i in (0, 1))
        held.clear()
        coded = pa.concat_arrays([a, b]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        nodes, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ends = rank[coded.indices.to_numpy()]
        root = spanning(len(nodes), ends[: len(a)], ends[len(a) :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved]))], names=["node", "root"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= EDGES_AT_ONCE:
            yield stars()
    if any(x.num_rows for x in held):
        yield stars()


def connected_components(edges: DataFrame, write: Write, drop: Callable[[str], None] | None = None, name: str = "round") -> DataFrame:
    """node, root for every node of edges (a, b) that isn't the root of its component; a root is the smallest node of its component.

    Edges are first contracted inside tasks. Every round then links the larger neighbours of each node to its smallest one,
    then each node's smaller neighbours to the smallest of them, until the edges are stars. Minima are aggregated and
    stored before the join that hands them out, so both its sides are shuffled for it alone, and Spark can split a hub
    of very many edges over tasks. `write` cuts the lineage: it stores a table and reads it back.
    """
    kind = edges.schema["a"].dataType.simpleString()
    pairs = edges.filter(F.col("a") != F.col("b")).select("a", "b")
    now = write(pairs.mapInArrow(_contract, f"node {kind}, root {kind}").distinct(), f"{name}0")
    at = 0
    while True:
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = write(both.groupBy("node").agg(F.min("root").alias("least")).withColumn("least", F.least("least", "node")), f"{name}{at}-least")
        large = both.join(least, "node").filter(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        large = write(large, f"{name}{at}-large")
        low = write(large.groupBy("node").agg(F.min("root").alias("least")), f"{name}{at}-low")
        out = large.join(low, "node").select(F.explode(F.array(F.struct("node", F.col("least").alias("root")), F.struct(F.col("root").alias("node"), F.col("least").alias("root")))).alias("e"))
        out = write(out.select("e.*").filter(F.col("node") != F.col("root")).distinct(), f"{name}{at + 1}")
        if drop:
            for table in (f"{name}{at}", f"{name}{at}-least", f"{name}{at}-large", f"{name}{at}-low"):
                drop(table)
        now, at = out, at + 1
        stats = now.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("node").alias("nodes")).first()
        if stats["rows"] == stats["nodes"] and now.select(F.col("root").alias("node")).distinct().join(now, "node", "left_semi").isEmpty():
            return now
