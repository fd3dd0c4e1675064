"""Consecutive numbers of rows in a global order, without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgraph.scratch import Scratch


def numbered(rows: DataFrame, keys: list[str], name: str, scratch: Scratch) -> DataFrame:
    """rows with `name`: 0, 1, .. in the order of the keys. Ranges of keys are sorted in tasks; their sizes, one number a
    task, are summed on the driver."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    tagged = scratch.write(ordered, f"ordered-{name}").withColumn("_part", F.shiftrightunsigned("_at", 33))
    sizes = sorted((r["_part"], r["count"]) for r in tagged.groupBy("_part").count().collect())  # one row per partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _start long"))
    return tagged.join(offsets, "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_at")
