"""Sharding by bytes with Karmarkar-Karp differencing over indivisible groups.

A partial partition is a vector of k byte sums, one for each shard. Differencing takes the two with the largest spread,
adds the fullest part of one to the emptiest of the other, and puts the sum back. Equal texts form one group, whose
weight is summed before anything else. Blocks of groups are differenced in tasks of their own; each leaves one partial
partition, and those are differenced in turn: the method is the same at every level, so the driver only ever sees
`fan` vectors of k sums.

Defined results: a null text has size 1 and shares a group with the empty text; rows that repeat are rows of their
own in the same shard; an empty table gives an empty result. One group that outweighs a shard's share can't be split,
so its shard is as heavy as it is.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismgraph.llm.common import Scratch, buckets, text_or_empty


def difference(vectors: Sequence[Sequence[int]]) -> tuple[list[list[int]], list[int]]:
    """Karmarkar-Karp over vectors of k sums: for each vector the final part of each of its parts, and the final sums."""
    n = len(vectors)
    k = len(vectors[0])
    sums: list[list[int]] = []
    made: list[tuple[int, int, list[int], list[int]]] = []  # left, right, where the left's and the right's parts went
    start: list[list[int]] = []
    heap: list[tuple[int, int]] = []
    for i, v in enumerate(vectors):
        order = sorted(range(k), key=lambda j: (-v[j], j))
        start.append(order)
        sums.append([v[j] for j in order])
        heap.append((sums[i][-1] - sums[i][0], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        z = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(k), key=z.__getitem__, reverse=True)
        place = [0] * k
        for p, i in enumerate(order):
            place[i] = p
        made.append((a, b, place, place[::-1]))
        sums.append([z[i] for i in order])
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    part: list[list[int] | None] = [None] * len(sums)
    part[-1] = list(range(k))
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, left, right = made[node - n]
        mine = part[node]
        part[a] = [mine[p] for p in left]
        part[b] = [mine[p] for p in right]
    out = []
    for i in range(n):
        back = [0] * k
        for p, j in enumerate(start[i]):
            back[j] = part[i][p]
        out.append(back)
    return out, sums[-1]


def _difference_groups(k: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["weight", "digest"], ascending=[False, True], kind="stable").reset_index(drop=True)
        parts, _ = difference([[int(w)] + [0] * (k - 1) for w in rows["weight"]])
        rows["part"] = [p[0] for p in parts]
        return rows[["digest", "block", "part", "weight"]]

    return run


def _difference_partials(k: int, fan: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        vectors = _vectors(k, zip(rows["block"], rows["part"], rows["weight"]))
        ids = sorted(vectors)
        parts, _ = difference([vectors[i] for i in ids])
        out = [(i, p, int(key[0]), parts[n][p], vectors[i][p]) for n, i in enumerate(ids) for p in range(k)]
        return pd.DataFrame(out, columns=["block", "part", "next_block", "next_part", "weight"])

    return run


def _vectors(k: int, rows) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for block, part, weight in rows:
        out.setdefault(int(block), [0] * k)[int(part)] += int(weight)
    return out


def assign_groups(spark: SparkSession, groups: DataFrame, shards: int, scratch: Scratch, block_groups: int = 16_384, fan: int = 4096) -> DataFrame:
    """digest, shard for every row (digest binary, weight long) of groups, balanced by weight."""
    blocks = buckets(groups.count(), block_groups)
    keyed = groups.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("long"))
    placed = scratch.write(keyed.groupBy("block").applyInPandas(_difference_groups(shards), "digest binary, block long, part int, weight long"), "placed")
    partial = placed.groupBy("block", "part").agg(F.sum("weight").cast("long").alias("weight"))
    placed = placed.select("digest", "block", "part")
    level = 0
    while blocks > fan:
        keyed = partial.withColumn("parent", F.floor(F.col("block") / fan).cast("long"))
        schema = "block long, part int, next_block long, next_part int, weight long"
        step = scratch.write(keyed.groupBy("parent").applyInPandas(_difference_partials(shards, fan), schema), f"merged{level}")
        placed = placed.join(step.drop("weight"), ["block", "part"]).select("digest", F.col("next_block").alias("block"), F.col("next_part").alias("part"))
        partial = step.groupBy(F.col("next_block").alias("block"), F.col("next_part").alias("part")).agg(F.sum("weight").cast("long").alias("weight"))
        blocks, level = buckets(blocks, fan), level + 1
    vectors = _vectors(shards, partial.collect())  # at most fan x shards rows
    ids = sorted(vectors)
    parts = difference([vectors[i] for i in ids])[0] if ids else []
    final = spark.createDataFrame([(i, p, parts[n][p]) for n, i in enumerate(ids) for p in range(shards)], "block long, part int, shard int")
    return placed.join(F.broadcast(final), ["block", "part"]).select("digest", "shard")


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 8, block_groups: int = 16_384, slot_rows: int = 16_384) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, digest, shard, slot (gapless from 0 in each shard).

    Law `bytes`: the sums of size (UTF-8 bytes plus 1) of the shards are as near equal as whole groups of equal texts
    allow. Slots follow a hash of the document, so that they can be numbered in many tasks.
    """
    scratch = Scratch(spark, "shard")
    facts = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("digest"),
    )
    narrow = scratch.write(facts, "facts")
    groups = scratch.write(narrow.groupBy("digest").agg(F.sum("size").cast("long").alias("weight"), F.count(F.lit(1)).alias("rows")), "groups")
    total = groups.agg(F.sum("rows")).first()[0] or 0
    shard_of = assign_groups(spark, groups.select("digest", "weight"), shards, scratch, block_groups)
    per = buckets(total, slot_rows * shards)
    rows = narrow.join(shard_of, "digest").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(per)).cast("int"))
    rows = scratch.write(rows, "sharded")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot")
    )
