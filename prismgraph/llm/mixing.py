"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a target number of words. A document is taken floor(rate) times, and once more with the fractional
part of the rate as its inclusion probability. The flight phase moves the probabilities of three documents at a time
along the null space of two constraints, the number of documents and their words, until one of them is 0 or 1. Blocks of
a source fly on their own; each leaves at most two undecided documents, and these fly together on the next level, until
one block holds what a source has left. The landing decides the last two and a dozen that waited for it, all choices
compared: it takes the one nearest to the words, and documents, that are expected of them.

Defined results: a null text has size 0 and is taken any number of times at no cost; a null source is a source of its
own, the last; documents that lack or repeat an id are sampled, and taken, row by row; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismgraph.llm.common import WORD, Scratch, buckets

#: A source table of at most this many rows is broadcast; beyond it Spark chooses the join.
BROADCAST_SOURCES = 100_000
EPS = 1e-9


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[float], weights: Sequence[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Shares share * sum(sizes) by weight; no target passes cap * its size, and what is above goes to the others."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def _move(p: list[float], u: Sequence[float], rng: random.Random) -> None:
    """One step of the flight: along u or against it, to the border, with odds that keep every expectation."""
    up = min(((1 - x) / d if d > 0 else x / -d) for x, d in zip(p, u) if d)
    down = min((x / d if d > 0 else (1 - x) / -d) for x, d in zip(p, u) if d)
    step = up if rng.random() * (up + down) < down else -down
    for i, d in enumerate(u):
        p[i] = min(1.0, max(0.0, p[i] + step * d))
        if p[i] < EPS:
            p[i] = 0.0
        elif p[i] > 1 - EPS:
            p[i] = 1.0


def flight(prob: Sequence[float], size: Sequence[float], rng: random.Random, land: bool = False, landing: int = 12) -> list[float]:
    """The probabilities after the flight: all 0 or 1 but for two at most, or for none after the landing.

    `landing` documents, spread evenly over the order, wait for the landing: enough to make up for the last two.
    """
    out = list(prob)
    moving = [k for k in range(len(out)) if EPS < out[k] < 1 - EPS]
    for k in set(range(len(out))) - set(moving):
        out[k] = float(out[k] > 0.5)
    wait = moving[:: max(1, len(moving) // landing)][:landing] if land else []
    hand: list[int] = []
    for k in moving:
        if k in wait:
            continue
        hand.append(k)
        if len(hand) == 3:
            a, b, c = (size[i] for i in hand)
            u = (c - b, a - c, b - a)
            if not any(u):
                u = (1.0, -1.0, 0.0)
            p = [out[i] for i in hand]
            _move(p, u, rng)
            for i, x in zip(hand, p):
                out[i] = x
            hand = [i for i in hand if 0.0 < out[i] < 1.0]
    if land and (hand or wait):
        hand += wait
        picks = (np.arange(1 << len(hand))[:, None] >> np.arange(len(hand))) & 1
        words = np.abs(picks @ np.array([size[i] for i in hand], float) - sum(size[i] * out[i] for i in hand))
        count = np.abs(picks.sum(1) - sum(out[i] for i in hand))
        for i, x in zip(hand, picks[int(np.argmin(words + count))]):
            out[i] = float(x)
    return out


FLOWN = "doc_id {id}, text_hash long, size long, sid int, base int, pi double, block long, extra int"


def _fly(seed: int, level: int, last: bool):
    order = [("size", "descending"), ("doc_id", "ascending"), ("pi", "ascending"), ("text_hash", "ascending")]
    names = ["doc_id", "text_hash", "size", "sid", "base", "pi", "block"]

    def fly(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select(names).sort_by(order)
        rng = random.Random(f"{seed}|{level}|{key[0].as_py()}|{key[1].as_py()}")
        moved = flight(rows["pi"].to_pylist(), rows["size"].to_pylist(), rng, land=last)
        extra = pa.array([int(x) if x in (0.0, 1.0) else None for x in moved], pa.int32())
        return rows.set_column(names.index("pi"), "pi", pa.array(moved, pa.float64())).append_column("extra", extra)

    return fly


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    block_rows: int = 4096,
    size: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, text_hash, source, size, source_size, target (its source's), copies, taken (size * copies).

    Sources weigh `weights`, repeating, by code point with null last. Reruns on the same rows agree: the random numbers
    come from the seed, the source and the block, and rows are sorted inside a block.
    """
    scratch = Scratch(spark, "mix")
    narrow = scratch.write(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), (word_count() if size is None else size).alias("size")), "sizes")
    found = narrow.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    totals = [int(r["s"] or 0) for r in found]
    goal = targets(totals, [weights[i % len(weights)] for i in range(len(found))], share, cap)
    rates = [min(cap, t / s) if s else 0.0 for t, s in zip(goal, totals)]
    blocks = [buckets(r["n"], block_rows) for r in found]
    table = spark.createDataFrame(
        [(r["source"], i, totals[i], goal[i], int(math.floor(rates[i])), rates[i] - math.floor(rates[i]), blocks[i]) for i, r in enumerate(found)],
        "source string, sid int, source_size long, target double, base int, pi double, nb int",
    )
    if len(found) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rows = narrow.alias("n").join(table.alias("t"), F.col("n.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("doc_id", "text_hash", "size", "sid", "base", "pi", F.pmod(F.xxhash64("doc_id", "size"), F.col("nb")).alias("block"))
    schema = FLOWN.format(id=docs.schema["doc_id"].dataType.simpleString())
    decided: DataFrame | None = None
    level, most = 0, max(blocks, default=1)
    while True:
        last = most == 1
        flown = scratch.write(rows.groupBy("sid", "block").applyInArrow(_fly(seed, level, last), schema), f"level{level}")
        done = flown.filter(F.col("extra").isNotNull())
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        per = buckets(most * 2, block_rows)
        rows = flown.filter(F.col("extra").isNull()).drop("extra").withColumn("block", F.pmod(F.col("block"), F.lit(per)).cast("long"))
        level, most = level + 1, per
    copies = (F.col("base") + F.col("extra")).cast("int")
    facts = F.broadcast(table) if len(found) <= BROADCAST_SOURCES else table
    return decided.join(facts.select("sid", "source", "source_size", "target"), "sid").select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken")
    )


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it.

    Rows are met by id, source and text, nulls included. Rows that agree in all three have copies that differ by one at
    most; they are numbered, by partition and inside it, and the first of them are taken once more."""
    key = ["doc_id", "source", "text_hash"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.spark_partition_id().alias("part"))
    rows = rows.withColumn("text_hash", F.xxhash64("row.text")).alias("d")
    low = F.min("copies")
    times = mixed.groupBy(*key).agg(low.alias("low"), (F.sum("copies") - low * F.count(F.lit(1))).alias("more"))

    def met(times: DataFrame) -> DataFrame:
        same = F.col("d.row.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.row.source").eqNullSafe(F.col("m.source"))
        return rows.join(times.alias("m"), same & (F.col("d.text_hash") == F.col("m.text_hash"))).select("d.row", "d.part", "m.*")

    taken = met(times.filter("more = 0")).select("row", F.col("low").alias("copies"))
    uneven = times.filter("more > 0")
    if not uneven.isEmpty():
        uneven = Scratch(docs.sparkSession, "taken").write(met(uneven), "uneven").alias("u")
        earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = uneven.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
        parts = parts.select(*key, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).alias("p")
        same = [F.col(f"u.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*key, "part"]]
        nth = F.row_number().over(Window.partitionBy(*[F.col(f"u.{c}") for c in [*key, "part"]]).orderBy(F.lit(0)))
        numbered = uneven.join(parts, same).select("u.row", "u.low", "u.more", (F.col("p.before") + nth).alias("nth"))
        taken = taken.unionByName(numbered.select("row", (F.col("low") + (F.col("nth") <= F.col("more")).cast("int")).alias("copies")))
    nth = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")
    return taken.filter("copies > 0").select("row", nth).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
