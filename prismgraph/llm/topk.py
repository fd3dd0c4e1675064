"""Exact top-k inner-product search with a ball tree per shard, branch and bound.

Vectors are dealt into shards by row, so that no id or vector that repeats fills one alone. A task builds the ball tree of a shard, once, and stores it:
nodes halve their vectors along the direction of widest spread and keep centre and radius, so that <q, centre> + |q| *
radius bounds every score below. Queries are gathered into blocks. The first tree is broadcast to all blocks and searched
alone; its k-th scores stay with the blocks as what a candidate must reach. The other trees and the blocks meet in a grid
of cells, some blocks and some trees each, a task for every cell: it holds its blocks, takes one tree after the other, and
passes the k-th scores on from tree to tree. A block's queries walk a tree together: at each node every query goes first
to the child with the larger bound, and leaves out a node whose bound is below its k-th best score so far.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; only vectors of
equal length are compared; a row doesn't answer a query of its own id; rows that repeat an id with other components are
rows of their own, and queries that share an id share one list; ties go to the smaller id; with fewer than k candidates
all are returned; a score must fit a signed long; an empty table, or one without queries, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismgraph.llm.common import Scratch, bound_batches, buckets

LOWEST, NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Exact in double precision as long as a sum of products stays below this.
EXACT = 2**53


class BallTree:
    """ids and integer vectors in leaf order; nodes with bounds of slices, children by number (0: none)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 256):
        self.ids, self.vectors = ids.copy(), vectors.astype(np.float64)
        self.whole = vectors
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        centres, radii = [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, False)]
        while todo:
            lo, hi, parent, is_right = todo.pop()
            node = len(self.lo)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            part = self.vectors[order[lo:hi]]
            centre = part.mean(0)
            gap = part - centre
            far = np.einsum("ij,ij->i", gap, gap)
            self.lo.append(lo)
            self.hi.append(hi)
            self.left.append(0)
            self.right.append(0)
            centres.append(centre)
            radii.append(float(np.sqrt(far.max())))
            if hi - lo > leaf and radii[-1] > 0:
                a = part[int(np.argmax(far))]
                b = part[int(np.argmax(((part - a) ** 2).sum(1)))]
                along = part @ (b - a)
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(along, mid)]
                todo.append((lo + mid, hi, node, True))
                todo.append((lo, lo + mid, node, False))
        self.ids, self.vectors, self.whole = self.ids[order], self.vectors[order], vectors[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.most = float(np.abs(vectors).max()) if vectors.size else 0.0

    def stored(self) -> dict:
        """The tree as a row: ids, vectors, nodes (bounds and children) and balls (radius, centre) as bytes."""
        nodes = np.array([self.lo, self.hi, self.left, self.right], "<i8")
        balls = np.concatenate([self.radii[:, None], self.centres], 1).astype("<f8")
        return {"ids": self.ids.astype("<i8").tobytes(), "vectors": self.whole.astype("<i8").tobytes(), "nodes": nodes.tobytes(), "balls": balls.tobytes()}

    @classmethod
    def load(cls, row) -> BallTree:
        out = cls.__new__(cls)
        out.ids = np.frombuffer(row["ids"], "<i8")
        out.whole = np.frombuffer(row["vectors"], "<i8").reshape(len(out.ids), -1)
        out.vectors = out.whole.astype(np.float64)
        out.lo, out.hi, out.left, out.right = np.frombuffer(row["nodes"], "<i8").reshape(4, -1).tolist()
        balls = np.frombuffer(row["balls"], "<f8").reshape(len(out.lo), -1)
        out.radii, out.centres = balls[:, 0], balls[:, 1:]
        out.most = float(np.abs(out.whole).max()) if out.whole.size else 0.0
        return out

    def bounds(self, node: int, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Upper bounds, a little above what rounding could take away."""
        reach = norm * self.radii[node]
        inner = q @ self.centres[node]
        return inner + reach + 1e-9 * (np.abs(inner) + reach) + 1e-6


class Best:
    """The k best (score, smaller id) of each query of a block, and what a candidate must reach."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.score = np.full((queries, k), LOWEST)
        self.id = np.full((queries, k), NONE)

    def offer(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        """Merges candidates into the lists of the queries that have any; the others aren't touched."""
        rows, at = np.unique(q, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        s = np.concatenate([self.score[rows].ravel(), s])
        i = np.concatenate([self.id[rows].ravel(), i])
        order = np.lexsort((i, ~s, at))  # ~s falls as s rises, without overflow
        first = np.searchsorted(at[order], np.arange(len(rows)))
        take = order[first[:, None] + np.arange(self.k)]
        self.score[rows], self.id[rows] = s[take], i[take]
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, n = np.nonzero(self.id != NONE)
        return q, self.id[q, n], self.score[q, n]


def search(tree: BallTree, ids: np.ndarray, q: np.ndarray, best: Best) -> None:
    """Adds a tree's candidates for the block of queries (integers as doubles) to best."""
    norm = np.sqrt(np.einsum("ij,ij->i", q, q))
    safe = q.shape[1] * tree.most * (np.abs(q).max() if q.size else 0.0) < EXACT
    todo = [(0, np.arange(len(ids)))]
    while todo:
        node, who = todo.pop()
        who = who[tree.bounds(node, q[who], norm[who]) >= best.floor[who]]
        if not len(who):
            continue
        if not tree.left[node]:
            lo, hi = tree.lo[node], tree.hi[node]
            if safe:
                score = (q[who] @ tree.vectors[lo:hi].T).astype(np.int64)
            else:
                score = q[who].astype(np.int64) @ tree.whole[lo:hi].T
            row, col = np.nonzero(score >= best.floor[who][:, None])
            found = tree.ids[lo:hi][col]
            other = found != ids[who][row]
            row, col, found = row[other], col[other], found[other]
            if len(row):
                best.offer(who[row], score[row, col], found)
            continue
        a, b = tree.left[node], tree.right[node]
        first = tree.bounds(a, q[who], norm[who]) >= tree.bounds(b, q[who], norm[who])
        near_a, near_b = who[first], who[~first]
        todo += [(b, near_a), (a, near_b), (b, near_b), (a, near_a)]  # the last is walked first


def _vectors(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype="<i8").reshape(len(raw), -1)


TREE = "ids binary, vectors binary, nodes binary, balls binary"
FOUND = "query_id long, vec_id long, score long"


def _gather(column: str, rows: int, make) -> object:
    """Rows that come sorted by a column are gathered by its value, at most 2 * rows at a time, and made into one row each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def made() -> pd.DataFrame:
            part = pd.concat(held)
            held.clear()
            return pd.DataFrame([{column: part[column].iat[0]} | make(part["vec_id"].to_numpy(np.int64), _vectors(part["vector"]))])

        for frame in frames:
            for _, part in frame.groupby(column, sort=False):
                if held and (held[-1][column].iat[0] != part[column].iat[0] or sum(map(len, held)) >= 2 * rows):
                    yield made()
                held.append(part)
        if held:
            yield made()

    return run


def _lists(best: Best, ids: np.ndarray) -> pd.DataFrame:
    q, found, score = best.found()
    return pd.DataFrame({"query_id": ids[q], "vec_id": found, "score": score})


def _asked(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vectors"], "<i8").reshape(len(ids), -1).astype(np.float64)


def _pilot(tree, k: int):
    """Blocks of queries -> the same with floors, the scores that a candidate must reach, and the lists of the first tree."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = BallTree.load(tree.value)
        for frame in frames:
            for row in frame.to_dict("records"):
                ids, q = _asked(row)
                best = Best(len(ids), k, np.full(len(ids), LOWEST))
                search(first, ids, q, best)
                found = _lists(best, ids)
                yield pd.DataFrame([row | {"floor": best.floor.astype("<i8").tobytes(), "found": found.to_numpy("<i8").tobytes()}])

    return run


def _unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for raw in frame["found"]:
            yield pd.DataFrame(np.frombuffer(raw, "<i8").reshape(-1, 3), columns=["query_id", "vec_id", "score"])


def _cells(k: int):
    """Rows sorted by cell, a cell's blocks before its trees -> the lists of its queries over its trees."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, blocks = None, []
        for frame in frames:
            for row in frame.to_dict("records"):
                if row["cell"] != cell:
                    for ids, _, best in blocks:
                        yield _lists(best, ids)
                    cell, blocks = row["cell"], []
                if row["is_tree"]:
                    tree = BallTree.load(row)
                    for ids, q, best in blocks:
                        search(tree, ids, q, best)
                else:
                    ids, q = _asked(row)
                    blocks.append((ids, q, Best(len(ids), k, np.frombuffer(row["floor"], "<i8"))))
        for ids, _, best in blocks:
            yield _lists(best, ids)

    return run


def quantised(vector: str = "embedding") -> Column:
    """Components as floor(64 * x), little-endian signed 64-bit; null where the vector takes no part."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return F.when((F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda e: F.floor(F.lit(64.0) * e)))


def _as_bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f["vector"] = [np.asarray(v, dtype="<i8").tobytes() for v in f["vector"]]
        yield f


def topk_search(
    spark: SparkSession, vectors: DataFrame, query: Column, k: int = 20, shard_rows: int = 16_384, query_block: int = 8_192, leaf: int = 512, cell_trees: int = 64, cell_blocks: int = 8, item_bytes: int = 8 << 20
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of `vectors` (vec_id, embedding) for each row where `query` holds.

    Shards and blocks have about so many rows and bytes, and twice that at most. A cell of the grid has about `cell_trees`
    trees and `cell_blocks` blocks; there are as many as that takes, and no fewer than cores while trees last.
    """
    bound_batches(spark)
    scratch = Scratch(spark, "topk")
    whole = vectors.select("vec_id", quantised().alias("vector"), query.alias("asks")).filter("vector is not null and vec_id is not null")
    whole = whole.withColumn("dim", F.size("vector"))
    whole = scratch.write(whole.mapInPandas(_as_bytes, "vec_id long, vector binary, asks boolean, dim int"), "vectors")
    sizes = {r["dim"]: (r["n"], r["asks"]) for r in whole.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("int")).alias("asks")).collect()}  # one row per length
    found: list[DataFrame] = []
    for dim, (n, asks) in sorted(sizes.items()):
        if not asks:
            continue
        most = max(1, item_bytes // (8 * dim))
        shard_rows_, block_rows = min(shard_rows, most), min(query_block, most)
        shards, blocks = buckets(n, shard_rows_), buckets(asks, block_rows)
        mine = whole.filter(F.col("dim") == dim)
        by_row = lambda parts: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")  # noqa: E731  of stored rows
        dealt = lambda rows, name, parts: rows.select("vec_id", "vector", by_row(parts).alias(name)).repartition(parts, name).sortWithinPartitions(name, "vec_id")
        build = lambda ids, raw: BallTree(ids, raw, leaf).stored()
        trees = scratch.write(dealt(mine, "shard", shards).mapInPandas(_gather("shard", shard_rows_, build), f"shard int, {TREE}"), f"trees{dim}")
        gather = lambda ids, raw: {"ids": ids.astype("<i8").tobytes(), "vectors": raw.astype("<i8").tobytes()}
        asked = dealt(mine.filter("asks"), "block", blocks).mapInPandas(_gather("block", block_rows, gather), "block int, ids binary, vectors binary")
        least = trees.agg(F.min(F.struct("shard", F.xxhash64("ids").alias("h"))).alias("at")).first()["at"]
        is_first = (F.col("shard") == least["shard"]) & (F.xxhash64("ids") == least["h"])
        first = spark.sparkContext.broadcast(trees.filter(is_first).select(*TREE.replace(" binary", "").split(", ")).first().asDict())  # of 2 * item_bytes and its nodes at most
        asked = scratch.write(asked.mapInPandas(_pilot(first, k), "block int, ids binary, vectors binary, floor binary, found binary"), f"asked{dim}")
        found.append(asked.select("found").mapInPandas(_unpack, FOUND))
        if trees.limit(2).count() < 2:
            continue
        columns = buckets(blocks, cell_blocks)
        lines = min(shards, max(buckets(shards, cell_trees), buckets(spark.sparkContext.defaultParallelism, columns)))
        none = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
        column, line = F.explode(F.sequence(F.lit(0), F.lit(columns - 1))), F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))
        left = trees.filter(~is_first).select(by_row(lines).alias("line"), column.alias("column"), F.lit(True).alias("is_tree"), "ids", "vectors", "nodes", "balls", *none("floor"))
        right = asked.withColumn("column", by_row(columns)).select(line.alias("line"), "column", F.lit(False).alias("is_tree"), "ids", "vectors", *none("nodes", "balls"), "floor")
        cells = left.unionByName(right).select((F.col("line") * columns + F.col("column")).cast("int").alias("cell"), "is_tree", "ids", "vectors", "nodes", "balls", "floor")
        cells = cells.repartitionById(lines * columns, F.col("cell")).sortWithinPartitions("cell", "is_tree")
        found.append(scratch.write(cells.mapInPandas(_cells(k), FOUND), f"found{dim}"))
        scratch.drop(f"trees{dim}")
    scratch.drop("vectors")
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
