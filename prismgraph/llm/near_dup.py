"""Jaccard join of documents over word 5-grams: MinHash candidates, Bayesian pruning, exact verification.

1. Every text becomes its set of 64-bit hashes of five consecutive words, and 128 MinHash values of that set. Documents
   of equal sets collapse to one node with a count: copies are never paired.
2. Bands of four MinHash values make candidates: nodes that share a band (a pair at 0.8 misses all 32 bands with a chance
   of 5e-8). They meet the smallest node of that band, and the connected components of these links hold all candidate
   pairs. Pairs are never written out.
3. A unit of work is a component or, where that takes fewer copies of sets, as in long chains of weak links, each band
   of it that nodes share; a pair is then compared in the first band it shares. A unit is cut into blocks; each pair
   of blocks is compared in a task of its own. MinHash values are compared 16 at a time, and a pair is dropped once the
   posterior probability (uniform prior) that its similarity reaches the threshold falls below the tolerance. The rest
   is verified on the sets themselves.
4. A task returns, for each node, how many documents it is linked to, and a spanning star for each group that it found;
   the components of those are the classes.

Defined results: words are runs of characters other than [\\x20\\x09-\\x0D], case and marks count; a text of one to four
words is one shingle of them all; a null text, or one without words, has no shingles, no links and a class of its own;
rows that repeat are copies of one another; the class of documents that all lack an id is null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from prismgraph.llm.common import Scratch, bound_batches
from prismgraph.operators.components import connected_components, spanning

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
STEP = 16
#: Tables of at most this many rows (of some 200 bytes, 300 in a hash relation) are broadcast; beyond it Spark chooses.
BROADCAST_ROWS = 100_000
BLOCK_BYTES = 1 << 20
_P = 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts that lie one after another in data, and the text it is in.

    Differences of running sums of byte * p**i are shifted back by p**-start, so equal words hash alike anywhere."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.ones(n + 1, bool)
    edge[1:-1] = doc[1:] != doc[:-1]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = np.full(n, np.uint64(_P)), np.full(n, np.uint64(pow(_P, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), doc[start]


def shingles(data: np.ndarray, ends: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    word, doc = _word_hashes(data, ends)
    bound = np.searchsorted(doc, np.arange(len(ends) + 1))
    k = np.uint64(0x9FB21C651E98DF25)
    if len(word) >= width:
        g = word[: len(word) - width + 1].copy()
        for i in range(1, width):
            g = g * k + word[i : len(word) - width + 1 + i]
        g = _mix(g)
    out = []
    for a, z in zip(bound[:-1], bound[1:]):
        if z - a >= width:
            out.append(np.unique(g[a : z - width + 1]))
        elif z > a:
            h = np.uint64(z - a)
            with np.errstate(over="ignore"):
                for w in word[a:z]:
                    h = h * k + w
            out.append(_mix(np.array([h], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _hash_family(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, texts x HASHES; texts without shingles get zeros."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        h = (flat >> np.uint64(32)).astype(np.uint32)
        begin = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
        for j, (a, b) in enumerate(zip(*_hash_family())):
            x = h * a + b
            out[some, j] = np.minimum.reduceat(x ^ (x >> np.uint32(16)), begin)
    return out


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo]
        lo = hi


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, h, text -> doc_id, h, node, signature."""
    for b in batches:
        for lo, hi, data, ends in _blocks(b.column(2)):
            sets = shingles(data, ends)
            sig = signatures(sets)
            keys = pa.array([set_key(s) for s in sets], pa.binary())
            rows = pa.array([r.tobytes() if len(s) else None for r, s in zip(sig, sets)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], keys, rows], names=["doc_id", "text_hash", "node", "signature"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, node, copies, places -> the same without text, with signature and shingles, of rows that have that node's set."""
    names = ["node", "copies", "places", "signature", "shingles"]
    for b in batches:
        for lo, hi, data, ends in _blocks(b.column(0)):
            sets = shingles(data, ends)
            nodes = b.column(1)[lo:hi].to_pylist()
            right = [i for i, s in enumerate(sets) if set_key(s) == nodes[i]]
            sig = signatures(sets)
            at = pa.array([lo + i for i in right], pa.int64())
            own = [pa.array([sig[i].tobytes() for i in right], pa.binary()), pa.array([sets[i].tobytes() for i in right], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(1, 4)), *own], names=names)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ..: matches that keep a pair. With m of n matches and a uniform prior the similarity is
    Beta(m + 1, n - m + 1), and it reaches t with the chance that n + 1 trials of chance t succeed m times at most."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, below, m = (1 - threshold) ** (n + 1), 0.0, 0
        while m <= n:
            below += chance
            if below >= tolerance:
                break
            chance *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append(m)
    return out


def linked_pairs(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (left, right) those whose sets' Jaccard similarity reaches the threshold."""
    size = np.array([len(s) for s in sets], np.int64)
    small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    near = small >= threshold * large - 1e-9
    left, right = left[near], right[near]
    match = np.zeros(len(left), np.int32)
    for step, least in enumerate(need):
        cols = slice(step * STEP, (step + 1) * STEP)
        match += (sig[left, cols] == sig[right, cols]).sum(1, dtype=np.int32)
        alive = match >= least
        left, right, match = left[alive], right[alive], match[alive]
    if not len(left):
        return left, right
    both = _common_many(sets, left, right) if len(left) > 4 * len(sets) else np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)])
    ok = both >= threshold * (size[left] + size[right] - both) - 1e-9
    return left[ok], right[ok]


def _common_many(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of intersections by products of incidence matrices, some columns at a time; shingles of one set drop out."""
    used = np.unique(np.concatenate([left, right]))
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, column, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, z = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((len(used), width), np.float32)
        x[row[a:z], column[a:z] - lo] = 1
        total += x @ x.T
    return total[np.searchsorted(used, left), np.searchsorted(used, right)].astype(np.int64)


def first_shared_band(sig: np.ndarray, left: np.ndarray, right: np.ndarray, at: int, width: int = 1 << 14) -> np.ndarray:
    """Which of the pairs share no band before number `at`."""
    out = np.ones(len(left), bool)
    for lo in range(0, len(left) if at else 0, width):
        a, b = sig[left[lo : lo + width], : at * ROWS], sig[right[lo : lo + width], : at * ROWS]
        out[lo : lo + width] = ~(a == b).reshape(len(a), at, ROWS).all(2).any(1)
    return out


def _compare(threshold: float, tolerance: float):
    need = least_matches(threshold, tolerance)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, at, i, j = key
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        sig = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(len(rows), HASHES)
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        if i == j:
            left, right = np.triu_indices(len(rows), 1)
        else:
            block = rows["block"].to_numpy()
            a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
            left, right = np.repeat(a, len(b)), np.tile(b, len(a))
        if at > 0:
            fresh = first_shared_band(sig, left, right, int(at))
            left, right = left[fresh], right[fresh]
        left, right = linked_pairs(sig, sets, left, right, threshold, need)
        copies = rows["copies"].to_numpy(np.int64)
        links = np.bincount(left, copies[right], len(rows)) + np.bincount(right, copies[left], len(rows))
        root = spanning(len(rows), left, right)
        some = links > 0
        node = rows["node"]
        return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "hub": node.iloc[root[some]].to_numpy()})

    return run


def _places(banded: DataFrame, hubs: DataFrame, members: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """node, places: the units of work that a node is compared in, as (unit, at, blocks); `at` is -1 for a component and
    the band's number for a band. Either way costs as many copies of each set as its unit has blocks; the cheaper is taken."""
    cut = lambda n: F.ceil(F.col(n) / F.lit(block))
    whole = members.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    bands = hubs.join(members, hubs["hub"] == members["node"]).groupBy("comp").agg(F.sum(F.col("n") * cut("n")).alias("copies"))
    plan = whole.join(bands, "comp").select("comp", cut("size").cast("int").alias("blocks"), ((F.col("size") > block) & (F.col("copies") < F.col("size") * cut("size"))).alias("by_band"))
    plan = scratch.write(plan, "plan")
    place = lambda unit, at, blocks: F.struct(unit.alias("unit"), at.alias("at"), blocks.cast("int").alias("blocks"))
    out = members.join(plan.filter("not by_band"), "comp").select("node", F.array(place(F.col("comp"), F.lit(-1), F.col("blocks"))).alias("places"))
    chains = plan.filter("by_band")
    if not chains.isEmpty():
        mine = banded.join(members.join(chains.select("comp"), "comp").select("node"), "node", "left_semi").join(hubs, "band")
        mine = mine.select("node", place(F.encode(F.col("band").cast("string"), "utf-8"), F.col("at"), cut("n")).alias("p"))
        out = out.unionByName(mine.groupBy("node").agg(F.collect_list("p").alias("places")))  # at most one for each band
    return out


def jaccard_join(
    spark: SparkSession, docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-7, block: int = 256, with_first: bool = False
) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id (smallest doc_id of all that links connect), n_links (documents of similarity
    threshold or more, copies included), n_copies (documents of the same set, itself included), copy_id (the smallest).
    `with_first` adds class_first: no_id, doc_id, text_hash of the smallest of the class, ids first; null for a text without words."""
    bound_batches(spark)
    scratch = Scratch(spark, "near")
    kind = docs.schema["doc_id"].dataType
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    signed = scratch.write(texts.mapInArrow(_sign, f"doc_id {kind.simpleString()}, text_hash long, node binary, signature binary"), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.any_value("signature").alias("signature"), first)
    nodes = scratch.write(nodes, "nodes")

    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("signature"), b * (4 * ROWS) + 1, F.lit(4 * ROWS)))))
    banded = nodes.select("node", band.alias("at", "band"))
    hubs = scratch.write(banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "hubs")
    met = banded.join(hubs, "band").filter(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    stars = connected_components(met, scratch.write, scratch.drop, "candidates")

    members = stars.select("node", F.col("root").alias("comp")).unionByName(stars.select(F.col("root").alias("node"), F.col("root").alias("comp")).distinct())
    members = scratch.write(members, "members")
    placed = _places(banded, hubs, members, block, scratch).join(nodes.select("node", "copies", "first"), "node")
    placed = scratch.write(placed, "placed")
    few = placed.count() <= BROADCAST_ROWS
    chosen = (F.broadcast(placed) if few else placed).alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.first.doc_id")) & (F.col("d.text_hash") == F.col("p.first.text_hash"))
    # rows that repeat id and text, of which there may be very many, become one before anything else is done with them
    found = texts.alias("d").join(chosen, same).select("d.text", "p.node", "p.copies", "p.places").dropDuplicates(["node"])
    place = "places array<struct<unit:binary,at:int,blocks:int>>"
    sets = found.mapInArrow(_sets, f"node binary, copies long, {place}, signature binary, shingles binary")
    sets = sets.withColumn("p", F.explode("places")).select("node", "copies", "signature", "shingles", "p.unit", "p.at", "p.blocks")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = sets.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    compared = paired.groupBy("unit", "at", "i", "j").applyInPandas(_compare(threshold, tolerance), "node binary, links long, hub binary")
    compared = scratch.write(compared, "compared")

    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(compared.select(F.col("node").alias("a"), F.col("hub").alias("b")), scratch.write, scratch.drop, "classes")
    facts = nodes.select("node", "copies", "first").join(groups, "node", "left").join(links, "node", "left")
    facts = facts.select("node", "copies", "first", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = facts.groupBy("root").agg(F.min("first").alias("class_first"))
    facts = facts.join(classes, "root").select("node", "copies", "links", F.col("first.doc_id").alias("copy_id"), F.col("class_first.doc_id").alias("class_id"), *(["class_first"] if with_first else []))
    facts = scratch.write(facts, "facts")
    scratch.keep("signed", "facts")
    out = signed.select("doc_id", "text_hash", "node").join(facts, "node", "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        *(["class_first"] if with_first else []),
    )


def keep_one_each(spark: SparkSession, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each class, that of the smallest (doc_id, hash of the text). Of rows that repeat id and text one stays.

    Documents that lack an id go where their class has one with an id; where it has none, one of them stays. Texts without
    words are classes of their own: of those without an id all stay."""
    scratch = Scratch(spark, "keep")
    joined = scratch.write(jaccard_join(spark, docs, threshold, with_first=True), "joined")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(whole, F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("d")

    def matching(rows: DataFrame, how: str, left: DataFrame) -> DataFrame:
        rows = F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
        return left.join(rows.alias("r"), F.col("d.id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.h") == F.col("r.text_hash")), how)

    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    gone = joined.filter(F.col("class_first").isNotNull() & (F.col("class_first") != own)).select("doc_id", "text_hash").distinct()
    out = matching(gone, "left_anti", keyed)
    again = joined.filter("doc_id is not null or class_first is not null").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    if not again.isEmpty():
        out = matching(again, "left_anti", out).unionByName(matching(again, "left_semi", out).dropDuplicates(["id", "h"]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
