"""Quality scores by voting of the nearest labelled documents in a latent-semantic space.

Terms are counted over the whole text, vectorised over Arrow's buffers: byte trigrams, runs of four character classes,
word shapes, and words equal to the one before. Counts become log(1 + n) * idf, each family at a fixed length; a truncated SVD of the
labelled sample gives the latent space. The sample's vectors are broadcast; for every document the cosine with every one
of them is computed exactly, block by block, and the nearest vote with their similarity as weight.

The sample is bounded: at most `sample` labelled rows (4,096 by default, some 0.8 MB of vectors), those with the smallest
hash of doc_id. It is the only thing that doesn't grow with the input.

Defined results: a null text counts as empty; a text without terms, and every text where there are no labels at all, gets
the mean label of the sample (0.5 without labels); a doc_id labelled twice has the mean of its labels; texts of over
1 MiB are counted in pieces of that size; rows that repeat are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgraph.llm.common import bound_batches

TRIGRAMS, RUNS, SHAPES = 2048, 1024, 128
TERMS = TRIGRAMS + RUNS + SHAPES + 1
#: Columns of each family and the length it is given; words like the one before count as their share of all words.
FAMILIES = (((0, TRIGRAMS), 0.5), ((TRIGRAMS, TRIGRAMS + RUNS), 0.7), ((TRIGRAMS + RUNS, TERMS - 1), 0.7))
PIECE = 1 << 20
#: Bytes and documents of one block of counting.
BLOCK_BYTES, BLOCK_DOCS = 1 << 18, 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Class of each byte: 0 space, 1 other white space, 2 lower, 3 upper, 4 digit, 5 beyond ASCII, 6 to 14 marks by kind, 15 other marks."""
    out = np.full(256, 15, np.uint8)
    out[32] = 0
    out[9:14] = 1
    out[97:123] = 2
    out[65:91] = 3
    out[48:58] = 4
    out[128:] = 5
    for i, marks in enumerate((b".", b",;:", b"!?", b"*#", b"%$&", b"|", b"-_", b"'\"`", b"/\\@=<>")):
        out[list(marks)] = 6 + i
    return out


CLASS = _classes()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    p, q = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    up, down = np.full(n, p), np.full(n, q)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def count_terms(data: np.ndarray, ends: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts of every term, docs x TERMS, of texts that lie one after another in data and end at `ends`."""
    docs, n = len(ends), len(data)
    out = np.zeros((docs, TERMS), np.float32)
    if not n:
        return out
    doc = np.repeat(np.arange(docs), np.diff(ends, prepend=0))
    b = data.astype(np.uint32)
    if n > 2:
        h = ((b[:-2] * 65599 + b[1:-1]) * 65599 + b[2:]) * np.uint32(0x9E3779B1) >> 21
        ok = doc[:-2] == doc[2:]
        out[:, :TRIGRAMS] = np.bincount((doc[:-2] * TRIGRAMS + h)[ok], minlength=docs * TRIGRAMS).reshape(docs, -1)
    c = CLASS[data].astype(np.uint32)
    if n > 3:
        h = ((c[:-3] << 12) | (c[1:-2] << 8) | (c[2:-1] << 4) | c[3:]) * np.uint32(0x9E3779B1) >> 22
        ok = doc[:-3] == doc[3:]
        out[:, TRIGRAMS : TRIGRAMS + RUNS] = np.bincount((doc[:-3] * RUNS + h)[ok], minlength=docs * RUNS).reshape(docs, -1)
    inside = np.concatenate([[False], c > 1, [False]])
    edge = np.concatenate([[True], doc[1:] != doc[:-1], [True]])
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    if len(start):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][:n])])
        word = (total[end] - total[start]) * powers[1][start]
        upper = np.concatenate([[0], np.cumsum(c == 3)])
        shout = (upper[end] - upper[start]) * 2 > (end - start)
        shape = shout * 64 + np.minimum(np.log2(end - start).astype(int), 3) * 16 + c[end - 1]
        at = doc[start]
        out[:, TRIGRAMS + RUNS : -1] = np.bincount(at * SHAPES + shape, minlength=docs * SHAPES).reshape(docs, -1)
        again = (word[1:] == word[:-1]) & (at[1:] == at[:-1])
        out[:, -1] = np.bincount(at[1:][again], minlength=docs)
    return out


def counted(texts: pa.Array, powers: tuple[np.ndarray, np.ndarray]) -> Iterator[np.ndarray]:
    """Term counts of the texts of an Arrow string array, block after block."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, min(lo + BLOCK_DOCS, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1))
        a, z = int(offsets[lo]), int(offsets[hi])
        if z - a <= PIECE:
            yield count_terms(data[a:z], offsets[lo + 1 : hi + 1] - a, powers)
        else:  # one long text
            yield sum(count_terms(data[i : min(z, i + PIECE)], np.array([min(z, i + PIECE) - i]), powers) for i in range(a, z, PIECE))
        lo = hi


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray  # TERMS x dims
    known: np.ndarray  # sample x dims, unit length
    label: np.ndarray
    prior: float
    nearest: int
    power: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = weigh(counts, self.idf) @ self.axes
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(norm > 0, norm, 1)

    def score(self, counts: np.ndarray, leave_out: bool = False) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if not len(self.known):
            return out
        z = self.latent(counts)
        near = z @ self.known.T
        if leave_out:
            np.fill_diagonal(near, -1)
        k = min(self.nearest, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(near, at, 1), 0) ** self.power
        total = w.sum(1)
        ok = total > 1e-9
        out[ok] = (w * self.label[at]).sum(1)[ok] / total[ok]
        return np.clip(out, 0, 1)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Each family of terms to a length of its own, so that long families don't drown short ones."""
    x = np.log1p(counts) * idf
    for (a, z), length in FAMILIES:
        norm = np.linalg.norm(x[:, a:z], axis=1, keepdims=True)
        x[:, a:z] *= length / np.where(norm > 0, norm, 1)
    words = counts[:, TRIGRAMS + RUNS : -1].sum(1)
    x[:, -1] = np.sqrt(counts[:, -1] / np.maximum(words, 1))
    return x


def fit(counts: np.ndarray, label: np.ndarray, dims: int = 48, nearest: int = 15, power: float = 4.0, seed: int = 5) -> Model:
    """Truncated SVD by randomised subspace iteration, on the bounded sample."""
    n = len(counts)
    if not n:
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5, nearest, power)
    idf = (np.log((1 + n) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = weigh(counts, idf)
    dims = min(dims, n, TERMS)
    q = np.random.default_rng(seed).standard_normal((TERMS, dims + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    model = Model(idf, (q @ v[:dims].T).astype(np.float32), np.zeros((0, 1), np.float32), label.astype(np.float64), float(label.mean()), nearest, power)
    model.known = model.latent(counts).astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """The fold that isn't learned from: crc32 of doc_id as text, modulo parts."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def _texts_to_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, label -> the numbers of the terms that occur, how often each does, label."""
    powers = _powers(PIECE)
    for b in batches:
        terms, counts = [], []
        for block in counted(b.column(0), powers):
            for row in block:
                at = np.flatnonzero(row)
                terms.append(at.astype("<u2").tobytes())
                counts.append(row[at].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(counts, pa.binary()), b.column(1)], names=["terms", "counts", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, sample: int = 4096) -> Model:
    usable = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if learn is None else learn))
    chosen = usable.groupBy("doc_id").agg(F.avg(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(sample).select("text", "label")
    bound_batches(docs.sparkSession)
    rows = texts.repartition(8).mapInArrow(_texts_to_counts, "terms binary, counts binary, label double").collect()  # at most `sample`
    rows.sort(key=lambda r: (bytes(r["terms"]), bytes(r["counts"]), r["label"]))
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["terms"], "<u2")] = np.frombuffer(r["counts"], "<f4")
    return fit(counts, np.array([r["label"] for r in rows], float))


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of a text. Texts alone go to Python, once, and come back as a number; Spark keeps the other columns."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        powers = _powers(PIECE)
        for texts in batches:
            found = [held.value.score(c) for c in counted(texts, powers)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return score(F.coalesce(text, F.lit("")))


def score_quality(spark: SparkSession, docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of every document, and score (0 to 1; higher: label 1 is likelier) under `name`."""
    bound_batches(spark)
    return docs.select(*[F.col(f"`{c}`") for c in keep], score_column(spark, model, F.col("text")).alias(name))
