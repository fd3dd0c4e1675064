"""Line deduplication with a suffix array over the corpus' line sequences.

A line's id is its digest. Suffixes are the places (document, line); the suffix array is built by prefix doubling: the
rank of the first 2k lines of a suffix comes from the ranks of its first k lines and of the k lines after them, numbered
in order by a distributed sort. Suffixes whose first k lines occur once drop out for good, so the rounds soon hold the
repeated parts of the corpus only. All suffixes that share their first L lines are one interval of the array with a
longest common prefix of L or more; it is named by the ranks of the two overlapping blocks of 2**h lines that cover L.

A run of lines counts if it has `min_words` words. Every smallest run that begins or ends at some line is looked up in
its interval, and deleted unless it is the first there, by (document, line). Their union is the union of all maximal
repeated runs of that many words without their first copies: each part of such a run lies in a smallest run that begins
or ends inside it. The doubling ends when no smallest run is longer than what is ranked.

Defined results: lines end at \\n; words are runs of characters other than [\\x20\\x09-\\x0D]; the first copy is that of
the smallest (doc_id, hash of the text, line), null ids first; rows that repeat both id and text are treated alike, as
one document; a null text stays null; a text that loses all its lines becomes empty; an empty table gives an empty
result; other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from prismgraph.llm.common import Scratch, bound_batches, free_name

#: Lines per Arrow batch that a task sends back.
ROWS_OUT = 20_000


def smallest_runs(words: np.ndarray, least: int) -> np.ndarray:
    """Rows (first line, lines): for each line the smallest run from it, and to it, that has `least` words, once each."""
    n = len(words)
    total = np.concatenate([[0], np.cumsum(words)])
    line = np.arange(n)
    stop = np.searchsorted(total, total[:-1] + least, "left")  # one past the last line of the run from here
    onward = np.stack([line, stop - line], 1)[stop <= n]
    begin = np.searchsorted(total, total[1:] - least, "right") - 1  # first line of the run that ends here
    back = np.stack([begin, line + 1 - begin], 1)[begin >= 0]
    return np.unique(np.concatenate([onward, back]), axis=0)


def _lines(least: int, arrow_id: pa.DataType):
    """doc_id, h, text -> doc_id, h, line, digest, and the lengths of the smallest runs from this line."""
    names = ["doc_id", "h", "line", "digest", "runs"]
    kinds = [arrow_id, pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            for c in out:
                c.clear()
            return made

        for b in batches:
            for doc, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                lines = text.as_py().encode().split(b"\n")
                found = smallest_runs(np.array([len(x.split()) for x in lines]), least)
                runs: list[list[int]] = [[] for _ in lines]
                for first, count in found.tolist():
                    runs[first].append(count)
                out[0] += [doc] * len(lines)
                out[1] += [h] * len(lines)
                out[2] += range(len(lines))
                out[3] += [hashlib.md5(x, usedforsecurity=False).digest() for x in lines]
                out[4] += runs
                if len(out[0]) >= ROWS_OUT:
                    yield batch()
        if out[0]:
            yield batch()

    return run


def _rebuild(batches: Iterator[pa.RecordBatch], added: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Takes the runs in the last column out of column `text`; adds the numbers of lines and of removed ones."""
    for b in batches:
        names = b.schema.names[:-1]
        at, rows = names.index("text"), b.column(len(names)).to_pylist()
        texts, total, removed = b.column(at).to_pylist(), [], []
        for i, runs in enumerate(rows):
            n = 0 if texts[i] is None else texts[i].count("\n") + 1
            total.append(n)
            if not runs:
                removed.append(0)
                continue
            lines = texts[i].split("\n")
            gone = np.zeros(n + 1, np.int64)
            for run in runs:
                gone[run["line"]] += 1
                gone[run["line"] + run["run"]] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            texts[i] = "\n".join(x for x, k in zip(lines, keep) if k)
            removed.append(n - int(keep.sum()))
        columns = [pa.array(texts, b.column(at).type) if i == at else b.column(i) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int32()), pa.array(removed, pa.int32())], names=[*names, *added])


def _ranked(df: DataFrame, key: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Numbers the rows of df, which hold each key once, in the order of the keys."""
    ordered = df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("rank", F.monotonically_increasing_id())
    return scratch.write(ordered, name)


def repeated_runs(spark: SparkSession, docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """doc_id, h (hash of the text), line, run: the smallest runs that aren't the first of their interval."""
    kind = docs.schema["doc_id"].dataType
    texts = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    schema = f"doc_id {kind.simpleString()}, h long, line int, digest binary, runs array<int>"
    lines = texts.mapInArrow(_lines(min_words, to_arrow_type(kind)), schema)
    # a struct is never null itself, so joins match the documents without an id too
    lines = scratch.write(lines.select(F.struct("doc_id").alias("doc"), "h", "line", "digest", "runs"), "lines")
    place = F.struct("doc", "h", "line")

    # rows that repeat id and text are one document: count places, not rows
    ids = lines.groupBy("digest").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("digest")
    ids = _ranked(ids, ["digest"], scratch, "ids")
    suffixes = lines.join(ids, "digest").select("doc", "h", "line", "rank", "runs").distinct()
    suffixes = scratch.write(suffixes, "suffixes0")
    runs = suffixes.select("doc", "h", "line", F.explode("runs").alias("run"))
    ranks = suffixes.drop("runs")
    found: DataFrame | None = None
    level = 0
    while True:
        k = 1 << level
        # intervals of depth k to 2k - 1
        here = runs.filter(F.col("run") < 2 * k).join(ranks, ["doc", "h", "line"])
        if k > 1:
            tail = ranks.select("doc", "h", F.col("line").alias("_at"), F.col("rank").alias("rank2"))
            here = here.withColumn("_at", F.col("line") + F.col("run") - k).join(tail, ["doc", "h", "_at"]).drop("_at")
        else:
            here = here.withColumn("rank2", F.col("rank"))
        here = scratch.write(here.select("doc", "h", "line", "run", "rank", "rank2"), f"runs{level}")
        interval = ["run", "rank", "rank2"]
        first = here.groupBy(*interval).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last")
        first = scratch.write(first, f"first{level}")  # the join then shuffles both sides anew, and can split a hot interval
        later = here.join(first, interval).filter(place != F.col("first")).select("doc", "h", "line", "run")
        later = scratch.write(later, f"later{level}")
        found = later if found is None else found.unionByName(later)
        runs = scratch.write(runs.filter(F.col("run") >= 2 * k).join(ranks, ["doc", "h", "line"], "left_semi"), f"longer{level}")
        if runs.isEmpty():
            return found.select("doc.doc_id", "h", "line", "run")
        # ranks of twice the depth; what occurs once, or runs past its document, drops out
        ahead = Window.partitionBy("doc", "h").orderBy("line").rangeBetween(k, k)
        pairs = ranks.withColumn("then", F.first("rank").over(ahead)).filter("then is not null")
        pairs = scratch.write(pairs, f"pairs{level}")
        twice = pairs.groupBy("rank", "then").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("rank").alias("one"), F.col("then").alias("two"))
        twice = _ranked(twice, ["one", "two"], scratch, f"ids{level + 1}")
        ranks = pairs.withColumnsRenamed({"rank": "one", "then": "two"}).join(twice, ["one", "two"]).select("doc", "h", "line", "rank")
        ranks = scratch.write(ranks, f"suffixes{level + 1}")
        level += 1


def dedup_lines(spark: SparkSession, docs: DataFrame, min_words: int = 5, added: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """The columns of docs with text rid of later copies of repeated runs of lines, and n_lines, n_removed under the names `added`."""
    bound_batches(spark)
    scratch = Scratch(spark, "lines")
    runs = repeated_runs(spark, docs, min_words, scratch)
    gone = runs.groupBy("doc_id", "h").agg(F.collect_list(F.struct("line", "run")).alias("runs"))
    gone = scratch.write(gone, "gone").alias("g")
    scratch.keep("gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("h")).alias("d")
    joined = rows.join(gone, F.col("d.row.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.h") == F.col("g.h")), "left")
    joined = joined.select(*[F.col("d.row").getField(c).alias(c) for c in docs.columns], F.col("g.runs").alias(free_name(docs.columns, "_runs")))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.IntegerType()) for c in added)])
    return joined.mapInArrow(lambda batches: _rebuild(batches, added), schema)
