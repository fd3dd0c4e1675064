"""Exact deduplication as a stateful stream, with DataFrame functions only.

The stream reads the documents in micro-batches. Its state, kept on disk by RocksDB without expiry, holds for each
SHA-256 of a normalised text the number of rows, the smallest identifier and that row's locator (file and row index).
Each batch writes the keys that it changed; the newest row of a key is its state. A key seen more than once is a hit:
the whole texts of its rows are then compared with the text at the keeper's locator, and rows that differ in spite of
equal digests are grouped by the text itself.

Defined results: null counts as the empty text; white space is [\\x20\\x09-\\x0D], each run read as one space (also at
the ends); rows that repeat a doc_id are rows of their own, and of equal texts the one row at the smallest (doc_id,
file, row) stays, null ids last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismgraph.llm.common import SPACE, Scratch, text_or_empty

#: Hit keys of at most this many rows (of some 100 bytes) are broadcast to the scan; beyond it Spark shuffles.
BROADCAST_HITS = 200_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stream. Without fallocate a store of few keys takes no more disk than it fills (else 4 MB each).
STORE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, digest, place (what orders rows of equal texts), norm."""
    norm = docs.select("doc_id", normalised().alias("norm"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.struct("file", "at").alias("locator"))
    return norm.select("doc_id", digest(F.col("norm")).alias("digest"), place.alias("place"), "norm")


def digest_state(
    spark: SparkSession, path: str, scratch: Scratch, digest: Callable[[Column], Column] = sha256, batch_bytes: int = 1 << 40, checkpoint: str | None = None, files: int | None = None
) -> DataFrame:
    """Runs the stream over all files at path and returns its state: digest, n, keep (the place of the row that stays).

    With a lasting `checkpoint` a later run reads only files that came since, on top of the same state.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger" if files else "maxBytesPerTrigger", files or batch_bytes)
    folder, _, name = path.rstrip("/").rpartition("/")
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(there).isFile():
        stream = reader.option("pathGlobFilter", name).parquet(folder)  # the file source wants a folder
    else:
        stream = reader.parquet(path)
    seen = _keyed(stream, digest).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("keep"))
    home = checkpoint or scratch.path

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/state/epoch={epoch}")

    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = seen.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{home}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    kept = spark.read.schema(T.StructType([*seen.schema.fields, T.StructField("epoch", T.LongType())])).option("basePath", f"{home}/state").parquet(f"{home}/state")
    if query.lastProgress is None or query.lastProgress["batchId"] == 0 and not checkpoint:
        return kept.drop("epoch")
    newest = kept.groupBy("digest").agg(F.max_by(F.struct("n", "keep"), "epoch").alias("s"))
    return newest.select("digest", "s.n", "s.keep")


def exact_dedup(
    spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = 1 << 40, checkpoint: str | None = None, files: int | None = None
) -> DataFrame:
    """One row per document at path: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(spark, "dedup")
    schema = spark.read.parquet(path).schema
    out = "doc_id {0}, keep_id {0}, group_size long, kept boolean, text_sha256 string".format(schema["doc_id"].dataType.simpleString())
    if spark.read.parquet(path).isEmpty():
        return spark.createDataFrame([], out)
    state = digest_state(spark, path, scratch, digest, batch_bytes, checkpoint, files)
    hits = state.filter("n > 1")
    few = hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    docs = _keyed(spark.read.parquet(path), digest)
    members = docs.join(F.broadcast(hits) if few else hits, "digest")
    keepers = members.filter(F.col("place") == F.col("keep")).select("digest", F.col("norm").alias("keep_norm"))
    checked = members.join(keepers, "digest").select(
        "doc_id", "place", "keep", "digest", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.when(F.col("norm") != F.col("keep_norm"), F.col("norm")).alias("other")
    )
    checked = scratch.write(checked, "checked")
    if checked.filter("other is not null").isEmpty():
        groups = checked.join(hits.select("digest", "n"), "digest")
    else:  # equal digests of different texts: the text itself is the key
        sizes = checked.groupBy("digest", "other").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
        groups = checked.join(sizes, checked["digest"].eqNullSafe(sizes["digest"]) & checked["other"].eqNullSafe(sizes["other"]))
        groups = groups.select("doc_id", "place", F.col("first").alias("keep"), "text_sha256", "n")
    many = groups.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == F.col("keep")).alias("kept"), "text_sha256")
    if digest is sha256:
        single = state.filter("n = 1").select(
            F.col("keep.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )
    else:
        alone = docs.join(state.filter("n = 1").select("digest"), "digest", "left_semi")
        single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    return many.unionByName(single)
