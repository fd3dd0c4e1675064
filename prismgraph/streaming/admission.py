"""Incremental admission: JSON-lines files that arrive in a folder, each batch of files admitted as it comes.

Every file is a scope of its own, so a batch that runs again after a failure replaces what it admitted before. A file
that can't be read or breaks its declaration is listed in the table `rejected` and doesn't stop the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prismgraph.errors import CatalogError
from prismgraph.sources.corpus import Corpus
from prismgraph.sources.units import read_units


def admit_stream(corpus: Corpus, world: str, folder: str, checkpoint: str, files_each: int = 100) -> StreamingQuery:
    """Starts a stream that admits all files present in folder and those since its last run, then ends."""
    spark = corpus.spark
    lines = spark.readStream.option("maxFilesPerTrigger", files_each).text(folder)
    files = lines.select(F.col("_metadata.file_path").alias("file"))

    def admit(batch: DataFrame, epoch: int) -> None:
        rejected = []
        for row in sorted(batch.select("file").distinct().collect()):  # files_each at most
            try:
                corpus.admit(world, row["file"], read_units(spark, row["file"]).drop("file"))
            except CatalogError as error:
                rejected.append((row["file"], str(error), epoch))
        if rejected:
            spark.createDataFrame(rejected, "file string, problem string, epoch long").write.mode("append").parquet(f"{corpus.path}/rejected")

    return files.writeStream.foreachBatch(admit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
