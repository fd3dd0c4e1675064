"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from prismgraph.errors import CatalogError


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this machine for a session that has no other
    machine, as in tests; on a cluster its lack is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise CatalogError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/prismgraph-checkpoints"
    return folder.rstrip("/")


class Scratch:
    """Tables of one run, under one folder of the shared directory. Results are lazy and may still read them when the
    run is over, so what nothing dropped before goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        fs, there = self._fs()
        fs.mkdirs(there)
        fs.deleteOnExit(there)

    def _fs(self, name: str = "") -> tuple:
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back: the lineage ends there, and a lost executor costs no recomputation."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.tables.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes one table, or the whole folder."""
        fs, there = self._fs(name)
        fs.delete(there, True)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, which what is still to run reads."""
        for name in set(self.tables) - set(names):
            self.drop(name)
        self.tables = [n for n in self.tables if n in names]
