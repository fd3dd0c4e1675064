"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from prismgraph.scratch import Scratch

__all__ = ["SPACE", "WORD", "Scratch", "bound_batches", "buckets", "free_name", "text_or_empty"]

#: ASCII white space, as one Java / RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch on its way to a Python worker; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes in this session, unless it says itself how large they are: batches of so many rows
    have any size where texts are long. Plans run later than they are made, so the setting stays."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(taken: list[str], name: str) -> str:
    """The name, after as many underscores as it takes to clash with none that is taken; case doesn't count."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def buckets(rows: int, each: int) -> int:
    """Number of buckets that hold about `each` of `rows` rows, at least one."""
    return max(1, -(-int(rows) // int(each)))
