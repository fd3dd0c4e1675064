"""Results as text: an aligned table, or a JSON array of objects whose values are strings."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgraph.scratch import Scratch


def as_text(rows: DataFrame) -> DataFrame:
    """All columns as strings: binary as lowercase hexadecimal digits, null as nothing."""
    shown = [F.lower(F.hex(F.col(f"`{c}`"))) if t == "binary" else F.col(f"`{c}`").cast("string") for c, t in rows.dtypes]
    return rows.select(*[F.coalesce(x, F.lit("")).alias(c) for x, c in zip(shown, rows.columns)])


def json_lines(rows: DataFrame) -> Iterator[str]:
    """The lines of a JSON array, a row each. A partition at a time is held."""
    before = "["
    for r in as_text(rows).toLocalIterator():
        yield before + json.dumps(r.asDict(), ensure_ascii=False)
        before = ","
    yield "[]" if before == "[" else "]"


def table_lines(rows: DataFrame) -> Iterator[str]:
    """A heading and the rows, columns as wide as their longest value, two spaces apart. Rows are stored once, so nothing
    runs twice, and a partition at a time is held."""
    text = Scratch(rows.sparkSession, "shown").write(as_text(rows).withColumn("_n", F.monotonically_increasing_id()), "rows").orderBy("_n").drop("_n")
    widths = text.agg(*[F.coalesce(F.max(F.length(f"`{c}`")), F.lit(0)) for c in text.columns]).first()
    widths = [max(len(c), w) for c, w in zip(text.columns, widths)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
    yield line(text.columns)
    for r in text.toLocalIterator():
        yield line(r)
