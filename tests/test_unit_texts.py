"""Units to and from text, from flat columns and a few at once."""

import json

import pyarrow as pa
from graphs import SEP, document, line
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prismgraph.sources import units as u
from prismgraph.sources.builder import json_units


def test_texts_are_those_of_unit_json_and_slices_are_small(spark, monkeypatch):
    odd = json.loads(line("a/1", {"x": ("k", []), "y": ("k", [])}, [("x", "c", 0, "y")], [("x", 'l"\\\n', "y", "origin")]))
    values = [{"kind": "text", "value": 'é"\\ \x01'}, {"kind": "bool", "value": True}, {"kind": "u64", "value": 2**64 - 1}, {"kind": "i64", "value": -5}, {"kind": "bytes", "value": [0, 255]}]
    fields = [{"dimension": "names", "name": f"f{i}", "value": v} for i, v in enumerate(values)]
    odd["graph"]["nodes"][0][1]["fields"] = odd["graph"]["edges"][0]["fields"] = fields
    rows = [u.parse_unit(json.dumps(odd)), u.parse_unit(json.dumps(odd)), u.parse_unit(document("doc", {"a": [1, None, "x"], "b": {}}, "w"))]
    rows[1]["nodes"][0]["key"] = SEP.join(["derived:part", "o", "p", "x"])
    batch = pa.Table.from_pylist(rows, to_arrow_schema(StructType.fromDDL(u.UNIT))).to_batches()[0]
    assert u.unit_texts(batch) == [u.unit_json(r) for r in batch.to_pylist()] and u.unit_texts(batch.slice(1, 1)) == [u.unit_json(batch.to_pylist()[1])]
    monkeypatch.setattr(u, "UNITS_AT_ONCE", 2)
    assert [b.num_rows for b in u._render(iter([batch]))] == [2, 1]


def test_documents_of_one_file_are_dealt_to_every_core(spark):
    units = json_units(spark.range(100).coalesce(1), F.lit("[1]"), F.col("id"), "w")
    assert units.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
