"""Forms: what differs in keys alone is worked out once, with the same results as graph by graph."""

import pyarrow as pa
from pyspark.sql import functions as F

from prismgraph.catalog import STRICT, _hashed
from prismgraph.operators import check
from prismgraph.operators.forms import read_form, with_form
from prismgraph.operators.hashing import hash_units
from prismgraph.sources.producers import order_units
from prismgraph.wire import SEPARATOR

DIMS = ("structure", "names", "constants")


def orders(spark, copies):
    """Three orders, each with as many copies under other keys; the lines of a copy come in another order."""
    tops = [(100 * i + k, s, "1-URGENT") for i in range(copies) for k, s in ((1, "F"), (2, "O"), (3, "F"))]
    lines = {1: [("N", "O", 5.0), ("A", "F", 7.0)], 2: [("N", "O", 5.0), ("N", "O", 5.0)], 3: []}
    rows = [(100 * i + k, n, 1, 1, q, a, b, 1.0, "1990-01-01") for i in range(copies) for k, of in lines.items() for n, (a, b, q) in enumerate(of if i % 2 else of[::-1])]
    return order_units(
        spark.createDataFrame(tops, "o_orderkey long, o_orderstatus string, o_orderpriority string"),
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_extendedprice double, l_shipdate string"),
    )


def test_copies_have_one_form_and_the_digests_of_each_graph_alone(spark):
    units = orders(spark, 6)
    assert with_form(units).select("form").distinct().count() == 3
    columns = ("name", "digests", "shape", "mixed_pairs", "joint", "node_count", "policy_id")
    told = lambda rows: sorted(map(str, rows.select(*columns[:1], F.array_sort(F.map_entries("digests")), "shape", "mixed_pairs", F.array_sort(F.map_entries("joint")), "node_count", "policy_id").collect()))
    assert told(_hashed(units, {"*": DIMS})) == told(hash_units(units, {"*": DIMS}, ("shape",)))


def test_joint_digests_of_the_wanted_facets_alone(spark):
    some = _hashed(orders(spark, 1), {"*": DIMS}, [DIMS]).filter("mixed_pairs <> 0").select(F.map_keys("joint")).collect()
    assert [r[0] for r in some] == [["structure+names+constants"]]


def test_graphs_whose_keys_count_keep_them(spark):
    units = orders(spark, 1).filter("name = '1'")
    twice = units.withColumn("nodes", F.concat("nodes", "nodes"))
    assert "trade.line" in with_form(twice).first()["form"] and "trade.line" not in with_form(units).first()["form"]


def test_units_that_differ_in_keys_and_values_are_checked_and_read_once(spark, monkeypatch):
    units = orders(spark, 6).withColumn("gid", F.col("name"))
    assert check._skeletons(units).select("form").distinct().count() == 2  # two lines, or none
    forms, read = [r["form"] for r in check._skeletons(units).collect()], []
    monkeypatch.setattr(check, "read_form", lambda form: read.append(form) or read_form(form))
    batch = pa.RecordBatch.from_pydict({"gid": [str(i) for i in range(18)], "keys": [["a", "b", "c"]] * 18, "form": forms})
    assert sum(b.num_rows for b in check._check({"trade.order/1": STRICT})(iter([batch]))) == 18 and len(read) == 2
    declared = check.infer_declaration(units, "trade.order/1")
    assert declared == check.infer_declaration(units.filter("o_orderkey < 4"), "trade.order/1") and declared.children[0].shape == "set"
    assert check.check_units(units, {"trade.order/1": STRICT}).count() == 18
    found = check.check_units(units.filter("o_orderkey in (1, 303)"), {"trade.order/1": STRICT}).collect()
    assert sorted((r["gid"], r["at"].split(SEPARATOR)[-1]) for r in found) == [("1", "1"), ("303", "303")]
