"""Stars hashed as columns: the same digests as by the kernel, which is not asked."""

import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prismgraph.functions.blake3 import blake3_grids, blake3_many
from prismgraph.operators import hashing
from prismgraph.operators.stars import _by_bytes, read_stars
from prismgraph.sources.producers import order_units
from prismgraph.sources.units import GRAPH


def fact(dimension, name, kind, text=None, num=None, raw=None):
    return {"dimension": dimension, "name": name, "kind": kind, "text": text, "num": None if num is None else Decimal(num), "bytes": raw}


def units(n, odd, seed=3):
    """Graphs of a parent and children; with `odd` some aren't stars: two ends, a chain, an edge beside."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        keys = [f"{i}-{j}" for j in range(r.choice([1, 2, 3, 3, 4, 5, 6, 10, 17, 41]))]
        nodes = [{"key": keys[0], "kind": "order", "fields": [fact("structure", "s", "text", r.choice("FOP")), fact("names", "p", "text", r.choice("12é"))]}]
        label, ordinal = r.choice([("line", 0), ("part", 3)])
        for k in keys[1:]:
            own = [fact("structure", "flag", "text", r.choice("AN")), fact("constants", "q", "i64", num=r.choice([-5, 7, 900])), fact("constants", "raw", "bytes", raw=b"xy"), fact("constants", "q", "u64", num=7)]
            own = own[: r.choice([1, 2, 2, 2, 3, 4])]
            r.shuffle(own)
            nodes.append({"key": k, "kind": "line", "fields": own})
        children = [{"parent": keys[0], "label": label, "ordinal": ordinal, "child": k} for k in keys[1:]]
        edges, what = [], r.random() if odd and len(keys) > 2 else 1
        if what < 0.1:
            children[1]["ordinal"] = 9
        elif what < 0.2:
            children[1]["parent"] = keys[1]
        elif what < 0.3:
            edges = [{"source": keys[1], "label": "x", "target": keys[2], "role": "control", "fields": []}]
        r.shuffle(nodes)
        r.shuffle(children)
        out.append({"recipe": r.choice(["r/1", "r/2"]), "name": str(i), "graph_key": str(i), "nodes": nodes, "children": children, "edges": edges})
    return pa.Table.from_pylist(out, to_arrow_schema(StructType.fromDDL(f"recipe string, name string, {GRAPH}"))).combine_chunks().to_batches()[0]


def told(run, rows):
    return sorted(str([x if not isinstance(x, list) else sorted(x) for x in r.values()]) for b in run(iter([rows])) for r in b.to_pylist())


@pytest.mark.parametrize("facets", [None, [], [("structure", "constants")]])
@pytest.mark.parametrize("modes", [["shape"], ["identity", "shape"]])
def test_digests_of_the_kernel(spark, monkeypatch, modes, facets):
    rows = units(400, odd=True).slice(3)
    assert 64 < read_stars(rows)[0].sum() < rows.num_rows
    run = hashing._hash(["name"], {"r/1": ("structure", "names", "constants"), "*": ("constants", "structure")}, modes, facets)
    found = told(run, rows)
    monkeypatch.setattr(hashing, "FEWEST", 1 << 30)
    assert found == told(run, rows)


def test_the_kernel_is_not_asked_for_stars(spark, monkeypatch):
    monkeypatch.setattr(hashing, "hash_graphs", lambda *a, **k: pytest.fail("a star went through the kernel"))
    assert len(told(hashing._hash(["name"], {"*": ("structure", "constants")}, ["shape"], None), units(200, odd=False))) == 200


def test_a_key_twice_is_told(spark):
    rows = units(100, odd=False).to_pylist()
    twice = next(r for r in rows if len(r["nodes"]) > 2)
    twice["nodes"][1]["key"] = twice["nodes"][2]["key"]
    rows = pa.RecordBatch.from_pylist(rows, units(1, False).schema)
    with pytest.raises(hashing.DuplicateNode):
        told(hashing._hash(["name"], {"*": ("structure",)}, ["shape"], None), rows)


def test_grids():
    r = np.random.default_rng(1)
    grids = [r.integers(0, 256, shape).astype(np.uint8) for shape in ((3, 0), (5, 1), (7, 64), (2, 65), (4, 1024), (3, 1025), (2, 3000), (1, 5000), (5000, 130), (0, 70))]
    for grid, found in zip(grids, blake3_grids(grids), strict=True):
        assert [x.tobytes() for x in found] == blake3_many([x.tobytes() for x in grid])


def test_digests_that_begin_alike_are_put_in_order():
    some = np.zeros((1, 3, 32), np.uint8)
    some[0, :, 31] = 2, 0, 1
    assert _by_bytes(some)[0, :, 31].tolist() == [0, 1, 2]


def test_orders_whose_lines_are_not_numbered_have_the_same_digests(spark):
    tops = spark.createDataFrame([(i, "FO"[i % 2], "1-URGENT") for i in range(5)], "o_orderkey long, o_orderstatus string, o_orderpriority string")
    lines = spark.createDataFrame(
        [(i, n, 1, 1, float(n % 3), "AN"[n % 2], "O", 1.0, "1990-01-01") for i in range(1, 5) for n in range(i)],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string, l_extendedprice double, l_shipdate string",
    )
    for dims in (("structure",), ("names",), ("structure", "constants")):
        made = order_units(tops, lines, dimensions=dims, numbered=False)
        assert "l_partkey" not in made._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1].splitlines()[0]
        found = [sorted(map(str, hashing.hash_units(u, {"*": dims}, ("shape",)).select("name", "digests", "mixed_pairs", "joint").collect())) for u in (made, order_units(tops, lines))]
        assert found[0] == found[1]
