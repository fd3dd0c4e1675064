"""Forms of graphs: a graph as JSON in which positions stand for keys, so that graphs that differ in keys alone are one.

What free keys or keys left out can't tell apart is then worked out once for each form. A form holds the whole graph but
its keys: equal forms are isomorphic graphs. Graphs that are the same may have several forms, which costs time only.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nodes of a graph whose keys become positions, as each end is looked up among them. Larger graphs keep their keys, as
#: do those with a key twice or an end that is no node: they are seldom the same as another.
NODES_IN_FORM = 256
#: Bytes of forms that are read at once in a task, but for a single longer one.
FORM_BYTES = 2 << 20


def _facts(dimensions: Sequence[str] | None, values: bool):
    """The facts of a node that count: of some dimensions (None: all), with or without their values."""
    parts = [("d", "dimension"), ("n", "name"), ("k", "kind"), *([("t", "text"), ("v", "num"), ("b", "bytes")] if values else [])]
    short = lambda f: F.struct(*[f[c].alias(a) for a, c in parts])
    some = lambda fs: fs if dimensions is None else F.filter(fs, lambda f: f["dimension"].isin(*dimensions))
    return lambda fs: F.transform(some(fs), short)


def with_form(units: DataFrame, dimensions: Sequence[str] | None = None, values: bool = True, by_key: bool = False) -> DataFrame:
    """Replaces nodes, children and edges by `keys` and `form`: node i of the form has the i-th key, from 1 on. Nodes are in
    the order of their contents, or of their keys where that order counts."""
    facts = _facts(dimensions, values)
    order = lambda key, *own: (key, *own) if by_key else (*own, key)
    node = lambda n: F.struct(*order(n["key"].alias("i"), n["kind"].alias("k"), facts(n["fields"]).alias("f")))
    rest = [c for c in units.columns if c not in ("nodes", "children", "edges")]
    child = lambda c, at: F.struct(at(c["parent"]).alias("p"), c["label"].alias("l"), c["ordinal"].alias("o"), at(c["child"]).alias("c"))
    edge = lambda x, at: F.struct(at(x["source"]).alias("s"), x["label"].alias("l"), at(x["target"]).alias("t"), x["role"].alias("r"), F.size(x["fields"]).alias("n"))
    rows = units.select(*rest, F.sort_array(F.transform("nodes", node)).alias("_nodes"), "children", "edges")
    rows = rows.withColumn("keys", F.col("_nodes")["i"])
    small = (F.size("keys") <= NODES_IN_FORM) & (F.size(F.array_distinct("keys")) == F.size("keys"))
    place = lambda k: F.array_position("keys", k)
    placed = lambda c, made: F.when(F.col("_small"), F.sort_array(F.transform(c, lambda x: made(x, place))))
    rows = rows.withColumn("_small", small).withColumns({"_c": placed("children", child), "_e": placed("edges", edge)})
    off = F.exists("_c", lambda c: (c["p"] == 0) | (c["c"] == 0)) | F.exists("_e", lambda x: (x["s"] == 0) | (x["t"] == 0))
    free = F.to_json(F.struct("recipe", F.transform("_nodes", lambda n: F.struct(n["k"].alias("k"), n["f"].alias("f"))).alias("nodes"), F.col("_c").alias("children"), F.col("_e").alias("edges")))
    same = lambda k: k
    bound = F.to_json(F.struct("recipe", F.col("_nodes").alias("nodes"), F.transform("children", lambda x: child(x, same)).alias("children"), F.transform("edges", lambda x: edge(x, same)).alias("edges")))
    return rows.select(*rest, "keys", F.when(F.col("_small") & ~off, free).otherwise(bound).alias("form"))


def form_id() -> Column:
    return F.unhex(F.sha2("form", 256))


def read_form(form: str) -> tuple[str, list[tuple], list[tuple], list[tuple]]:
    """recipe, nodes (key, kind, facts), children (parent, label, ordinal, child) and edges (source, label, target, role, number
    of facts on it); keys are positions where the form has none. A fact is (dimension, name, kind, value or None)."""
    x = json.loads(form)
    fact = lambda f: (f.get("d"), f.get("n"), f.get("k"), f.get("t") if f.get("k") == "text" else base64.b64decode(f["b"]) if "b" in f else f.get("v"))
    nodes = [(n.get("i", i), n.get("k"), [fact(f) for f in n.get("f", ())]) for i, n in enumerate(x.get("nodes", ()), 1)]
    children = [(c.get("p"), c.get("l"), c.get("o"), c.get("c")) for c in x.get("children", ())]
    return x.get("recipe"), nodes, children, [(e.get("s"), e.get("l"), e.get("t"), e.get("r"), e.get("n")) for e in x.get("edges", ())]


def form_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    """Forms of batches of one column, FORM_BYTES together at most, or a single one."""
    for b in batches:
        some, held = [], 0
        for form in b.column(0).to_pylist():
            if some and held + len(form) > FORM_BYTES:
                yield some
                some, held = [], 0
            some.append(form)
            held += len(form)
        if some:
            yield some
