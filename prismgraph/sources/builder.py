"""Graphs made in Python, each step checked as it is taken, and a producer that makes units of JSON documents."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prismgraph import wire
from prismgraph.errors import CatalogError, DuplicateNode, EdgeFields, MissingNode
from prismgraph.plans.declaration import ChildDecl, Declaration, FieldDecl
from prismgraph.sources.units import LIMITS, UNITS_AT_ONCE, UNIT, name


def fact(dimension: str, field: str, kind: str, value) -> dict:
    if dimension not in wire.DIMENSIONS:
        raise CatalogError(f"unknown dimension `{dimension}`")
    if kind not in wire.VALUE_KINDS:
        raise CatalogError(f"unknown value kind `{kind}`")
    if kind in LIMITS and not LIMITS[kind][0] <= value <= LIMITS[kind][1]:
        raise CatalogError(f"{value} is no {kind}")
    out = {"dimension": dimension, "name": name(field, "field name"), "kind": kind, "text": None, "num": None, "bytes": None}
    slot = kind if kind in ("text", "bytes") else "num"
    return out | {slot: Decimal(int(value)) if slot == "num" else value}


class GraphBuilder:
    """Nodes first, then what refers to them. Keys are canonical strings."""

    def __init__(self, graph_key: str):
        self.graph_key = graph_key
        self.nodes: dict[str, dict] = {}
        self.children: list[dict] = []
        self.edges: list[dict] = []

    def _known(self, key: str) -> str:
        if key not in self.nodes:
            raise MissingNode(f"no node has the key `{key}`")
        return key

    def node(self, key: str, kind: str) -> str:
        if key in self.nodes:
            raise DuplicateNode(f"node `{key}` occurs twice")
        self.nodes[key] = {"key": key, "kind": name(kind, "node kind"), "fields": []}
        return key

    def field(self, key: str, dimension: str, field: str, kind: str, value) -> None:
        self.nodes[self._known(key)]["fields"].append(fact(dimension, field, kind, value))

    def child(self, parent: str, label: str, ordinal: int, child: str) -> None:
        if not 0 <= ordinal < 2**32:
            raise CatalogError("an ordinal must fit 32 bits")
        self.children.append({"parent": self._known(parent), "label": name(label, "child label"), "ordinal": ordinal, "child": self._known(child)})

    def edge(self, source: str, label: str, target: str, role: str, fields: tuple = ()) -> None:
        if role not in wire.ROLES:
            raise CatalogError(f"unknown edge role `{role}`")
        if fields and role != "origin":
            raise EdgeFields("only origin edges may hold fields")
        self.edges.append({"source": self._known(source), "label": name(label, "edge label"), "target": self._known(target), "role": role, "fields": list(fields)})

    def unit(self, recipe: str, population: str, shown: str, status: str = "final") -> dict:
        return {"recipe": recipe, "population": population, "name": shown, "status": status, "graph_key": self.graph_key, "nodes": list(self.nodes.values()), "children": self.children, "edges": self.edges}


# --- JSON documents --------------------------------------------------------------------------------------------------

KINDS = ("flag", "list", "none", "number", "object", "text")
_KEY = FieldDecl("key", ("names",), "text", "optional")
#: Members of an object are a set, items of a list a sequence; keys are names, values are constants.
JSON = Declaration(
    "json/1",
    KINDS,
    True,
    (
        ("flag", (_KEY, FieldDecl("flag", ("constants",), "bool", "one"))),
        ("list", (_KEY,)),
        ("none", (_KEY,)),
        ("number", (_KEY, FieldDecl("whole", ("constants",), "i64", "optional"), FieldDecl("decimal", ("constants",), "text", "optional"))),
        ("object", (_KEY,)),
        ("text", (_KEY, FieldDecl("text", ("constants",), "text", "one"))),
    ),
    (ChildDecl(("list",), "item", KINDS, "seq"), ChildDecl(("object",), "member", KINDS, "set")),
    acyclic="children_and_dependency",
    keys="by path",
)


def json_unit(text: str, shown: str, owner: str, population: str = "document") -> dict:
    """A JSON document as a unit of recipe json/1. Numbers that are no 64-bit integers count by how they are written."""
    sep = wire.SEPARATOR
    g = GraphBuilder(sep.join(["json", name(population, "population"), name(shown, "name"), "tree"]))
    todo = [(json.loads(text, parse_float=Decimal), "$", None, None)]
    while todo:
        value, path, parent, place = todo.pop()
        kind = "object" if isinstance(value, dict) else "list" if isinstance(value, list) else "text" if isinstance(value, str) else "none" if value is None else "flag" if isinstance(value, bool) else "number"
        key = g.node(f"entity:json{sep}{owner}:{shown}{sep}{path}", kind)
        if parent is not None:
            if isinstance(place, str):
                g.field(key, "names", "key", "text", place)
                g.child(parent, "member", 0, key)
            else:
                g.child(parent, "item", place, key)
        if kind in ("text", "flag"):
            g.field(key, "constants", kind, "text" if kind == "text" else "bool", value)
        elif kind == "number":
            whole = isinstance(value, int) and LIMITS["i64"][0] <= value <= LIMITS["i64"][1]
            g.field(key, "constants", "whole" if whole else "decimal", "i64" if whole else "text", value if whole else str(value))
        steps = value.items() if kind == "object" else enumerate(value) if kind == "list" else ()
        todo += [(v, f"{path}/{k}".replace(sep, " "), key, k) for k, v in steps]
    return g.unit(JSON.recipe, population, shown)


def _documents(schema: pa.Schema, population: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, UNITS_AT_ONCE):
                b = whole.slice(lo, UNITS_AT_ONCE)
                rows = [json_unit(text, shown, owner, population) for text, shown, owner in zip(*(b.column(i).to_pylist() for i in range(3)))]
                yield from pa.Table.from_pylist(rows, schema).to_batches()

    return run


def json_units(rows: DataFrame, text: Column, shown: Column, owner: str, population: str = "document") -> DataFrame:
    """A unit for each row whose text is a JSON document; rows without a text have none. A small file of many documents would
    be one task, so they are dealt to every core."""
    schema = StructType.fromDDL(UNIT)
    sent = rows.filter(text.isNotNull()).select(text.cast("string").alias("text"), shown.cast("string").alias("shown"), F.lit(owner).alias("owner"))
    return sent.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(_documents(to_arrow_schema(schema), population), schema)
