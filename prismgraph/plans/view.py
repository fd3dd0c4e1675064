"""Views: saved graph transforms. Roots are selected, what they reach is kept, facts outside it are projected away."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from prismgraph import wire
from prismgraph.errors import ViewError
from prismgraph.functions import encode as e
from prismgraph.functions.blake3 import blake3
from prismgraph.operators.sizes import large_graphs
from prismgraph.scratch import Scratch

# Root selectors in their order.
SELECTORS = ("child-parent", "child-target", "node-kind")


@dataclass(frozen=True)
class View:
    name: str
    input: str
    roots: tuple[tuple[str, str], ...]
    children: tuple[str, ...] | None  # None: all; empty: none
    roles: tuple[str, ...]
    dimensions: tuple[str, ...]
    erased: tuple[tuple[str, str], ...]

    def plan_id(self) -> bytes:
        """Depends on what the view means, not on how or in which order it is written."""
        out = [e.text(wire.VIEW_PLAN), e.u32(wire.VIEW_SCHEMA), e.text(self.name), e.text(self.input), e.u32(len(self.roots))]
        out += [e.text(kind) + e.text(label) for kind, label in self.roots]
        if self.children is None:
            out.append(e.text("children-all"))
        elif not self.children:
            out.append(e.text("children-none"))
        else:
            out += [e.text("children-labels"), e.u32(len(self.children)), *map(e.text, self.children)]
        out += [e.u32(len(self.roles)), *map(e.text, self.roles), e.u32(len(self.dimensions)), *map(e.text, self.dimensions)]
        if self.erased:
            out += [e.text("erase"), e.u32(len(self.erased)), *(e.text(d) + e.text(n) for d, n in self.erased)]
        return blake3(b"".join(out))

    def output_recipe(self) -> str:
        return f"view:{self.name}@{self.plan_id().hex()}"

    def follows(self, label: str) -> bool:
        return self.children is None or label in self.children

    def keeps(self, fact: dict) -> bool:
        return fact["dimension"] in self.dimensions and (fact["dimension"], fact["name"]) not in self.erased


def parse_view(source: str) -> View:
    once: dict[str, str] = {}
    roots, labels, roles, dims, erased = set(), set(), set(), set(), set()
    every = False

    def fail(at: int, why: str):
        raise ViewError(f"line {at}: {why}")

    def quoted(at: int, text: str, what: str) -> str:
        if len(text) < 2 or text[0] != '"' or text[-1] != '"':
            fail(at, f"{what} must be quoted")
        if not text[1:-1] or '"' in text[1:-1]:
            fail(at, f"invalid {what}")
        return text[1:-1]

    def listed(at: int, text: str, what: str) -> list[str]:
        found = [x.strip() for x in text.split(",") if x.strip()]
        return found or fail(at, f"expected at least one {what}")

    def dimension(at: int, text: str) -> str:
        return text if text in wire.DIMENSIONS else fail(at, f"unknown dimension `{text}`")

    for at, raw in enumerate(source.split("\n"), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        word, rest = (line.split(None, 1) + [""])[:2]
        if word in ("language", "view", "input"):
            if word in once:
                fail(at, f"duplicate `{word}` directive")
            once[word] = quoted(at, rest, word)
        elif word == "root":
            kind, argument = (rest.split(None, 1) + ["", ""])[:2]
            argument = quoted(at, argument, "root selector")
            roots.add((kind, argument) if kind in SELECTORS else fail(at, f"unknown root selector `{kind}`"))
        elif word == "traverse":
            kind, argument = (rest.split(None, 1) + ["", ""])[:2]
            if kind == "children" and not argument:
                every = True
            elif kind == "children":
                labels.update(listed(at, argument, "child label"))
            elif kind == "edges":
                roles.update(r if r in wire.ROLES else fail(at, f"unknown edge role `{r}`") for r in listed(at, argument, "edge role"))
            else:
                fail(at, f"unknown traversal `{kind}`")
        elif word == "retain":
            dims.update(dimension(at, d) for d in listed(at, rest, "dimension"))
        elif word == "erase":
            for item in listed(at, rest, "field class"):
                d, dot, field = item.partition(".")
                if not dot:
                    fail(at, f"field class `{item}` must be `dimension.field`")
                erased.add((dimension(at, d), field or fail(at, "empty field name")))
        else:
            fail(at, f"unknown directive `{word}`")
    for word in ("language", "view", "input"):
        if word not in once:
            fail(1, f"missing `{word}` directive")
    if once["language"] != wire.VIEW_LANGUAGE:
        fail(1, f"unsupported language `{once['language']}`; expected `{wire.VIEW_LANGUAGE}`")
    if not roots:
        fail(1, "view must define at least one root")
    if not dims:
        fail(1, "view must retain at least one dimension")
    for d, field in sorted(erased):
        if d not in dims:
            fail(1, f"erase {d}.{field}: dimension `{d}` is not retained, so there is nothing to erase")
    return View(
        once["view"], once["input"], tuple(sorted(roots, key=lambda r: (SELECTORS.index(r[0]), r[1]))), None if every else tuple(sorted(labels)), tuple(r for r in wire.ROLES if r in roles),
        tuple(d for d in wire.DIMENSIONS if d in dims), tuple(sorted(erased, key=lambda x: (wire.DIMENSIONS.index(x[0]), x[1]))),
    )


def _fact_order(f: dict) -> tuple:
    payload = f["text"] if f["kind"] == "text" else f["bytes"] if f["kind"] == "bytes" else int(f["num"])
    return wire.DIMENSIONS.index(f["dimension"]), f["name"], wire.VALUE_KINDS.index(f["kind"]), payload


def transform(view: View, row: dict) -> dict:
    """The graph columns of a unit after the view. Between nodes that are reached every child and edge stays."""
    live: set[str] = set()
    for kind, label in view.roots:
        if kind == "node-kind":
            live.update(n["key"] for n in row["nodes"] if n["kind"] == label)
        else:
            live.update(c["parent" if kind == "child-parent" else "child"] for c in row["children"] if c["label"] == label)
    if not live:
        raise ViewError("no roots selected")
    onward: dict[str, list[str]] = {}
    for c in row["children"]:
        if view.follows(c["label"]):
            onward.setdefault(c["parent"], []).append(c["child"])
    for x in row["edges"]:
        if x["role"] in view.roles:
            onward.setdefault(x["source"], []).append(x["target"])
    queue = deque(live)
    while queue:
        for target in onward.get(queue.popleft(), ()):
            if target not in live:
                live.add(target)
                queue.append(target)
    facts = lambda fs: sorted((f for f in fs if view.keeps(f)), key=_fact_order)
    nodes = [n | {"fields": facts(n["fields"])} for n in sorted(row["nodes"], key=lambda n: n["key"]) if n["key"] in live]
    children = sorted((c for c in row["children"] if c["parent"] in live and c["child"] in live), key=lambda c: (c["parent"], c["label"], c["ordinal"], c["child"]))
    edges = [x | {"fields": facts(x["fields"])} for x in row["edges"] if x["source"] in live and x["target"] in live]
    edges.sort(key=lambda x: (x["source"], wire.ROLES.index(x["role"]), x["label"], x["target"], [_fact_order(f) for f in x["fields"]]))
    return {"nodes": nodes, "children": children, "edges": edges}


def _apply(view: View, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recipe = view.output_recipe()
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    out.append(row | transform(view, row) | {"recipe": recipe, "problem": None})
                except ViewError as error:
                    out.append(row | {"recipe": recipe, "problem": str(error), "nodes": [], "children": [], "edges": []})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    return run


def apply_view(view: View, units: DataFrame, check: bool = True) -> DataFrame:
    """Units of the view's input recipe as units of its output recipe. A graph without roots is an error, or a row with a
    problem if `check` is off."""
    schema = StructType([*units.schema.fields, StructField("problem", StringType())])
    out = units.filter(F.col("recipe") == view.input).mapInArrow(_apply(view, to_arrow_schema(schema)), schema)
    if not check:
        return out
    bad = out.filter("problem is not null").select("name", "problem").first()
    if bad:
        raise ViewError(f"{bad['name']}: {bad['problem']}")
    return out.drop("problem")


def _reached(key: tuple, edges: pa.Table, roots: pa.Table) -> pa.Table:
    """The keys of one graph that its roots reach."""
    follow: dict = {}
    for s, t in zip(edges["s"].to_pylist(), edges["t"].to_pylist()):
        follow.setdefault(s, []).append(t)
    todo = roots["key"].to_pylist()
    seen = set(todo)
    while todo:
        fresh = [t for t in follow.pop(todo.pop(), ()) if t not in seen]
        seen.update(fresh)
        todo += fresh
    kinds = roots.schema
    return pa.table({"gid": pa.array([key[0].as_py()] * len(seen), kinds.field("gid").type), "key": pa.array(list(seen), kinds.field("key").type)})


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """gid, key reached from roots (gid, key) over edges (gid, s, t), the roots included. Edges and roots that lack a graph
    or a key don't count.

    A graph of up to EDGES_IN_TASK edges and roots is searched in one task; larger ones take a join per step of
    the frontier, which an anti-join keeps free of nodes already seen."""
    scratch = Scratch(edges.sparkSession, "reach")
    edges = scratch.write(edges.select("gid", "s", "t").dropna().distinct(), "edges")
    roots = scratch.write(roots.select("gid", "key").dropna().distinct(), "roots")
    large = large_graphs(edges.select("gid").unionByName(roots.select("gid")), scratch)
    if large is None:
        return _searched(edges, roots)
    near = _searched(edges.join(large, "gid", "left_anti"), roots.join(large, "gid", "left_anti"))
    return near.unionByName(_stepped(edges.join(large, "gid", "left_semi"), roots.join(large, "gid", "left_semi"), scratch))


def _searched(edges: DataFrame, roots: DataFrame) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in roots.schema)
    return edges.groupBy("gid").cogroup(roots.groupBy("gid")).applyInArrow(_reached, schema)


def _stepped(edges: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    edges = scratch.write(edges, "far")
    seen = new = scratch.write(roots, "0")
    at = 0
    while not new.isEmpty():
        ahead = new.withColumnRenamed("key", "s").join(edges, ["gid", "s"]).select("gid", F.col("t").alias("key")).distinct()
        at += 1
        new = scratch.write(ahead.join(seen, ["gid", "key"], "left_anti"), str(at))
        seen = seen.unionByName(new)
        if at % 8 == 0:  # else the plan grows with the depth
            seen = scratch.write(seen, f"seen{at}")
    return seen
