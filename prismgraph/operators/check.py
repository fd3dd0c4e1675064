"""Checking graphs against declarations, and inferring a declaration.

Every rule is local to a graph and none reads a value, so a check is a single pass without a shuffle, in which a task
checks each form without values once; violations (gid, at, problem) come back. Inferring is a few aggregations over the forms, whose results are as
small as a declaration.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgraph import wire
from prismgraph.errors import CatalogError, CycleDetected
from prismgraph.operators.forms import read_form, with_form
from prismgraph.operators.kernel import closing_node, components
from prismgraph.operators.sizes import large_graphs
from prismgraph.plans.declaration import ChildDecl, Declaration, EdgeDecl, FieldDecl
from prismgraph.scratch import Scratch

VALUE_NAMES = {"text": "Text", "bool": "Bool", "u64": "U64", "i64": "I64", "bytes": "Bytes"}
OCCURS_NAMES = {"one": "One", "optional": "Optional", "many": "Many"}
SHAPE_NAMES = {"seq": "Seq", "set": "Set", "one": "One"}
VIOLATION = "gid string, at string, problem string"

Found = Iterator[tuple[str | None, str]]


class Relations:
    """The exploded tables of units that carry a gid."""

    def __init__(self, units: DataFrame):
        self.units = units
        self.nodes = units.select("gid", F.explode("nodes").alias("n")).select("gid", "n.key", "n.kind", "n.fields")
        fields = self.nodes.select("gid", "key", F.col("kind").alias("node_kind"), F.explode("fields").alias("f"))
        self.fields = fields.select("gid", "key", "node_kind", "f.dimension", "f.name", F.col("f.kind").alias("value_kind"), "f.text", "f.num", "f.bytes")
        self.children = units.select("gid", F.explode("children").alias("c")).select("gid", "c.*")
        self.edges = units.select("gid", F.explode("edges").alias("e")).select("gid", "e.source", "e.label", "e.target", "e.role", "e.fields")

    def kinds(self, of: str, name: str) -> DataFrame:
        return self.nodes.select("gid", F.col("key").alias(of), F.col("kind").alias(name))

    def typed_children(self) -> DataFrame:
        return self.children.join(self.kinds("parent", "parent_kind"), ["gid", "parent"]).join(self.kinds("child", "child_kind"), ["gid", "child"])

    def typed_edges(self) -> DataFrame:
        return self.edges.join(self.kinds("source", "source_kind"), ["gid", "source"]).join(self.kinds("target", "target_kind"), ["gid", "target"])

    def roots(self) -> DataFrame:
        return self.nodes.select("gid", "key", "kind").join(self.children.select("gid", F.col("child").alias("key")).distinct(), ["gid", "key"], "left_anti")


class Graph:
    """What the rules read of a graph: nodes (key, kind, facts), children (parent, label, ordinal, child), edges (source,
    label, target, role, facts on it)."""

    def __init__(self, nodes: list[tuple], children: list[tuple], edges: list[tuple]):
        self.nodes, self.children, self.edges = nodes, children, edges
        self.kind = {key: kind for key, kind, _ in nodes}


def broken(g: Graph) -> Found:
    """A key twice, an edge or child without its nodes, facts on an edge that isn't an origin."""
    if len(g.kind) < len(g.nodes):
        for key, n in Counter(key for key, _, _ in g.nodes).items():
            if n > 1:
                yield key, f"node key occurs {n} times"
    for parent, _, _, child in g.children:
        for end, key in (("parent", parent), ("child", child)):
            if key not in g.kind:
                yield key, f"{end} is not a node of the graph"
    for source, _, target, role, facts in g.edges:
        for end, key in (("source", source), ("target", target)):
            if key not in g.kind:
                yield key, f"{end} is not a node of the graph"
        if role != "origin" and facts:
            yield source, "only origin edges may hold fields"


def fits(shape: str, ordinals: list[int]) -> bool:
    """Whether sorted ordinals are 0, 1, .. (seq), all 0 (set), or one 0 (one)."""
    if shape == "seq":
        return ordinals == list(range(len(ordinals)))
    return not any(ordinals) and (shape == "set" or len(ordinals) == 1)


class Rules:
    """A declaration, laid out for look-ups."""

    def __init__(self, d: Declaration):
        self.roots, self.single_root, self.acyclic = set(d.roots), d.single_root, d.acyclic
        self.fields = {kind: {f.name: f for f in fields} for kind, fields in d.kinds}
        self.counted = {kind: [f for f in fields if f.occurs != "many"] for kind, fields in d.kinds}
        self.groups = {(p, c.label): c for c in d.children for p in c.parents}
        self.required: dict[str, list[str]] = defaultdict(list)
        for c in d.children:
            for p in set(c.parents):
                if c.shape == "one" and not c.optional:
                    self.required[p].append(c.label)
        self.patterns: dict[tuple, list[EdgeDecl]] = defaultdict(list)
        for x in d.edges:
            for s in x.sources:
                for t in x.targets:
                    self.patterns[s, t, x.role].append(x)

    def violations(self, g: Graph) -> Found:
        yield from self.of_nodes(g)
        yield from self.of_children(g)
        yield from self.of_edges(g)
        if self.acyclic != "no":
            at = closing_node(list(g.kind), arcs(g, self.acyclic == "children_and_dependency"))
            if at is not None:
                yield at, str(CycleDetected(at))

    def of_nodes(self, g: Graph) -> Found:
        for key, kind, facts in g.nodes:
            if kind not in self.fields:
                yield key, f"kind `{kind}` is not declared"
                continue
            known, counts = self.fields[kind], Counter()
            for dimension, name, value in facts:
                counts[name] += 1
                f = known.get(name)
                if f is None:
                    yield key, f"field `{name}` is not declared on `{kind}`"
                    continue
                if dimension not in f.dimensions:
                    yield key, f"field `{name}` is in {dimension}, not a declared dimension"
                if value != f.value:
                    yield key, f"field `{name}` holds {VALUE_NAMES.get(value, value)}, declared {VALUE_NAMES[f.value]}"
            for f in self.counted[kind]:
                n = counts[f.name]
                if n > 1 or f.occurs == "one" and not n:
                    yield key, f"field `{f.name}` occurs {n} times, declared {OCCURS_NAMES[f.occurs]}"

    def of_children(self, g: Graph) -> Found:
        ordinals: dict[tuple, list[int]] = defaultdict(list)
        for parent, label, ordinal, child in g.children:
            kind = g.kind[parent]
            group = self.groups.get((kind, label))
            if group is None:
                yield parent, f"`{kind}` may not have children labelled `{label}`"
                continue
            if g.kind[child] not in group.children:
                yield parent, f"child `{g.kind[child]}` under `{kind}` -{label}-> is not declared"
            ordinals[parent, label].append(ordinal)
        for (parent, label), found in ordinals.items():
            shape = self.groups[g.kind[parent], label].shape
            if not fits(shape, sorted(found)):
                yield parent, f"children -{label}-> have ordinals {sorted(found)}, declared {SHAPE_NAMES[shape]}"
        for key, kind, _ in g.nodes:
            for label in self.required.get(kind, ()):
                if (key, label) not in ordinals:
                    yield key, f"`{kind}` has no child -{label}->, declared required"
        below = {child for _, _, _, child in g.children}
        roots = [(key, kind) for key, kind, _ in g.nodes if key not in below]
        if self.single_root and len(roots) != 1:
            yield None, f"{len(roots)} roots, declared exactly one"
        for key, kind in roots:
            if kind not in self.roots:
                yield key, f"`{kind}` may not be a root"

    def of_edges(self, g: Graph) -> Found:
        for source, label, target, role, _ in g.edges:
            s, t = g.kind[source], g.kind[target]
            if role != "origin" and not any(x.matches(label) for x in self.patterns.get((s, t, role), ())):
                yield source, f"edge `{s}` -{label}-> `{t}` ({role}) is not declared"


def arcs(g: Graph, dependencies: bool) -> list[tuple[str, str]]:
    out = [(parent, child) for parent, _, _, child in g.children]
    return out + [(s, t) for s, _, t, role, _ in g.edges if dependencies and role == "dependency"]


# --- forms of units -------------------------------------------------------------------------------------------------


#: Forms whose violations a task remembers, and their length.
KNOWN, KNOWN_BYTES = 5_000, 16_384


def _skeletons(units: DataFrame) -> DataFrame:
    """gid, keys and form without values, in the order of the keys."""
    return with_form(units.select(F.col("gid").cast("string").alias("gid"), "recipe", "nodes", "children", "edges"), values=False, by_key=True)


def _wrong(form: str, rules: Mapping[str, Rules]) -> list[tuple]:
    recipe, nodes, children, edges = read_form(form)
    g = Graph([(key, kind, [f[:3] for f in facts]) for key, kind, facts in nodes], children, edges)
    wrong = list(broken(g))
    if recipe not in rules:
        return [(None, f"no declaration for recipe {recipe}"), *wrong]
    return wrong or list(rules[recipe].violations(g))


def _check(declarations: Mapping[str, Declaration]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = {recipe: Rules(d) for recipe, d in declarations.items()}
        known: dict[str, list[tuple]] = {}
        for b in batches:
            out: list[tuple] = []
            keys = b.column(1)
            for i, (gid, form) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                wrong = known.get(form)
                if wrong is None:
                    wrong = _wrong(form, rules)
                    if len(form) <= KNOWN_BYTES and len(known) < KNOWN:
                        known[form] = wrong
                if wrong:
                    own = keys[i].as_py()
                    out += [(gid, own[at - 1] if isinstance(at, int) else at, problem) for at, problem in wrong]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["gid", "at", "problem"])

    return run


def check_units(units: DataFrame, declarations: Mapping[str, Declaration]) -> DataFrame:
    """Violations (gid, at, problem) of units by the declarations of their recipes; an unknown recipe is one, too.

    A graph whose structure is broken is reported for that alone. One scan of the units, no shuffle; a task checks units that
    differ in keys and values alone once, by their positions in the order of the keys."""
    return _skeletons(units).select("gid", "keys", "form").mapInArrow(_check(dict(declarations)), VIOLATION)


# --- cycles --------------------------------------------------------------------------------------------------------


def on_cycles(edges: list[tuple]) -> set:
    """The nodes that lie on a cycle of (source, target) edges: those of a component of several, or with an edge to themselves."""
    keys = sorted({x for e in edges for x in e})
    at = {k: i for i, k in enumerate(keys)}
    follow: list[set[int]] = [set() for _ in keys]
    for s, t in edges:
        follow[at[s]].add(at[t])
    comp = components([sorted(x) for x in follow])
    size = Counter(comp)
    return {k for i, k in enumerate(keys) if size[comp[i]] > 1 or i in follow[i]}


def _cyclic(key: tuple, rows: pa.Table) -> pa.Table:
    found = sorted(on_cycles(list(zip(rows["s"].to_pylist(), rows["t"].to_pylist()))))
    return pa.table({"gid": pa.array([key[0].as_py()] * len(found), rows["gid"].type), "key": pa.array(found, rows["s"].type)})


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """gid, key of the nodes that lie on a cycle of edges (gid, s, t). Edges that lack a graph or an end don't count.

    A graph of up to EDGES_IN_TASK edges goes to one task as it is. In larger ones rounds of joins first trim what nothing
    comes out of, or nothing goes into, until the edges on or between cycles are left. A round is one semi-join each way,
    and there are as many as the longest path beside the cycles has nodes."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    scratch = Scratch(edges.sparkSession, "cycles")
    whole = scratch.write(edges.select("gid", "s", "t").dropna().distinct(), "edges")
    large = large_graphs(whole, scratch)
    if large is not None:
        whole = whole.join(large, "gid", "left_anti").unionByName(_trimmed(whole.join(large, "gid", "left_semi"), scratch))
    return whole.groupBy("gid").applyInArrow(_cyclic, f"gid {kinds['gid']}, key {kinds['s']}")


def _trimmed(now: DataFrame, scratch: Scratch) -> DataFrame:
    """The edges on or between cycles."""
    now, at = scratch.write(now, "0"), 0
    size = now.count()
    while size:
        inner = now.join(now.select("gid", F.col("s").alias("t")).distinct(), ["gid", "t"], "left_semi")
        inner = scratch.write(inner.join(inner.select("gid", F.col("t").alias("s")).distinct(), ["gid", "s"], "left_semi"), str(at + 1))
        scratch.drop(str(at))
        left = inner.count()
        now, at = inner, at + 1
        if left == size:
            break
        size = left
    return now.select("gid", "s", "t")


# --- inference -----------------------------------------------------------------------------------------------------


_FACT = "struct<d:string,n:string,k:string>"
_FORM = f"nodes array<struct<i:string,k:string,f:array<{_FACT}>>>, children array<struct<p:string,l:string,o:bigint,c:string>>, edges array<struct<s:string,l:string,t:string,r:string,n:int>>"


def _read(forms: DataFrame) -> DataFrame:
    """Forms as units without values, under their form's id."""
    own = forms.select(F.sha2("form", 256).alias("gid"), F.from_json("form", _FORM).alias("g"))
    none = F.lit(None)
    fact = lambda f: F.struct(f["d"].alias("dimension"), f["n"].alias("name"), f["k"].alias("kind"), none.cast("string").alias("text"), none.cast("decimal(20,0)").alias("num"), none.cast("binary").alias("bytes"))
    nodes = F.transform("g.nodes", lambda n, i: F.struct(F.coalesce(n["i"], (i + 1).cast("string")).alias("key"), n["k"].alias("kind"), F.transform(n["f"], fact).alias("fields")))
    children = F.transform("g.children", lambda c: F.struct(c["p"].alias("parent"), c["l"].alias("label"), c["o"].alias("ordinal"), c["c"].alias("child")))
    edges = F.transform("g.edges", lambda x: F.struct(x["s"].alias("source"), x["l"].alias("label"), x["t"].alias("target"), x["r"].alias("role"), x["n"].alias("fields")))
    return own.select("gid", nodes.alias("nodes"), children.alias("children"), edges.alias("edges"))


def infer_declaration(units: DataFrame, recipe: str) -> Declaration:
    """The narrowest declaration that all the units satisfy; what fits no declaration is an error that lists it.

    Units that differ in keys and values alone are read once. What is collected is as large as the declaration: one row
    for each kind, field, child group and edge."""
    scratch = Scratch(units.sparkSession, "infer")
    r = Relations(_read(scratch.write(_skeletons(units).select("form").distinct(), "forms")))
    totals = {x["kind"]: x["n"] for x in r.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    per_node = r.fields.groupBy("gid", "key", "node_kind", "name").agg(F.count(F.lit(1)).alias("n"), F.collect_set("dimension").alias("d"), F.collect_set("value_kind").alias("v"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    fields = per_node.groupBy("node_kind", "name").agg(F.count(F.lit(1)).alias("carriers"), F.min("n").alias("low"), F.max("n").alias("high"), flat("d").alias("d"), flat("v").alias("v")).collect()
    groups = r.typed_children().groupBy("gid", "parent", "parent_kind", "label").agg(F.sort_array(F.collect_list("ordinal")).alias("o"), F.collect_set("child_kind").alias("k"))
    n = F.size("o")
    seq, same, one = F.col("o") == F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), F.col("o")[n - 1] == 0, (n == 1) & (F.col("o")[0] == 0)
    shaped = groups.groupBy("parent_kind", "label").agg(
        F.count(F.lit(1)).alias("parents"), F.bool_and(seq).alias("seq"), F.bool_and(same).alias("set"), F.bool_and(one).alias("one"), F.bool_and(seq | same).alias("some"), flat("k").alias("k")
    ).collect()
    edges = r.typed_edges().filter("role <> 'origin'").select("source_kind", "label", "target_kind", "role").distinct().collect()
    roots = r.roots()
    root_kinds = sorted(x[0] for x in roots.select("kind").distinct().collect())
    per_graph = r.units.select("gid").join(roots.groupBy("gid").agg(F.count(F.lit(1)).alias("n")), "gid", "left")
    single = per_graph.filter("n is null or n <> 1").isEmpty()
    scratch.drop()

    problems, kinds, children = [], [], []
    for kind in sorted(totals):
        found = []
        for f in sorted((f for f in fields if f["node_kind"] == kind), key=lambda f: f["name"]):
            if len(f["v"]) != 1:
                problems.append(f"`{kind}.{f['name']}` holds values of types {', '.join(sorted(f['v'], key=wire.VALUE_KINDS.index))}")
            occurs = "many" if f["high"] > 1 else "one" if f["carriers"] == totals[kind] else "optional"
            found.append(FieldDecl(f["name"], tuple(d for d in wire.DIMENSIONS if d in f["d"]), f["v"][0], occurs))
        kinds.append((kind, tuple(found)))
    for g in sorted(shaped, key=lambda g: (g["parent_kind"], g["label"])):
        if not g["some"]:
            problems.append(f"`{g['parent_kind']}` -{g['label']}-> has ordinals that no shape fits")
        shape = next((s for s in ("one", "seq", "set") if g[s]), None)
        if shape is None:
            problems.append(f"`{g['parent_kind']}` -{g['label']}-> fits no single shape across graphs")
        optional = shape == "one" and g["parents"] < totals[g["parent_kind"]]
        children.append(ChildDecl((g["parent_kind"],), g["label"], tuple(sorted(g["k"])), shape or "seq", optional))
    if problems:
        raise CatalogError("; ".join(problems))
    order = sorted(edges, key=lambda x: (x["source_kind"], x["label"], x["target_kind"], wire.ROLES.index(x["role"])))
    return Declaration(recipe, tuple(root_kinds), single, tuple(kinds), tuple(children), tuple(EdgeDecl((x["source_kind"],), x["label"], False, (x["target_kind"],), x["role"]) for x in order))
