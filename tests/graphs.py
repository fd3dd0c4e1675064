"""Small graphs that several tests share."""

import json

from prismgraph import wire
from prismgraph.operators.kernel import Graph, hash_graphs
from prismgraph.sources.builder import GraphBuilder, json_unit
from prismgraph.sources.units import unit_json

SEP = wire.SEPARATOR


def key(kind, owner, local):
    return f"entity:{kind}{SEP}{owner}{SEP}{local}"


def named(nodes, children=(), edges=(), owner="demo"):
    """Nodes {local: (kind, fields)}, children (parent, label, ordinal, child), edges (source, label, target, role) by local."""
    k = lambda x: key("n", owner, x)
    return Graph({k(x): (kind, list(fields)) for x, (kind, fields) in nodes.items()}, [(k(a), b, c, k(d)) for a, b, c, d in children], [(k(a), b, k(c), d) for a, b, c, d in edges])


def hashed(graph, keys="free", dims=wire.DIMENSIONS, recipe="test/1", nodes=False):
    return hash_graphs([(graph, recipe, keys, dims)], nodes)[0]


def golden():
    """The graph of the published golden digests."""
    body, lit = key("test.body", "golden", "body:0"), key("test.expr", "golden", "expr:0")
    fields = [("constants", "value", "u64", 13), ("names", "name", "text", "x"), ("types", "type", "text", "u256")]
    return Graph({body: ("body", []), lit: ("literal", fields)}, [(body, "expr", 0, lit)], [(lit, "uses", body, "reference")])


TEXT = lambda d, n, v: (d, n, "text", v)
U64 = lambda d, n, v: (d, n, "u64", v)


def joint_pair(swapped):
    a, b = ("u16", "u8") if swapped else ("u8", "u16")
    return named(
        {"p": ("call", []), "a": ("op", [TEXT("names", "n", "add"), TEXT("types", "t", a)]), "b": ("op", [TEXT("names", "n", "mul"), TEXT("types", "t", b)])},
        [("p", "arg", 0, "a"), ("p", "arg", 0, "b")],
    )


def document(shown, value, owner):
    """A line of a unit file: the JSON document `value`."""
    return unit_json(json_unit(json.dumps(value), shown, owner))


def line(recipe, nodes, children, edges=(), shown="f", owner="w"):
    """A line of a unit file from nodes {local: (kind, facts)}, children and edges by local."""
    g = GraphBuilder(SEP.join(["file", owner, shown, "graph"]))
    at = {x: g.node(key("part", f"{owner}:{shown}", x), kind) for x, (kind, _) in nodes.items()}
    for x, (_, facts) in nodes.items():
        for f in facts:
            g.field(at[x], *f)
    for parent, label, ordinal, child in children:
        g.child(at[parent], label, ordinal, at[child])
    for source, label, target, role in edges:
        g.edge(at[source], label, at[target], role)
    return unit_json(g.unit(recipe, "parts", shown))


#: Two worlds: the invoice is the same in both, the ticket differs in keys, the profile in values.
LEFT = [("invoice", {"lines": [3, 4], "paid": True}), ("ticket", {"seat": 7, "row": "k"}), ("profile", {"age": 30, "tags": ["a"]})]
RIGHT = [("invoice", {"paid": True, "lines": [3, 4]}), ("ticket", {"place": 7, "line": "k"}), ("profile", {"age": 31, "tags": ["a"]})]
