"""Units: one graph each, as JSON lines outside and as nested rows inside.

Inside, a key is its canonical string, whose parts are joined by U+001F and which can be read back; a value is its kind
and one of text, num (bool, u64, i64) or bytes. u64 doesn't fit a signed long, so num is decimal(20, 0).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from json.encoder import encode_basestring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prismgraph import wire
from prismgraph.errors import CatalogError, DuplicateNode, EmptyName, InvalidName, NodeKeyMismatch
from prismgraph.operators.kernel import Graph

FIELD = "struct<dimension:string,name:string,kind:string,text:string,num:decimal(20,0),bytes:binary>"
GRAPH = (
    "graph_key string, "
    f"nodes array<struct<key:string,kind:string,fields:array<{FIELD}>>>, "
    "children array<struct<parent:string,label:string,ordinal:bigint,child:string>>, "
    f"edges array<struct<source:string,label:string,target:string,role:string,fields:array<{FIELD}>>>"
)
UNIT = f"recipe string, population string, name string, status string, {GRAPH}"


def name(x, what: str) -> str:
    """A name isn't empty and doesn't hold the separator of canonical keys."""
    if not isinstance(x, str) or not x:
        raise EmptyName(f"empty {what}")
    if wire.SEPARATOR in x:
        raise InvalidName(f"{what} holds U+001F")
    return x


def pairs(items, what: str) -> list[tuple]:
    """A map without string keys travels as a list of pairs."""
    if not isinstance(items, list) or any(not isinstance(p, list) or len(p) != 2 for p in items):
        raise CatalogError(f"{what} must be pairs")
    return [(k, v) for k, v in items]


def entity_key(x: dict) -> str:
    try:
        parts = x["kind"], x.get("owner", x.get("owner_key")), x.get("local", x.get("local_key"))
    except (TypeError, KeyError, AttributeError):
        raise CatalogError("an entity key needs kind, owner and local") from None
    if all(isinstance(p, str) and p for p in parts) and (key := wire.SEPARATOR.join(parts)).count(wire.SEPARATOR) == 2:
        return key
    return wire.SEPARATOR.join(name(p, f"entity key {w}") for p, w in zip(parts, ("kind", "owner", "local")))


def node_key(x: dict) -> str:
    if isinstance(x, dict) and set(x) == {"entity"}:
        return f"entity:{entity_key(x['entity'])}"
    if isinstance(x, dict) and set(x) == {"derived"}:
        return f"derived:{entity_key(x['derived']['owner'])}{wire.SEPARATOR}{name(x['derived']['local'], 'node key local')}"
    raise CatalogError("a node key is an entity or derived")


def graph_key(x: dict) -> str:
    return f"{entity_key(x['owner'])}{wire.SEPARATOR}{name(x['local'], 'graph key local')}"


def _entity_json(parts: list[str]) -> dict:
    return dict(zip(("kind", "owner", "local"), parts))


def node_key_json(key: str) -> dict:
    kind, _, rest = key.partition(":")
    parts = rest.split(wire.SEPARATOR)
    return {"entity": _entity_json(parts)} if kind == "entity" else {"derived": {"owner": _entity_json(parts[:3]), "local": parts[3]}}


def graph_key_json(key: str) -> dict:
    parts = key.split(wire.SEPARATOR)
    return {"owner": _entity_json(parts[:3]), "local": parts[3]}


LIMITS = {"u64": (0, 2**64 - 1), "i64": (-(2**63), 2**63 - 1)}


def _field(x: dict) -> dict:
    if x.get("dimension") not in wire.DIMENSIONS:
        raise CatalogError(f"unknown dimension `{x.get('dimension')}`")
    kind, value = x["value"].get("kind"), x["value"].get("value")
    out = {"dimension": x["dimension"], "name": name(x["name"], "field name"), "kind": kind, "text": None, "num": None, "bytes": None}
    if kind == "text" and isinstance(value, str):
        out["text"] = value
    elif kind == "bool" and isinstance(value, bool):
        out["num"] = Decimal(int(value))
    elif kind in LIMITS and isinstance(value, int) and not isinstance(value, bool) and LIMITS[kind][0] <= value <= LIMITS[kind][1]:
        out["num"] = Decimal(value)
    elif kind == "bytes" and isinstance(value, list):
        out["bytes"] = bytes(value)
    else:
        raise CatalogError(f"field `{x['name']}` has no {kind} value")
    return out


def _field_json(f: dict) -> dict:
    kind = f["kind"]
    value = f["text"] if kind == "text" else bool(f["num"]) if kind == "bool" else list(f["bytes"]) if kind == "bytes" else int(f["num"])
    return {"dimension": f["dimension"], "name": f["name"], "value": {"kind": kind, "value": value}}


def parse_graph(g: dict) -> dict:
    nodes = []
    for k, n in pairs(g["nodes"], "nodes"):
        key = node_key(k)
        if n["key"] != k and node_key(n["key"]) != key:
            raise NodeKeyMismatch(f"node `{key}` is stored under another key")
        nodes.append({"key": key, "kind": name(n["kind"], "node kind"), "fields": [_field(f) for f in n.get("fields", [])]})
    if len({n["key"] for n in nodes}) < len(nodes):
        raise DuplicateNode("a node key occurs twice")
    children = []
    for c in g.get("children", []):
        if not isinstance(c["ordinal"], int) or not 0 <= c["ordinal"] < 2**32:
            raise CatalogError("an ordinal must fit 32 bits")
        children.append({"parent": node_key(c["parent"]), "label": name(c["label"], "child label"), "ordinal": c["ordinal"], "child": node_key(c["child"])})
    edges = []
    for x in g.get("edges", []):
        if x.get("role") not in wire.ROLES:
            raise CatalogError(f"unknown edge role `{x.get('role')}`")
        edges.append({"source": node_key(x["source"]), "label": name(x["label"], "edge label"), "target": node_key(x["target"]), "role": x["role"], "fields": [_field(f) for f in x.get("fields", [])]})
    return {"graph_key": graph_key(g["graph_key"]), "nodes": nodes, "children": children, "edges": edges}


def graph_json(row: dict) -> dict:
    edges = []
    for x in row["edges"]:
        edge = {"source": node_key_json(x["source"]), "label": x["label"], "target": node_key_json(x["target"]), "role": x["role"]}
        edges.append(edge | ({"fields": [_field_json(f) for f in x["fields"]]} if x["fields"] else {}))
    nodes = [[node_key_json(n["key"]), {"key": node_key_json(n["key"]), "kind": n["kind"], "fields": [_field_json(f) for f in n["fields"]]}] for n in row["nodes"]]
    children = [{"parent": node_key_json(c["parent"]), "label": c["label"], "ordinal": c["ordinal"], "child": node_key_json(c["child"])} for c in row["children"]]
    return {"graph_key": graph_key_json(row["graph_key"]), "nodes": nodes, "children": children, "edges": edges}


def parse_unit(line: str) -> dict:
    """A unit as a nested row. Keys of the unit that aren't known are refused; inside the graph they are ignored."""
    try:
        x = json.loads(line)
        unknown = set(x) - {"recipe", "population", "name", "status", "graph"}
        if unknown:
            raise CatalogError(f"unknown field `{min(unknown)}`")
        status = x.get("status", "final")
        if status not in ("final", "provisional"):
            raise CatalogError(f"unknown status `{status}`")
        if not isinstance(x["name"], str):
            raise CatalogError("a unit needs a name")
        return {"recipe": name(x["recipe"], "recipe"), "population": name(x["population"], "population"), "name": x["name"], "status": status, **parse_graph(x["graph"])}
    except CatalogError:
        raise
    except (KeyError, TypeError, ValueError, AttributeError) as error:
        raise CatalogError(f"not a unit: {type(error).__name__} {error}") from None


def unit_json(row: dict) -> str:
    return json.dumps({k: row[k] for k in ("recipe", "population", "name", "status")} | {"graph": graph_json(row)}, ensure_ascii=False, separators=(",", ":"))


def to_graph(row: dict) -> Graph:
    """The kernel's graph of a nested row."""

    def fact(f: dict) -> tuple:
        kind = f["kind"]
        return f["dimension"], f["name"], kind, f["text"] if kind == "text" else f["bytes"] if kind == "bytes" else int(f["num"])

    nodes: dict[str, tuple[str, list]] = {}
    for n in row["nodes"]:
        if n["key"] in nodes:
            raise DuplicateNode(f"node `{n['key']}` occurs twice")
        nodes[n["key"]] = (n["kind"], [fact(f) for f in n["fields"]])
    return Graph(nodes, [(c["parent"], c["label"], c["ordinal"], c["child"]) for c in row["children"]], [(x["source"], x["label"], x["target"], x["role"]) for x in row["edges"]])


def struct_lists(lists: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Bounds of each list, and the columns of the structs in them; a null list is an empty one."""
    sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False)) * ~np.asarray(lists.is_null())
    return np.concatenate([[0], np.cumsum(sizes)]), lists.flatten().flatten()


def kernel_graphs(nodes: pa.Array, children: pa.Array, edges: pa.Array) -> list[Graph]:
    """The kernel's graphs of the nested columns of some rows, made from flat columns."""
    at, (keys, kinds, facts) = struct_lists(nodes)
    fact_at, columns = struct_lists(facts)
    facts = [(d, n, k, t if k == "text" else raw if k == "bytes" else int(num)) for d, n, k, t, num, raw in zip(*(c.to_pylist() for c in columns))]
    keys, own = keys.to_pylist(), list(zip(kinds.to_pylist(), (facts[a:z] for a, z in zip(fact_at[:-1], fact_at[1:]))))
    child_at, columns = struct_lists(children)
    children = list(zip(*(c.to_pylist() for c in columns)))
    edge_at, columns = struct_lists(edges)
    edges = list(zip(*(c.to_pylist() for c in columns[:4])))
    out = []
    for i in range(len(at) - 1):
        a, z = at[i], at[i + 1]
        found = dict(zip(keys[a:z], own[a:z]))
        if len(found) < z - a:
            twice = next(k for n, k in enumerate(keys[a:z]) if k in keys[a : a + n])
            raise DuplicateNode(f"node `{twice}` occurs twice")
        out.append(Graph(found, children[child_at[i] : child_at[i + 1]], edges[edge_at[i] : edge_at[i + 1]]))
    return out


#: Units that are read or written at once in a task.
UNITS_AT_ONCE = 500


def _parse(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, UNITS_AT_ONCE):
                yield from parsed(b.slice(lo, UNITS_AT_ONCE))

    def parsed(b: pa.RecordBatch) -> list[pa.RecordBatch]:
        rows = []
        for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if line.strip():
                try:
                    rows.append({"file": file, "problem": None, "line": None} | parse_unit(line))
                except CatalogError as error:
                    rows.append({"file": file, "problem": str(error), "line": line})
        return pa.Table.from_pylist(rows, schema).to_batches()

    return run


def read_units(spark: SparkSession, path: str | list[str], check: bool = True) -> DataFrame:
    """Units of JSON-lines files, with their file. Blank lines are skipped; a line that isn't a unit is an error, told
    with its number, or a row with a problem if `check` is off."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    schema = StructType.fromDDL(f"file string, problem string, line string, {UNIT}")
    units = lines.mapInArrow(_parse(to_arrow_schema(schema)), schema)
    if not check:
        return units
    bad = units.filter("problem is not null").select("file", "line", "problem").first()
    if bad:
        numbered = spark.read.text(bad["file"]).withColumn("n", F.monotonically_increasing_id())
        at = numbered.filter(F.col("value") == bad["line"]).agg(F.min("n")).first()[0]
        before = numbered.filter(F.col("n") < at).count()
        raise CatalogError(f"{bad['file']} line {before + 1}: {bad['problem']}")
    return units.drop("problem", "line")


def _said(x: str | None) -> str:
    return "null" if x is None else encode_basestring(x)


def _entity_text(parts: list[str]) -> str:
    return "{" + ",".join(f'"{k}":{_said(p)}' for k, p in zip(("kind", "owner", "local"), parts)) + "}"


def _key_text(key: str) -> str:
    kind, _, rest = key.partition(":")
    parts = rest.split(wire.SEPARATOR)
    if kind == "entity":
        return f'{{"entity":{_entity_text(parts)}}}'
    return f'{{"derived":{{"owner":{_entity_text(parts[:3])},"local":{_said(parts[3])}}}}}'


def _field_text(dimension: str, name: str, kind: str, text: str | None, num: Decimal | None, raw: bytes | None) -> str:
    value = _said(text) if kind == "text" else ("true" if num else "false") if kind == "bool" else f"[{','.join(map(str, raw))}]" if kind == "bytes" else str(int(num))
    return f'{{"dimension":{_said(dimension)},"name":{_said(name)},"value":{{"kind":{_said(kind)},"value":{value}}}}}'


def _field_texts(lists: pa.Array) -> list[str]:
    """The fields of each node or edge as the inside of a JSON list."""
    at, columns = struct_lists(lists)
    texts = [_field_text(*f) for f in zip(*(c.to_pylist() for c in columns))]
    return [",".join(texts[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]


def unit_texts(b: pa.RecordBatch) -> list[str]:
    """What `unit_json` makes of each row, made from flat columns."""
    column = dict(zip(b.schema.names, b.columns))
    node_at, (keys, kinds, facts) = struct_lists(column["nodes"])
    nodes = []
    for key, kind, own in zip(map(_key_text, keys.to_pylist()), kinds.to_pylist(), _field_texts(facts)):
        nodes.append(f'[{key},{{"key":{key},"kind":{_said(kind)},"fields":[{own}]}}]')
    child_at, columns = struct_lists(column["children"])
    children = [f'{{"parent":{_key_text(a)},"label":{_said(label)},"ordinal":{n},"child":{_key_text(c)}}}' for a, label, n, c in zip(*(c.to_pylist() for c in columns))]
    edge_at, (*columns, facts) = struct_lists(column["edges"])
    edges = []
    for a, label, c, role, own in zip(*(c.to_pylist() for c in columns), _field_texts(facts)):
        fields = f',"fields":[{own}]' if own else ""
        edges.append(f'{{"source":{_key_text(a)},"label":{_said(label)},"target":{_key_text(c)},"role":{_said(role)}{fields}}}')
    node_at, child_at, edge_at = node_at.tolist(), child_at.tolist(), edge_at.tolist()
    out = []
    for i, (recipe, population, name, status, graph) in enumerate(zip(*(column[c].to_pylist() for c in ("recipe", "population", "name", "status", "graph_key")))):
        parts = graph.split(wire.SEPARATOR)
        made = f'{{"graph_key":{{"owner":{_entity_text(parts[:3])},"local":{_said(parts[3])}}},"nodes":[{",".join(nodes[node_at[i] : node_at[i + 1]])}],"children":[{",".join(children[child_at[i] : child_at[i + 1]])}],"edges":[{",".join(edges[edge_at[i] : edge_at[i + 1]])}]}}'
        out.append(f'{{"recipe":{_said(recipe)},"population":{_said(population)},"name":{_said(name)},"status":{_said(status)},"graph":{made}}}')
    return out


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, UNITS_AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(unit_texts(b.slice(lo, UNITS_AT_ONCE)), pa.string())], names=["value"])


def write_units(units: DataFrame, path: str) -> None:
    columns = StructType.fromDDL(UNIT).names
    units.select(*columns).mapInArrow(_render, "value string").write.mode("overwrite").text(path)
