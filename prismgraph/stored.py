"""Registered queries over what is written, admitted, asserted, viewed and refused, and the SQL that recomputes them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgraph import errors, wire
from prismgraph.catalog import NATIONS_VIEW, _orders, _table
from prismgraph.operators import claims as c
from prismgraph.operators import queries as q
from prismgraph.operators.check import check_units, cyclic_nodes, infer_declaration
from prismgraph.operators.exact import canonicalise, verify
from prismgraph.operators.merkle import set_root
from prismgraph.plans.declaration import ChildDecl, Declaration, Declarations, EdgeDecl, FieldDecl, parse_declaration
from prismgraph.plans.view import parse_view
from prismgraph.scratch import Scratch
from prismgraph.sources import producers as p
from prismgraph.sources import records as r
from prismgraph.sources.builder import GraphBuilder, json_units
from prismgraph.sources.corpus import Corpus, artifact_id, origin_hash
from prismgraph.sources.table import table_lines
from prismgraph.sources.units import UNIT, graph_key_json, node_key_json, read_units, write_units

SEP = wire.SEPARATOR


# --- units outside and inside ----------------------------------------------------------------------------------------


def units_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as JSON lines and read again."""
    path = f"{Scratch(spark, 'lines').path}/units"
    write_units(_orders(spark, sf), path)
    units = read_units(spark, path)
    line = F.filter("nodes", lambda n: n["kind"] == "line")
    hundredths = F.aggregate(line, F.lit(0).cast("decimal(38,0)"), lambda acc, n: acc + F.filter(n["fields"], lambda f: f["name"] == "quantity")[0]["num"].cast("decimal(38,0)"), lambda x: x.cast("long"))
    status = F.filter(F.col("nodes")[0]["fields"], lambda f: f["name"] == "status")[0]["text"]
    return units.select("name", status.alias("status"), F.size("nodes").alias("nodes"), F.size("children").alias("children"), hundredths.alias("hundredths"))


#: What a line of refused_lines has wrong, by nation key modulo their number: the problem, and the change to the unit.
DEFECTS: tuple[tuple[str | None, Callable[[dict], object]], ...] = (
    (None, lambda u: u),
    ("unknown field `extra`", lambda u: u | {"extra": 1}),
    ("empty recipe", lambda u: u | {"recipe": ""}),
    ("population holds U+001F", lambda u: u | {"population": f"a{SEP}b"}),
    ("unknown status `odd`", lambda u: u | {"status": "odd"}),
    ("a node key occurs twice", lambda u: u | {"graph": u["graph"] | {"nodes": u["graph"]["nodes"] * 2}}),
    ("nodes must be pairs", lambda u: u | {"graph": u["graph"] | {"nodes": [[1]]}}),
    ("an entity key needs kind, owner and local", lambda u: u | {"graph": u["graph"] | {"graph_key": {"owner": {}, "local": "x"}}}),
)


def refused_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line for each nation, most with one defect: what reading says of it. Blank lines are skipped."""

    def line(nation: int) -> str:
        key = node_key_json(f"entity:nation{SEP}geo{SEP}{nation}")
        graph = {"graph_key": graph_key_json(f"nation{SEP}geo{SEP}{nation}{SEP}one"), "nodes": [[key, {"key": key, "kind": "nation", "fields": []}]], "children": [], "edges": []}
        unit = {"recipe": "geo/1", "population": "nation", "name": str(nation), "graph": graph}
        return json.dumps(DEFECTS[nation % len(DEFECTS)][1](unit)) + "\n"

    path = f"{Scratch(spark, 'refused').path}/lines"
    _table(spark, sf, "nation").select(F.udf(line)("n_nationkey").alias("value")).write.text(path)
    found = read_units(spark, path, check=False)
    nation = F.coalesce("name", F.regexp_extract("line", '"name": "([0-9]+)"', 1)).cast("int")
    return found.select(nation.alias("nation"), F.coalesce("problem", F.lit("")).alias("problem"))


def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as JSON documents, as units: their nodes by kind."""
    doc = F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.array("c_nationkey", F.lit(None).cast("int")).alias("nations"), (F.col("c_custkey") % 2 == 0).alias("even"), F.struct(F.col("c_custkey").alias("key")).alias("inner")), {"ignoreNullFields": "false"})
    units = json_units(_table(spark, sf, "customer"), doc, F.col("c_custkey"), "customers")
    kinds = units.select(F.explode("nodes").alias("n")).groupBy("n.kind").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct(F.get(F.filter("n.fields", lambda f: (f["dimension"] == "constants") & (f["kind"] == "text")), F.lit(0))["text"]).alias("texts"))
    return kinds


def built_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """What the builder says to steps that can't be taken, one for each region."""
    g = GraphBuilder(SEP.join("abcd"))
    g.node("entity:x", "k")
    steps = (lambda: g.node("entity:x", "k"), lambda: g.child("entity:x", "l", 0, "entity:y"), lambda: g.edge("entity:x", "l", "entity:x", "data", ({},)), lambda: g.node("entity:z", ""), lambda: g.node("entity:z", f"k{SEP}"))
    rows = [(k, _said(step)) for k, step in enumerate(steps)]
    return _table(spark, sf, "region").join(F.broadcast(spark.createDataFrame(rows, "r_regionkey int, error string")), "r_regionkey").select("r_name", "error")


def _said(step: Callable[[], object]) -> str:
    try:
        step()
    except errors.CatalogError as error:
        return type(error).__name__
    return ""


# --- checks ----------------------------------------------------------------------------------------------------------

LOOSE = Declaration(
    "trade.order/1",
    ("order",),
    True,
    (
        ("order", (FieldDecl("status", ("structure",), "text", "one"), FieldDecl("priority", ("names",), "text", "one"))),
        ("line", (FieldDecl("flag", ("structure",), "text", "one"), FieldDecl("state", ("structure",), "text", "one"), FieldDecl("quantity", ("constants",), "i64", "one"))),
    ),
    (ChildDecl(("order",), "line", ("line",), "set"),),
    (EdgeDecl(("order",), "next", True, ("order",), "control"), EdgeDecl(("order",), "self", False, ("order",), "data")),
    "children_and_dependency",
)


def _altered_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, each changed in one way by its key modulo 12."""
    rule = F.col("o_orderkey") % 12
    at = lambda k, changed, name: F.when(rule == k, changed).otherwise(F.col(name))
    top = F.col("nodes")[0]
    rest = F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 1, F.lit(0)))
    as_top = lambda n, kind=None, fields=None: F.concat(F.array(F.struct(n["key"].alias("key"), (kind if kind is not None else n["kind"]).alias("kind"), (fields if fields is not None else n["fields"]).alias("fields"))), rest)
    changed = lambda field, **to: F.transform(top["fields"], lambda f: F.when(f["name"] == field, F.struct(*[to.get(k, f[k]).alias(k) for k in ("dimension", "name", "kind", "text", "num", "bytes")])).otherwise(f))
    nodes = F.col("nodes")
    for k, made in (
        (0, as_top(top, fields=F.filter(top["fields"], lambda f: f["name"] != "status"))),
        (1, as_top(top, kind=F.lit("parcel"))),
        (2, as_top(top, fields=changed("priority", dimension=F.lit("constants")))),
        (3, as_top(top, fields=changed("status", kind=F.lit("bytes")))),
        (7, F.slice("nodes", F.lit(1), F.size("nodes") - 1)),
        (8, F.concat("nodes", F.array(top))),
        (10, as_top(top, fields=F.concat(top["fields"], F.filter(top["fields"], lambda f: f["name"] == "status")))),
        (11, as_top(top, fields=changed("priority", name=F.lit("urgency")))),
    ):
        nodes = F.when(rule == k, made).otherwise(nodes)
    child = lambda **to: F.transform("children", lambda x: F.struct(*[to.get(k, x[k]).alias(k) for k in ("parent", "label", "ordinal", "child")]))
    children = at(4, child(label=F.lit("part")), "children")
    children = F.when(rule == 5, F.slice("children", F.lit(1), F.lit(0))).when(rule == 9, child(ordinal=F.lit(3).cast("long"))).otherwise(children)
    edges = at(6, F.array(p.edge(top["key"], "next:1", top["key"], "control"), p.edge(top["key"], "previous", top["key"], "control"), p.edge(top["key"], "self", top["key"], "data"), p.edge(top["key"], "selfish", top["key"], "data")), "edges")
    units = _orders(spark, sf).withColumns({"nodes": nodes, "children": children, "edges": edges, "gid": F.col("name")})
    return Scratch(spark, "altered").write(units, "units")


def checked_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that break every rule of a declaration: how often each violation is found."""
    found = check_units(_altered_orders(spark, sf), {LOOSE.recipe: LOOSE})
    return found.groupBy("problem").agg(F.count(F.lit(1)).alias("violations"), F.count_distinct("gid").alias("units"))


def check_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What the check command says: units checked, units that break."""
    units = _altered_orders(spark, sf)
    broken = check_units(units, {LOOSE.recipe: LOOSE}).agg(F.count_distinct("gid").alias("broken"))
    return units.agg(F.count(F.lit(1)).alias("checked")).crossJoin(F.broadcast(broken))  # one row each


_ARCS = {
    0: (("b", "c"), ("c", "b"), ("c", "a"), ("a", "d"), ("d", "e"), ("e", "d")),  # a lies between two cycles
    1: (("a", "b"), ("b", "c"), ("a", "c")),
    2: (("c", "c"), ("a", "b")),
}


def closing_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A small graph for each supplier, with cycles, without, or with an edge from a node to itself: the node that closes one."""
    key = lambda x: p.node_key("part", "supplier", F.lit(x))
    nodes = F.array(*[p.node(key(x), "part") for x in "abcde"])
    edges = p.no_edges()
    for k, arcs in _ARCS.items():
        edges = F.when(F.col("s_suppkey") % 3 == k, F.array(*[p.edge(key(s), "needs", key(t), "dependency") for s, t in arcs])).otherwise(edges)
    children = F.array().cast("array<struct<parent:string,label:string,ordinal:bigint,child:string>>")
    units = _table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("gid"), F.lit("parts/1").alias("recipe"), nodes.alias("nodes"), children.alias("children"), edges.alias("edges"))
    declared = Declaration("parts/1", ("part",), False, (("part", ()),), (), (EdgeDecl(("part",), "needs", False, ("part",), "dependency"),), "children_and_dependency")
    found = check_units(units, {"parts/1": declared})
    return found.select(F.col("gid").cast("long").alias("supplier"), F.element_at(F.split("at", SEP), 3).alias("node"), F.substring_index("problem", " ", 2).alias("problem"))


def cycle_members(spark: SparkSession, sf: str) -> DataFrame:
    """The same arcs as one table of edges for all suppliers: the nodes on cycles, but none between them."""
    arcs = spark.createDataFrame([(k, s, t) for k, some in _ARCS.items() for s, t in some], "k int, a string, b string")
    at = lambda x: F.concat(F.col("s_suppkey").cast("string"), F.lit("/"), x)
    edges = _table(spark, sf, "supplier").join(F.broadcast(arcs), F.col("s_suppkey") % 3 == F.col("k")).select((F.col("s_nationkey")).alias("gid"), at(F.col("a")).alias("s"), at(F.col("b")).alias("t"))
    return cyclic_nodes(edges).select(F.col("gid").cast("long").alias("nation"), F.col("key").alias("node"))


def declared(spark: SparkSession, sf: str) -> DataFrame:
    """Declarations on their own: what is wrong with them, what they fill, what the registry does."""
    registry = Declarations()
    registry.declare(LOOSE)
    refuses = lambda **change: _said(lambda: parse_declaration(json.loads(LOOSE.to_json()) | change)) == "CatalogError"
    whole = json.loads(LOOSE.to_json())
    rows = [
        ("fills", "+".join(LOOSE.fills())),
        ("status is in", "+".join(LOOSE.field_dimensions("order", "status"))),
        ("names has priority", str(LOOSE.declares_field("names", "priority"))),
        ("names has status", str(LOOSE.declares_field("names", "status"))),
        ("reads back", str(parse_declaration(LOOSE.to_json()) == LOOSE)),
        ("a kind twice", str(refuses(kinds=whole["kinds"] * 2))),
        ("a child group twice", str(refuses(children=whole["children"] * 2))),
        ("an undeclared root", str(refuses(roots=["odd"]))),
        ("an odd acyclicity", str(refuses(acyclic="maybe"))),
        ("the same again", _said(lambda: registry.declare(LOOSE))),
        ("another under its name", _said(lambda: registry.declare(parse_declaration(whole | {"single_root": False})))),
        ("an unknown recipe", _said(lambda: registry.require("none/1"))),
    ]
    return spark.createDataFrame(rows, "what string, said string")


# --- the stored collection -------------------------------------------------------------------------------------------

CHAT = Declaration(
    "chat/1",
    ("conversation",),
    True,
    (
        ("conversation", ()),
        ("turn", (FieldDecl("role", ("structure",), "text", "optional"), FieldDecl("text", ("names",), "text", "optional"), FieldDecl("chars", ("constants",), "u64", "optional"))),
    ),
    (ChildDecl(("conversation",), "turn", ("turn",), "seq"),),
)


def collection_life(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations admitted in three scopes; one is replaced, one emptied, one broken batch refused; then all is scanned."""
    corpus = Corpus(spark, f"{Scratch(spark, 'collection').path}/corpus")
    refused = _said(lambda: corpus.admit("chat", "early", p.conversation_units(_table(spark, sf, "conversations"))))
    corpus.declare(CHAT)
    units = Scratch(spark, "admitted").write(p.conversation_units(_table(spark, sf, "conversations")), "units")
    part = lambda n, k: units.filter(F.pmod("conv_id", F.lit(n)) == k)
    for k in range(3):
        corpus.admit("chat", f"part{k}", part(3, k))
    corpus.admit("chat", "part1", part(6, 1))
    corpus.admit("chat", "part2", units.filter("false"))
    broken = part(3, 0).withColumn("children", F.transform("children", lambda x: F.struct(x["parent"].alias("parent"), F.lit("odd").alias("label"), x["ordinal"].alias("ordinal"), x["child"].alias("child"))))
    whole = _said(lambda: corpus.admit("chat", "part0", broken))
    twice = _said(lambda: corpus.admit("chat", "part0", part(3, 0).unionByName(part(3, 0))))
    again = Corpus(spark, corpus.path)
    one = lambda what, rows, item: rows.groupBy(item.alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "item", "n")
    out = one("digests", again.digests("conversation"), F.concat_ws("/", "batch", "mode"))
    out = out.unionByName(one("shape only", again.digests(mode="shape"), F.col("world")))
    out = out.unionByName(one("graphs", again.graphs("chat/1", "chat"), F.col("batch")))
    out = out.unionByName(one("named", again.graphs(selector="::=3"), F.col("name")))
    out = out.unionByName(one("artifacts", again.table("artifacts"), F.concat_ws("/", "label", "origin")))
    ids = again.table("artifacts").filter(F.col("artifact_id") == F.when(F.col("label") == "part0", artifact_id("chat", "part0")).otherwise(artifact_id("chat", "part1")))
    out = out.unionByName(one("artifact ids", ids, F.lit(str(len(origin_hash("x"))))))
    told = [("said", f"{refused}, {whole}, {twice}", 1), ("recipe", "+".join(again.declarations.require("chat/1").fills()), len(again.declarations.known))]
    return out.unionByName(spark.createDataFrame(told, "what string, item string, n long"))


def _geography(spark: SparkSession, sf: str, name: str) -> Corpus:
    corpus = Corpus(spark, f"{Scratch(spark, name).path}/corpus")
    units = p.geography_unit(_table(spark, sf, "region"), _table(spark, sf, "nation"), _table(spark, sf, "supplier"))
    units = Scratch(spark, name).write(units, "units")
    corpus.declare(infer_declaration(units.withColumn("gid", F.col("name")), "geo/1"))
    corpus.admit("world", "all", units)
    return corpus


def assertions_life(spark: SparkSession, sf: str) -> DataFrame:
    """Claims and an attestation about the regions: listed once each, closed under their conditions, looked up and refused."""
    corpus = _geography(spark, sf, "assertions")
    of = lambda n: f"world::={n}"
    same = lambda a, b, **how: corpus.claim("geography", "shape", "all", "same", of(a), of(b), ("proof", [("by", "hand")]), **how)
    root = bytes(32)
    first, again, when = same(0, 1, note="a"), same(0, 1, note="b"), same(1, 2, assumptions=root)
    corpus.attest("geography", "shape", "all", "checked", of(0), ("run", []))
    claims = corpus.claims()
    some = claims.filter("assumptions is null").first()
    index = q.facet_index(corpus.digests("geography", "shape"), "all")
    rows = [("claim ids", str(first == again) + str(first != when), 1)]
    for what, assume in (("alone", ()), ("assuming", (root,))):
        found, rests_on = c.gated_lookup(index, claims, bytes(some["facet_id"]), bytes(some["left"]), assume)
        seen = {r["via"]: r["n"] for r in found.groupBy("via").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows += [("direct", what, seen.get("direct", 0)), ("through claims", what, seen.get("claims", 0)), ("rests on", what, rests_on.count())]
        rows.append(("classes", what, corpus.bucket("geography", "shape", "all", claims=True, assume=assume, min_size=1)[0].count()))
    rows.append(("checked", "geography", corpus.bucket("geography", "shape", "all", require="checked", min_size=1)[1].first()["excluded"]))
    rows += [(r["kind"], r["what"], r["n"]) for r in corpus.assertions().groupBy("kind", "what").agg(F.count(F.lit(1)).alias("n")).collect()]
    side = (bytes(some["facet_id"]), bytes(some["left"]))
    refusals = {
        "several": lambda: q.resolve_one(corpus.digests("geography", "shape"), "world"),
        "none": lambda: q.resolve_one(corpus.digests("geography", "shape"), "::=none"),
        "another facet": lambda: c.claim("same", side, (bytes(32), side[1]), ("x", [])),
        "another index": lambda: c.gated_lookup(index, claims, bytes(32), side[1]),
        "a newer version": lambda: c.supported(claims.withColumn("schema_version", F.lit(wire.CLAIMS_SCHEMA + 1))),
    }
    rows += [("refused", f"{what}: {_said(step)}", 1) for what, step in refusals.items()]
    return spark.createDataFrame(rows, "what string, item string, n long")


def stored_view(spark: SparkSession, sf: str) -> DataFrame:
    """A view of the regions, stored twice over: its graphs are there once, under one batch."""
    corpus = _geography(spark, sf, "viewed")
    view = parse_view(NATIONS_VIEW)
    corpus.materialise(view, unit="geography")
    shown = Scratch(spark, "viewed").write(corpus.materialise(parse_view("# the same, in other words\n" + NATIONS_VIEW.replace("structure, names", "names ,structure"))), "rows")
    stored = corpus.digests(f"view:{view.name}").groupBy("name").agg(F.count(F.lit(1)).alias("digests"), F.count_distinct("batch").alias("batches"), F.count_distinct("recipe").alias("recipes"))
    graphs = corpus.graphs(view.output_recipe()).groupBy("name").agg(F.count(F.lit(1)).alias("graphs"))
    whole = shown.filter("length(identity_address) = 64 and length(shape_address) = 64 and identity_address <> shape_address").select("name", "output_nodes")
    return whole.join(stored, "name").join(graphs, "name")


def root_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The set root of the SHA-256 digests of the regions' keys 0 to 4, by both plans."""
    leaves = _table(spark, sf, "region").filter("r_regionkey between 0 and 4").select(F.unhex(F.sha2(F.col("r_regionkey").cast("string").cast("binary"), 256)).alias("d"))
    rows = [(plan, made.hex(), n) for plan, (made, n) in (("alone", set_root(leaves.unionByName(leaves), "d")), ("blocks", set_root(leaves, "d", alone=1, block=2)))]
    return spark.createDataFrame(rows, "plan string, root string, leaves long")


def collision_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customers named by segment and nation: names that agree without their number get numbers in a fixed order."""
    people = _table(spark, sf, "customer").select(F.lit("shape").alias("mode"), F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("graph_key"), F.lit("b").alias("batch"), F.create_map(F.lit("structure"), F.col("c_custkey").cast("string").cast("binary")).alias("digests"))
    return q.picked(people).select("key", F.col("digests")["structure"].cast("string").cast("long").alias("customer"))


def diff_named(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of two selections, of names that hold a 7 only."""
    digest = lambda x: F.create_map(F.lit("structure"), F.unhex(F.sha2(x.cast("string").cast("binary"), 256)))
    parts = _table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").cast("string").alias("graph_key"), F.lit("shape").alias("mode"), F.lit("b").alias("batch"), F.lit("part").alias("population"), "p_partkey", "p_size")
    left = parts.withColumns({"side": F.lit("l"), "digests": digest(F.col("p_size"))})
    right = parts.filter("p_partkey % 5 <> 0").withColumns({"side": F.lit("r"), "digests": digest(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))})
    out = q.diff(left.unionByName(right), "part", F.col("side") == "l", F.col("side") == "r", name="7")
    return out.filter("dimension in ('-', 'structure')").select("name", "a", "b", "same")


# --- references, records, tables, errors -----------------------------------------------------------------------------


def uris_read_back(spark: SparkSession, sf: str) -> DataFrame:
    hashed = lambda x: F.unhex(F.sha2(x.cast("string").cast("binary"), 256))
    made = _table(spark, sf, "orders").select("o_orderkey", r.uri_column(hashed(F.col("o_orderstatus")), F.lit("names"), hashed(F.col("o_orderkey"))).alias("uri"))
    wrong = F.when(F.col("o_orderkey") % 4 == 0, F.upper("uri")).when(F.col("o_orderkey") % 4 == 1, F.concat("uri", F.lit(":x"))).otherwise(F.col("uri"))
    return made.select("o_orderkey", "uri", F.lower(F.hex(r.parse_uri_column(wrong)["digest"])).alias("digest"))


def fingerprints_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Digest rows as JSON records, read again by the codec."""
    hashed = lambda x: F.unhex(F.sha2(x.cast("string").cast("binary"), 256))
    key = p.graph_key("nation", "geo", F.col("n_nationkey"), "one")
    text = r.fingerprint_column(key, hashed(F.lit("policy")), F.create_map(F.lit("names"), hashed(F.col("n_name")), F.lit("structure"), hashed(F.col("n_regionkey"))), F.col("n_nationkey").cast("long"))
    back = F.udf(lambda t: (lambda x: (x["graph_key"].split(SEP)[2], bytes(x["digests"]["names"]).hex(), x["node_count"], r.fingerprint(x) == t))(r.parse_fingerprint(t)), "key string, names string, nodes long, same boolean")
    return _table(spark, sf, "nation").select(back(text).alias("x")).select("x.*")


def table_regions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "region").select("r_regionkey", "r_name", F.unhex(F.lpad(F.hex("r_regionkey"), 2, "0")).alias("raw")).orderBy("r_regionkey")
    return spark.createDataFrame(list(enumerate(table_lines(rows))), "line long, shown string")


def verified_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """A path through each nation's region, region by region: mappings of its canonical form, and of a wrong one."""
    found = []
    for region in sorted(x["r_regionkey"] for x in _table(spark, sf, "region").collect()):
        graph = ([str(v % 2) for v in range(region + 3)], [(v, v + 1, "next") for v in range(region + 2)])
        made = canonicalise(graph)
        right = (made["labels"], made["edges"])
        turned = [made["mapping"][-1], *made["mapping"][1:-1], made["mapping"][0]]
        found.append((region, verify(graph, right, made["mapping"]), verify(graph, right, turned), verify(graph, right, made["mapping"][:-1]), verify((graph[0], graph[1] * 2), right, made["mapping"])))
    return spark.createDataFrame(found, "region int, own boolean, turned boolean, shorter boolean, doubled boolean")


def error_kinds(spark: SparkSession, sf: str) -> DataFrame:
    from prismgraph.functions import encode as e
    from prismgraph.operators.kernel import Graph, check_acyclic, hash_graphs
    from prismgraph.sources.units import name, parse_graph

    lone = Graph({"entity:a": ("k", [])}, [("entity:a", "l", 0, "entity:a")], [])
    key = node_key_json(f"entity:a{SEP}b{SEP}c")
    other = node_key_json(f"entity:a{SEP}b{SEP}d")
    hashed = hash_graphs([(Graph({"entity:a": ("k", [])}, [], []), "x/1", "free", ("structure",))])[0]
    steps = {
        "empty text": lambda: name("", "x"),
        "separator": lambda: name(SEP, "x"),
        "no dimension": lambda: e.facet_id(bytes(32), ()),
        "digest": lambda: r.digest_bytes("AB"),
        "version": lambda: e.policy_id("x", "free", 9),
        "node key": lambda: parse_graph({"graph_key": graph_key_json(f"a{SEP}b{SEP}c{SEP}d"), "nodes": [[key, {"key": other, "kind": "k"}]]}),
        "missing node": lambda: Graph({}, [("x", "l", 0, "y")], []).index(),
        "cycle": lambda: check_acyclic(lone.index(), False),
        "dimension": lambda: hashed.address(("structure", "types")),
        "reference": lambda: r.parse_uri("x:y"),
        "record version": lambda: r.parse_fingerprint('{"schema_version": 9}'),
    }
    return spark.createDataFrame([(what, _said(step)) for what, step in steps.items()], "what string, error string")


QUERIES = {
    f.__name__: f
    for f in (
        units_read_back, refused_lines, json_documents, built_graphs, checked_rules, check_summary, closing_nodes, cycle_members, declared, collection_life, assertions_life, stored_view, root_regions, collision_names, diff_named,
        uris_read_back, fingerprints_read_back, table_regions, verified_mappings, error_kinds,
    )
}

_N = "n as (select o_orderkey, any_value(o_orderstatus) as status, any_value(o_orderpriority) as priority, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)"
#: For each changed order: the problem, how often it is found in it.
_BREAKS = f"""{_N}, b(o_orderkey, problem, k) as (
    select o_orderkey, 'field `status` occurs 0 times, declared One', 1 from n where o_orderkey % 12 = 0
    union all select o_orderkey, 'kind `parcel` is not declared', 1 from n where o_orderkey % 12 = 1
    union all select o_orderkey, '`parcel` may not have children labelled `line`', n from n where o_orderkey % 12 = 1
    union all select o_orderkey, '`parcel` may not be a root', 1 from n where o_orderkey % 12 = 1
    union all select o_orderkey, 'field `priority` is in constants, not a declared dimension', 1 from n where o_orderkey % 12 = 2
    union all select o_orderkey, 'field `status` holds Bytes, declared Text', 1 from n where o_orderkey % 12 = 3
    union all select o_orderkey, '`order` may not have children labelled `part`', n from n where o_orderkey % 12 = 4
    union all select o_orderkey, (n + 1) || ' roots, declared exactly one', 1 from n where o_orderkey % 12 = 5 and n > 0
    union all select o_orderkey, '`line` may not be a root', n from n where o_orderkey % 12 = 5
    union all select o_orderkey, 'edge `order` -previous-> `order` (control) is not declared', 1 from n where o_orderkey % 12 = 6
    union all select o_orderkey, 'edge `order` -selfish-> `order` (data) is not declared', 1 from n where o_orderkey % 12 = 6
    union all select o_orderkey, case when n > 0 then 'child is not a node of the graph' else '0 roots, declared exactly one' end, 1 from n where o_orderkey % 12 = 7
    union all select o_orderkey, 'node key occurs 2 times', 1 from n where o_orderkey % 12 = 8
    union all select o_orderkey, 'children -line-> have ordinals [3' || repeat(', 3', n - 1) || '], declared Set', 1 from n where o_orderkey % 12 = 9 and n > 0
    union all select o_orderkey, 'field `status` occurs 2 times, declared One', 1 from n where o_orderkey % 12 = 10
    union all select o_orderkey, 'field `urgency` is not declared on `order`', 1 from n where o_orderkey % 12 = 11
    union all select o_orderkey, 'field `priority` occurs 0 times, declared One', 1 from n where o_orderkey % 12 = 11)"""
_ASKED = "('direct', 'alone', 1), ('through claims', 'alone', 1), ('rests on', 'alone', 1), ('classes', 'alone', 4), ('direct', 'assuming', 1), ('through claims', 'assuming', 2), ('rests on', 'assuming', 2), ('classes', 'assuming', 3)"
#: Fixed value: the root of these five digests, as an independent implementation of the hash has it (tests/test_root.py).
REGIONS_ROOT = "86f36fa63507338a6886e323996af54afee191c904d54726ccdd60bb1c3ae404"


def _values(columns: str, *rows: tuple) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"select * from (values {', '.join('(' + ', '.join(map(quoted, row)) + ')' for row in rows)}) v({columns})"


ORACLE = {
    "units_read_back": """select o_orderkey::varchar as name, any_value(o_orderstatus) as status, (1 + count(l_orderkey))::int as nodes, count(l_orderkey)::int as children,
        coalesce(sum(round(l_quantity * 100)), 0)::bigint as hundredths from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""",
    "refused_lines": "select n_nationkey::int as nation, case n_nationkey % 8 " + " ".join(f"when {i} then '{said or ''}'" for i, (said, _) in enumerate(DEFECTS)) + " end as problem from nation",
    "json_documents": """with n as (select count(*) as n, count(distinct c_mktsegment) as s from customer)
        select 'object' as kind, 2 * n as nodes, 0::bigint as texts from n union all select 'text', n, s from n union all select 'list', n, 0 from n
        union all select 'number', 2 * n, 0 from n union all select 'none', n, 0 from n union all select 'flag', n, 0 from n""",
    "built_graphs": "select r_name, case r_regionkey when 0 then 'DuplicateNode' when 1 then 'MissingNode' when 2 then 'EdgeFields' when 3 then 'EmptyName' when 4 then 'InvalidName' end as error from region where r_regionkey < 5",
    "checked_rules": f"with {_BREAKS} select problem, sum(k)::bigint as violations, count(distinct o_orderkey) as units from b where k > 0 group by problem",
    "check_summary": f"with {_BREAKS} select (select count(*) from orders) as checked, count(distinct o_orderkey) as broken from b where k > 0",
    "closing_nodes": "select s_suppkey::bigint as supplier, case s_suppkey % 3 when 0 then 'd' else 'c' end as node, 'cycle through' as problem from supplier where s_suppkey % 3 <> 1",
    "cycle_members": """select s_nationkey::bigint as nation, s_suppkey || '/' || x as node from supplier, (values (0, 'b'), (0, 'c'), (0, 'd'), (0, 'e'), (2, 'c')) v(k, x) where s_suppkey % 3 = k""",
    "declared": _values(
        "what, said", ("fills", "structure+names+constants"), ("status is in", "structure"), ("names has priority", "True"), ("names has status", "False"), ("reads back", "True"), ("a kind twice", "True"), ("a child group twice", "True"),
        ("an undeclared root", "True"), ("an odd acyclicity", "True"), ("the same again", ""), ("another under its name", "CatalogError"), ("an unknown recipe", "CatalogError"),
    ),
    "collection_life": """with c as (select distinct conv_id from conversations), k as (select conv_id, case when conv_id % 3 = 0 then 'part0' else 'part1' end as part from c where conv_id % 3 = 0 or conv_id % 6 = 1)
        select 'digests' as what, 'chat:' || part || '/' || mode as item, count(*) as n from k, (values ('identity'), ('shape')) m(mode) group by part, mode
        union all select 'shape only', 'chat', count(*) from k
        union all select 'graphs', 'chat:' || part, count(*) from k group by part
        union all select 'named', '3', count(*) from k where conv_id = 3 having count(*) > 0
        union all select 'artifacts', s || '/' || substr(sha256(s), 1, 8), 1 from (values ('part0'), ('part1'), ('part2')) v(s)
        union all select 'artifact ids', '8', 2
        union all select 'said', 'BrokenUnits, BrokenUnits, CatalogError', 1
        union all select 'recipe', 'structure+names+constants', 1""",
    "assertions_life": f"""select what, item, n::bigint as n from (values ('claim ids', 'TrueTrue', 1), {_ASKED}, ('checked', 'geography', 4), ('claim', 'same', 2), ('attestation', 'checked', 1),
        ('refused', 'several: CatalogError', 1), ('refused', 'none: CatalogError', 1), ('refused', 'another facet: ClaimError', 1), ('refused', 'another index: LookupFacetMismatch', 1), ('refused', 'a newer version: ClaimError', 1)) v(what, item, n)""",
    "stored_view": "select r_regionkey::varchar as name, (1 + count(n_nationkey))::int as output_nodes, 2::bigint as digests, 1::bigint as batches, 1::bigint as recipes, 1::bigint as graphs from region join nation on n_regionkey = r_regionkey group by r_regionkey",
    "root_regions": f"select * from (values ('alone', '{REGIONS_ROOT}', 5::bigint), ('blocks', '{REGIONS_ROOT}', 5::bigint)) v(plan, root, leaves)",
    "collision_names": """with p as (select c_mktsegment as norm, c_mktsegment || '_' || c_nationkey as name, c_custkey, count(*) over (partition by c_mktsegment) as n,
            row_number() over (partition by c_mktsegment order by c_mktsegment || '_' || c_nationkey, c_custkey) as i from customer)
        select case when n = 1 then norm when i = 1 then name else name || '#' || i end as key, c_custkey::bigint as customer from p""",
    "diff_named": """with p as (select p_partkey, p_partkey::varchar as name, substr(sha256(p_size::varchar), 1, 16) as a, substr(sha256((p_size + (p_partkey % 3 = 0)::int)::varchar), 1, 16) as b from part where p_partkey::varchar like '%7%')
        select name, case when p_partkey % 5 = 0 then 'present' else a end as a, case when p_partkey % 5 = 0 then 'absent' else b end as b, case when p_partkey % 5 <> 0 and a = b then '=' else 'DIFF' end as same from p""",
    "uris_read_back": f"""select o_orderkey, '{wire.MAGIC}:{wire.SCHEMA_VERSION}:' || sha256(o_orderstatus) || ':names:' || sha256(o_orderkey::varchar) as uri,
        case when o_orderkey % 4 > 1 then sha256(o_orderkey::varchar) end as digest from orders""",
    "fingerprints_read_back": "select n_nationkey::varchar as key, sha256(n_name) as names, n_nationkey::bigint as nodes, true as same from nation",
    "table_regions": """with w as (select greatest(max(length(r_name)), 6) as w from region)
        select 0::bigint as line, 'r_regionkey  ' || rpad('r_name', w::int, ' ') || '  raw' as shown from w
        union all select row_number() over (order by r_regionkey), rpad(r_regionkey::varchar, 11, ' ') || '  ' || rpad(r_name, w::int, ' ') || '  ' || lpad(lower(to_hex(r_regionkey)), 2, '0') from region, w""",
    "verified_mappings": "select r_regionkey::int as region, true as own, false as turned, false as shorter, false as doubled from region",
    "error_kinds": _values(
        "what, error", ("empty text", "EmptyName"), ("separator", "InvalidName"), ("no dimension", "EmptyFacet"), ("digest", "InvalidDigest"), ("version", "UnsupportedVersion"), ("node key", "NodeKeyMismatch"), ("missing node", "MissingNode"),
        ("cycle", "CycleDetected"), ("dimension", "MissingDimension"), ("reference", "InvalidReference"), ("record version", "UnsupportedVersion"),
    ),
}
