import json

import pytest
from graphs import LEFT, RIGHT, document, hashed, line, named
from pyspark.sql import functions as F

from prismgraph import wire
from prismgraph.errors import BrokenUnits, CatalogError, ClaimError, LookupFacetMismatch, RootMismatch, ViewError
from prismgraph.functions import encode as e
from prismgraph.operators import claims as c
from prismgraph.operators import queries as q
from prismgraph.operators.check import check_units, infer_declaration
from prismgraph.operators.merkle import set_root
from prismgraph.plans.declaration import Declarations, parse_declaration
from prismgraph.plans.view import apply_view, parse_view
from prismgraph.sources.builder import JSON, KINDS
from prismgraph.sources.corpus import Corpus, artifact_id
from prismgraph.sources.units import UNIT, parse_unit, read_units, to_graph, unit_json as render, write_units

DECLARED = json.loads(JSON.to_json())


def lines(path, units):
    path.write_text("\n".join(u if isinstance(u, str) else json.dumps(u) for u in units) + "\n\n")
    return str(path)


@pytest.fixture
def corpus(spark, tmp_path):
    out = Corpus(spark, f"file://{tmp_path}/corpus")
    out.declare(JSON)
    for world, docs in (("left", LEFT), ("right", RIGHT)):
        out.admit_files(world, [lines(tmp_path / f"{world}.jsonl", [document(n, x, world) for n, x in docs])])
    return out


def groups(found):
    return {r["members"]: (r["size"], r["artifacts"]) for r in found[0].collect()}


def test_end_to_end(spark, corpus, tmp_path):
    want = {"all": ["invoice"], "names-blind": ["invoice", "ticket"], "structure": ["invoice", "profile", "ticket"]}
    for facet, names in want.items():
        assert groups(corpus.bucket("document", "shape", facet)) == {n: (2, 2) for n in names}
    with pytest.raises(CatalogError, match="does not fill dimension types"):
        corpus.bucket("document", "shape", "types")[0].collect()
    with pytest.raises(CatalogError, match="nothing was admitted"):
        corpus.bucket("other", "shape", "all")
    summary = corpus.bucket("document", "shape", "all")[1].first()
    assert (summary["considered"], summary["classes"], round(summary["dedup_percent"], 3), summary["excluded"]) == (6, 5, 16.667, 0)

    root = corpus.root()
    assert (root["rows"], root["addresses"]) == (12, 11)  # bound keys name their world, so only free keys meet
    corpus.admit_files("right", [str(tmp_path / "right.jsonl")])  # again: replaced, not added
    assert corpus.root(check=root["root"]) == root
    with pytest.raises(RootMismatch):
        corpus.root(check="00" * 32)

    shared, total = corpus.overlap("document", "shape", "names-blind", "left", "right")
    assert sorted(r["a_names"][0] for r in shared.collect()) == ["invoice", "ticket"]
    assert total.first()["jaccard"] == 0.5
    rows = {(r["name"], r["mode"], r["dimension"]): r["same"] for r in corpus.diff("document", "left", "right").collect()}
    assert rows["ticket", "shape", "names"] == "DIFF" and rows["ticket", "shape", "structure"] == "=" and rows["profile", "shape", "types"] == "="
    with pytest.raises(CatalogError, match="no matching rows"):
        corpus.diff("document", "nowhere", "elsewhere")

    index = q.facet_index(corpus.digests("document", "shape"), "structure")
    assert sorted(r["graphs"] for r in q.index_sizes(index).collect()) == [1, 1, 1]  # graph keys pair units across worlds
    with pytest.raises(CatalogError):
        q.digest_index(corpus.digests(), bytes(32))


def test_all_or_nothing_and_scopes(spark, corpus, tmp_path):
    bad = json.loads(document("invoice", {"a": 1}, "left"))
    bad["graph"]["nodes"][1][1]["fields"][0]["name"] = "wrong"
    before = corpus.root()
    with pytest.raises(BrokenUnits, match="wrong"):
        corpus.admit_files("left", [lines(tmp_path / "bad.jsonl", [document("fine", 1, "left"), bad])])
    with pytest.raises(CatalogError, match="two units"):
        corpus.admit_files("left", [lines(tmp_path / "twice.jsonl", [document("x", 1, "left"), document("x", 2, "left")])])
    other = json.loads(document("x", 1, "left")) | {"recipe": "unknown/1"}
    with pytest.raises(CatalogError, match="no declaration for recipe unknown/1"):
        corpus.admit_files("left", [lines(tmp_path / "other.jsonl", [other])])
    assert corpus.root() == before
    lines(tmp_path / "right.jsonl", [])
    corpus.admit_files("right", [str(tmp_path / "right.jsonl")])  # an empty batch takes its rows away
    assert corpus.digests().select("world").distinct().collect()[0]["world"] == "left"
    again = Corpus(spark, corpus.path)  # declarations are stored
    assert again.declarations.require("json/1").fills() == ("structure", "names", "constants")
    with pytest.raises(CatalogError, match="different declaration"):
        again.declare(parse_declaration(DECLARED | {"single_root": False}))


def test_claims_and_attestations(spark, corpus):
    made = corpus.claim("document", "shape", "names-blind", "equivalent", "left::=profile", "right::=profile", ("proof", [("by", "hand")]), "a note")
    assert groups(corpus.bucket("document", "shape", "names-blind", claims=True)) == {n: (2, 2) for n in ("invoice", "profile", "ticket")}
    assert groups(corpus.bucket("document", "shape", "all", claims=True)) == {"invoice": (2, 2)}  # another facet
    assert groups(corpus.bucket("document", "shape", "names-blind")) == {n: (2, 2) for n in ("invoice", "ticket")}
    corpus.attest("document", "shape", "names-blind", "checked", "left::=invoice", ("run", []))
    found, summary = corpus.bucket("document", "shape", "names-blind", require="checked")
    assert groups((found, None)) == {"invoice": (2, 2)} and summary.first()["excluded"] == 4
    assert {r["kind"] for r in corpus.assertions().collect()} == {"claim", "attestation"}
    with pytest.raises(CatalogError, match="several"):
        corpus.attest("document", "shape", "names-blind", "checked", "left", ("run", []))
    with pytest.raises(CatalogError, match="no row"):
        corpus.attest("document", "shape", "names-blind", "checked", "zzz", ("run", []))
    index = q.facet_index(corpus.digests("document", "shape"), "names-blind")
    row = corpus.claims().first()
    found, rests_on = c.gated_lookup(index, corpus.claims(), bytes(row["facet_id"]), bytes(row["left"]))
    assert sorted(r["via"] for r in found.collect()) == ["claims", "direct"] and [bytes(r[0]) for r in rests_on.collect()] == [made]
    with pytest.raises(LookupFacetMismatch):
        c.gated_lookup(index, corpus.claims(), bytes(32), bytes(row["left"]))


def test_claim_ids_and_conditions(spark):
    facet, a, b, d, root = (bytes([i]) * 32 for i in range(1, 6))
    witness = ("proof", [("k", "v"), ("l", "w")])
    plain = c.claim("eq", (facet, a), (facet, b), witness)
    assert plain["claim_id"] == c.claim("eq", (facet, a), (facet, b), witness, note="other")["claim_id"]
    assert plain["claim_id"] != c.claim("eq", (facet, a), (facet, b), ("proof", witness[1][::-1]))["claim_id"]
    when = c.claim("eq", (facet, b), (facet, d), witness, assumptions=root)
    elsewhere = c.claim("eq", (a, b), (a, d), witness)
    table = c.claims_table(spark, [plain, plain, when, elsewhere])
    assert table.count() == 3
    with pytest.raises(ClaimError):
        c.claim("eq", (facet, a), (a, b), witness)
    rows = spark.createDataFrame([(facet, x) for x in (a, b, d)], "facet_id binary, address binary")
    classes = lambda *assume: {bytes(r["address"]): bytes(r["class"]) for r in c.with_representative(rows, table, assume).collect()}
    assert classes() == {a: a, b: a, d: d}
    assert classes(root) == {a: a, b: a, d: a}
    with pytest.raises(ClaimError):
        c.supported(table.withColumn("schema_version", F.lit(9)))


def test_check_lists_what_is_wrong(spark):
    value = {"a": [1, "x"], "b": None}
    good = parse_unit(document("d", value, "w"))

    def wrong(change):
        x = json.loads(document("d", value, "w"))
        at = {tuple(n["key"]["entity"]["local"].split("/")[1:]): n for _, n in x["graph"]["nodes"]}
        change(x["graph"], at)
        return parse_unit(json.dumps(x))

    cases = {
        "kind `odd` is not declared": lambda g, at: at["b",].update(kind="odd"),
        "field `whole` is not declared on `text`": lambda g, at: at["a", "1"].update(fields=at["a", "0"]["fields"]),
        "field `text` occurs 0 times, declared One": lambda g, at: at["a", "1"].update(fields=[]),
        "field `key` is in types, not a declared dimension": lambda g, at: at["b",]["fields"][0].update(dimension="types"),
        "field `key` holds U64, declared Text": lambda g, at: at["b",]["fields"][0].update(value={"kind": "u64", "value": 2**64 - 1}),
        "field `key` occurs 2 times, declared Optional": lambda g, at: at["b",].update(fields=at["b",]["fields"] * 2),
        "`object` may not have children labelled `item`": lambda g, at: [c.update(label="item") for c in g["children"] if c["label"] == "member"],
        "children -item-> have ordinals [0, 2], declared Seq": lambda g, at: [c.update(ordinal=2) for c in g["children"] if c["ordinal"] == 1],
        "children -member-> have ordinals [0, 1], declared Set": lambda g, at: next(c for c in g["children"] if c["label"] == "member").update(ordinal=1),
        "2 roots, declared exactly one": lambda g, at: g["children"].remove(next(c for c in g["children"] if c["label"] == "member")),
        "edge `list` -e-> `none` (data) is not declared": lambda g, at: g["edges"].append({"source": at["a",]["key"], "label": "e", "target": at["b",]["key"], "role": "data"}),
        "child is not a node of the graph": lambda g, at: g["nodes"].remove([at["b",]["key"], at["b",]]),
        "only origin edges may hold fields": lambda g, at: g["edges"].append({"source": at["a",]["key"], "label": "e", "target": at["b",]["key"], "role": "data", "fields": at["b",]["fields"]}),
    }
    units = [good | {"gid": "good"}] + [wrong(f) | {"gid": f"{i}"} for i, f in enumerate(cases.values())]
    units += [{**good, "gid": "twice", "nodes": good["nodes"] + good["nodes"][:1]}, {**good, "gid": "other", "recipe": "other/1"}, {**good, "gid": "none", "nodes": [], "children": []}]
    found = check_units(spark.createDataFrame(units, f"gid string, {UNIT}"), {"json/1": JSON})
    by = {}
    for r in found.collect():
        by.setdefault(r["gid"], set()).add(r["problem"])
    assert "good" not in by and by["twice"] == {"node key occurs 2 times"} and by["other"] == {"no declaration for recipe other/1"} and by["none"] == {"0 roots, declared exactly one"}
    for i, problem in enumerate(cases):
        assert problem in by[f"{i}"], (problem, by.get(f"{i}"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_cycles_are_found_and_what_lies_between_them_is_not_one(spark):
    from prismgraph.operators.check import cyclic_nodes, on_cycles

    nodes = {x: ("list", []) for x in "abcde"}
    arcs = [("b", "c"), ("c", "b"), ("c", "a"), ("a", "d"), ("d", "e"), ("e", "d")]
    units = [parse_unit(line("json/1", nodes, [(s, "item", 0, t) for s, t in arcs])) | {"gid": "g"}]
    problems = {r["problem"]: r["at"] for r in check_units(spark.createDataFrame(units, f"gid string, {UNIT}"), {"json/1": JSON}).collect()}
    assert [at[-1] for p, at in problems.items() if "cycle" in p] == ["d"]
    assert on_cycles(arcs) == set("bcde") and on_cycles([("x", "x"), ("x", "y")]) == {"x"} and on_cycles([]) == set()
    table = spark.createDataFrame([("g", s, t) for s, t in [*arcs, ("z", "b"), ("e", "y"), ("y", "w")]] + [("h", "a", "b")], "gid string, s string, t string")
    assert sorted(tuple(r) for r in cyclic_nodes(table).collect()) == [("g", x) for x in "bcde"]


def test_infer(spark):
    rows = [parse_unit(document(n, x, "w")) | {"gid": n} for n, x in LEFT]
    units = spark.createDataFrame(rows, f"gid string, {UNIT}")
    made = infer_declaration(units, "json/1")
    assert made.single_root and made.roots == ("object",) and [k for k, _ in made.kinds] == [k for k in KINDS if k != "none"]
    assert {(x.parents, x.label, x.shape) for x in made.children} == {(("list",), "item", "seq"), (("object",), "member", "set")}
    assert check_units(units, {"json/1": made}).isEmpty()
    assert parse_declaration(made.to_json()) == made


def test_declarations():
    registry = Declarations()
    registry.declare(JSON)
    assert parse_declaration(JSON.to_json()) == JSON
    assert registry.require("json/1").field_dimensions("flag", "flag") == ("constants",) and registry.require("json/1").field_dimensions("flag", "x") is None
    assert registry.require("json/1").declares_field("names", "key") and not registry.require("json/1").declares_field("types", "key")
    with pytest.raises(CatalogError, match="no declaration"):
        registry.require("other")
    for bad in (DECLARED | {"roots": ["odd"]}, DECLARED | {"kinds": DECLARED["kinds"] * 2}, DECLARED | {"children": DECLARED["children"] * 2}, DECLARED | {"acyclic": "maybe"}, {"recipe": "x"}):
        with pytest.raises(CatalogError):
            parse_declaration(json.dumps(bad))


def test_units_round_trip_and_refusals(spark, tmp_path):
    units = [json.loads(document(n, x, "left")) | {"status": "provisional"} for n, x in LEFT]
    first = units[0]["graph"]
    first["edges"].append({"source": first["nodes"][0][0], "label": "from", "target": {"derived": {"owner": {"kind": "k", "owner": "o", "local": "l"}, "local": "t"}}, "role": "origin", "fields": [{"dimension": "types", "name": "b", "value": {"kind": "bytes", "value": [0, 255]}}]})
    made = first["edges"][0]["target"]
    first["nodes"].append([made, {"key": made, "kind": "d", "fields": [{"dimension": "constants", "name": "i", "value": {"kind": "i64", "value": -42}}, {"dimension": "constants", "name": "t", "value": {"kind": "bool", "value": True}}]}])
    for u in units:
        again = json.loads(render(parse_unit(json.dumps(u))))
        assert parse_unit(json.dumps(again)) == parse_unit(json.dumps(u))
    read = read_units(spark, lines(tmp_path / "u.jsonl", units))
    assert read.count() == 3
    write_units(read, str(tmp_path / "out"))
    assert sorted(r["name"] for r in read_units(spark, str(tmp_path / "out")).collect()) == ["invoice", "profile", "ticket"]
    assert to_graph(parse_unit(json.dumps(units[1]))).index().keys
    path = tmp_path / "bad.jsonl"
    for change in ({"extra": 1}, {"recipe": ""}, {"status": "odd"}, {"population": "a\x1fb"}):
        path.write_text(json.dumps(units[1]) + "\n\n" + json.dumps(units[2] | change))
        with pytest.raises(CatalogError, match="line 3"):
            read_units(spark, str(path))
    twice = json.loads(document("x", 1, "l"))
    twice["graph"]["nodes"] *= 2
    for bad in ("{", "[]", json.dumps(twice)):
        with pytest.raises(CatalogError):
            parse_unit(bad)


def test_builder_checks_each_step():
    from prismgraph.errors import DuplicateNode, EdgeFields, EmptyName, MissingNode
    from prismgraph.sources.builder import GraphBuilder, fact

    g = GraphBuilder("a\x1fb\x1fc\x1fd")
    g.node("entity:x", "k")
    for error, step in (
        (DuplicateNode, lambda: g.node("entity:x", "k")),
        (EmptyName, lambda: g.node("entity:y", "")),
        (MissingNode, lambda: g.field("entity:z", "names", "n", "text", "v")),
        (MissingNode, lambda: g.child("entity:x", "l", 0, "entity:z")),
        (MissingNode, lambda: g.edge("entity:z", "l", "entity:x", "data")),
        (EdgeFields, lambda: g.edge("entity:x", "l", "entity:x", "data", (fact("names", "n", "text", "v"),))),
        (CatalogError, lambda: g.child("entity:x", "l", 2**32, "entity:x")),
        (CatalogError, lambda: g.edge("entity:x", "l", "entity:x", "odd")),
        (CatalogError, lambda: g.field("entity:x", "names", "n", "u64", -1)),
    ):
        with pytest.raises(error):
            step()
    g.edge("entity:x", "l", "entity:x", "origin", (fact("names", "n", "text", "v"),))
    unit = g.unit("r/1", "p", "n")
    assert len(unit["nodes"]) == len(unit["edges"]) == 1 and not unit["children"]


def test_references_and_fingerprints(spark):
    from prismgraph.errors import InvalidDigest, InvalidReference, UnsupportedVersion
    from prismgraph.sources import records as r

    policy, digest = bytes(range(32)), bytes(range(100, 132))
    text = r.uri(policy, "types", digest)
    assert r.parse_uri(text) == (wire.SCHEMA_VERSION, policy, "types", digest)
    scheme, version, p, d, x = text.split(":")
    bad = {f"other:{version}:{p}:{d}:{x}": InvalidReference, f"{scheme}:v:{p}:{d}:{x}": InvalidReference, f"{scheme}:{version}:{p}:odd:{x}": InvalidReference, f"{text}:more": InvalidReference, scheme: InvalidReference, text.upper().replace(scheme.upper(), scheme).replace("TYPES", "types"): InvalidDigest, f"{scheme}:{version}:{p}:{d}:{x[1:]}": InvalidDigest, f"{scheme}:{2**32}:{p}:{d}:{x}": InvalidReference}
    for t, error in bad.items():
        with pytest.raises(error):
            r.parse_uri(t)
    got = spark.createDataFrame([(t,) for t in [text, None, *bad]], "t string").select(r.parse_uri_column(F.col("t")).alias("p")).collect()
    assert [tuple(x["p"]) if x["p"] else None for x in got] == [(wire.SCHEMA_VERSION, policy, "types", digest)] + [None] * (len(bad) + 1)
    row = {"graph_key": "k\x1fo\x1fl\x1fg", "policy_id": policy, "digests": {"types": digest, "structure": policy}, "node_count": 3}
    assert r.parse_fingerprint(r.fingerprint(row)) == row | {"schema_version": wire.SCHEMA_VERSION}
    table = spark.createDataFrame([row], "graph_key string, policy_id binary, digests map<string,binary>, node_count long")
    assert table.select(r.fingerprint_column(*map(F.col, table.columns)).alias("j")).first()["j"] == r.fingerprint(row)
    with pytest.raises(UnsupportedVersion):
        r.parse_fingerprint(r.fingerprint(row).replace('"schema_version":3', '"schema_version":4'))
    with pytest.raises(CatalogError):
        r.parse_fingerprint("{}")


def test_shown_rows(spark):
    from prismgraph.sources.table import json_lines, table_lines

    rows = spark.createDataFrame([("a", 1, b"\x01"), ("long one", None, None)], "name string, n int, d binary")
    assert list(table_lines(rows)) == ["name      n  d", "a         1  01", "long one"]
    assert json.loads("".join(json_lines(rows))) == [{"name": "a", "n": "1", "d": "01"}, {"name": "long one", "n": "", "d": ""}]
    assert "".join(json_lines(rows.limit(0))) == "[]"


VIEW = f"""
# comment
language "{wire.VIEW_LANGUAGE}"
view "reach/1"
input "code/1"
root child-parent "entry"
traverse children entry, insn
traverse edges dependency, data
retain structure, types
"""


def test_views(spark, tmp_path):
    nodes = {k: (kind, [("structure", "s", "text", k[0]), ("names", "n", "text", k)]) for k, kind in [("fn", "fn"), ("e", "block"), ("next", "block"), ("dead", "block"), ("i", "insn"), ("j", "insn"), ("k", "insn")]}
    children = [("fn", "entry", 0, "e"), ("fn", "block", 0, "next"), ("fn", "block", 1, "dead"), ("e", "insn", 0, "i"), ("next", "insn", 0, "j"), ("dead", "insn", 0, "k")]
    nodes = {k: (kind, [(d, n, "text", v) for d, n, _, v in facts]) for k, (kind, facts) in nodes.items()}
    unit = line("code/1", nodes, children, [("e", "jump:0", "next", "dependency"), ("j", "def", "i", "data")])
    view = parse_view(VIEW)
    shuffled = VIEW.replace("entry, insn", "insn,entry").replace("structure, types", "types\nretain structure")
    assert parse_view(shuffled).plan_id() == view.plan_id() and parse_view(VIEW.replace("insn", "arg")).plan_id() != view.plan_id()
    for bad in (VIEW.replace("retain", "keep"), VIEW + 'view "x"', VIEW.replace('"entry"', "entry"), VIEW + "erase names.n", VIEW.replace("types", "odd"), VIEW.replace("root child-parent", "root odd"), "", VIEW.replace("/1\"\nview", "/9\"\nview")):
        with pytest.raises(ViewError):
            parse_view(bad)
    corpus = Corpus(spark, f"file://{tmp_path}/v")
    corpus.declare(infer_declaration(read_units(spark, lines(tmp_path / "f.jsonl", [unit])).withColumn("gid", F.col("name")), "code/1"))
    corpus.admit_files("w", [str(tmp_path / "f.jsonl")])
    row = corpus.materialise(view).first()
    assert row["output_nodes"] == 5
    made = corpus.graphs(view.output_recipe()).first()
    assert {f["dimension"] for n in made["nodes"] for f in n["fields"]} == {"structure"}
    again = corpus.materialise(view).first()
    assert again["shape_address"] == row["shape_address"] and corpus.digests("view:reach/1").count() == 2
    erased = parse_view(VIEW + "erase structure.s")
    assert erased.plan_id() != view.plan_id()
    assert all(not n["fields"] for n in apply_view(erased, corpus.graphs("code/1")).first()["nodes"])
    with pytest.raises(ViewError, match="no roots"):
        apply_view(parse_view(VIEW.replace('"entry"', '"zzz"')), corpus.graphs("code/1"))
    with pytest.raises(CatalogError, match="no graph"):
        corpus.materialise(parse_view(VIEW.replace("code/1", "zzz")))


def test_distributed_root_equals_the_plain_one(spark):
    leaves = [e.blake3(bytes([i])) for i in range(200)] * 2
    table = spark.createDataFrame([(x,) for x in leaves], "d binary")
    assert set_root(table, "d") == (e.set_root(leaves), 200)
    assert set_root(table, "d", alone=10, block=16) == (e.set_root(leaves), 200)
    assert set_root(table.limit(0), "d") == (e.set_root([]), 0)


def test_ids_of_artifacts_and_names_on_a_line(spark):
    assert len(artifact_id("o", "p")) == 16 and artifact_id("o", "p") != artifact_id("o", "p", True) != artifact_id("op", "", True)
    cases = [(["a" * 30, "b" * 30, "c"], 3), (["x"], 1), ([], 0), (["a" * 60, "b"], 9), (["n%02d" % i for i in range(20)], 40)]
    got = [r[0] for r in spark.createDataFrame(cases, "names array<string>, total int").select(q.capped(F.col("names"), F.col("total"))).collect()]
    assert got == ["a" * 30 + " (+2)", "x", "", "a" * 60 + " (+8)", ", ".join("n%02d" % i for i in range(11)) + " (+29)"]


def test_streaming_admission(spark, tmp_path):
    from prismgraph.streaming.admission import admit_stream

    corpus = Corpus(spark, f"file://{tmp_path}/s")
    corpus.declare(JSON)
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.jsonl", [document(n, x, "w") for n, x in LEFT])
    (tmp_path / "in" / "b.jsonl").write_text("{}\n")
    admit_stream(corpus, "w", str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()
    assert corpus.digests(mode="shape").count() == 3
    assert spark.read.parquet(f"{corpus.path}/rejected").count() == 1
    lines(tmp_path / "in" / "c.jsonl", [document("more", 5, "w")])
    admit_stream(corpus, "w", str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination()
    assert corpus.digests(mode="shape").count() == 4


def test_rounds_freeze_for_each_graph_alone():
    pair = named({"x": ("fn", []), "y": ("fn", []), "leaf": ("fn", [])}, edges=[("x", "e", "y", "dependency"), ("y", "e", "x", "dependency"), ("x", "e", "leaf", "dependency")])
    from prismgraph.operators.kernel import hash_graphs

    alone = hashed(pair)
    batch = hash_graphs([(pair, "test/1", "free", wire.DIMENSIONS), (named({"q": ("z", [])}), "test/1", "free", wire.DIMENSIONS)])[0]
    assert alone.digests == batch.digests and alone.shape == batch.shape
