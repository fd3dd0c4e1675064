import random

import pytest
from graphs import SEP, TEXT, U64, golden, hashed, joint_pair, key, named

from prismgraph import wire
from prismgraph.errors import CatalogError, CycleDetected
from prismgraph.functions import encode as e
from prismgraph.functions.blake3 import blake3, blake3_many
from prismgraph.operators.exact import canonicalise, verify
from prismgraph.operators.kernel import Graph, check_acyclic, hash_graphs

# Known answers of the hash function, for input bytes i mod 251.
ANSWERS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    64: "4eed7141ea4a5cd4b788606bd23f46e212af9cacebacdc7d1f4c6dc7f2511b98",
    1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
}

# Digests of the golden graph and its policies.
GOLDEN = {
    "bound": {
        "structure": "d083167dc593169c762d7d859a37e19e061c4f65cca211fd49a43bae4017f5ab",
        "names": "823cabf1d7e8b57fd0177d88371f41cd2cd0ddde56b3275e638e4b229fb1afe8",
        "constants": "0d148f3a8ad5aa8d551582205ec00bf79b28ebd2fa0da6af108964f5fb9ce2e4",
        "types": "0b7cbb70f0931a3f07622e3360892c55a2340c44e400767831d4088dd15f6250",
        "trace_events": "f777fde3348b40fb6ac2219f4c90c1f28f37d66b335c46a753f9753335d33d4e",
    },
    "free": {
        "structure": "2d57910e4aa2dadbbe02413bdc675a38c639c02b32a2773144ac41694b97a2a9",
        "names": "df2a7dd5ae81690d2cb585bae1fa1ff63670c9e72bd44f99a60ff0ee7fa0ff48",
        "constants": "fe15af979180ce737c17ce74b1acc2fe51197bebc67238317afd25e977b9944c",
        "types": "8808d3304feb1745186865b76782e961f0ea4ef977e4dbb8c75b43ade28aa7f0",
        "trace_events": "efd463ff13c2157ca8a813519edba89ebe62007b014395bc014982989672329f",
    },
}
POLICIES = {"bound": "b2a53a46bf979ebe7ddd7060107b379244555300eae561f7facff50e8415213a", "free": "867c75215b4383e77d887c737ffa7093b9944e2d9578abd3affedaf98a398f69"}
NAMES_BLIND_FREE = "7602d6196f953298273e9e3bdafeb60be4aaac9486e10f5ec61938ffdf3b0e16"


def test_known_answers_alone_and_together():
    messages = [bytes(i % 251 for i in range(n)) for n in ANSWERS]
    assert [x.hex() for x in blake3_many(messages)] == list(ANSWERS.values())
    assert [blake3(m).hex() for m in messages] == list(ANSWERS.values())


@pytest.mark.parametrize("keys", ["bound", "free"])
def test_golden_digests(keys):
    h = hashed(golden(), keys)
    assert {d: x.hex() for d, x in h.digests.items()} == GOLDEN[keys]
    assert h.policy_id.hex() == POLICIES[keys]


def test_golden_facet_and_refusals():
    assert e.facet_id(bytes.fromhex(POLICIES["free"]), [d for d in wire.DIMENSIONS if d != "names"]).hex() == NAMES_BLIND_FREE
    for bad in (lambda: e.facet_id(bytes(32), []), lambda: e.sorted_dimensions(["nope"]), lambda: e.policy_id("r", "free", 99), lambda: e.policy_id("r", "odd")):
        with pytest.raises(CatalogError):
            bad()


def test_masks_and_joint_digests():
    a, b = hashed(joint_pair(False)), hashed(joint_pair(True))
    three = hashed(named({"p": ("call", []), "a": ("lit", [TEXT("names", "n", "x"), U64("constants", "v", 1)]), "b": ("var", [TEXT("names", "n", "y"), U64("constants", "v", 2)])}, [("p", "arg", 0, "a"), ("p", "arg", 0, "b")]))
    assert (a.mixed_pairs, b.mixed_pairs, three.mixed_pairs) == (32, 32, 19)
    assert (len(a.joint), len(b.joint), len(three.joint)) == (8, 8, 16)
    assert a.digests["names"] == b.digests["names"] and a.digests["types"] == b.digests["types"]
    assert a.address(["names", "types"]) != b.address(["names", "types"])
    assert hashed(golden()).mixed_pairs == 0


def test_one_dimension_moves_alone_and_requests_do_not_matter():
    one = lambda v: named({"b": ("body", []), "l": ("literal", [U64("constants", "value", v)])}, [("b", "expr", 0, "l")])
    x, y = hashed(one(1)), hashed(one(2))
    assert [d for d in wire.DIMENSIONS if x.digests[d] != y.digests[d]] == ["constants"]
    assert hashed(one(1), dims=("constants",)).digests["constants"] == x.digests["constants"]


def test_order_of_insertion_and_ordinals():
    call = lambda a, b, o: named({"f": ("call", []), "x": ("lit", [U64("constants", "v", a)]), "y": ("lit", [U64("constants", "v", b)])}, [("f", "arg", 0, "x"), ("f", "arg", o, "y")])
    assert hashed(call(1, 2, 0)).digests == hashed(call(2, 1, 0)).digests  # children at one ordinal are a set
    assert hashed(call(1, 2, 0), "bound").digests["constants"] != hashed(call(2, 1, 0), "bound").digests["constants"]
    p, q = hashed(call(1, 2, 1)), hashed(call(2, 1, 1))
    assert p.digests["constants"] != q.digests["constants"] and p.digests["structure"] == q.digests["structure"]
    g = call(1, 2, 1)
    g.children.reverse()
    g.nodes = dict(reversed(g.nodes.items()))
    assert hashed(g).digests == p.digests


def test_cycles():
    ring = lambda n, owner="demo": named({f"f{i}": ("fn", []) for i in range(n)}, edges=[(f"f{i}", "calls", f"f{(i + 1) % n}", "dependency") for i in range(n)], owner=owner)
    assert hashed(ring(2)).digests["structure"] != hashed(ring(3)).digests["structure"]
    assert hashed(ring(3)).digests == hashed(ring(3, "other")).digests
    assert hashed(ring(3), "bound").digests != hashed(ring(3, "other"), "bound").digests
    check_acyclic(ring(3).index(), False)
    with pytest.raises(CycleDetected):
        check_acyclic(ring(1).index(), True)
    hashed(Graph())  # no nodes at all


def test_flat_edges_count():
    rewired = lambda to: named({"a": ("x", []), "l": ("lit", [U64("constants", "v", 1)]), "m": ("lit", [U64("constants", "v", 2)])}, edges=[("a", "d", to, "data")])
    assert hashed(rewired("l")).digests["constants"] != hashed(rewired("m")).digests["constants"]


def test_deep_graph_needs_no_recursion():
    n = 3000
    g = named({f"n{i:05}": ("k", []) for i in range(n)}, [(f"n{i:05}", "c", 0, f"n{i + 1:05}") for i in range(n - 1)])
    check_acyclic(g.index(), True)


def _random_graph(rng):
    n = rng.randint(2, 5)
    nodes = {f"v{i}": (rng.choice("ab"), [TEXT("names", "n", rng.choice("xy")), TEXT("types", "t", rng.choice(["t0", "t1"]))]) for i in range(n)}
    children = [(f"v{rng.randrange(i)}", "c", rng.randint(0, 1), f"v{i}") for i in range(1, n)]
    edges = [(f"v{rng.randrange(n)}", "e", f"v{rng.randrange(n)}", rng.choice(["data", "dependency"])) for _ in range(rng.randint(0, 2))]
    return named(nodes, children, edges)


def _exact_form(g, dims):
    ix = g.index()
    label = lambda v: "|".join([ix.kinds[v] if "structure" in dims else "_"] + sorted(f"{d}/{x}" for d, _, _, x in ix.fields[v] if d in dims))
    found = canonicalise(([label(v) for v in range(len(ix.keys))], [(s, t, f"{r}/{lb}/{o}") for r, lb, o, s, t in ix.skeleton]), seconds=60)
    return tuple(found["labels"]), tuple(found["edges"])


def test_addresses_mean_what_exact_forms_mean():
    rng = random.Random(0x5EED)
    graphs = [_random_graph(rng) for _ in range(250)]
    hashes = hash_graphs([(g, "r", "free", ("structure", "names", "types")) for g in graphs])
    for dims in (("structure",), ("names",), ("structure", "names"), ("names", "types"), ("structure", "names", "types")):
        by_address, by_form = {}, {}
        for g, h in zip(graphs, hashes):
            address, form = h.address(dims), _exact_form(g, dims)
            assert by_address.setdefault(address, form) == form
            assert by_form.setdefault(form, address) == address


def test_exact_forms_and_budget():
    prism = (["v"] * 6, [(a, b, "e") for a, b in [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)] for a, b in [(a, b), (b, a)]])
    utility = (["v"] * 6, [(a, b, "e") for a in (0, 1, 2) for b in (3, 4, 5) for a, b in [(a, b), (b, a)]])
    x, y = canonicalise(prism), canonicalise(utility)
    assert x["status"] == y["status"] == "exact" and x["edges"] != y["edges"]
    assert verify(prism, (x["labels"], x["edges"]), x["mapping"])
    assert not verify(prism, (y["labels"], y["edges"]), x["mapping"])
    ring = (["v"] * 3, [(0, 1, "e"), (1, 2, "e"), (2, 0, "e")])
    assert canonicalise(ring, states=1)["status"] == "budget-exceeded"
    assert canonicalise((["v"], [(0, 1, "e")]))["status"] == "unsupported"
    assert canonicalise((["v"] * 65, []))["reason"] == "graph size budget"
    assert key("a", "b", "c") == f"entity:a{SEP}b{SEP}c"


def test_set_root():
    a, b, c = (bytes([i]) * 32 for i in (1, 2, 3))
    leaf = lambda x: e.meta("root_leaf", x)
    assert e.set_root([c, a, b, a]) == e.meta("root_node", e.meta("root_node", leaf(a) + leaf(b)) + leaf(c))
    assert e.set_root([]) == e.meta("root_empty", b"") and e.set_root([a]) == leaf(a)
