"""Fixed values of the wire format: digests agree with other implementations only if these are kept as they are."""

# Magic string, record tags and version numbers of the byte format.
MAGIC = "riffcat"
SCHEMA_VERSION = 3
CLAIMS_SCHEMA = 2
VIEW_SCHEMA = 1
VIEW_LANGUAGE = "riffcat-view/1"
VIEW_PLAN = "riffcat.view-plan"
TAGS = {
    "local": "node.local",
    "init": "wl.init",
    "signature": "wl.signature",
    "component": "wl.component",
    "tree": "component.tree",
    "context": "node.component_context",
    "colour": "graph.colour",
    "full": "graph.full",
    "shape": "shape.init",
    "policy": "riffcat.policy",
    "facet": "riffcat.facet",
    "address": "riffcat.facet_address",
    "joint": "riffcat.facet_address.joint",
    "root_empty": "riffcat.root.empty",
    "root_leaf": "riffcat.root.leaf",
    "root_node": "riffcat.root.node",
    "claim": "riffcat.claim",
    "attestation": "riffcat.attestation",
}

# Closed vocabularies, in their order.
DIMENSIONS = ("structure", "names", "constants", "types", "trace_events")
ROLES = ("graph", "control", "data", "reference", "call", "dependency", "origin")
VALUE_KINDS = ("text", "bool", "u64", "i64", "bytes")
MODES = {"identity": "bound", "shape": "free"}
SEPARATOR = "\x1f"
JOINT_KIND = "_"
SHAPE_BIN = "shape"

# Budget of the exact search.
EXACT_VERTICES, EXACT_EDGES, EXACT_STATES, EXACT_SECONDS, EXACT_LABEL_BYTES = 64, 256, 100_000, 2.0, 1_048_576
