"""References and records that travel between tools: URIs of digests, and fingerprints of graphs as JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from prismgraph import wire
from prismgraph.errors import CatalogError, InvalidDigest, InvalidReference, UnsupportedVersion
from prismgraph.sources.units import graph_key, graph_key_json

HEX = re.compile("[0-9a-f]{64}")
#: Parts of a URI after its scheme, in their order.
PARTS = "schema_version bigint, policy_id binary, dimension string, digest binary"
LARGEST_VERSION = 2**32 - 1


def digest_bytes(text: str) -> bytes:
    if not isinstance(text, str) or not HEX.fullmatch(text):
        raise InvalidDigest(f"`{text}` is not 64 lowercase hexadecimal digits")
    return bytes.fromhex(text)


def uri(policy_id: bytes, dimension: str, digest: bytes, schema_version: int = wire.SCHEMA_VERSION) -> str:
    return ":".join([wire.MAGIC, str(schema_version), policy_id.hex(), dimension, digest.hex()])


def parse_uri(text: str) -> tuple[int, bytes, str, bytes]:
    """schema_version, policy_id, dimension, digest."""
    scheme, *parts = text.split(":")
    if scheme != wire.MAGIC:
        raise InvalidReference(f"`{scheme}` is not the scheme {wire.MAGIC}")
    if len(parts) != 4:
        raise InvalidReference(f"{len(parts)} parts after the scheme, not 4")
    version, policy, dimension, digest = parts
    if not re.fullmatch(r"\+?[0-9]+", version) or int(version) > LARGEST_VERSION:
        raise InvalidReference(f"`{version}` is not a schema version")
    if dimension not in wire.DIMENSIONS:
        raise InvalidReference(f"unknown dimension `{dimension}`")
    return int(version), digest_bytes(policy), dimension, digest_bytes(digest)


def uri_column(policy_id: Column, dimension: Column, digest: Column, schema_version: int = wire.SCHEMA_VERSION) -> Column:
    return F.concat_ws(":", F.lit(wire.MAGIC), F.lit(schema_version).cast("string"), F.lower(F.hex(policy_id)), dimension, F.lower(F.hex(digest)))


def parse_uri_column(text: Column) -> Column:
    """A struct of the parts; null where the text is no such URI."""
    parts = F.split(text, ":", -1)
    pattern = rf"^{wire.MAGIC}:[+]?[0-9]+:[0-9a-f]{{64}}:({'|'.join(wire.DIMENSIONS)}):[0-9a-f]{{64}}$"
    version = parts[1].try_cast("bigint")
    made = F.struct(version.alias("schema_version"), F.unhex(parts[2]).alias("policy_id"), parts[3].alias("dimension"), F.unhex(parts[4]).alias("digest"))
    return F.when(text.rlike(pattern) & (version <= LARGEST_VERSION), made)


def fingerprint(row: dict) -> str:
    """A digest row (graph_key, policy_id, digests, node_count) as one JSON object, dimensions in their order."""
    digests = {d: bytes(row["digests"][d]).hex() for d in wire.DIMENSIONS if d in row["digests"]}
    out = {"graph_key": graph_key_json(row["graph_key"]), "policy_id": bytes(row["policy_id"]).hex(), "schema_version": row.get("schema_version", wire.SCHEMA_VERSION), "digests": digests, "node_count": row["node_count"]}
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def parse_fingerprint(text: str) -> dict:
    """The digest row of a fingerprint; a version that isn't known is refused."""
    try:
        x = json.loads(text)
        if x["schema_version"] != wire.SCHEMA_VERSION:
            raise UnsupportedVersion(f"schema version {x['schema_version']} is not supported, this is {wire.SCHEMA_VERSION}")
        unknown = set(x["digests"]) - set(wire.DIMENSIONS)
        if unknown:
            raise CatalogError(f"unknown dimension `{min(unknown)}`")
        if not isinstance(x["node_count"], int) or x["node_count"] < 0:
            raise CatalogError("node_count must be a number of nodes")
        return {"graph_key": graph_key(x["graph_key"]), "policy_id": digest_bytes(x["policy_id"]), "schema_version": x["schema_version"], "digests": {d: digest_bytes(v) for d, v in x["digests"].items()}, "node_count": x["node_count"]}
    except CatalogError:
        raise
    except (KeyError, TypeError, ValueError, AttributeError) as error:
        raise CatalogError(f"not a fingerprint: {type(error).__name__} {error}") from None


def fingerprint_column(graph_key: Column, policy_id: Column, digests: Column, node_count: Column) -> Column:
    """The same JSON as `fingerprint`, made by Spark from the columns of a digest row."""
    sep = wire.SEPARATOR
    part = lambda i: F.split(graph_key, sep)[i]
    owner = F.struct(part(0).alias("kind"), part(1).alias("owner"), part(2).alias("local"))
    given = F.struct(*[F.lower(F.hex(digests[d])).alias(d) for d in wire.DIMENSIONS])  # to_json leaves out what is null
    whole = F.struct(F.struct(owner.alias("owner"), part(3).alias("local")).alias("graph_key"), F.lower(F.hex(policy_id)).alias("policy_id"), F.lit(wire.SCHEMA_VERSION).alias("schema_version"), given.alias("digests"), node_count.alias("node_count"))
    return F.to_json(whole)
