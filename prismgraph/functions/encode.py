"""Canonical byte encoding: lengths and numbers are little-endian, multisets of records are counted and sorted by bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from functools import lru_cache

from prismgraph import wire
from prismgraph.errors import CatalogError, EmptyFacet, UnsupportedVersion
from prismgraph.functions.blake3 import blake3, blake3_many

u32 = struct.Struct("<I").pack
u64 = struct.Struct("<Q").pack
i64 = struct.Struct("<q").pack


def text(value: str) -> bytes:
    raw = value.encode()
    return u64(len(raw)) + raw


def value(kind: str, payload) -> bytes:
    """A tagged value: kind and what it holds."""
    if kind == "text":
        return text("text") + text(payload)
    if kind == "bool":
        return text("bool") + bytes([bool(payload)])
    if kind == "u64":
        return text("u64") + u64(int(payload))
    if kind == "i64":
        return text("i64") + i64(int(payload))
    if kind == "bytes":
        return text("bytes") + u64(len(payload)) + bytes(payload)
    raise CatalogError(f"unknown value kind `{kind}`")


def value_order(kind: str, payload) -> tuple:
    return wire.VALUE_KINDS.index(kind), payload


def records(items: Iterable[bytes]) -> bytes:
    items = sorted(items)
    return u32(len(items)) + b"".join(items)


@lru_cache(maxsize=4096)
def header(recipe: str, bin_: str, keys: str, tag: str) -> bytes:
    """What every record of a dimension begins with: it commits to version, recipe, dimension, key mode and tag."""
    return text(wire.MAGIC) + u32(wire.SCHEMA_VERSION) + text(recipe) + text(bin_) + text(keys) + text(wire.TAGS[tag])


@lru_cache(maxsize=64)
def meta_header(tag: str) -> bytes:
    return text(wire.MAGIC) + u32(wire.SCHEMA_VERSION) + text(wire.TAGS[tag])


def meta(tag: str, payload: bytes) -> bytes:
    return blake3(meta_header(tag) + payload)


# --- ids of policies, facets and addresses -------------------------------------------------------------------------


def sorted_dimensions(dimensions: Iterable[str]) -> tuple[str, ...]:
    """In the fixed order, each once."""
    found = set(dimensions)
    unknown = found - set(wire.DIMENSIONS)
    if unknown:
        raise CatalogError(f"unknown dimension `{min(unknown)}` (expected {', '.join(wire.DIMENSIONS)})")
    return tuple(d for d in wire.DIMENSIONS if d in found)


def dimensions_key(dimensions: Iterable[str]) -> str:
    return "+".join(sorted_dimensions(dimensions))


@lru_cache(maxsize=4096)
def policy_id(recipe: str, keys: str, schema_version: int = wire.SCHEMA_VERSION) -> bytes:
    if schema_version != wire.SCHEMA_VERSION:
        raise UnsupportedVersion(f"schema version {schema_version} is not supported, this is {wire.SCHEMA_VERSION}")
    if keys not in wire.MODES.values():
        raise CatalogError(f"unknown key mode `{keys}`")
    return meta("policy", u32(schema_version) + text(recipe) + text(keys))


@lru_cache(maxsize=4096)
def _facet_id(policy: bytes, dimensions: tuple[str, ...]) -> bytes:
    return meta("facet", policy + u32(len(dimensions)) + b"".join(map(text, dimensions)))


def facet_id(policy: bytes, dimensions: Iterable[str]) -> bytes:
    dims = sorted_dimensions(dimensions)
    if not dims:
        raise EmptyFacet("a facet needs at least one dimension")
    return _facet_id(policy, dims)


def combined_message(facet: bytes, digests: Sequence[tuple[str, bytes]]) -> bytes:
    return meta_header("address") + facet + b"".join(text(d) + x for d, x in digests)


def joint_message(facet: bytes, joint: bytes) -> bytes:
    return meta_header("joint") + facet + joint


def pair_bit(a: str, b: str) -> int:
    """The bit of two dimensions in a mixed-pairs mask; 0 for one with itself."""
    pairs = [(x, y) for i, x in enumerate(wire.DIMENSIONS) for y in wire.DIMENSIONS[i + 1 :]]
    key = tuple(sorted((a, b), key=wire.DIMENSIONS.index))
    return 1 << pairs.index(key) if a != b else 0


def facet_mask(dimensions: Iterable[str]) -> int:
    dims = sorted_dimensions(dimensions)
    return sum(pair_bit(a, b) for i, a in enumerate(dims) for b in dims[i + 1 :])


def set_root(leaves: Iterable[bytes]) -> bytes:
    """Merkle root of a set of digests: distinct, sorted, wrapped, joined in pairs; an odd one moves up as it is."""
    level = sorted(set(leaves))
    if not level:
        return meta("root_empty", b"")
    level = blake3_many([meta_header("root_leaf") + x for x in level])
    while len(level) > 1:
        joined = blake3_many([meta_header("root_node") + a + b for a, b in zip(level[::2], level[1::2])])
        level = joined + level[len(joined) * 2 :]
    return level[0]
