"""Digests of units as DataFrames: graphs go through the kernel batch by batch, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prismgraph import wire
from prismgraph.errors import DuplicateNode
from prismgraph.functions import encode as e
from prismgraph.functions.blake3 import blake3_many
from prismgraph.operators.forms import form_parts, read_form
from prismgraph.operators.kernel import Graph, hash_graphs
from prismgraph.operators.stars import FEWEST, hash_stars, read_stars
from prismgraph.sources.units import kernel_graphs, struct_lists

DIGESTS = "mode string, policy_id binary, digests map<string,binary>, shape binary, mixed_pairs int, joint map<string,binary>, node_count bigint"
#: Nodes hashed together at most, but for a single larger graph.
NODES_AT_ONCE = 5_000


def blake3_column(messages: Column) -> Column:
    return F.pandas_udf(_blake3, "binary")(messages)


def _blake3(messages: pd.Series) -> pd.Series:
    some = messages.notna()
    out = pd.Series([None] * len(messages), dtype=object)
    distinct: dict[bytes, int] = {}  # rows of one class say the same
    at = [distinct.setdefault(bytes(m), len(distinct)) for m in messages[some]]
    digests = blake3_many(list(distinct))
    out[some.to_numpy()] = [digests[k] for k in at]
    return out


def _hash(keep: list[str], dims: Mapping[str, Sequence[str]], modes: Sequence[str], facets: Sequence[Sequence[str]] | None):
    facts = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(DIGESTS))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if "shape" in modes and b.num_rows >= FEWEST:
                found = read_stars(b)
                if found[0].sum() >= FEWEST:
                    stars, made = hash_stars(found, b.num_rows, dims, facets, facts)
                    own = b.take(pa.array(stars))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), *(made[name] for name in facts)], names=[*keep, *facts])
                    yield from parts(own, [m for m in modes if m != "shape"])
                    b = b.filter(pa.array(~found[0]))
            yield from parts(b, modes)

    def parts(b: pa.RecordBatch, modes: Sequence[str]) -> Iterator[pa.RecordBatch]:
        ends, lo = struct_lists(b.column("nodes"))[0], 0
        while modes and lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + NODES_AT_ONCE, "right")) - 1)
            yield hashed(b.slice(lo, hi - lo), modes)
            lo = hi

    def hashed(rows: pa.RecordBatch, modes: Sequence[str]) -> pa.RecordBatch:
        graphs = kernel_graphs(*(rows.column(c) for c in ("nodes", "children", "edges")))
        found = hash_graphs([(g, recipe, wire.MODES[m], dims.get(recipe) or dims["*"]) for recipe, g in zip(rows.column("recipe").to_pylist(), graphs) for m in modes], facets=facets)
        own = pa.array(np.repeat(np.arange(rows.num_rows), len(modes)))
        columns = {
            "mode": list(modes) * rows.num_rows, "policy_id": [h.policy_id for h in found], "digests": [list(h.digests.items()) for h in found], "shape": [h.shape for h in found],
            "mixed_pairs": [h.mixed_pairs for h in found], "joint": [list(h.joint.items()) for h in found], "node_count": [h.node_count for h in found],
        }
        made = [pa.array(columns[name], kind) for name, kind in facts.items()]
        return pa.RecordBatch.from_arrays([*(rows.column(c).take(own) for c in keep), *made], names=[*keep, *facts])

    return run


def hash_units(units: DataFrame, dimensions: Mapping[str, Sequence[str]], modes: Sequence[str] = ("identity", "shape"), keep: Sequence[str] | None = None, facets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """A row per unit and mode with its digests. `dimensions` are those that each recipe fills; "*" stands for others. Joint
    digests are those of `facets` alone if they are given."""
    graph = ("nodes", "children", "edges")
    keep = [c for c in units.columns if c not in graph] if keep is None else list(keep)
    schema = StructType([units.schema[c] for c in keep] + StructType.fromDDL(DIGESTS).fields)
    sent = units.select(*dict.fromkeys([*keep, "recipe", *graph]))
    return sent.mapInArrow(_hash(keep, dict(dimensions), list(modes), facets), schema)


def _hash_forms(dims: Mapping[str, Sequence[str]], facets: Sequence[Sequence[str]] | None):
    facts = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(DIGESTS))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forms in form_parts(batches):
            items = []
            for form in forms:
                recipe, nodes, children, edges = read_form(form)
                g = Graph({k: (kind, own) for k, kind, own in nodes}, children, edges)
                if len(g.nodes) < len(nodes):
                    raise DuplicateNode(f"node `{next(k for i, (k, *_) in enumerate(nodes) if any(k == x[0] for x in nodes[:i]))}` occurs twice")
                items.append((g, recipe, "free", dims.get(recipe) or dims["*"]))
            found = hash_graphs(items, facets=facets)
            columns = {
                "form": forms, "mode": ["shape"] * len(forms), "policy_id": [h.policy_id for h in found], "digests": [list(h.digests.items()) for h in found], "shape": [h.shape for h in found],
                "mixed_pairs": [h.mixed_pairs for h in found], "joint": [list(h.joint.items()) for h in found], "node_count": [h.node_count for h in found],
            }
            yield pa.RecordBatch.from_arrays([pa.array(c, facts.get(name, pa.string())) for name, c in columns.items()], names=list(columns))

    return run


def hash_forms(forms: DataFrame, dimensions: Mapping[str, Sequence[str]], facets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """form and its digests under free keys, the joint ones of `facets` alone if they are given. See `hash_units`."""
    return forms.select("form").mapInArrow(_hash_forms(dict(dimensions), facets), f"form string, {DIGESTS}")


def with_message_hash(df: DataFrame, name: str, message: Column) -> DataFrame:
    return df.withColumn(name, blake3_column(message))


def _lit(raw: bytes) -> Column:
    return F.lit(bytearray(raw))


def resolve_facet(spec: str) -> tuple[str, ...]:
    """Dimensions of a facet: all (or full), names-blind, or some joined by +."""
    if spec in ("all", "full"):
        return wire.DIMENSIONS
    if spec == "names-blind":
        return tuple(d for d in wire.DIMENSIONS if d != "names")
    return e.sorted_dimensions(part.strip() for part in spec.split("+"))


def row_dimensions(wanted: Sequence[str], filled: Sequence[str], recipe: str) -> tuple[str, ...]:
    """What a facet means for a recipe: the two shorthand sets shrink to what it fills, any other set must be filled."""
    from prismgraph.errors import CatalogError

    wanted = e.sorted_dimensions(wanted)
    if set(wanted) in (set(wire.DIMENSIONS), set(wire.DIMENSIONS) - {"names"}):
        some = tuple(d for d in wanted if d in filled)
        if not some:
            raise CatalogError(f"recipe {recipe} fills none of the requested dimensions")
        return some
    for d in wanted:
        if d not in filled:
            raise CatalogError(f"recipe {recipe} does not fill dimension {d}")
    return wanted


def filled_kinds(digests: DataFrame) -> list:
    """recipe, policy_id and filled dimensions of all rows: one row for each recipe, key mode and set of dimensions."""
    return digests.select("recipe", "policy_id", F.array_sort(F.map_keys("digests")).alias("filled")).distinct().collect()


def with_address(digests: DataFrame, facet: str | None, name: str = "address", kinds: list | None = None) -> DataFrame:
    """Adds facet_id and the digest of each row's address at a facet (None: at all dimensions that the row has).

    Facets are resolved per recipe, key mode and set of filled dimensions, which are few, and joined back as literals of
    the message; where the mixed-pairs mask flags the facet, the stored joint digest is used, and its lack is an error.
    For several facets of the same rows `kinds` is their `filled_kinds`, found once.
    """
    spark = digests.sparkSession
    wanted = None if facet is None else resolve_facet(facet)
    rows = []
    for k in filled_kinds(digests) if kinds is None else kinds:
        dims = row_dimensions(wanted, k["filled"], k["recipe"]) if wanted is not None else e.sorted_dimensions(k["filled"])
        fid = e.facet_id(bytes(k["policy_id"]), dims)
        parts = [(d, e.text(d)) for d in dims]
        rows.append((k["policy_id"], k["filled"], fid, e.meta_header("address") + fid, e.meta_header("joint") + fid, parts, e.facet_mask(dims), e.dimensions_key(dims)))
    schema = "policy_id binary, _filled array<string>, facet_id binary, _head binary, _joint_head binary, _parts array<struct<d:string,raw:binary>>, _mask int, _key string"
    facets = F.broadcast(spark.createDataFrame(rows, schema))  # one row for each recipe, mode and set of dimensions
    joined = digests.withColumn("_filled", F.array_sort(F.map_keys("digests"))).join(facets, ["policy_id", "_filled"])
    combined = F.aggregate("_parts", F.col("_head"), lambda acc, x: F.concat(acc, x["raw"], F.col("digests")[x["d"]]))
    stored = F.col("joint")[F.col("_key")]
    joint = F.when(stored.isNotNull(), F.concat("_joint_head", stored)).otherwise(F.raise_error(F.concat(F.lit("no joint digest stored for "), "_key")).cast("binary"))
    message = F.when(F.col("mixed_pairs").bitwiseAND(F.col("_mask")) == 0, combined).otherwise(joint)
    out = with_message_hash(joined, name, message)
    return out.select(*digests.columns, "facet_id", name)
