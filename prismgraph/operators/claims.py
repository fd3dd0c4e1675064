"""Claims coarsen classes at exactly their facet; attestations filter by a property. Neither is ever validated."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgraph import wire
from prismgraph.errors import ClaimError, LookupFacetMismatch
from prismgraph.functions import encode as e
from prismgraph.operators.components import connected_components
from prismgraph.scratch import Scratch

WITNESS = "witness_kind string, witness array<struct<k:string,v:string>>, note string"
CLAIM = f"claim_id binary, schema_version int, relation string, facet_id binary, left binary, right binary, {WITNESS}, assumptions binary, left_display string, right_display string"
ATTESTATION = f"attestation_id binary, schema_version int, facet_id binary, subject binary, property string, {WITNESS}, subject_display string"


def _witness(kind: str, payload: Sequence[tuple[str, str]]) -> bytes:
    return e.text(kind) + e.u32(len(payload)) + b"".join(e.text(k) + e.text(v) for k, v in payload)


def claim(
    relation: str, left: tuple[bytes, bytes], right: tuple[bytes, bytes], witness: tuple[str, Sequence[tuple[str, str]]], facet_id: bytes | None = None, note: str | None = None, assumptions: bytes | None = None, displays: tuple[str, str] = ("", "")
) -> dict:
    """A claim row. left and right are (facet id, address digest) and must be at the claim's facet. The id leaves the note
    out, keeps the order of the witness, and covers assumptions only where there are any."""
    facet = facet_id or left[0]
    if left[0] != facet or right[0] != facet:
        raise ClaimError("both sides of a claim must be addresses at its facet")
    kind, payload = witness
    body = e.u32(wire.CLAIMS_SCHEMA) + e.text(relation) + facet + left[1] + right[1] + _witness(kind, payload)
    made = e.meta("claim", body + (e.text("assumptions") + assumptions if assumptions is not None else b""))
    return {
        "claim_id": made, "schema_version": wire.CLAIMS_SCHEMA, "relation": relation, "facet_id": facet, "left": left[1], "right": right[1], "witness_kind": kind, "witness": [{"k": k, "v": v} for k, v in payload],
        "note": note, "assumptions": assumptions, "left_display": displays[0], "right_display": displays[1],
    }


def attestation(facet_id: bytes, subject: bytes, property: str, witness: tuple[str, Sequence[tuple[str, str]]], note: str | None = None, display: str = "") -> dict:
    kind, payload = witness
    made = e.meta("attestation", e.u32(wire.CLAIMS_SCHEMA) + facet_id + subject + e.text(property) + _witness(kind, payload))
    return {
        "attestation_id": made, "schema_version": wire.CLAIMS_SCHEMA, "facet_id": facet_id, "subject": subject, "property": property, "witness_kind": kind, "witness": [{"k": k, "v": v} for k, v in payload], "note": note, "subject_display": display,
    }


def claims_table(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame(list(rows), CLAIM).dropDuplicates(["claim_id"])


def attestations_table(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame(list(rows), ATTESTATION).dropDuplicates(["attestation_id"])


def supported(rows: DataFrame) -> DataFrame:
    """Refuses rows of a newer version than this one knows."""
    newer = rows.filter(F.col("schema_version") > wire.CLAIMS_SCHEMA).first()
    if newer:
        raise ClaimError(f"schema version {newer['schema_version']} is newer than {wire.CLAIMS_SCHEMA}")
    return rows


def in_force(claims: DataFrame, assume: Iterable[bytes] = ()) -> DataFrame:
    """Claims without assumptions, and those whose assumption root is accepted."""
    roots = [F.lit(bytearray(r)) for r in assume]
    return claims.filter(F.col("assumptions").isNull() | (F.col("assumptions").isin(*roots) if roots else F.lit(False)))


def closure(claims: DataFrame, assume: Iterable[bytes] = ()) -> DataFrame:
    """facet_id, address, representative: the smallest address of the class, for every address but that one itself.

    Facets never mix: the nodes of the components are facet and address together."""
    scratch = Scratch(claims.sparkSession, "closure")
    edges = in_force(claims, assume).select(F.concat("facet_id", "left").alias("a"), F.concat("facet_id", "right").alias("b"))
    stars = connected_components(edges, scratch.write, scratch.drop)
    half = lambda c, at: F.substring(c, at, 32)
    return stars.select(half("node", 1).alias("facet_id"), half("node", 33).alias("address"), half("root", 33).alias("representative"))


def with_representative(rows: DataFrame, claims: DataFrame, assume: Iterable[bytes] = ()) -> DataFrame:
    """rows (facet_id, address) with class: the representative, or the address itself where no claim knows it."""
    joined = rows.join(closure(claims, assume), ["facet_id", "address"], "left")
    return joined.withColumn("class", F.coalesce("representative", "address")).drop("representative")


def supporting_claims(claims: DataFrame, assume: Iterable[bytes] = ()) -> DataFrame:
    """facet_id, class, claim_id: what a merged class rests on, a row for each claim."""
    named = in_force(claims, assume).select("facet_id", F.col("left").alias("address"), "claim_id")
    return with_representative(named, claims, assume).select("facet_id", "class", "claim_id").distinct()


def gated_lookup(index: DataFrame, claims: DataFrame, facet_id: bytes, address: bytes, assume: Iterable[bytes] = ()) -> tuple[DataFrame, DataFrame]:
    """What an address finds by itself and, separately, through claims: via (direct, claims), address, graph_key; and the
    claim_id of each claim that its class rests on."""
    if not index.filter(F.col("facet_id") != F.lit(bytearray(facet_id))).isEmpty():
        raise LookupFacetMismatch("the index is of another facet")
    spark = claims.sparkSession
    here = claims.filter(F.col("facet_id") == F.lit(bytearray(facet_id)))
    asked = spark.createDataFrame([(facet_id, address)], "facet_id binary, address binary")
    mine = F.broadcast(with_representative(asked, here, assume).select("class"))  # one row
    found = with_representative(index, here, assume).join(mine, "class")
    via = F.when(F.col("address") == F.lit(bytearray(address)), "direct").otherwise("claims")
    return found.select(via.alias("via"), "address", "graph_key"), supporting_claims(here, assume).join(mine, "class").select("claim_id")


def permitted(attestations: DataFrame, property: str) -> DataFrame:
    """The addresses that carry a property."""
    return attestations.filter(F.col("property") == property).select(F.col("subject").alias("address")).distinct()
