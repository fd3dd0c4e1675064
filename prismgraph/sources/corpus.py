"""A collection on disk: Parquet tables by record kind, graphs and digests partitioned by batch.

A batch is one replacement scope: admitting it again replaces what it admitted before and nothing else. Spark has no
transaction over several tables, so a batch is checked and staged whole before anything is replaced, and tables are
replaced in one order (declarations, artifacts, graphs, digests); a crash in between is mended by admitting it again.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prismgraph import wire
from prismgraph.errors import BrokenUnits, CatalogError
from prismgraph.operators import claims as c
from prismgraph.operators import queries as q
from prismgraph.operators.check import check_units
from prismgraph.operators.hashing import DIGESTS, hash_units, with_address
from prismgraph.plans.declaration import Declaration, Declarations, parse_declaration
from prismgraph.plans.view import View, apply_view
from prismgraph.scratch import Scratch
from prismgraph.sources.units import GRAPH, read_units

HEAD = "artifact_id string, world string, population string, recipe string, name string, status string"
SCHEMAS = {
    "artifacts": "artifact_id string, world string, origin string, pipeline string, optimize boolean, compiler string, label string, batch string",
    "graphs": f"{HEAD}, {GRAPH}, batch string",
    "digests": f"{HEAD}, graph_key string, {DIGESTS}, batch string",
    "claims": c.CLAIM,
    "attestations": c.ATTESTATION,
    "declarations": "recipe string, declaration string",
}


def artifact_id(owner: str, origin: str, variant: bool = False) -> str:
    """Of an owner's input: 16 hexadecimal digits that tell origins, and a variant of the same one, apart."""
    return hashlib.sha256(f"{owner}{wire.SEPARATOR}{origin}".encode() + bytes([variant])).hexdigest()[:16]


def origin_hash(origin: str) -> str:
    return hashlib.sha256(origin.encode()).hexdigest()[:8]


def batch_id(world: str, scope: str) -> str:
    return f"{world}:{scope}"


class Corpus:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.declarations = Declarations()
        for row in self.table("declarations").collect():  # one row per recipe
            self.declarations.declare(parse_declaration(row["declaration"]))

    # --- tables ----------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def table(self, name: str) -> DataFrame:
        fs, there = self._fs(f"{self.path}/{name}")
        if not fs.exists(there):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(StructType.fromDDL(SCHEMAS[name])).parquet(f"{self.path}/{name}")

    def digests(self, unit: str | None = None, mode: str | None = None) -> DataFrame:
        out = self.table("digests")
        out = out.filter(F.col("population") == unit) if unit else out
        return out.filter(F.col("mode") == mode) if mode else out

    def graphs(self, recipe: str | None = None, selector: str = "", unit: str | None = None, name: str | None = None, ordered: bool = False) -> DataFrame:
        """Graph rows by recipe, selector (over the owner of the graph's entity), population and name; in their order if asked."""
        out = self.table("graphs").withColumn("_owner", q.graph_owner())
        out = out.filter(F.col("recipe") == recipe) if recipe else out
        out = out.filter(q.selects(selector, owner="_owner")) if selector else out
        out = out.filter(F.col("population") == unit) if unit else out
        out = out.filter(F.col("name") == name) if name else out
        out = out.drop("_owner")
        return out.orderBy("artifact_id", "population", "name", "graph_key") if ordered else out

    def claims(self) -> DataFrame:
        return c.supported(self.table("claims")).dropDuplicates(["claim_id"])

    def attestations(self) -> DataFrame:
        return c.supported(self.table("attestations")).dropDuplicates(["attestation_id"])

    # --- writing ---------------------------------------------------------------------------------------------------

    def declare(self, declaration: Declaration) -> None:
        if self.declarations.known.get(declaration.recipe) != declaration:
            self.declarations.declare(declaration)
            row = self.spark.createDataFrame([(declaration.recipe, declaration.to_json())], SCHEMAS["declarations"])
            row.coalesce(1).write.mode("append").parquet(f"{self.path}/declarations")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def replace(self, name: str, batch: str, rows: DataFrame) -> None:
        """Replaces one batch of a table; a batch without rows is deleted."""
        if rows.isEmpty():
            from urllib.parse import quote

            fs, there = self._fs(f"{self.path}/{name}/batch={quote(batch, safe='-._~ ')}")
            for status in fs.globStatus(self._fs(f"{self.path}/{name}/batch=*")[1]) or []:
                found = status.getPath()
                if found.getName() == there.getName() or self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(found.getName()) == f"batch={batch}":
                    fs.delete(found, True)
            return
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{name}")

    def admit(self, world: str, scope: str, units: DataFrame) -> int:
        """Checks, hashes in both key modes and stores units as the batch of a world's scope, all of them or none."""
        batch = batch_id(world, scope)
        scratch = Scratch(self.spark, "admit")
        columns = [x for x in StructType.fromDDL(SCHEMAS["graphs"]).names if x in units.columns or x in ("artifact_id", "world", "batch")]
        staged = units.withColumns({"artifact_id": F.lit(artifact_id(world, scope)), "world": F.lit(world), "batch": F.lit(batch)}).select(*columns)
        staged = scratch.write(staged, "units")
        again = staged.groupBy("recipe", "population", "graph_key").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")).filter("n > 1").first()
        if again:
            raise CatalogError(f"{scope}: two units of {again['recipe']} with the key of `{again['name']}`")
        found = check_units(staged.withColumn("gid", F.concat_ws(wire.SEPARATOR, "recipe", "population", "graph_key")), self.declarations.known)
        first = found.orderBy("gid", "at", "problem").limit(5).collect()
        if first:
            listed = "; ".join(f"{r['at'].replace(wire.SEPARATOR, '/') + ': ' if r['at'] else ''}{r['problem']}" for r in first)
            raise BrokenUnits(f"{scope}: {listed}", [tuple(r) for r in first])
        digests = scratch.write(hash_units(staged, self.declarations.fills()).select(*StructType.fromDDL(SCHEMAS["digests"]).names), "digests")
        artifact = self.spark.createDataFrame([(artifact_id(world, scope), world, origin_hash(scope), "units", False, None, scope, batch)], SCHEMAS["artifacts"])
        self.replace("artifacts", batch, artifact)
        self.replace("graphs", batch, staged)
        self.replace("digests", batch, digests)
        n = staged.count()
        scratch.drop()
        return n

    def admit_files(self, world: str, files: list[str]) -> int:
        """Each file is a scope, in order; those before a file that fails stay."""
        return sum(self.admit(world, f, read_units(self.spark, f).drop("file")) for f in files)

    def materialise(self, view: View, selector: str = "", unit: str | None = None, name: str | None = None) -> DataFrame:
        """Stores the graphs that a view makes, hashed in the dimensions it retains: world, name, nodes before and after, addresses."""
        source = self.graphs(view.input, selector, unit, name)
        if source.isEmpty():
            raise CatalogError(f"no graph at recipe `{view.input}` matched `{selector}`")
        scratch = Scratch(self.spark, "view")
        before = scratch.write(source, "input")
        batch = F.concat(F.lit(f"view:{view.plan_id().hex()[:16]}:"), F.sha2("batch", 256).substr(1, 16))  # one for each of the input's
        made = apply_view(view, before.withColumn("batch", batch)).withColumn("population", F.lit(f"view:{view.name}"))
        made = scratch.write(made.withColumn("world", q.graph_owner()), "graphs")
        digests = scratch.write(hash_units(made, {"*": view.dimensions}).select(*StructType.fromDDL(SCHEMAS["digests"]).names), "digests")
        for table, rows in (("graphs", made), ("digests", digests)):
            self._renew(table, rows.select(*StructType.fromDDL(SCHEMAS[table]).names), scratch)
        row = ["batch", "artifact_id", "name", "graph_key"]
        addresses = with_address(digests, "+".join(view.dimensions)).groupBy(*row).pivot("mode", list(wire.MODES)).agg(F.first(F.lower(F.hex("address"))))
        sizes = made.select("batch", "artifact_id", "world", "name", "graph_key", F.size("nodes").alias("output_nodes"))
        return sizes.join(addresses.withColumnsRenamed({"identity": "identity_address", "shape": "shape_address"}), row)

    def _renew(self, table: str, rows: DataFrame, scratch: Scratch) -> None:
        """Replaces what rows' batches hold of the same graphs and keeps their other rows; dynamic overwrite touches no other batch."""
        batches = F.broadcast(rows.select("batch").distinct())  # one for each batch of the input
        same = ["batch", "population", "artifact_id", "name", "graph_key"]
        kept = self.table(table).join(batches, "batch", "left_semi").join(rows.select(*same).distinct(), same, "left_anti")
        whole = scratch.write(rows.unionByName(kept), f"whole-{table}")
        whole.repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/{table}")

    # --- assertions ------------------------------------------------------------------------------------------------

    def _address(self, selector: str, unit: str, mode: str, facet: str):
        row = q.resolve_one(self.digests(unit, mode), selector)
        one = self.digests(unit, mode).filter((F.col("batch") == row["batch"]) & (F.col("recipe") == row["recipe"]) & (F.col("graph_key") == row["graph_key"]))
        found = with_address(one, facet).first()
        return bytes(found["facet_id"]), bytes(found["address"]), f"{row['world']}::{row['name']}"

    def claim(self, unit: str, mode: str, facet: str, relation: str, left: str, right: str, witness: tuple[str, list[tuple[str, str]]], note: str | None = None, assumptions: bytes | None = None) -> bytes:
        (fa, a, da), (fb, b, db) = self._address(left, unit, mode, facet), self._address(right, unit, mode, facet)
        row = c.claim(relation, (fa, a), (fb, b), witness, None, note, assumptions, (da, db))
        self.append("claims", self.spark.createDataFrame([row], SCHEMAS["claims"]))
        return row["claim_id"]

    def attest(self, unit: str, mode: str, facet: str, property: str, subject: str, witness: tuple[str, list[tuple[str, str]]], note: str | None = None) -> bytes:
        fid, address, shown = self._address(subject, unit, mode, facet)
        row = c.attestation(fid, address, property, witness, note, shown)
        self.append("attestations", self.spark.createDataFrame([row], SCHEMAS["attestations"]))
        return row["attestation_id"]

    def assertions(self) -> DataFrame:
        """Claims and attestations in one list: kind, id, what, left, right, witness_kind, note, conditional."""
        short = lambda x: F.substring(F.lower(F.hex(x)), 1, 16).alias("id")
        a = self.claims().select(F.lit("claim").alias("kind"), short("claim_id"), F.col("relation").alias("what"), F.col("left_display").alias("left"), F.col("right_display").alias("right"), "witness_kind", "note", F.col("assumptions").isNotNull().alias("conditional"))
        b = self.attestations().select(F.lit("attestation").alias("kind"), short("attestation_id"), F.col("property").alias("what"), F.col("subject_display").alias("left"), F.lit("").alias("right"), "witness_kind", "note", F.lit(False).alias("conditional"))
        return a.unionByName(b)

    # --- questions -------------------------------------------------------------------------------------------------

    def _gates(self, claims: bool, assume: list[bytes], require: str | None) -> dict:
        return {"claims": self.claims() if claims or assume else None, "assume": assume, "attestations": self.attestations() if require else None, "require": require}

    def bucket(self, unit: str, mode: str, facet: str, claims: bool = False, assume: tuple = (), require: str | None = None, **how) -> tuple[DataFrame, DataFrame]:
        if self.digests(unit, mode).isEmpty():
            raise CatalogError(f"no digest rows for unit `{unit}` mode `{mode}`: nothing was admitted under them")
        return q.bucket(self.digests(), unit, mode, facet, **how, **self._gates(claims, list(assume), require))

    def overlap(self, unit: str, mode: str, facet: str, left: str, right: str, claims: bool = False, assume: tuple = (), require: str | None = None) -> tuple[DataFrame, DataFrame]:
        return q.overlap(self.digests(), unit, mode, facet, q.selects(left), q.selects(right), **self._gates(claims, list(assume), require))

    def diff(self, unit: str, left: str, right: str, name: str | None = None) -> DataFrame:
        out = q.diff(self.digests(), unit, q.selects(left), q.selects(right), name)
        if out.isEmpty():
            raise CatalogError(f"no matching rows for `{left}` / `{right}` at unit `{unit}`")
        return out

    def root(self, unit: str | None = None, mode: str | None = None, check: str | None = None) -> dict:
        return q.root(self.digests(), unit, mode, check)


def read_declaration(path: str) -> Declaration:
    with open(path, encoding="utf-8") as f:
        try:
            return parse_declaration(f.read())
        except CatalogError as error:
            raise CatalogError(f"{os.fspath(path)}: {error}") from None
