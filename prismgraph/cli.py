"""Command line over a stored collection: python -m prismgraph.cli --corpus PATH COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismgraph.errors import CatalogError
from prismgraph.sources.table import json_lines, table_lines


def _witness(text: list[str]) -> tuple[str, list[tuple[str, str]]]:
    kind, *pairs = text
    for p in pairs:
        if "=" not in p:
            raise CatalogError(f"witness `{p}` must be key=value")
    return kind, [tuple(p.split("=", 1)) for p in pairs]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="prismgraph")
    out.add_argument("--corpus", required=True)
    out.add_argument("--json", action="store_true")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, /, *flags: str, **options) -> argparse.ArgumentParser:
        made = sub.add_parser(name)
        for f in flags:
            made.add_argument(f)
        for f, default in options.items():
            made.add_argument(f"--{f}", default=default, type=type(default) if default is not None else str)
        return made

    add = command("add", "world")
    add.add_argument("files", nargs="+")
    add.add_argument("--declaration")
    check = command("check")
    check.add_argument("files", nargs="+")
    check.add_argument("--declaration")
    command("recipes")
    declaration = command("declaration", "action", "recipe")
    declaration.add_argument("files", nargs="*")
    command("view", "spec", selector="", unit=None, name=None)
    gates = {"unit": "", "mode": "shape", "facet": "all", "require": None}
    for name, flags, more in (("bucket", (), {"min-size": 2, "top": 25}), ("overlap", ("left", "right"), {})):
        made = command(name, *flags, **gates, **more)
        made.add_argument("--claims", action="store_true")
        made.add_argument("--assume", action="append", default=[])
    command("diff", "left", "right", unit="", name=None)
    command("root", unit=None, mode=None, check=None)
    flags = {"unit": "", "mode": "shape", "facet": "all", "note": None}
    claim = command("claim", "relation", "left", "right", assumptions=None, **flags)
    attest = command("attest", "property", "subject", **flags)
    for made in (claim, attest):
        made.add_argument("--witness", nargs="+", default=["none"])
    command("assertions")
    return out


def show(rows: DataFrame, as_json: bool) -> None:
    for line in json_lines(rows) if as_json else table_lines(rows):
        print(line)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from prismgraph.operators.check import check_units, infer_declaration
    from prismgraph.plans.view import parse_view
    from prismgraph.sources.corpus import Corpus, read_declaration
    from prismgraph.sources.units import read_units

    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("prismgraph").getOrCreate()
    try:
        corpus = Corpus(spark, a.corpus)
        if getattr(a, "declaration", None):
            corpus.declare(read_declaration(a.declaration))
        if a.command == "add":
            print(f"{corpus.admit_files(a.world, a.files)} units added")
        elif a.command == "check":
            units = read_units(spark, a.files).withColumn("gid", F.concat_ws("/", "file", "recipe", "population", "name", "graph_key"))
            found = check_units(units, corpus.declarations.known)
            broken = found.select("gid").distinct().count()
            from pyspark.sql.window import Window

            first = found.withColumn("n", F.row_number().over(Window.partitionBy("gid").orderBy("at", "problem"))).filter("n <= 5").drop("n")
            show(first.orderBy("gid", "at", "problem"), a.json)
            print(f"{units.count()} units checked, {broken} break")
            return int(broken > 0)
        elif a.command == "recipes":
            for recipe, d in sorted(corpus.declarations.known.items()):
                print(recipe, "+".join(d.fills()))
        elif a.command == "declaration":
            d = corpus.declarations.require(a.recipe) if a.action == "print" else infer_declaration(read_units(spark, a.files).withColumn("gid", F.concat_ws("/", "file", "population", "name", "graph_key")), a.recipe)
            print(d.to_json())
        elif a.command == "view":
            with open(a.spec, encoding="utf-8") as f:
                show(corpus.materialise(parse_view(f.read()), a.selector, a.unit, a.name), a.json)
        elif a.command in ("bucket", "overlap"):
            gates = {"claims": a.claims, "assume": tuple(bytes.fromhex(x) for x in a.assume), "require": a.require}
            if a.command == "bucket":
                rows, summary = corpus.bucket(a.unit, a.mode, a.facet, min_size=a.min_size, top=a.top, **gates)
                rows = rows.select("class", "size", "artifacts", "members")
            else:
                rows, summary = corpus.overlap(a.unit, a.mode, a.facet, a.left, a.right, **gates)
                rows = rows.select("class", "a_size", "a_members", "b_size", "b_members").orderBy("class")
            show(rows, a.json)
            if not a.json:
                show(summary, False)
        elif a.command == "diff":
            show(corpus.diff(a.unit, a.left, a.right, a.name), a.json)
        elif a.command == "root":
            print(json.dumps(corpus.root(a.unit, a.mode, a.check)))
        elif a.command == "claim":
            assumed = bytes.fromhex(a.assumptions) if a.assumptions else None
            print(corpus.claim(a.unit, a.mode, a.facet, a.relation, a.left, a.right, _witness(a.witness), a.note, assumed).hex())
        elif a.command == "attest":
            print(corpus.attest(a.unit, a.mode, a.facet, a.property, a.subject, _witness(a.witness), a.note).hex())
        elif a.command == "assertions":
            show(corpus.assertions(), a.json)
    except (CatalogError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
