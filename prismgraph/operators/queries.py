"""Questions to stored digests: bucket, overlap, diff, root, and the two indexes. Nothing is hashed again but addresses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismgraph import wire
from prismgraph.errors import CatalogError, PolicyMismatch, RootMismatch
from prismgraph.operators.claims import permitted, with_representative
from prismgraph.operators.hashing import with_address
from prismgraph.operators.merkle import set_root
from prismgraph.operators.ranks import numbered
from prismgraph.scratch import Scratch


def selects(selector: str, owner: str = "world", name: str = "name", artifact: str | None = "artifact_id") -> Column:
    """Rows that a selector means: a substring of owner, name or artifact id; `owner::name` needs both; a name after = is exact."""
    if "::" in selector:
        left, right = selector.split("::", 1)
        named = F.col(name) == right[1:] if right.startswith("=") else F.col(name).contains(right)
        return F.col(owner).contains(left) & named
    out = F.col(owner).contains(selector) | F.col(name).contains(selector)
    return out | F.col(artifact).contains(selector) if artifact else out


def graph_owner(key: str = "graph_key") -> Column:
    """The owner of the entity that a graph key belongs to."""
    return F.split(F.col(key), wire.SEPARATOR)[1]


def resolve_one(rows: DataFrame, selector: str, **columns) -> object:
    """The one row that a selector means; none, or several, are an error that lists five."""
    found = rows.filter(selects(selector, **columns)).limit(6).collect()
    if len(found) != 1:
        listed = ", ".join(sorted(r["name"] for r in found[:5]))
        raise CatalogError(f"`{selector}` matches no row" if not found else f"`{selector}` matches several rows: {listed}")
    return found[0]


def classed(
    digests: DataFrame, facet: str, claims: DataFrame | None = None, assume: Iterable[bytes] = (), attestations: DataFrame | None = None, require: str | None = None, final_only: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """digests with address and class, and the rows that the gate left out. The gate reads the address, not its class."""
    rows = with_address(digests.filter("status = 'final'") if final_only else digests, facet)
    excluded = None
    if require is not None:
        allowed = permitted(attestations, require)
        excluded = rows.join(allowed, "address", "left_anti")
        rows = rows.join(allowed, "address", "left_semi")
    if claims is None:
        return rows.withColumn("class", F.col("address")), excluded
    return with_representative(rows, claims, assume), excluded


def first_names(rows: DataFrame, by: list[str], keep: int) -> DataFrame:
    """by, n_names (distinct ones), names (the `keep` smallest): no list is longer than that, and tasks send no more on."""
    pairs = rows.filter("name is not null").select(*by, "name").distinct()
    some = pairs.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("name"))).filter(F.col("_i") <= keep)
    some = some.groupBy(*by).agg(F.array_sort(F.collect_list("name")).alias("names"))
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_names")).join(some, by)


def _with_names(classes: DataFrame, names: DataFrame, prefix: str = "") -> DataFrame:
    named = names.select("class", F.col("n_names").alias(f"{prefix}n_names"), F.col("names").alias(f"{prefix}names"))
    out = classes.join(named, "class", "left")
    return out.withColumns({f"{prefix}n_names": F.coalesce(f"{prefix}n_names", F.lit(0)), f"{prefix}names": F.coalesce(f"{prefix}names", F.array().cast("array<string>"))})


def capped(names: Column, total: Column, width: int = 56) -> Column:
    """Names on one line of some width, the rest of the total counted."""
    start = F.struct(F.lit("").alias("line"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def add(line: Column, name: Column) -> Column:
        first = line["n"] == 0
        goes = line["open"] & (first | (F.length(line["line"]) + F.length(name) + 2 <= width))
        longer = F.when(first, name).otherwise(F.concat(line["line"], F.lit(", "), name))
        return F.struct(F.when(goes, longer).otherwise(line["line"]).alias("line"), (line["n"] + goes.cast("int")).alias("n"), goes.alias("open"))

    made = F.aggregate(names, start, add)
    return F.when(made["n"] < total, F.concat(made["line"], F.lit(" (+"), (total - made["n"]).cast("string"), F.lit(")"))).otherwise(made["line"])


def bucket(digests: DataFrame, unit: str, mode: str, facet: str, min_size: int = 2, top: int | None = 25, sample: int = 4, **gates) -> tuple[DataFrame, DataFrame]:
    """Classes of a population at a facet: class, size, artifacts, n_names, names (the first of them), members (names and a
    count of the others), largest first if only `top` of them are asked for; and one summary row: considered, classes,
    dedup_percent, excluded."""
    rows = digests.filter((F.col("population") == unit) & (F.col("mode") == mode))
    rows, excluded = classed(rows, facet, **gates)
    left_out = (excluded or rows.limit(0)).agg(F.count(F.lit(1)).alias("excluded"))
    rows = Scratch(digests.sparkSession, "bucket").write(rows.select("class", "name", "artifact_id"), "rows")
    classes = rows.groupBy("class").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("artifact_id").alias("artifacts"))
    summary = classes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("considered"), F.count(F.lit(1)).alias("classes"))
    percent = F.when(F.col("considered") == 0, F.lit(0.0)).otherwise(100.0 * (1.0 - F.col("classes") / F.col("considered")))
    summary = summary.withColumn("dedup_percent", percent).crossJoin(F.broadcast(left_out))  # one row each
    shown = classes.filter(F.col("size") >= min_size)
    if top is not None:
        shown = shown.orderBy(F.desc("size"), "class").limit(top)
    shown = _with_names(shown, first_names(rows.join(shown.select("class"), "class", "left_semi"), ["class"], sample))
    more = F.when(F.col("n_names") > sample, F.concat(F.lit(" (+"), (F.col("n_names") - sample).cast("string"), F.lit(")"))).otherwise(F.lit(""))
    shown = shown.withColumn("members", F.concat(F.array_join("names", ", "), more))
    return (shown if top is None else shown.orderBy(F.desc("size"), "class")), summary


def overlap(digests: DataFrame, unit: str, mode: str, facet: str, left: Column, right: Column, width: int = 56, **gates) -> tuple[DataFrame, DataFrame]:
    """Classes that two selections share: class, a_size, b_size, a_names, b_names (the first of them), a_members, b_members
    (names on a line of some width, the others counted); and one row: a, b, shared, jaccard."""
    rows = digests.filter((F.col("population") == unit) & (F.col("mode") == mode)).withColumn("_a", left).withColumn("_b", right).filter("_a or _b")
    rows, _ = classed(rows, facet, **gates)
    rows = Scratch(digests.sparkSession, "overlap").write(rows.select("class", "name", F.col("_a").alias("a"), F.col("_b").alias("b")), "rows")
    side = lambda c: F.sum(F.col(c).cast("int")).alias(f"{c}_size")
    classes = rows.groupBy("class").agg(side("a"), side("b"))
    both = (F.col("a_size") > 0) & (F.col("b_size") > 0)
    total = classes.agg(F.sum((F.col("a_size") > 0).cast("long")).alias("a"), F.sum((F.col("b_size") > 0).cast("long")).alias("b"), F.sum(both.cast("long")).alias("shared"), F.count(F.lit(1)).alias("_any"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    total = total.select(zero("a"), zero("b"), zero("shared"), F.when(F.col("_any") == 0, F.lit(0.0)).otherwise(F.col("shared") / F.col("_any")).alias("jaccard"))
    shared = classes.filter(both)
    mine = rows.join(shared.select("class"), "class", "left_semi")
    for c in ("a", "b"):  # a line holds no more than one name each three characters
        shared = _with_names(shared, first_names(mine.filter(c), ["class"], width // 3 + 2), f"{c}_")
        shared = shared.withColumn(f"{c}_members", capped(F.col(f"{c}_names"), F.col(f"{c}_n_names"), width))
    return shared, total


def normalised_name(name: str = "name") -> Column:
    """Without one trailing underscore and its digits."""
    return F.regexp_replace(F.col(name), "^(.*)_[0-9]+$", "$1")


def picked(rows: DataFrame) -> DataFrame:
    """mode, key, digests: the normalised name where it is alone; else the name, then name#2, name#3 by (name, graph key, batch)."""
    scratch = Scratch(rows.sparkSession, "names")
    order = ["mode", "norm", "name", "graph_key", "batch"]
    ranked = scratch.write(numbered(rows.withColumn("norm", normalised_name()).select(*order, "digests"), order, "at", scratch), "ranked")
    groups = scratch.write(ranked.groupBy("mode", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low")), "groups")
    rows = ranked.join(groups, ["mode", "norm"]).withColumn("i", F.col("at") - F.col("low") + 1)
    key = F.when(F.col("n") == 1, F.col("norm")).when(F.col("i") == 1, F.col("name")).otherwise(F.concat("name", F.lit("#"), F.col("i").cast("string")))
    # two names may still meet at one key: the last one counts
    return rows.withColumn("key", key).groupBy("mode", "key").agg(F.max_by("digests", F.struct("norm", "i")).alias("digests"))


def diff(digests: DataFrame, unit: str, left: Column, right: Column, name: str | None = None) -> DataFrame:
    """name, mode, dimension, a, b, same: digests of two selections by name; a side that lacks the name shows absent."""
    rows = digests.filter(F.col("population") == unit)
    rows = rows.filter(F.col("name").contains(name)) if name else rows
    a = picked(rows.filter(left)).withColumnRenamed("digests", "da")
    b = picked(rows.filter(right)).withColumnRenamed("digests", "db")
    both = a.join(b, ["mode", "key"], "full_outer")
    dims = F.explode(F.when(F.col("da").isNull() | F.col("db").isNull(), F.array(F.lit("-"))).otherwise(F.array(*map(F.lit, wire.DIMENSIONS)))).alias("dimension")
    both = both.select("mode", "key", "da", "db", dims)
    short = lambda c: F.coalesce(F.substring(F.lower(F.hex(F.col(c)[F.col("dimension")])), 1, 16), F.lit(""))
    there = lambda c: F.when(F.col(c).isNull(), "absent").otherwise("present")
    alone = F.col("dimension") == "-"
    same = ~alone & F.col("da")[F.col("dimension")].eqNullSafe(F.col("db")[F.col("dimension")])
    return both.select(
        F.col("key").alias("name"), "mode", "dimension", F.when(alone, there("da")).otherwise(short("da")).alias("a"), F.when(alone, there("db")).otherwise(short("db")).alias("b"), F.when(same, "=").otherwise("DIFF").alias("same")
    )


def root(digests: DataFrame, unit: str | None = None, mode: str | None = None, check: str | None = None) -> dict:
    """Root over the distinct addresses of all rows at all dimensions they have; another root than `check` is an error."""
    rows = digests.filter(F.col("population") == unit) if unit else digests
    rows = rows.filter(F.col("mode") == mode) if mode else rows
    made, leaves = set_root(with_address(rows, None), "address")
    if check is not None and check != made.hex():
        raise RootMismatch(f"root is {made.hex()}, expected {check}")
    return {"root": made.hex(), "addresses": leaves, "rows": rows.count(), "unit": unit, "mode": mode}


def digest_index(digests: DataFrame, policy_id: bytes | None = None) -> DataFrame:
    """dimension, digest, graph_key, each once: the graphs of a digest are rows. All must be of one policy, if it is given."""
    if policy_id is not None and not digests.filter(F.col("policy_id") != F.lit(bytearray(policy_id))).isEmpty():
        raise PolicyMismatch("the index holds rows of another policy")
    return digests.select(F.explode("digests").alias("dimension", "digest"), "graph_key").distinct()


def facet_index(digests: DataFrame, facet: str) -> DataFrame:
    """facet_id, address, graph_key, each once."""
    return with_address(digests, facet).select("facet_id", "address", "graph_key").distinct()


def index_sizes(index: DataFrame) -> DataFrame:
    """For each key of an index the number of its graphs, and the first of them."""
    keys = [c for c in index.columns if c != "graph_key"]
    return index.groupBy(*keys).agg(F.count(F.lit(1)).alias("graphs"), F.min("graph_key").alias("first"))
