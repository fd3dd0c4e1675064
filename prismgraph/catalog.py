"""Registered queries over graphs derived from the test tables, and the SQL that recomputes each from the base tables.

On forests under free keys the colours tell graphs apart exactly, so classes of addresses are classes of a canonical
string that SQL can build. Queries return names, sizes and counts of classes, never the digests themselves.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismgraph import wire
from prismgraph.operators import claims as c
from prismgraph.operators import queries as q
from prismgraph.operators.check import check_units, cyclic_nodes, infer_declaration
from prismgraph.operators.exact import exact_column
from prismgraph.operators.forms import form_id, with_form
from prismgraph.operators.hashing import filled_kinds, hash_forms, hash_units, with_address
from prismgraph.plans.declaration import ChildDecl, Declaration, FieldDecl
from prismgraph.plans.view import apply_view, parse_view, reachable
from prismgraph.scratch import Scratch
from prismgraph.sources import producers as p

UNITS_EACH = 20_000
DIMENSIONS = {
    "trade.order/1": ("structure", "names", "constants"),
    "chat/1": ("structure", "names", "constants"),
    "session/1": ("structure", "constants"),
    "geo/1": ("structure", "names", "constants"),
}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _orders(spark: SparkSession, sf: str, **only) -> DataFrame:
    return p.order_units(_table(spark, sf, "orders"), _table(spark, sf, "lineitem"), **only)


def _filed(units: DataFrame) -> DataFrame:
    return units.withColumns({"artifact_id": F.concat("recipe", F.lit(":all")), "world": F.lit("tables"), "batch": F.lit("tables:all")})


def _hashed(units: DataFrame, dimensions: dict | None = None, facets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Stored digests of units under free keys. Graphs that differ in keys alone are hashed once: hashing costs far more
    than moving a graph. Forms are dealt evenly to every core, and to as many tasks as keep UNITS_EACH."""
    spark = units.sparkSession
    dimensions = dimensions or DIMENSIONS
    scratch = Scratch(spark, "hashed")
    rows = scratch.write(with_form(_filed(units), dimensions.get("*")).drop("keys").withColumn("form_id", form_id()), "rows")
    forms = scratch.write(rows.groupBy("form_id").agg(F.first("form").alias("form")), "forms")
    tasks = max(spark.sparkContext.defaultParallelism, -(-forms.count() // UNITS_EACH))
    digests = scratch.write(hash_forms(forms.repartition(tasks), dimensions, facets).withColumn("form_id", form_id()).drop("form"), "digests")
    return rows.drop("form").join(digests, "form_id").drop("form_id")


def _hashed_orders(spark: SparkSession, sf: str, dims: tuple[str, ...] = DIMENSIONS["trade.order/1"], facets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Stored digests of orders under free keys. Nearly every order is another form, and all are stars: whole batches are
    hashed as columns, in the tasks that put the orders together."""
    return Scratch(spark, "hashed").write(hash_units(_filed(_orders(spark, sf, dimensions=dims, numbered=False)), {"*": dims}, ("shape",), facets=facets), "digests")


def _classes(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    return found[0].select(F.col("names")[0].alias("first_name"), F.col("size"), "members")


def bucket_order(facet: str, *dims: str):
    return lambda spark, sf: _classes(q.bucket(_hashed_orders(spark, sf, dims, [dims]), "order", "shape", facet, top=None))


def bucket_conversation(spark: SparkSession, sf: str) -> DataFrame:
    units = p.conversation_units(_table(spark, sf, "conversations"))
    return _classes(q.bucket(_hashed(units, dimensions={"*": ("structure",)}), "conversation", "shape", "structure", top=None))


def bucket_session(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of control edges, as large as a user has events."""
    units = p.session_units(_table(spark, sf, "events"))
    return _classes(q.bucket(_hashed(units, dimensions={"*": ("structure",)}), "session", "shape", "structure", min_size=1, top=None))


def dedup_order(spark: SparkSession, sf: str) -> DataFrame:
    return q.bucket(_hashed_orders(spark, sf, facets=[DIMENSIONS["trade.order/1"]]), "order", "shape", "all", top=None)[1].withColumn("dedup_percent", F.round("dedup_percent", 6))


def facets_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every facet of the filled dimensions from one set of stored digests."""
    stored = _hashed_orders(spark, sf)
    dims, kinds = DIMENSIONS["trade.order/1"], filled_kinds(stored)
    out = None
    for n in range(1, len(dims) + 1):
        for some in combinations(dims, n):
            facet = "+".join(some)
            one = with_address(stored, facet, kinds=kinds).agg(F.lit(facet).alias("facet"), F.count(F.lit(1)).alias("considered"), F.count_distinct("address").alias("classes"))
            out = one if out is None else out.unionByName(one)
    return out


def overlap_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = _hashed_orders(spark, sf, ("structure", "constants"), []).withColumn("world", F.concat(F.lit("status:"), "o_orderstatus"))
    shared, _ = q.overlap(rows, "order", "shape", "constants", q.selects("status:F::"), q.selects("status:O::"))
    return shared.select(F.col("a_names")[0].alias("a_first"), F.col("b_names")[0].alias("b_first"), "a_size", "b_size")


def overlap_summary_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = _hashed_orders(spark, sf, ("structure", "constants"), []).withColumn("world", F.concat(F.lit("status:"), "o_orderstatus"))
    return q.overlap(rows, "order", "shape", "constants", q.selects("status:F::"), q.selects("status:O::"))[1].withColumn("jaccard", F.round("jaccard", 9))


def diff_conversation(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations against those that have a system turn, without that turn."""
    turns = _table(spark, sf, "conversations")
    less = turns.filter("role <> 'system'").join(turns.filter("role = 'system'").select("conv_id").distinct(), "conv_id", "left_semi")
    left = _hashed(p.conversation_units(turns)).withColumn("world", F.lit("whole"))
    right = _hashed(p.conversation_units(less)).withColumn("world", F.lit("less"))
    out = q.diff(left.unionByName(right), "conversation", F.col("world") == "whole", F.col("world") == "less")
    return out.select("name", "mode", "dimension", "same")


def digest_index_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = q.index_sizes(q.digest_index(_hashed_orders(spark, sf, ("structure",))))
    return rows.select("dimension", "graphs", F.split("first", wire.SEPARATOR)[2].alias("first_order"))


def facet_index_conversation(spark: SparkSession, sf: str) -> DataFrame:
    rows = q.index_sizes(q.facet_index(_hashed(p.conversation_units(_table(spark, sf, "conversations"))), "structure+constants"))
    return rows.select("graphs", F.split("first", wire.SEPARATOR)[2].alias("first_conversation"))


STRICT = Declaration(
    "trade.order/1",
    ("order",),
    True,
    (
        ("order", (FieldDecl("status", ("structure",), "text", "one"), FieldDecl("priority", ("names",), "text", "one"))),
        ("line", (FieldDecl("flag", ("structure",), "text", "one"), FieldDecl("state", ("structure",), "text", "one"), FieldDecl("quantity", ("constants",), "i64", "one"))),
    ),
    (ChildDecl(("order",), "line", ("line",), "one"),),
)


def check_order(spark: SparkSession, sf: str) -> DataFrame:
    """Orders against a declaration of exactly one line each."""
    units = _orders(spark, sf).withColumn("gid", F.col("name"))
    return check_units(units, {STRICT.recipe: STRICT}).select(F.col("gid").alias("name"), F.element_at(F.split("at", wire.SEPARATOR), 3).alias("at"), "problem")


def infer_order(spark: SparkSession, sf: str) -> DataFrame:
    units = _orders(spark, sf).withColumn("gid", F.col("name"))
    made = infer_declaration(units, "trade.order/1")
    rows = [(k, f.name, "+".join(f.dimensions), f.value, f.occurs) for k, fs in made.kinds for f in fs]
    rows += [(x.parents[0], x.label, "child", x.children[0], x.shape) for x in made.children]
    rows += [(k, "", "root", "", "single" if made.single_root else "several") for k in made.roots]
    return spark.createDataFrame(rows, "kind string, item string, what string, holds string, occurs string")


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """One graph in which part k has an edge to (k * k + size) modulo 1999: cycles with trees that lead to them."""
    step = (F.col("p_partkey") * F.col("p_partkey") + F.col("p_size")) % 1999
    return _table(spark, sf, "part").select(F.lit("parts").alias("gid"), F.col("p_partkey").cast("long").alias("s"), step.cast("long").alias("t"))


def acyclic_parts(spark: SparkSession, sf: str) -> DataFrame:
    return cyclic_nodes(_steps(spark, sf)).select(F.col("key").alias("part"))


def reachable_parts(spark: SparkSession, sf: str) -> DataFrame:
    roots = spark.range(1, 4).select(F.lit("parts").alias("gid"), F.col("id").alias("key"))
    return reachable(_steps(spark, sf), roots).select(F.col("key").alias("part"))


def _address(x: Column) -> Column:
    return F.unhex(F.sha2(x.cast("string").cast("binary"), 256))


def closure_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that link each customer to the next of the same nation and segment; classes by their representative."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    pairs = _table(spark, sf, "customer").withColumn("next", F.lead("c_custkey").over(w)).filter("next is not null")
    facet = F.unhex(F.lit("00" * 32))
    none = F.lit(None)
    claims = pairs.select(facet.alias("facet_id"), _address(F.col("c_custkey")).alias("left"), _address(F.col("next")).alias("right"), none.cast("binary").alias("assumptions"))
    people = _table(spark, sf, "customer").select("c_custkey", facet.alias("facet_id"), _address(F.col("c_custkey")).alias("address"))
    rows = c.with_representative(people, claims)
    return rows.groupBy("class").agg(F.min("c_custkey").alias("first_customer"), F.count(F.lit(1)).alias("size")).drop("class")


def claims_bucket_order(spark: SparkSession, sf: str) -> DataFrame:
    """Structure classes, merged by claims where the orders have equally many lines."""
    stored = Scratch(spark, "claims").write(_hashed_orders(spark, sf, ("structure",)), "digests")
    known = with_address(stored, "structure").select("facet_id", "address", "node_count").distinct()
    w = Window.partitionBy("facet_id", "node_count").orderBy("address")
    pairs = known.withColumn("next", F.lead("address").over(w)).filter("next is not null")
    claims = pairs.select("facet_id", F.col("address").alias("left"), F.col("next").alias("right"), F.lit(None).cast("binary").alias("assumptions"))
    return _classes(q.bucket(stored, "order", "shape", "structure", top=None, claims=claims))


def attested_bucket_order(spark: SparkSession, sf: str) -> DataFrame:
    """Structure classes of orders whose address carries a property: being that of some order with status P."""
    stored = Scratch(spark, "attested").write(_hashed_orders(spark, sf, ("structure",)), "digests")
    marked = with_address(stored.filter("o_orderstatus = 'P'"), "structure").select(F.col("address").alias("subject"), F.lit("partial").alias("property"))
    found = q.bucket(stored, "order", "shape", "structure", min_size=1, top=None, attestations=marked, require="partial")
    return found[1].withColumn("dedup_percent", F.round("dedup_percent", 6))


NATIONS_VIEW = f"""
language "{wire.VIEW_LANGUAGE}"
view "nations/1"
input "geo/1"
root child-parent "nation"
traverse children nation
retain structure, names
"""


def view_geography(spark: SparkSession, sf: str) -> DataFrame:
    units = p.geography_unit(_table(spark, sf, "region"), _table(spark, sf, "nation"), _table(spark, sf, "supplier"))
    seen = apply_view(parse_view(NATIONS_VIEW), units)
    names = F.array_sort(F.transform(F.filter("nodes", lambda n: n["kind"] == "nation"), lambda n: n["fields"][0]["text"]))
    return seen.select("region_id", F.size("nodes").alias("nodes"), F.size("children").alias("children"), F.array_join(names, ",").alias("nations"))


def view_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of a view's output under its own recipe: regions with equally many nations are one class without names."""
    units = p.geography_unit(_table(spark, sf, "region"), _table(spark, sf, "nation"), _table(spark, sf, "supplier"))
    view = parse_view(NATIONS_VIEW)
    rows = with_address(_hashed(apply_view(view, units), dimensions={"*": view.dimensions}), "structure")
    return rows.groupBy("address").agg(F.count(F.lit(1)).alias("regions"), F.min("node_count").alias("nodes")).drop("address")


def root_order(spark: SparkSession, sf: str) -> DataFrame:
    found = q.root(Scratch(spark, "rooted").write(_hashed_orders(spark, sf, facets=[DIMENSIONS["trade.order/1"]]), "digests"), "order", "shape")
    return spark.createDataFrame([(found["addresses"], found["rows"], len(found["root"]))], "addresses long, rows long, hex_digits int")


def exact_conversation(spark: SparkSession, sf: str) -> DataFrame:
    """Exact canonical forms of conversations as paths labelled with roles, grouped; those beyond the budget are one group."""
    turns = _table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: t["role"]).alias("labels"))
    ends = F.transform(F.sequence(F.lit(0), F.size("labels") - 1), lambda i: F.struct(i.alias("from"), (i + 1).alias("to"), F.lit("next").alias("role")))
    found = turns.withColumn("e", exact_column("labels", F.slice(ends, F.lit(1), F.size("labels") - 1)))
    return found.groupBy("e.status", "e.labels", "e.edges").agg(F.min("conv_id").alias("first_conversation"), F.count(F.lit(1)).alias("size")).select("status", "first_conversation", "size")


def mixed_pairs_order(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by whether structure and constants both vary among lines, as the mask has it."""
    rows = _hashed_orders(spark, sf, ("structure", "constants"), [])
    return rows.groupBy((F.col("mixed_pairs") != 0).alias("mixed")).agg(F.count(F.lit(1)).alias("orders"))


def select_conversation(spark: SparkSession, sf: str) -> DataFrame:
    rows = p.conversation_units(_table(spark, sf, "conversations")).withColumns({"world": q.graph_owner(), "artifact_id": F.lit("batch")})
    return rows.filter(q.selects("cha::1") | q.selects("::=7")).select("name")


def normalised_customers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("_"), F.col("c_nationkey").cast("string")).alias("name"))
    return rows.select("c_custkey", q.normalised_name().alias("norm"))


QUERIES = {
    "bucket_order_structure": bucket_order("structure", "structure"),
    "bucket_order_names_blind": bucket_order("names-blind", "structure", "constants"),
    "bucket_order_all": bucket_order("all", "structure", "names", "constants"),
    "bucket_conversation_structure": bucket_conversation,
    "bucket_session_structure": bucket_session,
    "dedup_order": dedup_order,
    "facets_order": facets_order,
    "overlap_order": overlap_order,
    "overlap_summary_order": overlap_summary_order,
    "diff_conversation": diff_conversation,
    "digest_index_order": digest_index_order,
    "facet_index_conversation": facet_index_conversation,
    "check_order": check_order,
    "infer_order": infer_order,
    "acyclic_parts": acyclic_parts,
    "reachable_parts": reachable_parts,
    "closure_customers": closure_customers,
    "claims_bucket_order": claims_bucket_order,
    "attested_bucket_order": attested_bucket_order,
    "view_geography": view_geography,
    "view_addresses": view_addresses,
    "root_order": root_order,
    "exact_conversation": exact_conversation,
    "mixed_pairs_order": mixed_pairs_order,
    "select_conversation": select_conversation,
    "normalised_customers": normalised_customers,
}

_LINE = {
    "structure": "l_returnflag || '/' || l_linestatus",
    "constants": "cast(round(l_quantity * 100) as bigint)::varchar",
}


def _forms(*dims: str) -> str:
    """SQL for one row per order: name, status, n (lines), form (canonical string of these dimensions)."""
    line = " || ';' || ".join(f"({_LINE[d]})" for d in dims if d in _LINE)
    lines = f"coalesce(string_agg({line}, ',' order by {line}) filter (where l_orderkey is not null), '')" if line else "''"
    top = " || ';' || ".join([{"structure": "o_orderstatus", "names": "o_orderpriority", "constants": "''"}[d] for d in dims])
    return f"""forms as (
        select o_orderkey::varchar as name, any_value(o_orderstatus) as status, count(l_orderkey) as n,
               any_value({top}) || '#' || count(l_orderkey) || '#' || {lines} as form
        from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)"""


_MEMBERS = "array_to_string(list_slice(list_sort(list(distinct name)), 1, 4), ', ') || case when count(distinct name) > 4 then ' (+' || (count(distinct name) - 4) || ')' else '' end as members"


def _bucket_sql(forms: str, min_size: int = 2) -> str:
    return f"with {forms} select min(name) as first_name, count(*) as size, {_MEMBERS} from forms group by form having count(*) >= {min_size}"


_TURNS = "forms as (select conv_id::varchar as name, string_agg({0}, chr(31) order by turn, role, text) as form from conversations group by conv_id)"
_FUNCTION = "f as (select p_partkey as s, (p_partkey * p_partkey + p_size) % 1999 as t from part)"

ORACLE = {
    "bucket_order_structure": _bucket_sql(_forms("structure")),
    "bucket_order_names_blind": _bucket_sql(_forms("structure", "constants")),
    "bucket_order_all": _bucket_sql(_forms("structure", "names", "constants")),
    "bucket_conversation_structure": _bucket_sql(_TURNS.format("role")),
    "bucket_session_structure": _bucket_sql("forms as (select user_id::varchar as name, string_agg(event_type, ',' order by ts, event_id) as form from events group by user_id)", 1),
    "dedup_order": f"with {_forms('structure', 'names', 'constants')} select count(*) as considered, count(distinct form) as classes, round(100.0 * (1.0 - count(distinct form) / count(*)), 6) as dedup_percent, 0::bigint as excluded from forms",
    "facets_order": " union all ".join(
        f"(with {_forms(*some)} select '{'+'.join(some)}' as facet, count(*) as considered, count(distinct form) as classes from forms)"
        for n in (1, 2, 3) for some in combinations(DIMENSIONS["trade.order/1"], n)
    ),
    "overlap_order": f"""with {_forms("constants")} select min(name) filter (where status = 'F') as a_first, min(name) filter (where status = 'O') as b_first,
        count(*) filter (where status = 'F') as a_size, count(*) filter (where status = 'O') as b_size from forms where status in ('F', 'O') group by form
        having count(*) filter (where status = 'F') > 0 and count(*) filter (where status = 'O') > 0""",
    "overlap_summary_order": f"""with {_forms("constants")}, g as (select form, bool_or(status = 'F') as a, bool_or(status = 'O') as b from forms where status in ('F', 'O') group by form)
        select count(*) filter (where a) as a, count(*) filter (where b) as b, count(*) filter (where a and b) as shared, round(count(*) filter (where a and b) / count(*), 9) as jaccard from g""",
    "diff_conversation": """with l as (select conv_id, string_agg(role, chr(31) order by turn, role, text) as structure, string_agg(text, chr(31) order by turn, role, text) as names,
                   string_agg(length(text)::varchar, ',' order by turn, role, text) as constants, count(*) as n from conversations group by conv_id),
        r as (select conv_id, string_agg(role, chr(31) order by turn, role, text) as structure, string_agg(text, chr(31) order by turn, role, text) as names,
                   string_agg(length(text)::varchar, ',' order by turn, role, text) as constants, count(*) as n from conversations where role <> 'system' and conv_id in (select conv_id from conversations where role = 'system') group by conv_id),
        j as (select l.conv_id::varchar as name, r.conv_id is null as gone, l.structure = r.structure as structure, l.names = r.names as names, l.constants = r.constants as constants
              from l left join r on l.conv_id = r.conv_id)
        select name, 'shape' as mode, '-' as dimension, 'DIFF' as same from j where gone
        union all select name, 'shape', 'structure', case when structure then '=' else 'DIFF' end from j where not gone
        union all select name, 'shape', 'names', case when names then '=' else 'DIFF' end from j where not gone
        union all select name, 'shape', 'constants', case when constants then '=' else 'DIFF' end from j where not gone
        union all select name, 'shape', d, '=' from j, (values ('types'), ('trace_events')) v(d) where not gone""",
    "digest_index_order": f"with {_forms('structure')} select 'structure' as dimension, count(*) as graphs, min(name) as first_order from forms group by form",
    "facet_index_conversation": f"with {_TURNS.format('role || length(text)::varchar')} select count(*) as graphs, min(name) as first_conversation from forms group by form",
    "check_order": f"""with {_forms("structure")}
        select name, name as at, 'children -line-> have ordinals [0' || repeat(', 0', n - 1) || '], declared One' as problem from forms where n > 1
        union all select name, name, '`order` has no child -line->, declared required' from forms where n = 0""",
    "infer_order": f"""with {_forms("structure")}, s as (select max(n) as high, min(n) as low from forms)
        select * from (values ('line', 'flag', 'structure', 'text', 'one'), ('line', 'quantity', 'constants', 'i64', 'one'), ('line', 'state', 'structure', 'text', 'one'),
            ('order', 'priority', 'names', 'text', 'one'), ('order', 'status', 'structure', 'text', 'one'), ('order', '', 'root', '', 'single')) v(kind, item, what, holds, occurs)
        union all select 'order', 'line', 'child', 'line', case when high = 1 then 'one' else 'set' end from s""",
    "acyclic_parts": f"""with recursive {_FUNCTION}, walk(k, x) as (select 0, s from f union select k + 1, t from walk join f on s = x where k < 400)
        select x::bigint as part from walk where k = 400 group by x""",
    "reachable_parts": f"with recursive {_FUNCTION}, seen(x) as (select i::bigint from range(1, 4) r(i) union select t from seen join f on s = x) select x as part from seen",
    "closure_customers": "select min(c_custkey) as first_customer, count(*) as size from customer group by c_nationkey, c_mktsegment",
    "claims_bucket_order": _bucket_sql(_forms("structure")).replace("group by form", "group by n"),
    "attested_bucket_order": f"""with {_forms("structure")}, good as (select distinct form from forms where status = 'P')
        select count(*) as considered, count(distinct form) as classes, round(case when count(*) = 0 then 0 else 100.0 * (1.0 - count(distinct form) / count(*)) end, 6) as dedup_percent,
               (select count(*) from forms where form not in (select form from good)) as excluded from forms where form in (select form from good)""",
    "view_geography": """select r_regionkey as region_id, (1 + count(n_nationkey))::int as nodes, count(n_nationkey)::int as children, string_agg(n_name, ',' order by n_name) as nations
        from region join nation on n_regionkey = r_regionkey group by r_regionkey""",
    "view_addresses": "with g as (select r_regionkey, count(*) as n from region join nation on n_regionkey = r_regionkey group by r_regionkey) select count(*) as regions, n + 1 as nodes from g group by n",
    "root_order": f"with {_forms('structure', 'names', 'constants')} select count(distinct form) as addresses, count(*) as rows, 64 as hex_digits from forms",
    "exact_conversation": """with t as (select conv_id, count(*) as n, string_agg(role, ',' order by turn, role, text) as form from conversations group by conv_id)
        select case when n <= 64 then 'exact' else 'budget-exceeded' end as status, min(conv_id) as first_conversation, count(*) as size from t
        group by case when n <= 64 then form end, case when n <= 64 then 'exact' else 'budget-exceeded' end""",
    "mixed_pairs_order": """with o as (select o_orderkey, count(distinct l_returnflag || '/' || l_linestatus) as a, count(distinct round(l_quantity * 100)) as b
                from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)
        select a > 1 and b > 1 as mixed, count(*) as orders from o group by 1""",
    "select_conversation": "select distinct conv_id::varchar as name from conversations where conv_id::varchar like '%1%' or conv_id = 7",
    "normalised_customers": "select c_custkey, c_mktsegment as norm from customer",
}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["bucket_order_structure"](spark, sf)
