"""Units from relational tables: orders, conversations, sessions and the geography of trade, as graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgraph import wire
from prismgraph.sources.units import FIELD

SEP = wire.SEPARATOR


def node_key(kind: str, owner: Column | str, local: Column) -> Column:
    return F.concat(F.lit(f"entity:{kind}{SEP}"), F.lit(owner) if isinstance(owner, str) else owner, F.lit(SEP), local.cast("string"))


def graph_key(kind: str, owner: str, local: Column, part: str) -> Column:
    return F.concat(F.lit(f"{kind}{SEP}{owner}{SEP}"), local.cast("string"), F.lit(f"{SEP}{part}"))


def fact(dimension: str, name: str, kind: str, value: Column) -> Column:
    """A field; a null value is none at all, which `facts` drops."""
    none = F.lit(None)
    made = F.struct(
        F.lit(dimension).alias("dimension"),
        F.lit(name).alias("name"),
        F.lit(kind).alias("kind"),
        (value.cast("string") if kind == "text" else none.cast("string")).alias("text"),
        (value.cast("decimal(20,0)") if kind in ("bool", "u64", "i64") else none.cast("decimal(20,0)")).alias("num"),
        (value.cast("binary") if kind == "bytes" else none.cast("binary")).alias("bytes"),
    )
    return F.when(value.isNotNull(), made)


def facts(*fields: Column) -> Column:
    return F.filter(F.array(*fields), lambda f: f.isNotNull()) if fields else F.array().cast(f"array<{FIELD}>")


def node(key: Column, kind: str, *fields: Column) -> Column:
    return F.struct(key.alias("key"), F.lit(kind).alias("kind"), facts(*fields).alias("fields"))


def child(parent: Column, label: str, ordinal: Column, key: Column) -> Column:
    return F.struct(parent.alias("parent"), F.lit(label).alias("label"), ordinal.cast("long").alias("ordinal"), key.alias("child"))


def no_edges() -> Column:
    return F.array().cast(f"array<struct<source:string,label:string,target:string,role:string,fields:array<{FIELD}>>>")


def edge(source: Column, label: str, target: Column, role: str) -> Column:
    return F.struct(source.alias("source"), F.lit(label).alias("label"), target.alias("target"), F.lit(role).alias("role"), F.array().cast(f"array<{FIELD}>").alias("fields"))


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def unit(recipe: str, population: str, name: Column, key: Column, **graph: Column) -> list[Column]:
    return [
        F.lit(recipe).alias("recipe"), F.lit(population).alias("population"), name.cast("string").alias("name"), F.lit("final").alias("status"), key.alias("graph_key"), *(c.alias(n) for n, c in graph.items()),
    ]


def order_units(orders: DataFrame, lineitem: DataFrame, dimensions: Sequence[str] = ("structure", "names", "constants"), numbered: bool = True) -> DataFrame:
    """An order and its lines, an unordered set. structure: status, return flag, line status; names: priority; constants:
    quantity in hundredths. Facts of other than these dimensions are left out; lines that needn't be `numbered` in a fixed
    order, as where keys are free, come without the columns that only order them."""
    root = node_key("trade.order", "orders", F.col("o_orderkey"))
    own = {"structure": ("l_returnflag", "l_linestatus"), "constants": ("l_quantity",)}
    told = [c for d, columns in own.items() if d in dimensions for c in columns]
    place = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice", "l_shipdate")
    line = F.struct(*([F.struct(*place).alias("place")] if numbered else []), *(told or ["l_linenumber"]))
    lines = F.collect_list(line)
    per = lineitem.withColumnRenamed("l_orderkey", "o_orderkey").groupBy("o_orderkey").agg((F.sort_array(lines) if numbered else lines).alias("ls"))
    joined = orders.join(per, "o_orderkey", "left").withColumn("ls", F.coalesce("ls", F.expr("array()").cast(per.schema["ls"].dataType)))
    joined = joined.withColumn("_stem", F.concat(F.lit(f"entity:trade.line{SEP}order:"), F.col("o_orderkey").cast("string"), F.lit(SEP)))  # once, not for each line
    key = lambda i: F.concat(F.col("_stem"), i.cast("string"))
    of = lambda d, *made: made if d in dimensions else ()

    def as_node(x: Column, i: Column) -> Column:
        shown = of("structure", lambda: fact("structure", "flag", "text", x["l_returnflag"]), lambda: fact("structure", "state", "text", x["l_linestatus"]))
        return node(key(i), "line", *(made() for made in (*shown, *of("constants", lambda: fact("constants", "quantity", "i64", F.round(x["l_quantity"] * 100).cast("long"))))))

    top = node(root, "order", *of("structure", fact("structure", "status", "text", F.col("o_orderstatus"))), *of("names", fact("names", "priority", "text", F.col("o_orderpriority"))))
    nodes = F.concat(F.array(top), F.transform("ls", as_node))
    children = F.transform("ls", lambda x, i: child(root, "line", F.lit(0), key(i)))
    return joined.select(*unit("trade.order/1", "order", F.col("o_orderkey"), graph_key("trade.order", "orders", F.col("o_orderkey"), "order"), nodes=nodes, children=children, edges=no_edges()), "o_orderkey", "o_orderstatus")


def conversation_units(turns: DataFrame) -> DataFrame:
    """A conversation and its turns in order. structure: role; names: text; constants: characters."""
    per = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    root = node_key("chat.conversation", "chat", F.col("conv_id"))
    key = lambda i: F.concat(F.lit(f"entity:chat.turn{SEP}conversation:"), F.col("conv_id").cast("string"), F.lit(SEP), i.cast("string"))
    as_node = lambda x, i: node(key(i), "turn", fact("structure", "role", "text", x["role"]), fact("names", "text", "text", x["text"]), fact("constants", "chars", "u64", F.length(x["text"])))
    nodes = F.concat(F.array(node(root, "conversation")), F.transform("ts", as_node))
    children = F.transform("ts", lambda x, i: child(root, "turn", i, key(i)))
    return per.select(*unit("chat/1", "conversation", F.col("conv_id"), graph_key("chat.conversation", "chat", F.col("conv_id"), "turns"), nodes=nodes, children=children, edges=no_edges()), "conv_id")


def session_units(events: DataFrame) -> DataFrame:
    """A user's events as a chain of control edges, without children. structure: type; constants: value in hundredths."""
    per = events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type", "value"))).alias("es"))
    key = lambda i: F.concat(F.lit(f"entity:event{SEP}user:"), F.col("user_id").cast("string"), F.lit(SEP), i.cast("string"))
    as_node = lambda x, i: node(key(i), "event", fact("structure", "type", "text", x["event_type"]), fact("constants", "value", "i64", F.round(x["value"] * 100).cast("long")))
    links = F.transform(F.slice("es", 2, F.greatest(F.size("es") - 1, F.lit(1))), lambda x, i: edge(key(i), "next", key(i + 1), "control"))
    no_children = F.array().cast("array<struct<parent:string,label:string,ordinal:bigint,child:string>>")
    return per.select(*unit("session/1", "session", F.col("user_id"), graph_key("user", "users", F.col("user_id"), "session"), nodes=F.transform("es", as_node), children=no_children, edges=links), "user_id")


def geography_unit(region: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    """One unit per region: nations below it, suppliers below those. names: names; constants: balance in cents."""
    owner = lambda c: node_key(c, "geo", F.col(f"{c}_id"))
    r = region.select(F.col("r_regionkey").alias("region_id"), "r_name")
    n = nation.select(F.col("n_nationkey").alias("nation_id"), "n_name", F.col("n_regionkey").alias("region_id"))
    s = supplier.select(F.col("s_suppkey").alias("supplier_id"), "s_name", F.col("s_nationkey").alias("nation_id"), cents("s_acctbal").alias("balance")).join(n, "nation_id")
    top = r.select("region_id", F.lit("a").alias("o"), node(owner("region"), "region", fact("names", "name", "text", F.col("r_name"))).alias("n"), F.lit(None).cast("struct<parent:string,label:string,ordinal:bigint,child:string>").alias("c"))
    zero = F.lit(0)
    mid = n.select("region_id", F.lit("b").alias("o"), node(owner("nation"), "nation", fact("names", "name", "text", F.col("n_name"))).alias("n"), child(owner("region"), "nation", zero, owner("nation")).alias("c"))
    low = s.select("region_id", F.lit("c").alias("o"), node(owner("supplier"), "supplier", fact("names", "name", "text", F.col("s_name")), fact("constants", "balance", "i64", F.col("balance"))).alias("n"), child(owner("nation"), "supplier", zero, owner("supplier")).alias("c"))
    rows = top.unionByName(mid).unionByName(low).groupBy("region_id").agg(F.collect_list("n").alias("nodes"), F.collect_list("c").alias("children"))
    return rows.select(*unit("geo/1", "geography", F.col("region_id"), graph_key("region", "geo", F.col("region_id"), "tree"), nodes=F.col("nodes"), children=F.col("children"), edges=no_edges()), "region_id")
