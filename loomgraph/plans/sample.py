"""The sample tables as a property graph and as triples. Ids are label number * 2**48 + key, so no shuffle is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, Tables
from loomgraph.operators.rdf import RdfStore, XSD, term

_ORDINAL = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7, "Event": 8, "Document": 9}


def node_id(label: str, key):
    return F.lit(_ORDINAL[label] << 48) + (F.col(key) if isinstance(key, str) else key).cast("bigint")


def sample_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def nodes(table: str, label: str, prefix: str, key: str, *names: str):
        return lambda: read(table).select(node_id(label, prefix + key).alias("_id"), F.col(prefix + key).cast("bigint").alias(key), *[F.col(prefix + n).alias(n) for n in names])

    def edge(table: str, src: str, a: str, dst: str, b: str):
        return read(table).select(node_id(src, a).alias("_id"), node_id(src, a).alias("_src"), node_id(dst, b).alias("_dst"))

    def documents() -> DataFrame:
        labels = read("labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        return read("documents").join(labels, "doc_id", "left").select(node_id("Document", "doc_id").alias("_id"), "doc_id", "lang", "source", "n_chars", "quality", "toxic")

    def follows() -> DataFrame:
        customer = read("customer")
        n, key, base = customer.count(), F.col("c_custkey"), F.lit(_ORDINAL["Customer"] << 48)  # modular arithmetic over the number of customers
        pair = lambda e, t: F.struct(e.alias("e"), key.alias("k"), (t % n).alias("t"))
        ends = customer.select(F.explode(F.array(pair(2 * key, 2 * key + 1), pair(2 * key + 1, 3 * key + 2))).alias("x"))
        return ends.select(F.col("x.e").alias("_id"), (base + F.col("x.k")).alias("_src"), (base + F.col("x.t")).alias("_dst"), (F.col("x.e") % 7).alias("weight"))

    def line(dst: str, key: str, *more: str):
        table = read("lineitem")
        return table.select(F.xxhash64(*table.columns).alias("_id"), node_id("Order", "l_orderkey").alias("_src"), node_id(dst, key).alias("_dst"), *[F.col(f"l_{x}").alias(x) for x in more])

    def following() -> DataFrame:
        after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        return read("events").withColumn("next", after).where("next is not null").select(node_id("Event", "event_id").alias("_id"), node_id("Event", "event_id").alias("_src"), node_id("Event", "next").alias("_dst"))

    tables = {
        "Region": nodes("region", "Region", "r_", "regionkey", "name"),
        "Nation": nodes("nation", "Nation", "n_", "nationkey", "name"),
        "Customer": nodes("customer", "Customer", "c_", "custkey", "name", "acctbal", "mktsegment"),
        "Supplier": nodes("supplier", "Supplier", "s_", "suppkey", "name", "acctbal"),
        "Part": nodes("part", "Part", "p_", "partkey", "name", "brand", "type", "size", "retailprice"),
        "Order": nodes("orders", "Order", "o_", "orderkey", "orderstatus", "totalprice", "orderdate", "orderpriority"),
        "User": lambda: read("events").select("user_id").distinct().select(node_id("User", "user_id").alias("_id"), "user_id"),
        "Event": lambda: read("events").select(node_id("Event", "event_id").alias("_id"), "event_id", "ts", "event_type", "value", "props"),
        "Document": documents,
    }
    rels = {
        "IN_REGION": lambda: edge("nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
        "IN_NATION": lambda: edge("customer", "Customer", "c_custkey", "Nation", "c_nationkey").union(edge("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey")),
        "PLACED": lambda: read("orders").select(node_id("Order", "o_orderkey").alias("_id"), node_id("Customer", "o_custkey").alias("_src"), node_id("Order", "o_orderkey").alias("_dst")),
        "CONTAINS": lambda: line("Part", "l_partkey", "linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate"),
        "SUPPLIED_BY": lambda: line("Supplier", "l_suppkey", "linenumber", "quantity"),
        "PERFORMED": lambda: read("events").select(node_id("Event", "event_id").alias("_id"), node_id("User", "user_id").alias("_src"), node_id("Event", "event_id").alias("_dst")),
        "NEXT": following,
        "FOLLOWS": follows,
    }
    targets = {"IN_REGION": "Region", "IN_NATION": "Nation", "PLACED": "Order", "CONTAINS": "Part", "SUPPLIED_BY": "Supplier", "PERFORMED": "Event", "NEXT": "Event", "FOLLOWS": "Customer"}
    keys = {"Region": "regionkey", "Nation": "nationkey", "Customer": "custkey", "Supplier": "suppkey", "Part": "partkey", "Order": "orderkey"}
    return PropertyGraph(Tables(tables), Tables(rels), targets, {k: (v, _ORDINAL[k] << 48) for k, v in keys.items()}, frozenset(tables))


def sample_triples(spark: SparkSession, sf_dir: str) -> RdfStore:
    """Nations and regions as triples in the default graph, and again the regions' names in a graph of their own."""
    nation, region = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    node = lambda kind, key: term("iri", F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")))
    none = F.lit(None).cast("struct<kind:string,value:string,datatype:string,lang:string>")
    quad = lambda t, s, p, o, g=none: t.select(s.alias("s"), term("iri", p).alias("p"), o.alias("o"), g.alias("g"))
    name = lambda c: term("literal", F.col(c), XSD + "string")
    parts = [
        quad(nation, node("nation", "n_nationkey"), "name", name("n_name")),
        quad(nation, node("nation", "n_nationkey"), "key", term("literal", F.col("n_nationkey").cast("string"), XSD + "integer")),
        quad(nation, node("nation", "n_nationkey"), "region", node("region", "n_regionkey")),
        quad(region, node("region", "r_regionkey"), "name", name("r_name")),
        quad(region, node("region", "r_regionkey"), "name", name("r_name"), term("iri", "regions")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return RdfStore(out)
