"""More of the catalogue: writes, scans of everything, functions of numbers and entities, triples that grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import values as v
from loomgraph.graph import PropertyGraph
from loomgraph.operators import match as m
from loomgraph.operators import rdf
from loomgraph.operators import rows as r
from loomgraph.operators import write as w
from loomgraph.plans.catalog import ORACLES, QUERIES, query, triples


@query("select s_suppkey as suppkey, s_acctbal > 0 as had_name, case when s_acctbal > 0 then 'seen' else 'new' end as mark from supplier")
def write_merge_on_create_on_match(g):
    known = g.with_nodes("Partner", g.nodes["Supplier"].where("acctbal > 0").select("_id", "suppkey", "name"))
    made = w.merge_nodes(known, m.scan(g, "s", "Supplier"), "Partner", "p", on_create={"mark": F.lit("new")}, on_match={"mark": F.lit("seen")}, suppkey=F.col("s__suppkey"))
    return made.graph.nodes["Partner"].select("suppkey", F.col("name").isNotNull().alias("had_name"), "mark")


@query("select p_partkey as partkey, case when p_size > 25 then null else p_brand end as brand, case when p_size > 25 then 'large' else p_name end as name from part")
def write_replace_properties(g):
    g2 = w.replace_properties(g, "Part", g.nodes["Part"].where("size > 25"), {"partkey": F.col("partkey"), "name": "large"})
    return g2.nodes["Part"].select("partkey", "brand", "name")


@query("select count(*) as n from supplier where s_acctbal > 8000")
def write_remove_label(g):
    rich = w.set_label(g, "Supplier", g.nodes["Supplier"].where("acctbal > 5000"), "Rich")
    g2 = w.set_label(rich, "Supplier", g.nodes["Supplier"].where("acctbal <= 8000"), "Rich", remove=True)
    return r.aggregate(m.scan(g2, "s", "Rich"), [], n=r.count_rows())


@query("select 'IN_NATION' as what, (select count(*) from customer) + count(*) as n from supplier where s_acctbal >= 0 union all select 'Supplier', count(*) from supplier where s_acctbal >= 0")
def write_delete_rels_then_nodes(g):
    """The relationships of suppliers in debt go, then the suppliers, which have none any more, by plain DELETE."""
    gone = g.nodes["Supplier"].where("acctbal < 0").select("_id")
    g2 = PropertyGraph({"Supplier": g.nodes["Supplier"]}, {t: g.rels[t] for t in ("IN_NATION", "SUPPLIED_BY")})
    for t, end in (("IN_NATION", "_src"), ("SUPPLIED_BY", "_dst")):
        g2 = w.delete_rels(g2, t, g2.rels[t].join(gone.select(F.col("_id").alias(end)), end, "left_semi"))
    g2 = w.delete_nodes(g2, "Supplier", gone)
    count = lambda t, n: t.agg(F.lit(n).alias("what"), F.count("*").alias("n"))
    return count(g2.rels["IN_NATION"], "IN_NATION").union(count(g2.nodes["Supplier"], "Supplier"))


@query(
    "select 'IN_REGION' as type, count(*) as n from nation union all select 'IN_NATION', (select count(*) from customer) + (select count(*) from supplier) union all select 'PLACED', count(*) from orders union all select 'CONTAINS', count(*) from lineitem "
    "union all select 'SUPPLIED_BY', count(*) from lineitem union all select 'PERFORMED', count(*) from events union all select 'FOLLOWS', 2 * count(*) from customer union all select 'NEXT', count(*) - count(distinct user_id) from events"
)
def scan_all_rels(g):
    return g.rel_table().groupBy(F.col("_type").alias("type")).agg(F.count("*").alias("n"))


@query(
    "select c_custkey as custkey, round(sin(c_acctbal), 6) as s, round(cos(c_acctbal), 6) as c, round(tan(c_acctbal / 20000), 6) as t, round(asin(c_acctbal / 20000), 6) as a, round(acos(c_acctbal / 20000), 6) as b, round(atan(c_acctbal), 6) as d, round(exp(c_acctbal / 5000), 6) as x, "
    "case when c_acctbal > 0 then round(log10(c_acctbal), 6) when c_acctbal = 0 then '-Infinity'::double else 'NaN'::double end as l, round(pow(c_custkey % 7, 2.5), 6) as p, round(pi() + exp(1), 9) as k, [1, 2, c_custkey]::bigint[] as xs from customer"
)
def fn_trigonometry(g):
    b, part = F.col("c__acctbal"), F.col("c__acctbal") / 20000
    made = {"s": F.sin(b), "c": F.cos(b), "t": F.tan(part), "a": F.asin(part), "b": F.acos(part), "d": F.atan(b), "x": F.exp(b / 5000), "l": v.log10(b), "p": v.power(F.col("c__custkey") % 7, F.lit(2.5))}
    more = [F.round(v.pi() + v.e(), 9).alias("k"), v.concat_lists(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), F.array("c__custkey")).alias("xs")]
    return m.scan(g, "c", "Customer").select(F.col("c__custkey").alias("custkey"), *[F.round(x, 6).alias(k) for k, x in made.items()], *more)


@query("select s_suppkey as suppkey, case when s_acctbal > 5000 then ['Supplier', 'Rich'] else ['Supplier'] end as labels, s_name as name, s_acctbal as acctbal, s_nationkey::bigint as lands, 'IN_NATION' as type from supplier")
def fn_entity_parts(g):
    """labels(n) as a list, properties(n) by type, type(r), and the end of a relationship by its id."""
    g2 = w.set_label(g, "Supplier", g.nodes["Supplier"].where("acctbal > 5000"), "Rich")
    found = m.expand(m.scan(g2, "s", "Supplier"), g2, "s", "IN_NATION", "n", rel="i", labels="Nation")
    held = found.withColumn("p", v.properties("s", ["name", "acctbal"]))
    return held.select(F.col("s__suppkey").alias("suppkey"), v.labels("s", held.columns).alias("labels"), F.col("p.name").alias("name"), F.col("p.acctbal").alias("acctbal"), (F.col("n__id") - F.lit(2 << 48)).alias("lands"), F.col("i__type").alias("type"))


@triples(
    "select kind, count(*) as n, min(id) as first, max(id) as last from (select kind, row_number() over (order by kind, x) as id from (select 'nation/' || n_nationkey as x, 'iri' as kind from nation union select 'region/' || r_regionkey, 'iri' from region "
    "union select n_name, 'literal' from nation union select r_name, 'literal' from region union select n_nationkey::varchar, 'literal' from nation union select unnest(['name', 'key', 'region', 'regions']), 'iri')) group by kind"
)
def rdf_dictionary_order(t):
    """IRIs before literals, whatever their values."""
    return t.terms().groupBy(F.col("term.kind").alias("kind")).agg(F.count("*").alias("n"), F.min("term_id").alias("first"), F.max("term_id").alias("last"))


@triples("select r_name as name from region")
def rdf_match_graph(t):
    return t.match(g=rdf.iri("regions")).select(F.col("o.value").alias("name"))


def _rdf_add_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of all orders are added twice, which counts once, and those of open orders deleted; then customers by status."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    node = lambda kind, key: rdf.term("iri", F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")))
    quads = lambda p, o: orders.select(node("order", "o_orderkey").alias("s"), rdf.term("iri", p).alias("p"), o.alias("o"), F.lit(None).cast(rdf.TERM).alias("g"))
    status = quads("status", rdf.term("literal", F.col("o_orderstatus"), rdf.XSD + "string"))
    store, new = rdf.RdfStore(quads("by", node("customer", "o_custkey"))).add(status.union(status))
    again, none = store.add(status)
    left = again.delete(status.where("o.value = 'O'"))
    found = left.bgp([("?order", rdf.iri("by"), "?customer"), ("?order", rdf.iri("status"), "?status")])
    counted = found.groupBy(F.col("status.value").alias("status")).agg(F.count("*").alias("orders"), F.countDistinct("customer.value").alias("customers"))
    total = lambda df, name: df.agg(F.lit(name).alias("status"), F.count("*").alias("orders"), F.lit(0).cast("long").alias("customers"))
    return counted.union(total(new, "added")).union(total(none, "added again"))


QUERIES["rdf_add_delete"] = _rdf_add_delete
ORACLES["rdf_add_delete"] = "select o_orderstatus as status, count(*) as orders, count(distinct o_custkey) as customers from orders where o_orderstatus <> 'O' group by 1 union all select 'added', count(*), 0 from orders union all select 'added again', 0, 0"
