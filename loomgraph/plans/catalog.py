"""Queries over the sample graph, one or more for each operator, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import values as v
from loomgraph.operators import match as m
from loomgraph.operators import rdf
from loomgraph.operators import rows as r
from loomgraph.operators import write as w
from loomgraph.plans.sample import node_id, sample_graph, sample_triples
from loomgraph.plans.scratch import materialize, scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(graph) as a query that reads the sample graph."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(sample_graph(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: FOLLOWS as a table (e, s, t, weight), for SQL.
FOLLOWS = "f as (select e, s, t % (select count(*) from customer) as t, e % 7 as weight from (select 2 * c_custkey as e, c_custkey as s, 2 * c_custkey + 1 as t from customer union all select 2 * c_custkey + 1, c_custkey, 3 * c_custkey + 2 from customer))"
NEXT = "nx as (select event_id as s, nxt as t from (select event_id, lead(event_id) over (partition by user_id order by ts, event_id) as nxt from events) where nxt is not null)"
DOCS = "d as (select doc_id, lang, source, n_chars, quality, toxic from documents left join (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by doc_id) using (doc_id))"

# ---------------------------------------------------------------- scans and filters


@query("select r_name as region, count(*) as customers, round(sum(c_acctbal), 2) as total from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_acctbal > 0 group by r_name")
def flagship(g):
    df = m.scan(g, "c", "Customer").where("c__acctbal > 0")
    df = m.expand(m.expand(df, g, "c", "IN_NATION", "n"), g, "n", "IN_REGION", "r")
    return r.aggregate(df, [F.col("r__name").alias("region")], customers=r.count_rows(), total=F.round(r.total("c__acctbal"), 2))


@query("select p_partkey as partkey, p_name as name, p_size::bigint as size from part")
def scan_label(g):
    return m.scan(g, "p", "Part").select(F.col("p__partkey").alias("partkey"), F.col("p__name").alias("name"), F.col("p__size").cast("bigint").alias("size"))


@query("select 'Region' as label, count(*) as n from region union all select 'Nation', count(*) from nation union all select 'Customer', count(*) from customer union all select 'Supplier', count(*) from supplier union all select 'Part', count(*) from part union all select 'Order', count(*) from orders union all select 'User', count(distinct user_id) from events union all select 'Event', count(*) from events union all select 'Document', count(*) from documents")
def scan_all_nodes_by_label_count(g):
    return r.aggregate(g.node_table(properties=[]), [F.col("_label").alias("label")], n=r.count_rows())


@query("select c_custkey as custkey, c_name as name from customer where c_custkey = 7")
def scan_by_id(g):
    return g.node_by_id((3 << 48) + 7, "Customer").select("custkey", "name")


@query("select c_custkey as custkey from customer where c_mktsegment = 'BUILDING'")
def scan_by_property(g):
    return g.nodes_by_property("mktsegment", "BUILDING", "Customer").select("custkey")


@query("select count(*) as n, sum(l_quantity) as quantity from lineitem")
def scan_rel_type(g):
    return r.aggregate(m.scan_rels(g, "c", "CONTAINS"), [], n=r.count_rows(), quantity=F.sum("c__quantity"))


@query("select type, n from (select 'IN_NATION' as type, (select count(*) from customer) + (select count(*) from supplier) as n union all select 'IN_REGION', count(*) from nation union all select 'PLACED', count(*) from orders)")
def scan_rel_types(g):
    return r.aggregate(m.scan_rels(g, "x", ["IN_NATION", "IN_REGION", "PLACED", "NO_SUCH_TYPE"]), [F.col("x__type").alias("type")], n=r.count_rows())


@query("select 1 + 2 * 3 as seven, 'a' || 'b' as ab, cast(null as bigint) as nothing")
def single_row(g):
    return g.spark.range(1).select((F.lit(1).cast("bigint") + F.lit(2) * F.lit(3)).cast("int").alias("seven"), F.concat(F.lit("a"), F.lit("b")).alias("ab"), F.lit(None).cast("bigint").alias("nothing"))


@query("select o_orderkey as orderkey from orders where o_totalprice >= 1000 and o_totalprice < 200000 and o_orderstatus <> 'F'")
def filter_comparison(g):
    return m.scan(g, "o", "Order").where("o__totalprice >= 1000 and o__totalprice < 200000 and o__orderstatus <> 'F'").select(F.col("o__orderkey").alias("orderkey"))


@query(f"with {DOCS} select doc_id, (quality = 1 and toxic = 0) as a, (quality = 1 or toxic = 1) as o, not (quality = 1) as n, ((quality = 1) <> (toxic = 1)) as x from d")
def filter_kleene(g):
    q, t = F.col("d__quality") == 1, F.col("d__toxic") == 1
    return m.scan(g, "d", "Document").select(F.col("d__doc_id").alias("doc_id"), (q & ~t).alias("a"), (q | t).alias("o"), (~q).alias("n"), v.xor(q, t).alias("x"))


@query(f"with {DOCS} select lang, count(*) filter (where quality is null) as unlabelled, count(*) filter (where quality is not null) as labelled from d group by lang")
def filter_is_null(g):
    return r.aggregate(m.scan(g, "d", "Document"), [F.col("d__lang").alias("lang")], unlabelled=F.count(F.when(F.col("d__quality").isNull(), 1)), labelled=F.count("d__quality"))


@query(f"with {DOCS} select doc_id, quality in (0, 2) as plain, case when quality is null then null when quality = 1 then true else null end as open, false as none from d")
def filter_in_list(g):
    q = F.col("d__quality")
    return m.scan(g, "d", "Document").select(F.col("d__doc_id").alias("doc_id"), v.in_list(q, F.array(F.lit(0), F.lit(2))).alias("plain"), v.in_list(q, F.array(F.lit(1), F.lit(None).cast("int"))).alias("open"), v.in_list(q, F.array().cast("array<int>")).alias("none"))


@query("select p_partkey as partkey, starts_with(p_name, 'P') as s, ends_with(p_name, '1') as e, contains(p_name, '10') as c from part")
def filter_string_predicates(g):
    n = F.col("p__name")
    return m.scan(g, "p", "Part").select(F.col("p__partkey").alias("partkey"), n.startswith("P").alias("s"), n.endswith("1").alias("e"), n.contains("10").alias("c"))


@query("select c_custkey as custkey from customer where regexp_full_match(c_name, '.*[0-4]')")
def filter_regex(g):
    return m.scan(g, "c", "Customer").where(v.matches(F.col("c__name"), ".*[0-4]")).select(F.col("c__custkey").alias("custkey"))


# ---------------------------------------------------------------- projections


@query("select p_partkey as partkey, p_partkey // 7 as q, p_partkey % 7 as rem, (-p_partkey) // 7 as nq, cast(null as bigint) as by_zero, p_size * 2 + 1 as lin, pow(p_size, 2) as sq from part")
def project_arithmetic(g):
    k, size = F.col("p__partkey"), F.col("p__size")
    return m.scan(g, "p", "Part").select(k.alias("partkey"), v.divide_int(k, 7).alias("q"), v.modulo_int(k, 7).alias("rem"), v.divide_int(-k, 7).alias("nq"), v.divide_int(k, 0).alias("by_zero"), (size * 2 + 1).alias("lin"), v.power(size, 2).alias("sq"))


@query("select p_partkey as partkey, case when p_size > 30 then 'large' when p_size > 10 then 'medium' end as c from part")
def project_case(g):
    return m.scan(g, "p", "Part").select(F.col("p__partkey").alias("partkey"), F.when(F.col("p__size") > 30, "large").when(F.col("p__size") > 10, "medium").alias("c"))


@query("select p_partkey as partkey, p_size::bigint as first, p_partkey as last_, cast(null as bigint) as outside, [2::bigint, p_partkey] as mid, substr(p_name, 2, 2) as s from part")
def project_slice_index(g):
    a = F.array(F.col("p__size").cast("bigint"), F.lit(2).cast("bigint"), F.col("p__partkey"))
    return m.scan(g, "p", "Part").select(F.col("p__partkey").alias("partkey"), v.at(a, 0).alias("first"), v.at(a, -1).alias("last_"), v.at(a, -9).alias("outside"), v.slice_list(a, 1, 9).alias("mid"), v.slice_string(F.col("p__name"), 1, 3).alias("s"))


@query("select c_custkey as custkey, c_name as name, 3 as size from customer")
def project_map(g):
    df = m.scan(g, "c", "Customer").withColumn("mp", v.properties("c", ["custkey", "name", "mktsegment"]))
    return df.select(F.col("c__custkey").alias("custkey"), F.col("mp.name").alias("name"), F.size(v.keys("c", ["custkey", "name", "mktsegment"])).alias("size"))


@query("select c_custkey as custkey from customer where c_acctbal > 5000.0 and c_mktsegment = 'MACHINERY'")
def param_binding(g):
    given = {"least": 5000.0, "segment": "MACHINERY"}
    return m.scan(g, "c", "Customer", properties={"mktsegment": given["segment"]}).where(F.col("c__acctbal") > F.lit(given["least"])).select(F.col("c__custkey").alias("custkey"))


# ---------------------------------------------------------------- expansion and patterns


@query("select c_custkey as custkey, n_name as nation from customer join nation on c_nationkey = n_nationkey")
def expand_out(g):
    return m.expand(m.scan(g, "c", "Customer"), g, "c", "IN_NATION", "n").select(F.col("c__custkey").alias("custkey"), F.col("n__name").alias("nation"))


@query("select n_name as nation, count(*) as customers from nation join customer on c_nationkey = n_nationkey group by n_name")
def expand_in(g):
    df = m.expand(m.scan(g, "n", "Nation"), g, "n", "IN_NATION", "c", direction="in", labels="Customer")
    return r.aggregate(df, [F.col("n__name").alias("nation")], customers=r.count_rows())


@query(f"with {FOLLOWS} select c, count(*) as n from (select s as c from f union all select t from f where s <> t) group by c")
def expand_both(g):
    df = m.expand(m.scan(g, "c", "Customer"), g, "c", "FOLLOWS", "_o", direction="both")
    return r.aggregate(df, [F.col("c__custkey").alias("c")], n=r.count_rows())


@query("select o_orderkey as orderkey, count(*) as n from orders join (select l_orderkey from lineitem union all select l_orderkey from lineitem) on l_orderkey = o_orderkey group by o_orderkey")
def expand_multi_type(g):
    df = m.expand(m.scan(g, "o", "Order"), g, "o", ["CONTAINS", "SUPPLIED_BY"], "_x")
    return r.aggregate(df, [F.col("o__orderkey").alias("orderkey")], n=r.count_rows())


@query("select n_name as nation, p_brand as brand, count(*) as n, sum(round(l_extendedprice * 100)::bigint)::bigint as cents from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_orderstatus = 'F' group by all")
def expand_four_hops(g):
    df = m.scan(g, "o", "Order", properties={"orderstatus": "F"})
    df = m.expand(df, g, "o", "PLACED", "c", direction="in", labels="Customer")
    df = m.expand(df, g, "c", "IN_NATION", "n")
    df = m.expand(df, g, "o", "CONTAINS", "p", rel="l")
    return r.aggregate(df, [F.col("n__name").alias("nation"), F.col("p__brand").alias("brand")], n=r.count_rows(), cents=F.sum(F.round(F.col("l__extendedprice") * 100).cast("bigint")))


@query(f"with {FOLLOWS} select a.s as a, b.s as b, b.t as c from f a join f b on a.t = b.s and a.e <> b.e")
def expand_two_hop(g):
    df = m.expand(m.scan(g, "a", "Customer"), g, "a", "FOLLOWS", "b", rel="r1")
    df = m.expand(df, g, "b", "FOLLOWS", "c", rel="r2", distinct_from=("r1",))
    return df.select(F.col("a__custkey").alias("a"), F.col("b__custkey").alias("b"), F.col("c__custkey").alias("c"))


@query("select o_orderkey as orderkey, l_linenumber as linenumber, l_quantity as quantity from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where l_returnflag = 'R' and l_quantity > 30")
def expand_rel_props(g):
    df = m.expand(m.scan(g, "o", "Order"), g, "o", "CONTAINS", "_p", rel="l", rel_properties={"returnflag": "R"}, where=F.col("l__quantity") > 30)
    return df.select(F.col("o__orderkey").alias("orderkey"), F.col("l__linenumber").alias("linenumber"), F.col("l__quantity").alias("quantity"))


@query("select s_name as supplier from supplier join nation on s_nationkey = n_nationkey where n_nationkey = 3")
def expand_inline_props(g):
    return m.expand(m.scan(g, "s", "Supplier"), g, "s", "IN_NATION", "n", end_properties={"nationkey": 3}).select(F.col("s__name").alias("supplier"))


@query("select r_name as region, n_name as nation from region, nation where n_nationkey < 5")
def pattern_cartesian(g):
    return m.cartesian(m.scan(g, "r", "Region"), m.scan(g, "n", "Nation").where("n__nationkey < 5")).select(F.col("r__name").alias("region"), F.col("n__name").alias("nation"))


@query("select n_name as nation, c_custkey as custkey, s_suppkey as suppkey from nation join customer on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey where c_acctbal > 9000 and s_acctbal > 5000")
def pattern_shared_var_join(g):
    df = m.expand(m.scan(g, "c", "Customer").where("c__acctbal > 9000"), g, "c", "IN_NATION", "n")
    df = m.expand(df, g, "n", "IN_NATION", "s", direction="in", labels="Supplier", hubs=True).where("s__acctbal > 5000")
    return df.select(F.col("n__name").alias("nation"), F.col("c__custkey").alias("custkey"), F.col("s__suppkey").alias("suppkey"))


@query(f"with {FOLLOWS} select a.s as a, a.t as b from f a join f b on a.t = b.s and b.t = a.s and a.e <> b.e")
def pattern_cycle(g):
    df = m.expand(m.scan(g, "a", "Customer"), g, "a", "FOLLOWS", "b", rel="r1")
    df = m.expand(df, g, "b", "FOLLOWS", "a", rel="r2", distinct_from=("r1",))
    return df.select(F.col("a__custkey").alias("a"), F.col("b__custkey").alias("b"))


@query(f"with {FOLLOWS}, w as (select e, s as a, t as b from f union all select e, t, s from f where s <> t) select x.a, count(*) as n from w x join w y on x.b = y.a and x.e <> y.e group by x.a")
def pattern_rel_uniqueness(g):
    df = m.expand(m.scan(g, "a", "Customer"), g, "a", "FOLLOWS", "_b", rel="r1", direction="both")
    df = m.expand(df, g, "_b", "FOLLOWS", "_c", rel="r2", direction="both", distinct_from=("r1",))
    return r.aggregate(df, [F.col("a__custkey").alias("a")], n=r.count_rows())


@query("select r_name as region, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on r_regionkey = n_regionkey group by r_name")
def pattern_anonymous(g):
    df = m.expand(m.expand(m.scan(g, "c", "Customer"), g, "c", "IN_NATION", "_n"), g, "_n", "IN_REGION", "r")
    return r.aggregate(df, [F.col("r__name").alias("region")], n=r.count_rows())


def _trails(least: int, most: int) -> str:
    levels = ["p1 as (select s as a, t as b, [e] as path, 1 as n from f)"] + [f"p{i} as (select a, f.t as b, list_append(path, f.e) as path, {i} as n from p{i - 1} join f on b = f.s where not list_contains(path, f.e))" for i in range(2, most + 1)]
    zero = ["select c_custkey as a, c_custkey as b, 0 as n from customer"] if least == 0 else []
    return f"with {FOLLOWS}, {', '.join(levels)} " + " union all ".join([*zero, *(f"select a, b, n from p{i}" for i in range(max(1, least), most + 1))])


def _paths(g, least: int, most: int):
    df = m.expand_paths(m.scan(g, "a", "Customer").select("a__id", "a__custkey"), g, "a", "FOLLOWS", "b", least=least, most=most, labels="Customer", path="p")
    return df.select(F.col("a__custkey").alias("a"), F.col("b__custkey").alias("b"), F.col("p__length").alias("n"))


@query(_trails(1, 3))
def varlen_bounded(g):
    return _paths(g, 1, 3)


@query(_trails(2, 2))
def varlen_exact(g):
    return _paths(g, 2, 2)


@query(_trails(0, 1))
def varlen_zero_min(g):
    return _paths(g, 0, 1)


@query("select n, count(*) as trails from (" + _trails(1, 6) + ") group by n")
def varlen_cyclic_trails(g):
    return _paths(g, 1, 6).groupBy("n").agg(F.count("*").alias("trails"))


@query("select s_suppkey as suppkey, n_name as place from supplier join nation on s_nationkey = n_nationkey union all select s_suppkey, r_name from supplier join nation on s_nationkey = n_nationkey join region on r_regionkey = n_regionkey")
def varlen_unbounded_dag(g):
    df = m.expand_paths(m.scan(g, "s", "Supplier").select("s__id", "s__suppkey"), g, "s", ["IN_NATION", "IN_REGION"], "x", labels=["Nation", "Region"], repeated_rels=True)
    return df.select(F.col("s__suppkey").alias("suppkey"), F.col("x__name").alias("place"))


@query("select c_custkey as custkey, 844424930131968 + c_custkey as node, 0 as distance from customer union all select c_custkey, 562949953421312 + c_nationkey, 1 from customer union all select c_custkey, 281474976710656 + n_regionkey, 2 from customer join nation on c_nationkey = n_nationkey")
def shortest_path(g):
    """From every customer to all that it reaches, with no limit on the length."""
    df = m.shortest_paths(m.scan(g, "a", "Customer").select("a__id"), g, "a", ["IN_NATION", "IN_REGION"], "b")
    return df.select((F.col("a__id") - F.lit(3 << 48)).alias("custkey"), F.col("b__id").alias("node"), F.col("b__distance").alias("distance"))



@query("select c_custkey as custkey, o_orderkey as orderkey from customer left join orders on o_custkey = c_custkey")
def optional_match(g):
    return m.expand(m.scan(g, "c", "Customer"), g, "c", "PLACED", "o", optional=True).select(F.col("c__custkey").alias("custkey"), F.col("o__orderkey").alias("orderkey"))


@query("select c_custkey as custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_totalprice > 300000 group by c_custkey")
def optional_match_where(g):
    df = m.expand(m.scan(g, "c", "Customer"), g, "c", "PLACED", "o", optional=True, where=F.col("o__totalprice") > 300000)
    return r.aggregate(df, [F.col("c__custkey").alias("custkey")], n=F.count("o__orderkey"))


@query("select c_custkey as custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def exists_semi(g):
    return m.where_exists(m.scan(g, "c", "Customer"), g, "c", "PLACED", labels="Order", end_properties={"orderstatus": "F"}).select(F.col("c__custkey").alias("custkey"))


@query("select c_custkey as custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def not_exists_anti(g):
    return m.where_exists(m.scan(g, "c", "Customer"), g, "c", "PLACED", negated=True).select(F.col("c__custkey").alias("custkey"))


@query("select n_name as nation, coalesce(list_sort(list(s_suppkey) filter (where s_suppkey is not null)), []) as suppliers from nation left join supplier on s_nationkey = n_nationkey group by n_name")
def pattern_comprehension(g):
    df = m.pattern_list(m.scan(g, "n", "Nation"), g, "n", "IN_NATION", F.col("s__suppkey"), "suppliers", end="s", direction="in", labels="Supplier")
    return df.select(F.col("n__name").alias("nation"), F.sort_array("suppliers").alias("suppliers"))


@query("select n_name as nation, top from nation join (select c_nationkey, max(c_acctbal) as top from customer group by 1) on c_nationkey = n_nationkey")
def call_subquery(g):
    def best(keys):
        df = m.expand(keys, g, "n", "IN_NATION", "c", direction="in", labels="Customer")
        return df.groupBy("n__id").agg(F.max("c__acctbal").alias("top"))

    return m.correlate(m.scan(g, "n", "Nation"), ["n__id"], best).select(F.col("n__name").alias("nation"), "top")


@query("select o_custkey as custkey, count(*) as degree from orders group by 1")
def csr_out_degree(g):
    return g.out_degree("PLACED").select((F.col("_src") - F.lit(3 << 48)).alias("custkey"), "degree")


@query(f"with {NEXT} select a.event_id as a, b.event_id as b from events a join nx on a.event_id = s join events b on b.event_id = t where a.event_type <> b.event_type")
def event_sequence(g):
    df = m.expand(m.scan(g, "a", "Event"), g, "a", "NEXT", "b").where("a__event_type <> b__event_type")
    return df.select(F.col("a__event_id").alias("a"), F.col("b__event_id").alias("b"))


# ---------------------------------------------------------------- aggregates and rows


@query("select count(*) as n from lineitem")
def agg_count_star(g):
    return r.aggregate(m.scan_rels(g, "l", "CONTAINS"), [], n=r.count_rows())


@query(f"with {DOCS} select count(quality) as labelled, count(*) as n from d")
def agg_count_nulls(g):
    return r.aggregate(m.scan(g, "d", "Document"), [], labelled=r.count("d__quality"), n=r.count_rows())


@query("select c_mktsegment as segment, round(sum(c_acctbal), 2) as s, round(avg(c_acctbal), 4) as a, min(c_acctbal) as lo, max(c_acctbal) as hi from customer group by 1")
def agg_sum_avg_min_max(g):
    b = "c__acctbal"
    return r.aggregate(m.scan(g, "c", "Customer"), [F.col("c__mktsegment").alias("segment")], s=F.round(r.total(b), 2), a=F.round(r.average(b), 4), lo=r.least(b), hi=r.greatest(b))


@query(f"with {DOCS} select lang, list_sort(list(quality), 'ASC', 'NULLS FIRST') as q from d group by lang")
def agg_collect(g):
    return r.aggregate(m.scan(g, "d", "Document"), [F.col("d__lang").alias("lang")], q=F.sort_array(r.collect("d__quality")))


@query("select p_brand as brand, count(distinct p_size) as sizes, sum(distinct p_size)::bigint as total, list_sort(list(distinct p_size)) as all_sizes from part group by 1")
def agg_distinct(g):
    return r.aggregate(m.scan(g, "p", "Part"), [F.col("p__brand").alias("brand")], sizes=r.count_distinct("p__size"), total=r.total_distinct("p__size"), all_sizes=F.sort_array(r.collect_distinct("p__size")))


@query("select o_orderpriority as priority, count(*) as n from orders group by 1")
def agg_grouped_ordered(g):
    return r.order_by(r.aggregate(m.scan(g, "o", "Order"), [F.col("o__orderpriority").alias("priority")], n=r.count_rows()), ("n", "desc"), "priority")


@query("select 0::bigint as n, 0::double as s, cast(null as double) as a")
def agg_empty_input(g):
    return r.aggregate(m.scan(g, "c", "Customer").where("c__custkey < 0"), [], n=r.count_rows(), s=r.total("c__acctbal"), a=r.average("c__acctbal"))


@query("select c_mktsegment as segment, count(*) + 1 as n, round(sum(c_acctbal) / count(*), 4) as mean from customer group by 1")
def agg_expression(g):
    return r.aggregate(m.scan(g, "c", "Customer"), [F.col("c__mktsegment").alias("segment")], n=r.count_rows() + 1, mean=F.round(F.sum("c__acctbal") / r.count_rows(), 4))


@query("select o_custkey as custkey, count(*) as n from orders group by 1 having count(*) > 12")
def agg_having_with(g):
    return g.out_degree("PLACED").where("degree > 12").select((F.col("_src") - F.lit(3 << 48)).alias("custkey"), F.col("degree").alias("n"))


@query("select round(stddev_samp(c_acctbal), 4) as sd, round(stddev_pop(c_acctbal), 4) as sdp, round(quantile_cont(c_acctbal, 0.9), 4) as p90, quantile_disc(c_custkey, 0.5) as med from customer")
def agg_stdev_percentile(g):
    b = "c__acctbal"
    return r.aggregate(m.scan(g, "c", "Customer"), [], sd=F.round(r.deviation(b), 4), sdp=F.round(r.deviation_population(b), 4), p90=F.round(r.percentile_continuous(b, 0.9), 4), med=r.percentile_discrete("c__custkey", 0.5))


@query(f"with {DOCS} select doc_id, row_number() over (order by quality desc nulls first, doc_id) as place from d")
def sort_multi_key_nulls(g):
    """The place of each document in the order; one row of numbers for each range of a global sort."""
    docs = r.order_by(m.scan(g, "d", "Document").select("d__doc_id", "d__quality"), ("d__quality", "desc"), "d__doc_id")
    placed = materialize(docs.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "sorted")
    ends = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    bases = ends.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(bases, "part").select(F.col("d__doc_id").alias("doc_id"), (F.col("base") + F.col("at") - F.col("first") + 1).alias("place"))


@query("select c_custkey as custkey from customer order by c_acctbal desc, c_custkey limit 10 offset 5")
def skip_limit(g):
    return r.limit(r.skip(r.order_by(m.scan(g, "c", "Customer").select(F.col("c__custkey").alias("custkey"), "c__acctbal"), ("c__acctbal", "desc"), "custkey"), 5), 10).select("custkey")


@query("select o_orderkey as orderkey, o_totalprice as price from orders order by o_totalprice desc, o_orderkey limit 20")
def topk(g):
    return r.limit(r.order_by(m.scan(g, "o", "Order").select(F.col("o__orderkey").alias("orderkey"), F.col("o__totalprice").alias("price")), ("price", "desc"), "orderkey"), 20)


@query("select distinct p_brand as brand, p_size::bigint as size from part")
def distinct_rows(g):
    return m.scan(g, "p", "Part").select(F.col("p__brand").alias("brand"), F.col("p__size").cast("bigint").alias("size")).distinct()


@query("select c_nationkey::bigint as k from customer union all select s_nationkey from supplier")
def union_all(g):
    key = lambda var, label: m.expand(m.scan(g, var, label), g, var, "IN_NATION", "n").select(F.col("n__nationkey").alias("k"))
    return r.union_all(key("c", "Customer"), key("s", "Supplier"))


@query("select c_nationkey::bigint as k from customer union select s_nationkey from supplier")
def union_distinct(g):
    return union_all(g).distinct()


@query("select n_name as nation, x from nation, (select unnest([1, 2, 3]) as x)")
def unwind_literal(g):
    return r.unwind(m.scan(g, "n", "Nation"), F.array(F.lit(1), F.lit(2), F.lit(3)), "x").select(F.col("n__name").alias("nation"), "x")


@query("select r_name as region, n_name as name from region join nation on n_regionkey = r_regionkey")
def unwind_collect(g):
    df = m.expand(m.scan(g, "n", "Nation"), g, "n", "IN_REGION", "r")
    return r.unwind(r.aggregate(df, [F.col("r__name").alias("region")], names=r.collect("n__name")), F.col("names"), "name").select("region", "name")


# ---------------------------------------------------------------- functions


@query("select p_partkey as partkey, upper(p_name) as u, lower(p_name) as l, reverse(p_name) as rev, substr(p_name, 3, 4) as sub, string_split(p_name, ' ') as parts, replace(p_name, 'a', 'X') as rep, left(p_name, 3) as lft, right(p_name, 3) as rgt, length(p_name) as n, 'x' as t from part")
def fn_string(g):
    n = F.col("p__name")
    return m.scan(g, "p", "Part").select(
        F.col("p__partkey").alias("partkey"), F.upper(n).alias("u"), F.lower(n).alias("l"), F.reverse(n).alias("rev"), v.substring(n, F.lit(2), 4).alias("sub"), v.split(n, " ").alias("parts"), v.replace(n, "a", "X").alias("rep"), v.left(n, 3).alias("lft"),
        v.right(n, 3).alias("rgt"), F.char_length(n).cast("bigint").alias("n"), v.trim(F.lit(" \tx\n")).alias("t"),
    )


@query("select c_custkey as custkey, abs(c_acctbal) as a, ceil(c_acctbal) as c, floor(c_acctbal) as f, round(c_acctbal) as r, sign(c_acctbal)::bigint as s, round(sqrt(abs(c_acctbal)), 6) as q, case when c_acctbal > 0 then round(ln(c_acctbal), 6) when c_acctbal = 0 then '-Infinity'::double else 'NaN'::double end as l, round(atan2(c_acctbal, 100), 6) as t from customer")
def fn_math(g):
    b = F.col("c__acctbal")
    return m.scan(g, "c", "Customer").select(F.col("c__custkey").alias("custkey"), F.abs(b).alias("a"), v.ceil_float(b).alias("c"), v.floor_float(b).alias("f"), v.round_float(b).alias("r"), v.sign(b).alias("s"), F.round(F.sqrt(F.abs(b)), 6).alias("q"), F.round(v.log(b), 6).alias("l"), F.round(F.atan2(b, F.lit(100)), 6).alias("t"))


@query("select p_partkey as partkey, p_partkey::varchar as s, p_partkey as i, 3::bigint as cut, 1.5::double as f, true as b, cast(null as bigint) as bad from part")
def fn_convert(g):
    k = F.col("p__partkey")
    return m.scan(g, "p", "Part").select(k.alias("partkey"), v.to_string(k).alias("s"), v.to_integer(k).alias("i"), v.to_integer(F.lit("3.7")).alias("cut"), v.to_float(F.lit(" 1.5 ")).alias("f"), v.to_boolean(F.lit("TRUE")).alias("b"), v.to_integer(F.lit("abc")).alias("bad"))


@query("select p_partkey as partkey, 3 as n, p_size as h, 2 as l, [7, 2] as t, [2, 7, p_size] as r from part")
def fn_list(g):
    a = F.array(F.col("p__size"), F.lit(7), F.lit(2))
    return m.scan(g, "p", "Part").select(F.col("p__partkey").alias("partkey"), F.size(a).alias("n"), v.head(a).alias("h"), v.last(a).alias("l"), v.tail(a).alias("t"), F.reverse(a).alias("r"))


@query("select p_partkey as partkey, list_sum(range(1, p_size + 1))::bigint as s, list_transform(range(0, p_size + 1, 10), lambda x: x * x) as sq, [] ::bigint[] as none from part")
def fn_range_reduce(g):
    up = v.range_list(0, F.col("p__size"), 10)
    return m.scan(g, "p", "Part").select(F.col("p__partkey").alias("partkey"), v.reduce_list(v.range_list(1, F.col("p__size")), F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("s"), v.comprehension(up, value=lambda x: x * x).alias("sq"), v.range_list(3, 1).alias("none"))


@query("select p_partkey as partkey, p_size > 5 as al, p_size > 40 or 10 > 40 as an, not (p_size > 40) as no, (p_size > 5)::int + 1 = 1 as si from part")
def fn_quantifiers(g):
    a = F.array(F.col("p__size"), F.lit(10))
    return m.scan(g, "p", "Part").select(F.col("p__partkey").alias("partkey"), v.all_of(a, lambda x: x > 5).alias("al"), v.any_of(a, lambda x: x > 40).alias("an"), v.none_of(a, lambda x: x > 40).alias("no"), v.single_of(a, lambda x: x > 5).alias("si"))


@query(f"with {DOCS} select doc_id, 'Document' as label, case when quality is null then ['doc_id', 'lang'] else ['doc_id', 'lang', 'quality'] end as keys, coalesce(quality, -1) as q from d")
def fn_entity(g):
    return m.scan(g, "d", "Document").select(F.col("d__doc_id").alias("doc_id"), F.col("d__label").alias("label"), v.keys("d", ["lang", "quality", "doc_id"]).alias("keys"), F.coalesce("d__quality", F.lit(-1)).alias("q"))


@query("select p_partkey as partkey, round(sqrt(p_size * p_size + 16.0), 6) as d from part")
def fn_point_distance(g):
    return m.scan(g, "p", "Part").select(F.col("p__partkey").alias("partkey"), F.round(v.distance(v.point(F.col("p__size"), 0), v.point(None, 4)), 6).alias("d"))


@query("select p_partkey as partkey, p_size = 10 as e, false as i, case when p_size = 10 then true else false end as l, cast(null as boolean) as u from part")
def fn_equality(g):
    s = F.col("p__size")
    return m.scan(g, "p", "Part").select(F.col("p__partkey").alias("partkey"), (s == 10).alias("e"), v.equal_incomparable(s, F.lit("a")).alias("i"), v.equal_list(F.array(s, F.lit(1)), F.array(F.lit(10), F.lit(1))).alias("l"), v.equal_list(F.array(F.lit(1), F.lit(None).cast("int")), F.array(F.lit(1), F.lit(2))).alias("u"))


# ---------------------------------------------------------------- writes, read back


@query("select n_nationkey::bigint as k, 'city of ' || n_name as name from nation")
def write_create_then_match(g):
    made = w.create_nodes(g, m.scan(g, "n", "Nation"), "City", "x", name=F.concat(F.lit("city of "), F.col("n__name")))
    made = w.create_rels(made.graph, made.rows, "HAS", "n", "x", "h", since=2020)
    g2 = made.graph
    df = m.expand(m.scan(g2, "n", "Nation"), g2, "n", "HAS", "c", labels="City", rel_properties={"since": 2020})
    return df.select(F.col("n__nationkey").alias("k"), F.col("c__name").alias("name"))


@query("select c_custkey as custkey, case when c_acctbal < 0 then 0.0 else c_acctbal end as acctbal, case when c_acctbal < 0 then 'reset' end as note from customer")
def write_set_merge_map(g):
    hit = g.nodes["Customer"].where("acctbal < 0").select("_id")
    g2 = w.set_properties(g, "Customer", hit, {"acctbal": F.lit(0.0), "note": F.lit("reset")})
    return m.scan(g2, "c", "Customer").select(F.col("c__custkey").alias("custkey"), F.col("c__acctbal").alias("acctbal"), F.col("c__note").alias("note"))


@query("select c_custkey as custkey, case when c_mktsegment = 'BUILDING' then null else c_mktsegment end as segment from customer")
def write_remove(g):
    g2 = w.remove_property(g, "Customer", g.nodes["Customer"].where("mktsegment = 'BUILDING'"), "mktsegment")
    return m.scan(g2, "c", "Customer").select(F.col("c__custkey").alias("custkey"), F.col("c__mktsegment").alias("segment"))


@query("select s_suppkey as suppkey, s_acctbal > 5000 as rich from supplier")
def write_set_label(g):
    g2 = w.set_label(g, "Supplier", g.nodes["Supplier"].where("acctbal > 5000"), "Rich")
    rich = m.scan(g2, "s", "Rich").select("s__id", F.lit(True).alias("rich"))
    return m.scan(g2, "s", "Supplier").join(rich, "s__id", "left").select(F.col("s__suppkey").alias("suppkey"), F.coalesce("rich", F.lit(False)).alias("rich"))


@query("select 'Nation' as what, count(*) as n from nation where n_regionkey <> 1 union all select 'IN_REGION', count(*) from nation where n_regionkey <> 1 union all select 'IN_NATION', (select count(*) from customer join nation on c_nationkey = n_nationkey where n_regionkey <> 1) + (select count(*) from supplier join nation on s_nationkey = n_nationkey where n_regionkey <> 1)")
def write_detach_delete(g):
    gone = m.expand(m.scan(g, "n", "Nation"), g, "n", "IN_REGION", "r", end_properties={"regionkey": 1}).select(F.col("n__id").alias("_id"))
    g2 = w.delete_nodes(g, "Nation", gone, detach=True)
    count = lambda t, n: t.agg(F.lit(n).alias("what"), F.count("*").alias("n"))
    return count(g2.nodes["Nation"], "Nation").union(count(g2.rels["IN_REGION"], "IN_REGION")).union(count(g2.rels["IN_NATION"], "IN_NATION"))


@query("select c_mktsegment as name, count(*) as n from customer group by 1")
def write_merge_node(g):
    made = w.merge_nodes(g, m.scan(g, "c", "Customer"), "Segment", "s", name=F.col("c__mktsegment"))
    made = w.merge_rels(made.graph, made.rows, "IN_SEGMENT", "c", "s", "i")
    again = w.merge_nodes(made.graph, m.scan(made.graph, "c", "Customer"), "Segment", "s", name=F.col("c__mktsegment"))
    df = m.expand(m.scan(again.graph, "s", "Segment"), again.graph, "s", "IN_SEGMENT", "c", direction="in", labels="Customer")
    return r.aggregate(df, [F.col("s__name").alias("name")], n=r.count_rows())


@query("select r_name as region, x as mark from region, (select unnest([1, 2]) as x)")
def write_foreach(g):
    rows = m.scan(g, "r", "Region")
    g2 = w.for_each(g, rows, F.array(F.lit(1), F.lit(2)), "x", lambda g1, df: w.create_nodes(g1, df, "Mark", "k", region=F.col("r__name"), mark=F.col("x")))
    return g2.nodes["Mark"].select("region", "mark")


# ---------------------------------------------------------------- triples


def triples(sql: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(sample_triples(spark, sf_dir))
        ORACLES[f.__name__] = sql
        return f

    return register


@triples("select n_name as name from nation where n_nationkey = 4")
def rdf_match_sp(t):
    return t.match(rdf.iri("nation/4"), rdf.iri("name")).select(F.col("o.value").alias("name"))


@triples("select 'nation/' || n_nationkey as nation from nation where n_regionkey = 2")
def rdf_match_po(t):
    return t.match(p=rdf.iri("region"), o=rdf.iri("region/2")).select(F.col("s.value").alias("nation"))


@triples("select (select count(*) from region) * 2 as quads, count(*) as triples from region")
def rdf_distinct_over_graphs(t):
    region = F.col("s.value").startswith("region/")
    quads = t.match(p=rdf.iri("name")).where(region).agg(F.count("*").alias("quads"))
    return quads.crossJoin(t.match_triples(p=rdf.iri("name")).where(region).agg(F.count("*").alias("triples")))


@triples("select n_nationkey::bigint as i, n_nationkey::varchar as text from nation")
def rdf_term_to_value(t):
    return t.match(p=rdf.iri("key")).select(rdf.typed_value(F.col("o"))["as_integer"].alias("i"), F.col("o.value").alias("text"))


@triples("select n_name as nation, r_name as region from nation join region on n_regionkey = r_regionkey")
def rdf_bgp_join(t):
    df = t.bgp([("?n", rdf.iri("region"), "?r"), ("?n", rdf.iri("name"), "?a"), ("?r", rdf.iri("name"), "?b")])
    return df.select(F.col("a.value").alias("nation"), F.col("b.value").alias("region"))


@triples("select count(*) as terms, count(*) as greatest from (select 'nation/' || n_nationkey as x, 'iri' as k from nation union select 'region/' || r_regionkey, 'iri' from region union select n_name, 'literal' from nation union select r_name, 'literal' from region union select n_nationkey::varchar, 'integer' from nation union select unnest(['name', 'key', 'region', 'regions']), 'iri')")
def rdf_dictionary(t):
    return t.terms().agg(F.count("*").alias("terms"), F.max("term_id").alias("greatest"))


@triples("select '<nation/' || n_nationkey || '> <name> \"' || n_name || '\" .' as line from nation")
def rdf_n_triples(t):
    return rdf.n_quads_lines(t.match(p=rdf.iri("name")).where(F.col("s.value").startswith("nation/"))).select(F.col("value").alias("line"))


# ---------------------------------------------------------------- files, written and read back


def _orders(g):
    from loomgraph.graph import PropertyGraph

    keep = {k: g.nodes[k] for k in ("Customer", "Order")}
    return PropertyGraph(keep, {"PLACED": g.rels["PLACED"]}, {"PLACED": "Order"})


def _again(g, kind):
    import uuid

    from loomgraph.sources import files

    path = f"{scratch_folder(g.spark)}/export-{uuid.uuid4()}"
    files.write_graph(_orders(g), path, kind)
    return files.read_graph(g.spark, path, kind)


@query("select o_orderkey::bigint as k, o_orderstatus as status, c_name as name from orders join customer on o_custkey = c_custkey")
def io_jsonl_roundtrip(g):
    g2 = _again(g, "jsonl")
    df = m.expand(m.scan(g2, "c", "Customer"), g2, "c", "PLACED", "o", labels="Order")
    return df.select(F.col("o__orderkey").alias("k"), F.col("o__orderstatus").alias("status"), F.col("c__name").alias("name"))


@query("select o_orderstatus as status, c_name as name from orders join customer on o_custkey = c_custkey")
def io_turtle_roundtrip(g):
    g2 = _again(g, "turtle")
    df = m.expand(m.scan(g2, "c", "Resource"), g2, "c", "PLACED", "o", labels="Resource")
    return df.select(F.col("o__orderstatus").alias("status"), F.col("c__name").alias("name"))


@query("select c_custkey::bigint as k, c_name as name from customer")
def io_csv_roundtrip(g):
    import uuid

    from loomgraph.sources import files

    path = f"{scratch_folder(g.spark)}/export-{uuid.uuid4()}"
    g.nodes["Customer"].select("_id", F.lit("Customer").alias("_label"), "custkey", "name").write.option("header", True).csv(path)
    g2 = files.read_csv(g.spark, path)
    return g2.nodes["Customer"].select(F.col("custkey").alias("k"), "name")


@query("select 'CREATE (n' || (562949953421312 + n_nationkey)::varchar || ':Nation {_nid: ' || (562949953421312 + n_nationkey)::varchar || ', name: ''' || n_name || ''', nationkey: ' || n_nationkey || '});' as line from nation")
def io_cypher_export(g):
    from loomgraph.graph import PropertyGraph
    from loomgraph.sources import files

    return files.cypher_lines(PropertyGraph({"Nation": g.nodes["Nation"]})).select(F.col("value").alias("line"))


from loomgraph.plans import catalog_extra  # noqa: E402, F401  registers its queries
