"""Operators on small graphs: plain cases and edge cases of values, writes, RDF and files."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomgraph.functions import values as v
from loomgraph.graph import PropertyGraph
from loomgraph.operators import match as m
from loomgraph.operators import rdf
from loomgraph.operators import rows as r
from loomgraph.operators import write as w
from loomgraph.sources import files


@pytest.fixture
def people(spark):
    return PropertyGraph({"Person": spark.createDataFrame([(1, "Alice", 30, "A"), (2, "Bob", 25, "B"), (3, "Carol", 40, "A")], "_id long, name string, age long, kind string")})


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def names(df):
    return [row[0] for row in df.collect()]


def test_filter_order_skip_limit(people):
    n = m.scan(people, "n", "Person")
    assert names(r.order_by(n.where("n__age > 26").select("n__name"), "n__name")) == ["Alice", "Carol"]
    assert names(r.order_by(n.select("n__name"), ("n__name", "desc"))) == ["Carol", "Bob", "Alice"]
    assert names(r.limit(r.skip(r.order_by(n.select("n__name"), "n__name"), 1), 1)) == ["Bob"]
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError):
            r.limit(n, bad)


def test_aggregates(people):
    n = m.scan(people, "n", "Person")
    row = r.aggregate(n, [], c=r.count_rows(), s=r.total("n__age"), a=r.average("n__age"), lo=r.least("n__age"), hi=r.greatest("n__age"), l=F.sort_array(r.collect("n__name"))).first()
    assert (row.c, row.s, round(row.a, 3), row.lo, row.hi, row.l) == (3, 95, 31.667, 25, 40, ["Alice", "Bob", "Carol"])
    assert sorted(map(tuple, r.aggregate(n, ["n__kind"], c=r.count_rows(), s=r.total("n__age")).collect())) == [("A", 2, 70), ("B", 1, 25)]


def test_collect_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(None, 2), (5, 1)], "v int, k int")
    assert sorted(df.agg(r.collect("v")).first()[0], key=str) == [5, None]
    assert df.agg(r.collect_ordered(F.col("v"), F.col("k"))).first()[0] == [5, None]


def test_set_then_scan(people):
    g = w.set_properties(people, "Person", people.nodes["Person"].where("name = 'Alice'"), {"age": F.lit(99), "city": F.lit("NYC")})
    rows = {x.name: x for x in g.nodes["Person"].collect()}
    assert (rows["Alice"].age, rows["Alice"].city, rows["Bob"].age, rows["Bob"].city) == (99, "NYC", 25, None)
    g = w.replace_properties(g, "Person", g.nodes["Person"].where("name = 'Bob'").select("_id"), {"name": "Robert"})
    row = g.nodes["Person"].where("_id = 2").first()
    assert (row.name, row.age, row.kind) == ("Robert", None, None)


def test_merge(people, spark):
    once = spark.range(1)
    made = w.merge_nodes(people, once, "Person", "e", name="Dave", on_create={"age": F.lit(1).cast("long")})
    assert made.changed == 1 and made.rows.first()["e__id"] == 4
    assert w.merge_nodes(made.graph, once, "Person", "e", name="Dave").changed == 0
    hit = w.merge_nodes(people, once, "Person", "e", name="Alice", on_match={"age": 31})
    assert hit.changed == 0 and {x.name: x.age for x in hit.graph.nodes["Person"].collect()}["Alice"] == 31
    assert w.merge_nodes(people, once, "Person", "e", name="Alice", age=99).changed == 1
    assert w.merge_nodes(people, spark.range(5), "City", "c", name="X").changed == 1


def test_create_counts_rows_before_the_statement(people):
    made = w.create_nodes(people, m.scan(people, "n", "Person"), "Person", "x", name=F.col("n__name"))
    assert made.changed == 3 and made.graph.nodes["Person"].count() == 6
    assert made.graph.nodes["Person"].select("_id").distinct().count() == 6


def test_delete(people, spark):
    g = people.with_rels("KNOWS", spark.createDataFrame([(1, 1, 2)], "_id long, _src long, _dst long"))
    bob = g.nodes["Person"].where("name = 'Bob'")
    with pytest.raises(ValueError):
        w.delete_nodes(g, "Person", bob)
    g = w.delete_nodes(g, "Person", bob, detach=True)
    assert g.nodes["Person"].count() == 2 and g.rels["KNOWS"].count() == 0


def test_labels(people):
    g = w.set_label(people, "Person", people.nodes["Person"].where("age > 29"), "Senior")
    assert m.scan(g, "s", "Senior").count() == 2 and m.scan(g, "s", "Person", all_of=["Senior"]).count() == 2
    g = w.set_label(g, "Person", people.nodes["Person"].where("age > 39"), "Senior", remove=True)
    assert m.scan(g, "s", "Senior").count() == 1
    assert m.scan(g, "c", "Company").count() == 0


def ring(spark, n, degree=5):
    rows = [(i * degree + j, i + 1, (i + j + 1) % n + 1) for i in range(n) for j in range(degree)]
    return PropertyGraph({"N": spark.range(1, n + 1).withColumnRenamed("id", "_id")}, {"E": spark.createDataFrame(rows, "_id long, _src long, _dst long")})


def test_ring(spark):
    g = ring(spark, 20)
    assert {x.degree for x in g.out_degree("E").collect()} == {5}
    assert m.expand_paths(m.scan(g, "a", "N"), g, "a", "E", "b", least=2, most=2).count() == 20 * 25
    assert m.shortest_paths(m.scan(g, "a", "N").where("a__id = 1"), g, "a", "E", "b").count() == 20
    assert g.adjacency("E").count() == 100


def test_loops_and_trails(spark):
    g = PropertyGraph({"N": spark.range(1, 3).withColumnRenamed("id", "_id")}, {"E": spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "_id long, _src long, _dst long")})
    assert m.expand(m.scan(g, "a", "N"), g, "a", "E", "_b", direction="both").count() == 3
    found = m.expand_paths(m.scan(g, "a", "N"), g, "a", "E", "b", path="p").select("a__id", "b__id", "p__rels").collect()
    assert sorted((x[0], x[1], tuple(x[2])) for x in found) == [(1, 1, (1,)), (1, 2, (1, 2)), (1, 2, (2,))]
    with pytest.raises(ValueError):
        m.expand(m.scan(g, "a", "N"), g, "a", "E", "b", direction="up")
    assert m.expand(m.scan(g, "a", "N"), g, "a", "NO_SUCH", "b").count() == 0


@pytest.mark.parametrize(
    ("column", "value"),
    [
        (lambda: v.divide_int(-7, 2), -3), (lambda: v.divide_int(7, 0), None), (lambda: v.divide_int(F.lit(-(2**63)), -1), None), (lambda: v.divide_int(F.lit(-(2**63)), 3), -3074457345618258602), (lambda: v.divide(1.0, 0.0), None),
        (lambda: v.modulo_int(-7, 3), -1), (lambda: v.modulo_int(7, 0), None), (lambda: v.power(2, 10), 1024.0),
        (lambda: v.equal_float(float("nan"), float("nan")), False), (lambda: v.equal_list(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))), False),
        (lambda: v.in_list(F.lit(None).cast("int"), F.array().cast("array<int>")), False), (lambda: v.in_list(3, F.array(F.lit(1), F.lit(None))), None),
        (lambda: v.at(F.array(F.lit(1), F.lit(2)), -1), 2), (lambda: v.at(F.array(F.lit(1)), -9), None), (lambda: v.slice_list(F.array(F.lit(1), F.lit(2), F.lit(3)), -2), [2, 3]), (lambda: v.slice_string(F.lit("hello"), 1, -1), "ell"),
        (lambda: v.range_list(1, 5, 2), [1, 3, 5]), (lambda: v.range_list(5, 1), []), (lambda: v.range_list(5, 1, -2), [5, 3, 1]), (lambda: v.tail(F.array().cast("array<int>")), []), (lambda: v.last(F.array().cast("array<int>")), None),
        (lambda: v.trim(F.lit("  x\t")), "x"), (lambda: v.substring(F.lit("hello"), -3, 2), "he"), (lambda: v.substring(F.lit("hello"), 3), "lo"), (lambda: v.split(F.lit("a.b"), "."), ["a", "b"]), (lambda: v.split(F.lit("ab"), ""), ["", "a", "b", ""]),
        (lambda: v.round_float(-2.5), -3.0), (lambda: v.sign(0.0), 0), (lambda: v.log(0), -math.inf), (lambda: v.to_integer(F.lit(" 3.9 ")), 3), (lambda: v.to_integer(F.lit("abc")), None), (lambda: v.to_boolean(F.lit("yes")), None),
        (lambda: v.single_of(F.array(F.lit(1), F.lit(None)), lambda x: x == 1), None), (lambda: v.all_of(F.array(F.lit(0), F.lit(None)), lambda x: x == 1), False), (lambda: v.distance(v.point(0, 0), v.point(3, 4)), 5.0), (lambda: v.matches(F.lit("abc"), "b"), False),
    ],
)
def test_values(spark, column, value):
    assert one(spark, column()) == value


def test_values_that_raise_or_are_nan(spark):
    assert math.isnan(one(spark, v.modulo(1.0, 0.0))) and math.isnan(one(spark, v.log(-1)))
    with pytest.raises(PySparkException):
        one(spark, v.range_list(1, 5, 0))


def test_rdf(spark):
    a, b, p = rdf.iri("a"), rdf.iri("b"), rdf.iri("p")
    store = rdf.RdfStore.of(spark, [(a, p, b), (a, p, b), (a, p, b, rdf.iri("g")), (a, p, rdf.literal("5", rdf.XSD + "integer")), (rdf.blank("x"), p, rdf.literal("hi \"you\"\n", lang="en"))])
    assert store.count() == 4 and store.match(a, p, b).count() == 2 and store.match_triples(a, p, b).count() == 1
    assert store.match(rdf.iri("zz")).count() == 0 and store.match(g=rdf.iri("g")).count() == 1
    more, new = store.add(store.quads.limit(2))
    assert new.count() == 0 and more.count() == 4
    assert store.delete(store.match(a, p, b)).count() == 2
    ids = store.terms().collect()
    assert sorted(x.term_id for x in ids) == list(range(1, len(ids) + 1))
    lines = names(rdf.n_quads_lines(store.quads))
    assert '_:x <p> "hi \\"you\\"\\n"@en .' in lines and '<a> <p> <b> <g> .' in lines
    value = rdf.typed_value(F.col("o"))
    assert names(store.match(a).select(value["as_integer"].alias("x")).where("x is not null")) == [5]


def test_csv(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text('_id,_LABEL,name,age,_x\na,Person,"Doe, John",30,1\nb,Person,Bob,,2\nc,,C,1.5,3\n')
    (tmp_path / "edges.csv").write_text("_src,_dst,_type,since\na,b,KNOWS,2020\na,zz,KNOWS,2021\nb,c,,\n")
    g = files.read_csv(spark, str(tmp_path / "nodes.csv"))
    g = files.read_csv(spark, str(tmp_path / "edges.csv"), g)
    assert sorted(g.nodes) == ["Node", "Person"] and g.nodes["Person"].columns == ["_key", "name", "age", "_id"]
    assert {x.name: x.age for x in g.nodes["Person"].collect()} == {"Doe, John": 30.0, "Bob": None}
    assert g.rels["KNOWS"].count() == 1 and g.rels["RELATED"].count() == 1
    (tmp_path / "bad.csv").write_text("_id,name\na\n")
    with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
        files.read_csv(spark, str(tmp_path / "bad.csv"))


def test_jsonl(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"type":"node","id":1,"label":"Person","name":"Alice","props":{"name":"Al","age":30}}\n{"type":"node","id":"b","name":"Bob"}\n{"type":"edge","src":1,"dst":"b","relType":"KNOWS","since":2020}\n')
    g = files.read_jsonl(spark, str(tmp_path / "g.jsonl"))
    assert g.nodes["Person"].first().name == "Al" and g.nodes["Node"].first().name == "Bob"
    assert g.rels["KNOWS"].first().since == 2020
    files.write_graph(g, str(tmp_path / "out"), "ndjson")
    again = files.read_jsonl(spark, str(tmp_path / "out"))
    assert again.rels["KNOWS"].count() == 1 and again.nodes["Person"].first().age == 30
    assert any(x.startswith("MATCH (a {_nid: 1}), (b {_nid: ") for x in names(files.cypher_lines(g)))
    for bad in ('{"type":"thing"}', '{"type":"edge","src":"a"}'):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(ValueError):
            files.read_jsonl(spark, str(tmp_path / "bad.jsonl"))


def test_turtle(spark, tmp_path):
    (tmp_path / "t.ttl").write_text('@prefix ex: <http://e/> .\n@base <http://b/> .\n# a comment.\nex:a a ex:T ; ex:p 1, 2.5, 1e3, true ; ex:q "x\\u00e9. \\"y\\""@en .\n<rel> ex:r _:n .\n_:n ex:s "v"^^ex:D .\n')
    quads = files.read_turtle(spark, str(tmp_path / "t.ttl"))
    found = {(x.s.value, x.p.value, x.o.value, x.o.datatype, x.o.lang) for x in quads.collect()}
    assert ("http://e/a", "http://e/q", 'xé. "y"', rdf.LANG_STRING, "en") in found and ("http://b/rel", "http://e/r", "n", None, None) in found
    assert ("n", "http://e/s", "v", "http://e/D", None) in found and len(found) == 8
    assert {d.rpartition("#")[2] for *_, d, _ in found if d} >= {"integer", "decimal", "double", "boolean"}
    g = files.turtle_graph(quads)
    assert m.scan(g, "n", "Resource").count() == 4 and g.rels["r"].count() == 1
    with pytest.raises(ValueError):
        files.parse_turtle("<a> <b> ( 1 )")


def test_turtle_loses_nothing(spark, tmp_path):
    """Statements on one line, full stops and newlines in literals, prefixes of each file's own; what can't be read raises."""
    (tmp_path / "a.ttl").write_text('PREFIX : <http://a/>\n:c :d :e . :f :g :h . :i :j """one.\ntwo . " three""", "x . y"@EN-gb .\n')
    (tmp_path / "b.ttl").write_text("@prefix : <http://b/> . :c :d :e.x . # end . of\n")
    rows = {(x.s.value, x.o.value, x.o.lang) for x in files.read_turtle(spark, str(tmp_path)).collect()}
    assert rows == {("http://a/c", "http://a/e", None), ("http://a/f", "http://a/h", None), ("http://a/i", 'one.\ntwo . " three', None), ("http://a/i", "x . y", "en-gb"), ("http://b/c", "http://b/e.x", None)}
    for bad in ("<a> <b> <c>", "<a> <b> .", "<a> <b> <c> . <d>", ":a :b :c .", '<a> <b> "c'):
        with pytest.raises(ValueError):
            files.parse_turtle(bad)
    lines = "".join(f'<http://x/{i}> <http://p> "{i}" .\n' for i in range(500))
    (tmp_path / "large").mkdir()
    (tmp_path / "large" / "c.nt").write_text(lines)
    assert files.read_turtle(spark, str(tmp_path / "large"), most_whole=1000).count() == 500


def test_turtle_lines_alone(spark, tmp_path):
    """Lines that are statements of their own are read as parse_turtle reads them, and by Spark's functions where they have no escapes."""
    lines = [
        '<s> <p> "" .', '<s><p>"x"@EN-gb.', '<s> <p> "1"^^<http://t> . # end \\ "', "_:b1 <p> _:c-2 .", "<s> <p> <> .", "", "  # only a comment .", '\t<s>\t<http://x/q#r>\t"a . <b> \' # é  " .\r',
        '<s> <p> "q\\"uo\\\\te\\n\\u00e9" .', '<\\u00e9> <p> "\\\\n" .', '<s> <p> "@en"@en .', '<s> <p> "1" .', '<s> <p> "1" .',
    ]
    (tmp_path / "sp ace").mkdir()
    (tmp_path / "sp ace" / "a+1.nt").write_bytes("\n".join(lines).encode())
    (tmp_path / "sp ace" / "b.ttl").write_text('@prefix : <http://b/> .\n<s> <p> "b" .\n:s :p """\n<s> <no> "statement" .\n""" .')
    want = {t for f in (tmp_path / "sp ace").iterdir() for t in files.parse_turtle(f.read_bytes().decode())}
    quads = files.read_turtle(spark, str(tmp_path / "sp ace"))
    rows = [(tuple(x.s), tuple(x.p), tuple(x.o)) for x in quads.collect()]
    assert set(rows) == want and len(rows) == len(want) == 12
    for bad in ('<s> <p> "x"@prefix .', '<s> <p> "x" "y" .', "<s> _:p <o>", '<s> <p> <o>@en .', '<s> <p> "x" . .', "<s> <p> <o o> ."):
        (tmp_path / "bad.nt").write_text(f"<s> <p> <o> .\n{bad}\n")
        with pytest.raises(Exception, match="unexpected|ends early"):
            files.read_turtle(spark, str(tmp_path / "bad.nt")).collect()
    assert len(files.read_turtle(spark, str(tmp_path / "sp ace" / "a+1.nt"), base="http://z/").where("s.value = 'http://z/s'").collect()) == 8
    g = files.read_graph(spark, str(tmp_path / "sp ace" / "a+1.nt"), "turtle")
    assert g.nodes["Resource"].count() == 5 and g.rels["p"].count() == 2


def test_turtle_of_plain_lines_needs_no_python(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<s> <p> "x" .\n<s> <q> <o> .\n' * 3)
    quads = files.read_turtle(spark, str(tmp_path / "a.nt"))
    assert quads.count() == 2 and "MapInArrow" not in quads._jdf.queryExecution().toString()


def _stars(spark, left, right):
    """Nodes 1 and 2, left and right neighbours of each, and two relationships to each neighbour of node 2."""
    ids = lambda n, first: spark.range(n).select((F.col("id") + first).alias("_id"))
    to = lambda t, hub, first: t.select((F.col("_id") * 10 + first).alias("_id"), F.col("_id").alias("_src"), F.lit(hub).cast("long").alias("_dst"))
    a, b = ids(left, 100_000), ids(right, 200_000)
    rels = to(a, 1, 0).union(to(b, 1, 0)).union(to(a.limit(7), 2, 1)).union(to(a.limit(7), 2, 2)).union(to(b.limit(5), 2, 3))
    return PropertyGraph({"Hub": spark.createDataFrame([(1,), (2,)], "_id long"), "A": a, "B": b}, {"TO": rels})


def test_expand_at_hubs_is_spread(spark):
    g = _stars(spark, 6000, 4000)
    df = m.expand(m.expand(m.scan(g, "a", "A"), g, "a", "TO", "h", labels="Hub"), g, "h", "TO", "b", direction="in", labels="B", hubs=True)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 * 4000 + 14 * 5 and max(sizes) < 0.7 * sum(sizes)


def test_expand_at_hubs_has_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 3)
    monkeypatch.setattr(m, "PAIRS", 40)
    g = _stars(spark, 20, 9)
    df = m.expand(m.scan(g, "a", "A"), g, "a", "TO", "h", labels="Hub", rel="r1")
    both = [m.expand(df, g, "h", "TO", "x", direction="in", labels=["A", "B"], rel="r2", distinct_from=("r1",), hubs=hubs) for hubs in (False, True)]
    assert both[0].columns == both[1].columns
    plain, spread = (sorted(map(str, t.collect())) for t in both)
    assert plain == spread and len(plain) == 20 * 28 + 14 * 18
    with pytest.raises(ValueError):
        m.expand(df, g, "h", "TO", "x", direction="in", hubs=True, optional=True)


def test_walks_do_not_broadcast_relationships(spark, monkeypatch):
    g = PropertyGraph({"N": spark.range(4).select(F.col("id").alias("_id"))}, {"TO": spark.createDataFrame([(1, 0, 1), (2, 1, 2), (3, 2, 0), (4, 2, 3)], "_id long, _src long, _dst long")})
    plans, write = [], m.materialize
    monkeypatch.setattr(m, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    n = m.scan(g, "n", "N")
    closed = m.expand_paths(n, g, "n", "TO", "n", most=5, path="p")
    assert sorted((x.n__id, x.p__length) for x in closed.collect()) == [(0, 3), (1, 3), (2, 3)]
    assert m.shortest_paths(n, g, "n", "TO", "x").where("x__distance = 3").collect() == [(0, 3, 3)]
    plans.append(closed._jdf.queryExecution().executedPlan().toString())
    hops = [line for plan in plans for line in plan.splitlines() if "HashJoin" in line and "__from" in line]
    assert len(plans) == 6 and hops == [] and any("SortMergeJoin" in plan for plan in plans)


def test_values_match_whole_strings(spark):
    df = spark.createDataFrame([("abc",), ("abc\n",), ("xabc",), (None,)], "s string")
    assert [x[0] for x in df.select(v.matches(F.col("s"), "abc")).collect()] == [True, False, False, None]


def test_shortest_paths_have_no_limit(spark):
    chain = PropertyGraph({"N": spark.range(40).select(F.col("id").alias("_id"))}, {"E": spark.range(39).select(F.col("id").alias("_id"), F.col("id").alias("_src"), (F.col("id") + 1).alias("_dst"))})
    found = m.shortest_paths(m.scan(chain, "a", "N").where("a__id = 0"), chain, "a", "E", "b").collect()
    assert len(found) == 40 and max(x.b__distance for x in found) == 39


def test_lookup_by_id_reaches_the_scan(spark, sf_dir):
    from loomgraph.plans.sample import sample_graph

    plan = sample_graph(spark, sf_dir).node_by_id((3 << 48) + 7, "Customer")._jdf.queryExecution().toString()
    assert "EqualTo(c_custkey,7)" in plan


def test_plain_delete_of_connected_nodes_raises(people):
    with pytest.raises(ValueError):
        w.delete_nodes(people, "Person", people.nodes["Person"].where("name = 'Bob'"))


def test_terms_are_in_canonical_order(spark):
    store = rdf.RdfStore.of(spark, [(rdf.blank("z"), rdf.iri("m"), rdf.literal("a", lang="EN")), (rdf.blank("z"), rdf.iri("m"), rdf.literal("a", lang="en"))])
    assert [(x.term.kind, x.term.lang) for x in store.terms().orderBy("term_id").collect()] == [("blank", None), ("iri", None), ("literal", "en")]


def test_formats():
    assert files.format_of("x.NDJSON") == "jsonl" and files.format_of("ttl") == "turtle" and files.format_of("a/b.cql") == "cypher"
    with pytest.raises(ValueError):
        files.format_of("x.doc")
