"""Graph files: CSV, JSON Lines and Turtle in; Cypher text, JSON Lines and Turtle out. Spark reads, splits and writes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import PropertyGraph, union_all
from loomgraph.operators.write import _next_id, _number
from loomgraph.plans.scratch import materialize

#: Format names and file endings, as users give them.
FORMATS = {"csv": "csv", "jsonl": "jsonl", "jsonlines": "jsonl", "ndjson": "jsonl", "cypher": "cypher", "cql": "cypher", "turtle": "turtle", "ttl": "turtle"}


def format_of(name_or_path: str) -> str:
    key = name_or_path.lower().rpartition(".")[2]
    if key not in FORMATS:
        raise ValueError(f"unknown format {name_or_path!r}")
    return FORMATS[key]


def _typed(table: DataFrame, names: list[str]) -> DataFrame:
    """String columns as bigint, double or boolean where all their values are; empty cells are null."""
    table = table.withColumns({n: F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")) for n in names})
    if not names:
        return table
    kinds = ("bigint", "double", "boolean")
    fits = lambda n, k: F.lower(f"`{n}`").isin("true", "false") if k == "boolean" else F.col(f"`{n}`").try_cast(k).isNotNull()
    checks = [F.coalesce(F.every(fits(n, k) | F.col(f"`{n}`").isNull()), F.lit(False)).alias(f"{i}_{k}") for i, n in enumerate(names) for k in kinds]
    found = table.agg(*checks).first()
    return table.withColumns({n: F.col(f"`{n}`").cast(next((k for k in kinds if found[f"{i}_{k}"]), "string")) for i, n in enumerate(names)})


def _numbered(graph: PropertyGraph | None, nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> PropertyGraph:
    """Gives nodes (with `_key`) ids and resolves the keys of edges (`_src_key`, `_dst_key`); edges whose ends are unknown are left out."""
    held = graph or PropertyGraph({}, {})
    tables, rels = dict(held.nodes), dict(held.rels)
    first = max([_next_id(t) for t in tables.values()], default=1)
    for label, table in nodes.items():
        new = _number(table, first)
        first += new.count()
        tables[label] = union_all([tables[label], new]) if label in tables else new
    keys = union_all([t.select("_key", "_id") for t in tables.values() if "_key" in t.columns]).groupBy("_key").agg(F.min("_id").alias("_id"))
    for rel_type, table in edges.items():
        ends = table.join(keys.select(F.col("_key").alias("_src_key"), F.col("_id").alias("_src")), "_src_key").join(keys.select(F.col("_key").alias("_dst_key"), F.col("_id").alias("_dst")), "_dst_key")
        new = _number(ends.drop("_src_key", "_dst_key"), _next_id(rels.get(rel_type)))
        rels[rel_type] = union_all([rels[rel_type], new]) if rel_type in rels else new
    return PropertyGraph(tables, rels, held.targets)


def read_csv(spark: SparkSession, path: str, graph: PropertyGraph | None = None) -> PropertyGraph:
    """A node file (`_id`, `_label`) or an edge file (`_src`, `_dst`, `_type`); a ragged row raises."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', mode="FAILFAST", inferSchema=False, enforceSchema=False)
    by_lower = {c.lower(): c for c in raw.columns}
    properties = [c for c in raw.columns if not c.startswith("_")]
    typed = _typed(raw, properties)
    get = lambda n, other: F.coalesce(F.nullif(F.col(f"`{by_lower[n]}`"), F.lit("")), F.lit(other)) if n in by_lower else F.lit(other)
    if "_src" in by_lower and "_dst" in by_lower:
        table = materialize(typed.select(F.col(by_lower["_src"]).alias("_src_key"), F.col(by_lower["_dst"]).alias("_dst_key"), get("_type", "RELATED").alias("_type"), *properties), "edges")
        return _numbered(graph, {}, {r[0]: table.where(F.col("_type") == r[0]).drop("_type") for r in table.select("_type").distinct().collect()})
    if "_id" not in by_lower:
        raise ValueError("a node file needs _id, an edge file _src and _dst")
    table = materialize(typed.select(F.col(by_lower["_id"]).alias("_key"), get("_label", "Node").alias("_label"), *properties), "nodes")
    return _numbered(graph, {r[0]: table.where(F.col("_label") == r[0]).drop("_label") for r in table.select("_label").distinct().collect()}, {})


def read_jsonl(spark: SparkSession, path: str, graph: PropertyGraph | None = None) -> PropertyGraph:
    """Objects of type node (id, label) or edge (src, dst, relType); properties lie flat or in props, and props wins."""
    raw = materialize(spark.read.json(path), "records")
    if "type" not in raw.columns or not raw.where("type is null or type not in ('node', 'edge')").isEmpty():
        raise ValueError("a record's type is node or edge")
    inner = [f.name for f in raw.schema["props"].dataType.fields] if "props" in raw.columns and isinstance(raw.schema["props"].dataType, T.StructType) else []
    flat = [f.name for f in raw.schema.fields if f.name not in ("type", "id", "label", "props", "src", "dst", "relType", "type_name") and not isinstance(f.dataType, (T.ArrayType, T.StructType))]
    get = lambda n: F.coalesce(*[F.col(f"props.`{n}`")] * (n in inner), *[F.col(f"`{n}`")] * (n in flat)).alias(n)
    names = list(dict.fromkeys([*inner, *flat]))
    text = lambda *ns: F.coalesce(*[F.col(n).cast("string") for n in ns if n in raw.columns], F.lit(None).cast("string"))
    nodes, edges = raw.where("type = 'node'"), raw.where("type = 'edge'")
    nodes = materialize(nodes.select(text("id").alias("_key"), F.coalesce(text("label"), F.lit("Node")).alias("_label"), *map(get, names)), "nodes")
    edges = materialize(edges.select(text("src").alias("_src_key"), text("dst").alias("_dst_key"), F.coalesce(text("relType", "type_name"), F.lit("RELATED")).alias("_type"), *map(get, names)), "edges")
    if not edges.where("_src_key is null or _dst_key is null").isEmpty():
        raise ValueError("an edge needs src and dst")
    part = lambda df, by: {r[0]: _used(df.where(F.col(by) == r[0]).drop(by), names) for r in df.select(by).distinct().collect()}
    return _numbered(graph, part(nodes, "_label"), part(edges, "_type"))


def _used(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the properties that no row has."""
    has = df.agg(*[F.count(f"`{n}`").alias(f"n{i}") for i, n in enumerate(names)]).first() if names else []
    return df.drop(*[n for i, n in enumerate(names) if not has[i]])


# ---------------------------------------------------------------- Turtle

_TOKEN = re.compile(r"""\s*(?:\#[^\n]*(?:\n|\Z)\s*)*(?:
    <(?P<iri>[^<>\s]*)> | _:(?P<blank>[\w-]+) | "{3}(?P<long>.*?)"{3} | "(?P<text>(?:[^"\\\n]|\\.)*)" | '(?P<single>(?:[^'\\\n]|\\.)*)' | @(?P<directive>prefix|base)(?=\s) | (?P<sparql>(?i:prefix|base))(?=\s) | @(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    | \^\^(?P<typed>) | (?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)(?![\w:]) | (?P<word>a|true|false)(?![\w:.-]) | (?P<name>[\w-]*:(?:[\w%-]|\.(?=[\w%-]))*) | (?P<punct>[;,.]) | (?P<end>\Z) | (?P<bad>\S))""", re.X | re.S)
_ESCAPE = re.compile(r'\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([tbnrf"\'\\]))')
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
_XSD = "http://www.w3.org/2001/XMLSchema#"
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def parse_turtle(text: str, base: str = "") -> list[tuple]:
    """Triples of terms of a Turtle document; prefixes and base hold from where they stand. Collections and anonymous
    blank nodes are not accepted; whatever can't be read raises."""
    from urllib.parse import urljoin

    unescape = lambda s: _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), s)
    tokens = [(m.lastgroup, m[m.lastgroup]) for m in _TOKEN.finditer(text) if m.lastgroup != "end"]
    prefixes: dict[str, str] = {}
    triples, at = [], 0

    def take(what: str | None = None, value: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"the document ends early: {text[-80:]!r}")
        kind, found = tokens[at]
        if what is not None and (kind != what or value not in (None, found)):
            raise ValueError(f"unexpected {found!r} after {[t[1] for t in tokens[max(0, at - 5) : at]]}")
        at += 1
        return found

    def following(kind: str, value: str | None = None) -> bool:
        return at < len(tokens) and tokens[at][0] == kind and value in (None, tokens[at][1])

    def absolute(value: str) -> str:
        return urljoin(base, unescape(value)) if base else unescape(value)

    def resource() -> tuple:
        if following("iri"):
            return ("iri", absolute(take()), None, None)
        if following("blank"):
            return ("blank", take(), None, None)
        prefix, _, rest = take("name").partition(":")
        if prefix not in prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return ("iri", prefixes[prefix] + rest, None, None)

    def node() -> tuple:
        if at < len(tokens) and tokens[at][0] in ("text", "single", "long"):
            value = unescape(take())
            if following("lang"):
                return ("literal", value, "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", take().lower())
            if following("typed"):
                take()
                return ("literal", value, resource()[1], None)
            return ("literal", value, _XSD + "string", None)
        if following("number"):
            value = take()
            return ("literal", value, _XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None)
        if following("word", "true") or following("word", "false"):
            return ("literal", take(), _XSD + "boolean", None)
        return resource()

    while at < len(tokens):
        if following("directive") or following("sparql"):
            ended = tokens[at][0] == "directive"
            if take().lower() == "prefix":
                name = take("name")
                prefixes[name.removesuffix(":")] = absolute(take("iri"))
            else:
                base = absolute(take("iri"))
            if ended:
                take("punct", ".")
            continue
        subject = resource()
        while True:
            verb = ("iri", _TYPE, None, None) if following("word", "a") and take() else resource()
            triples.append((subject, verb, node()))
            while following("punct", ","):
                take()
                triples.append((subject, verb, node()))
            if not following("punct", ";"):
                break
            while following("punct", ";"):
                take()
            if following("punct", "."):
                break
        take("punct", ".")
    return triples


#: Files of up to so many bytes are read whole, each in a task; a larger one is read by lines, one statement to a line.
MOST_WHOLE = 64 << 20

#: A line that is one statement without prefixes, which says the same wherever it stands. Spark's functions read the
#: simple ones; those with escapes go to parse_turtle. Both patterns take less than parse_turtle does, never more.
_MARK = "\x01"
_STATEMENT = r"""^\s*(%(iri)s|%(blank)s)\s*(%(iri)s)\s*(?:(%(iri)s|%(blank)s)|("%(text)s")(%(lang)s|\^\^%(iri)s)?)\s*\.\s*(?:#[^\n\x01]*)?\z"""
_PARTS = {"blank": "_:[A-Za-z0-9_-]+", "lang": r"@(?!(?:prefix|base)\s)[A-Za-z]++(?:-[A-Za-z0-9]++)*+"}
_SIMPLE = _STATEMENT % {**_PARTS, "iri": r"<[^<>\\\p{Cc}\p{Z}]*>", "text": r'[^"\\\n\x01]*'}
_ESCAPED = _STATEMENT % {**_PARTS, "iri": r"<[^<>\p{Cc}\p{Z}]*>", "text": r'[^"\\\n\x01]*+(?:\\[^\n\x01][^"\\\n\x01]*+)*+'}
_NOTHING = r"^\s*(?:#[^\n\x01]*)?\z"


def _simple_quads(lines: DataFrame) -> DataFrame:
    """Quads of the lines that are simple statements."""
    from loomgraph.operators.rdf import LANG_STRING, XSD, term

    parts = F.split(F.regexp_replace("value", _SIMPLE, _MARK.join(f"${i}" for i in range(1, 6))), _MARK)
    found = lines.select(F.explode(F.array(parts)).alias("x")).where(F.size("x") == 5)  # explode: one match for a line, not one for each part
    s, p, o, text, more = (F.col("x")[i] for i in range(5))
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    resource = lambda c: term(F.when(c.startswith("<"), "iri").otherwise("blank"), F.when(c.startswith("<"), inner(c)).otherwise(F.substring(c, 3, 1 << 30)))
    datatype = F.when(more == "", XSD + "string").when(more.startswith("@"), LANG_STRING).otherwise(F.substring(more, F.lit(4), F.length(more) - 4))
    literal = term("literal", inner(text), datatype, F.when(more.startswith("@"), F.substring(more, 2, 1 << 30)))
    none = F.lit(None).cast("struct<kind:string,value:string,datatype:string,lang:string>")
    return found.select(resource(s).alias("s"), resource(p).alias("p"), F.when(text == "", resource(o)).otherwise(literal).alias("o"), none.alias("g"))


def _turtle_quads(spark: SparkSession, path: str, base: str = "", most_whole: int = MOST_WHOLE) -> DataFrame:
    """Quads of Turtle files, each as often as it is said."""
    from loomgraph.operators.rdf import QUAD

    sizes = {r["file_path"]: r for r in spark.read.format("binaryFile").load(path).select("path", "length", "_metadata.file_path").collect()}  # one row for each file
    if not sizes:
        return spark.createDataFrame([], QUAD)
    lines = lambda names: spark.read.text(names, lineSep="\n")
    plain, escaped = [], []
    if not base:  # which makes iris depend on more than their line
        value = F.col("value")
        simple, alone = value.rlike(_SIMPLE) | value.rlike(_NOTHING), value.rlike(_ESCAPED)
        kind = F.when(~F.is_valid_utf8(value), 2).when(simple, 0).when(alone, 1).otherwise(2)
        kinds = lines([r["path"] for r in sizes.values()]).groupBy("_metadata.file_path").agg(F.max(kind).alias("kind")).collect()
        plain = [sizes[r["file_path"]]["path"] for r in kinds if r["kind"] < 2]
        escaped = [sizes[r["file_path"]]["path"] for r in kinds if r["kind"] == 1]
    others = [r for r in sizes.values() if r["path"] not in set(plain)]
    large = [r["path"] for r in others if r["length"] > most_whole]
    small = [r["path"] for r in others if r["length"] <= most_whole]
    texts = [spark.read.text(files, wholetext=whole).select("value") for whole, files in ((True, small), (False, large)) if files]
    if escaped:
        texts.append(lines(escaped).select("value").where(~F.col("value").rlike(_SIMPLE)))

    def run(batches):
        import pyarrow as pa

        term = pa.struct([(n, pa.string()) for n in ("kind", "value", "datatype", "lang")])
        as_dict = lambda t: dict(zip(("kind", "value", "datatype", "lang"), t, strict=True))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if found := parse_turtle(text, base):
                    yield pa.RecordBatch.from_arrays([*(pa.array([as_dict(t[i]) for t in found], term) for i in range(3)), pa.nulls(len(found), term)], names=list("spog"))

    found = [union_all(texts).mapInArrow(run, QUAD)] if texts else []
    return union_all([*found, _simple_quads(lines(plain))] if plain else found)


def read_turtle(spark: SparkSession, path: str, base: str = "", most_whole: int = MOST_WHOLE) -> DataFrame:
    """Distinct quads (s, p, o, g) of Turtle files.

    Files in which each line is a statement of its own without prefixes, as in N-Triples files, are read by lines and
    split, whatever their size. Of others, the prefixes and base are a file's own; those above most_whole bytes are read
    by lines too, and a line that needs a prefix or goes on in the next one raises. Nothing is left out.
    """
    return _turtle_quads(spark, path, base, most_whole).distinct()


#: Up to so many properties are gathered in one aggregation, with a condition for each; more are pivoted.
MOST_CONDITIONS = 100


def turtle_graph(quads: DataFrame) -> PropertyGraph:
    """A property graph of label Resource: literals become properties named by predicate, other objects relationships.

    A quad that is given twice counts once.
    """
    key = lambda c: F.when(F.col(f"{c}.kind") == "blank", F.concat(F.lit("_:"), F.col(f"{c}.value"))).otherwise(F.col(f"{c}.value"))
    literal = F.col("o.kind") == "literal"
    whole = F.when(~literal, F.struct(F.col("s.kind").alias("s"), "p", F.col("o.kind").alias("o"), "g"))  # with the keys, what tells relationships apart
    rows = materialize(quads.select(key("s").alias("_src_key"), F.regexp_extract("p.value", r"_*([^/#]*)$", 1).alias("p"), key("o").alias("o"), literal.alias("literal"), whole.alias("whole")), "triples")
    held = [(r["p"], r["literal"]) for r in rows.select("p", "literal").distinct().collect()]
    names, types = [p for p, is_literal in held if is_literal], [p for p, is_literal in held if not is_literal]
    said = rows.select(F.col("_src_key").alias("_key"), F.when(F.col("literal"), F.col("p")).alias("p"), "o").union(rows.where("not literal").select("o", F.lit(None), F.lit(None)).distinct())
    if len(names) > MOST_CONDITIONS:
        nodes = said.groupBy("_key").pivot("p", names).agg(F.min("o"))
    else:
        nodes = said.groupBy("_key").agg(F.count("*").alias("_rows"), *[F.min(F.when(F.col("p") == n, F.col("o"))).alias(n) for n in names]).drop("_rows")
    edges = rows.where("not literal").distinct()
    return _numbered(None, {"Resource": nodes}, {t: edges.where(F.col("p") == t).select("_src_key", F.col("o").alias("_dst_key")) for t in types})


# ---------------------------------------------------------------- export


def _properties(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if not c.startswith("_"))


def jsonl_lines(graph: PropertyGraph, labels: list[str] | None = None) -> DataFrame:
    """One JSON object for each node, then for each relationship; null properties are left out."""
    out = []
    for label in labels or graph.nodes:
        t = graph.nodes[label]
        props = F.struct(*[F.col(c) for c in _properties(t)]) if _properties(t) else F.create_map().cast("map<string,string>")
        out.append(t.select(F.to_json(F.struct(F.lit("node").alias("type"), F.col("_id").cast("string").alias("id"), F.lit(label).alias("label"), props.alias("props"))).alias("value")))
    for rel_type, t in ({} if labels else graph.rels).items():
        props = F.struct(*[F.col(c) for c in _properties(t)]) if _properties(t) else F.create_map().cast("map<string,string>")
        out.append(t.select(F.to_json(F.struct(F.lit("edge").alias("type"), F.col("_src").cast("string").alias("src"), F.col("_dst").cast("string").alias("dst"), F.lit(rel_type).alias("relType"), props.alias("props"))).alias("value")))
    return union_all(out)


def _quoted(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_]\w*", name) else "`" + name.replace("`", "``") + "`"


def _cypher_value(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        c = F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.col(f"`{name}`").isNotNull(), F.concat(F.lit(f"{_quoted(name)}: "), c.cast("string")))


def cypher_lines(graph: PropertyGraph) -> DataFrame:
    """CREATE statements for nodes, then MATCH … CREATE for relationships; keys sorted."""
    out = []
    for label, t in graph.nodes.items():
        props = F.concat_ws(", ", F.concat(F.lit("_nid: "), F.col("_id").cast("string")), *[_cypher_value(t, c) for c in _properties(t)])
        out.append(t.select(F.concat(F.lit("CREATE (n"), F.col("_id").cast("string"), F.lit(f":{_quoted(label)} {{"), props, F.lit("});")).alias("value")))
    for rel_type, t in graph.rels.items():
        props = F.concat_ws(", ", *[_cypher_value(t, c) for c in _properties(t)]) if _properties(t) else F.lit("")
        shown = F.when(props != "", F.concat(F.lit(" {"), props, F.lit("}"))).otherwise("")
        out.append(t.select(F.concat(F.lit("MATCH (a {_nid: "), F.col("_src").cast("string"), F.lit("}), (b {_nid: "), F.col("_dst").cast("string"), F.lit(f"}}) CREATE (a)-[:{_quoted(rel_type)}"), shown, F.lit("]->(b);")).alias("value")))
    return union_all(out)


def turtle_lines(graph: PropertyGraph) -> DataFrame:
    """A statement for each label, property and relationship."""
    out = []
    subject = F.concat(F.lit("<n"), F.col("_id").cast("string"), F.lit(">"))
    for label, t in graph.nodes.items():
        rows = [F.concat(subject, F.lit(f' <_label> "{label}" .'))]
        for c in _properties(t):
            text = F.col(f"`{c}`").cast("string")
            for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
                text = F.replace(text, F.lit(raw), F.lit(shown))
            rows.append(F.when(F.col(f"`{c}`").isNotNull(), F.concat(subject, F.lit(f' <{c}> "'), text, F.lit('" .'))))
        out.append(t.select(F.explode(F.array_compact(F.array(*rows))).alias("value")))
    for rel_type, t in graph.rels.items():
        out.append(t.select(F.concat(F.lit("<n"), F.col("_src").cast("string"), F.lit(f"> <{rel_type}> <n"), F.col("_dst").cast("string"), F.lit("> .")).alias("value")))
    return union_all(out)


EXPORTS = {"jsonl": jsonl_lines, "cypher": cypher_lines, "turtle": turtle_lines}


def write_graph(graph: PropertyGraph, path: str, kind: str) -> None:
    EXPORTS[format_of(kind)](graph).write.text(path)


def read_graph(spark: SparkSession, path: str, kind: str, graph: PropertyGraph | None = None) -> PropertyGraph:
    kind = format_of(kind)
    if kind == "turtle":
        return turtle_graph(_turtle_quads(spark, path))
    return {"csv": read_csv, "jsonl": read_jsonl}[kind](spark, path, graph)
