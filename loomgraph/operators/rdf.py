"""RDF: quads as DataFrame rows, with pattern matching, basic graph patterns and a term dictionary.

A term is struct<kind, value, datatype, lang> with kind iri, blank or literal; a quad is (s, p, o, g), g being null for
the default graph. Stores are immutable.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.scratch import materialize

TERM = "struct<kind:string,value:string,datatype:string,lang:string>"
QUAD = f"s {TERM}, p {TERM}, o {TERM}, g {TERM}"
XSD = "http://www.w3.org/2001/XMLSchema#"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
Term = tuple  # (kind, value, datatype, lang)


def iri(value: str) -> Term:
    return ("iri", value, None, None)


def blank(value: str) -> Term:
    return ("blank", value, None, None)


def literal(value: str, datatype: str | None = None, lang: str | None = None) -> Term:
    """Language tags are held in lower case, as they are the same in any."""
    return ("literal", value, datatype or (LANG_STRING if lang else XSD + "string"), lang and lang.lower())


def term(kind, value, datatype=None, lang=None) -> Column:
    """A term from Columns or plain strings."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(column(kind).alias("kind"), column(value).alias("value"), column(datatype).alias("datatype"), F.lower(column(lang)).alias("lang"))


def _is(position: str, t: Term) -> Column:
    names = ("kind", "value", "datatype", "lang")
    return reduce(lambda a, b: a & b, [F.col(f"{position}.{n}").eqNullSafe(F.lit(x)) for n, x in zip(names, t, strict=True)])


def _same(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in "spog"])


@dataclass(frozen=True)
class RdfStore:
    quads: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, rows: list[tuple]) -> "RdfStore":
        """From (s, p, o) or (s, p, o, g) of terms."""
        return cls(spark.createDataFrame([(*r, None)[:4] for r in rows], QUAD).distinct())

    def add(self, quads: DataFrame) -> tuple["RdfStore", DataFrame]:
        """The store with quads, and those of them that are new."""
        new = quads.select(*"spog").distinct().alias("x").join(self.quads.alias("h"), _same("x", "h"), "left_anti")
        return RdfStore(self.quads.unionByName(new)), new

    def delete(self, quads: DataFrame) -> "RdfStore":
        return RdfStore(self.quads.alias("h").join(quads.alias("x"), _same("h", "x"), "left_anti"))

    def match(self, s: Term | None = None, p: Term | None = None, o: Term | None = None, g: Term | None = None) -> DataFrame:
        """Quads with the given terms, in all graphs unless one is given; filters reach the scan."""
        conditions = [_is(c, t) for c, t in zip("spog", (s, p, o, g), strict=True) if t is not None]
        return reduce(lambda d, c: d.where(c), conditions, self.quads)

    def match_triples(self, s: Term | None = None, p: Term | None = None, o: Term | None = None) -> DataFrame:
        """Distinct triples over all graphs."""
        return self.match(s, p, o).select("s", "p", "o").distinct()

    def count(self) -> int:
        return self.quads.count()

    def terms(self) -> DataFrame:
        """The dictionary: term and term_id from 1, in canonical order (blank nodes, IRIs, literals)."""
        used = reduce(lambda a, b: a.union(b), [self.quads.select(F.col(c).alias("term")) for c in "spog"]).where("term is not null").distinct()
        rank = F.array_position(F.array(F.lit("blank"), F.lit("iri"), F.lit("literal")), F.col("term.kind"))
        order = (rank, F.col("term.value"), F.col("term.datatype"), F.col("term.lang"))
        parts = materialize(used.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "terms")
        inside = parts.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
        sizes = inside.groupBy("part").agg(F.count("*").alias("n"))
        bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return inside.join(bases, "part").select("term", (F.col("base") + F.col("at")).alias("term_id"))

    def bgp(self, patterns: list[tuple]) -> DataFrame:
        """Joins triple patterns; a string that starts with ? is a variable and becomes a column."""
        out = None
        for pattern in patterns:
            fixed = [None if isinstance(t, str) else t for t in pattern]
            found = self.match_triples(*fixed)
            names: dict[str, str] = {}
            for position, t in zip("spo", pattern, strict=True):
                if isinstance(t, str):
                    if t in names:
                        found = found.where(F.col(position) == F.col(names[t]))
                    names.setdefault(t, position)
            found = found.select(*[F.col(c).alias(v[1:]) for v, c in names.items()])
            shared = [] if out is None else [c for c in found.columns if c in out.columns]
            out = found if out is None else out.join(found, shared) if shared else out.crossJoin(found)
        return out


def typed_value(t: Column) -> dict[str, Column]:
    """A literal as integer, float, boolean or string: one column each, null where the datatype is another."""
    datatype, value = t["datatype"], t["value"]
    whole = F.when(datatype == XSD + "integer", value.try_cast("bigint"))
    real = F.when(datatype.isin(XSD + "decimal", XSD + "double"), value.try_cast("double"))
    truth = F.when(datatype == XSD + "boolean", F.when(value.isin("true", "1"), True).when(value.isin("false", "0"), False))
    return {"as_integer": whole, "as_float": real, "as_boolean": truth, "as_string": F.when(whole.isNull() & real.isNull() & truth.isNull(), value)}


def n_triples(t: Column) -> Column:
    """A term as N-Triples text."""
    escaped = t["value"]
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    suffix = F.when(t["lang"].isNotNull(), F.concat(F.lit("@"), t["lang"])).when(t["datatype"] == XSD + "string", F.lit("")).otherwise(F.concat(F.lit("^^<"), t["datatype"], F.lit(">")))
    return F.when(t["kind"] == "iri", F.concat(F.lit("<"), t["value"], F.lit(">"))).when(t["kind"] == "blank", F.concat(F.lit("_:"), t["value"])).otherwise(F.concat(F.lit('"'), escaped, F.lit('"'), F.coalesce(suffix, F.lit(""))))


def n_quads_lines(quads: DataFrame) -> DataFrame:
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), n_triples(F.col("g")))).otherwise("")
    return quads.select(F.concat(n_triples(F.col("s")), F.lit(" "), n_triples(F.col("p")), F.lit(" "), n_triples(F.col("o")), graph, F.lit(" .")).alias("value"))
