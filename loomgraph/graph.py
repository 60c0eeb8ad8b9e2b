"""The property graph: one DataFrame for each node label and each relationship type, immutable.

Node tables have `_id` (long) and a column for each property; relationship tables have `_id`, `_src`, `_dst` and
properties. A missing property is a null. Operators bind a node or relationship to a variable `a` as the columns
`a__id`, `a__label` (or `a__type`, `a__src`, `a__dst`) and `a__<property>`, so Catalyst prunes what nothing uses.
Writes give a new graph that shares the tables it does not change.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE, REL = ("_id", "_extra_labels"), ("_id", "_src", "_dst")


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


class Tables(Mapping):
    """Tables by name, each built when it is first asked for, so a query reads the files of the tables it uses only."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __contains__(self, name) -> bool:
        return name in self._makers

    def having(self, name: str, table: DataFrame) -> "Tables":
        after = Tables({**self._makers, name: lambda: table})
        after._made = {**self._made, name: table}
        return after


@dataclass(frozen=True)
class PropertyGraph:
    nodes: Mapping[str, DataFrame]
    rels: Mapping[str, DataFrame] = field(default_factory=dict)
    #: Where a relationship type leads: type -> label of its targets, if there is just one; spares a join.
    targets: dict[str, str] = field(default_factory=dict)
    #: Labels whose ids are a stored key plus a constant: label -> (key, constant); a look-up by id then reaches the scan.
    id_keys: dict[str, tuple[str, int]] = field(default_factory=dict)
    #: Labels whose tables are known to have no labels beside the first one.
    single: frozenset = frozenset()

    @property
    def spark(self):
        return SparkSession.active()

    def with_nodes(self, label: str, table: DataFrame) -> "PropertyGraph":
        nodes = self.nodes.having(label, table) if isinstance(self.nodes, Tables) else {**self.nodes, label: table}
        return replace(self, nodes=nodes, id_keys={k: v for k, v in self.id_keys.items() if k != label}, single=self.single - {label})

    def with_rels(self, rel_type: str, table: DataFrame) -> "PropertyGraph":
        return replace(self, rels=self.rels.having(rel_type, table) if isinstance(self.rels, Tables) else {**self.rels, rel_type: table})

    def node_table(self, labels: str | list[str] | None = None, properties: list[str] | None = None) -> DataFrame:
        """Nodes with one of the labels (all if none are named), with `_label`; unknown labels have no nodes."""
        wanted = list(self.nodes) if labels is None else [labels] if isinstance(labels, str) else list(labels)
        held = []
        for label in wanted:
            if label in self.nodes:
                table = self.nodes[label]
                keep = [c for c in table.columns if c in NODE or properties is None or c in properties]
                held.append(table.select(*keep, F.lit(label).alias("_label")))
            for other in self.nodes if labels is not None else ():  # nodes that carry the label beside their first one
                if other not in wanted and other not in self.single and "_extra_labels" in self.nodes[other].columns:
                    table = self.nodes[other]
                    keep = [c for c in table.columns if c in NODE or properties is None or c in properties]
                    held.append(table.where(F.array_contains("_extra_labels", label)).select(*keep, F.lit(other).alias("_label")))
        if not held:
            return self.spark.createDataFrame([], "_id long, _label string")
        return union_all(held)

    def rel_table(self, types: str | list[str] | None = None) -> DataFrame:
        """Relationships of one of the types (all if none are named), with `_type`; unknown types have none."""
        wanted = list(self.rels) if types is None else [types] if isinstance(types, str) else list(types)
        held = [self.rels[t].withColumn("_type", F.lit(t)) for t in wanted if t in self.rels]
        if not held:
            return self.spark.createDataFrame([], "_id long, _src long, _dst long, _type string")
        return union_all(held)

    def out_degree(self, types: str | list[str] | None = None) -> DataFrame:
        return self.rel_table(types).groupBy("_src").agg(F.count("*").alias("degree"))

    def adjacency(self, types: str | list[str] | None = None) -> DataFrame:
        """(source, target, relationship, type), laid out by source for repeated traversals; persisted by the caller."""
        table = self.rel_table(types).select(F.col("_src").alias("source"), F.col("_dst").alias("target"), F.col("_id").alias("relationship"), F.col("_type").alias("type"))
        return table.repartition("source").sortWithinPartitions("source", "target", "relationship")

    def node_by_id(self, node_id: int, labels: str | list[str] | None = None) -> DataFrame:
        """The node with an id; where ids are a key plus a constant, the key is compared, which the scan can do."""
        wanted = list(self.nodes) if labels is None else [labels] if isinstance(labels, str) else list(labels)
        plain = [k for k in wanted if k in self.id_keys]
        found = [self.nodes[k].where(F.col(self.id_keys[k][0]) == F.lit(node_id - self.id_keys[k][1])).withColumn("_label", F.lit(k)) for k in plain]
        others = [k for k in wanted if k not in self.id_keys]
        if others or not plain or any(k not in self.single for k in self.nodes):
            found.append(self.node_table(others or wanted).where(F.col("_id") == node_id))
        return union_all(found).dropDuplicates(["_id", "_label"]) if len(found) > 1 else found[0]

    def nodes_by_property(self, name: str, value, labels: str | list[str] | None = None) -> DataFrame:
        held = [t.where(F.col(name) == value).withColumn("_label", F.lit(k)) for k, t in self.nodes.items() if name in t.columns and (labels is None or k in ([labels] if isinstance(labels, str) else labels))]
        return union_all(held) if held else self.spark.createDataFrame([], "_id long, _label string")


def bind(table: DataFrame, var: str) -> DataFrame:
    """Columns of a node or relationship table as columns of variable var; a property that is named like a bound
    column of the table (label, id, …) gets a trailing underscore."""
    held = {c[1:] for c in table.columns if c.startswith("_")}
    name = lambda c: c[1:] if c.startswith("_") else f"{c}_" if c in held else c
    return table.select(*[F.col(f"`{c}`").alias(f"{var}__{name(c)}") for c in table.columns])
