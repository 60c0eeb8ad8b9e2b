"""Writes: each gives a new PropertyGraph and counts are read from the tables; nothing is changed in place.

Ids of new nodes and relationships follow the greatest id of their table. They are dense over the rows created, which are
written out once, so a later read or a lost executor does not number them anew.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import PropertyGraph, union_all
from loomgraph.plans.scratch import materialize


@dataclass(frozen=True)
class Written:
    graph: PropertyGraph
    rows: DataFrame  # the bindings, with what was created bound
    changed: int


def _number(df: DataFrame, first: int, name: str = "_id") -> DataFrame:
    """Dense ids from first: rows are counted by partition, and each partition is numbered from the rows before it."""
    placed = materialize(df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "created")
    counts = sorted(placed.groupBy("__part").agg(F.count("*"), F.min("__at")).collect())  # one row per partition
    offsets, before = [], first
    for part, n, least in counts:
        offsets.append((part, before - least))
        before += n
    bases = df.sparkSession.createDataFrame(offsets, "__part int, __base long")  # one row per partition, so it is broadcast
    return materialize(placed.join(F.broadcast(bases), "__part").withColumn(name, F.col("__at") + F.col("__base")).drop("__part", "__at", "__base"), "numbered")


def _next_id(table: DataFrame | None) -> int:
    if table is None:
        return 1
    greatest = table.agg(F.max("_id")).first()[0]
    return 1 if greatest is None else greatest + 1


def _add(held: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if held is None else union_all([held, new])


def create_nodes(graph: PropertyGraph, rows: DataFrame, label: str, var: str, extra_labels: list[str] = (), **values) -> Written:
    """A node for each row; values are Columns over the row or plain values."""
    named = rows.select("*", *[(v if isinstance(v, Column) else F.lit(v)).alias(f"{var}__{k}") for k, v in values.items()])
    made = _number(named, _next_id(graph.nodes.get(label)), f"{var}__id")
    table = made.select(F.col(f"{var}__id").alias("_id"), *[F.col(f"{var}__{k}").alias(k) for k in values])
    if extra_labels:
        table = table.withColumn("_extra_labels", F.array(*[F.lit(x) for x in extra_labels]))
    return Written(graph.with_nodes(label, _add(graph.nodes.get(label), table)), made.withColumn(f"{var}__label", F.lit(label)), made.count())


def create_rels(graph: PropertyGraph, rows: DataFrame, rel_type: str, src: str, dst: str, var: str, **values) -> Written:
    """A relationship for each row, between the bound variables src and dst."""
    named = rows.select("*", *[(v if isinstance(v, Column) else F.lit(v)).alias(f"{var}__{k}") for k, v in values.items()])
    made = _number(named, _next_id(graph.rels.get(rel_type)), f"{var}__id")
    table = made.select(F.col(f"{var}__id").alias("_id"), F.col(f"{src}__id").alias("_src"), F.col(f"{dst}__id").alias("_dst"), *[F.col(f"{var}__{k}").alias(k) for k in values])
    return Written(graph.with_rels(rel_type, _add(graph.rels.get(rel_type), table)), made.withColumn(f"{var}__type", F.lit(rel_type)), made.count())


def merge_nodes(graph: PropertyGraph, rows: DataFrame, label: str, var: str, on_create: dict | None = None, on_match: dict | None = None, **match) -> Written:
    """Binds the node that equals all of match, or creates it; one row's creation is the next row's match.

    If several nodes fit, the one with the least id is bound. on_create, on_match: name -> value or Column over the row.
    """
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    keyed = rows.select("*", *[column(v).alias(f"{var}__{k}") for k, v in match.items()])
    names = list(match)
    held = graph.nodes.get(label)
    if held is not None and all(k in held.columns for k in names):
        known = held.groupBy(*names).agg(F.min("_id").alias("_id"))
    else:
        known = keyed.sparkSession.createDataFrame([], T.StructType([*[T.StructField(k, keyed.schema[f"{var}__{k}"].dataType) for k in names], T.StructField("_id", T.LongType())]))
    wanted = keyed.select(*[F.col(f"{var}__{k}").alias(k) for k in names]).distinct()
    new = _number(wanted.join(known, names, "left_anti"), _next_id(held))
    added = new.select("_id", *names, *[column(v).alias(k) for k, v in (on_create or {}).items()])
    after = graph.with_nodes(label, _add(held, added))
    if on_match:
        hit = known.join(wanted, names, "left_semi").select("_id", *[column(v).alias(f"__{k}") for k, v in on_match.items()])
        after = set_properties(after, label, hit, {k: F.col(f"__{k}") for k in on_match})
    ids = known.select("_id", *names).unionByName(new.select("_id", *names)).select(F.col("_id").alias(f"{var}__id"), *[F.col(k).alias(f"{var}__{k}") for k in names])
    return Written(after, keyed.join(ids, [f"{var}__{k}" for k in names]).withColumn(f"{var}__label", F.lit(label)), new.count())


def merge_rels(graph: PropertyGraph, rows: DataFrame, rel_type: str, src: str, dst: str, var: str, **match) -> Written:
    """Binds the relationship between src and dst that equals all of match, or creates one for each distinct pair."""
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    names = ["_src", "_dst", *match]
    keyed = rows.select("*", F.col(f"{src}__id").alias("_src"), F.col(f"{dst}__id").alias("_dst"), *[column(v).alias(k) for k, v in match.items()])
    held = graph.rels.get(rel_type)
    if held is not None and all(k in held.columns for k in names):
        known = held.groupBy(*names).agg(F.min("_id").alias("_id"))
    else:
        known = keyed.select(*names, F.lit(None).cast("long").alias("_id")).limit(0)
    new = _number(keyed.select(*names).distinct().join(known, names, "left_anti"), _next_id(held))
    ids = known.select(*names, "_id").unionByName(new.select(*names, "_id"))
    bound = keyed.join(ids, names).drop("_src", "_dst").withColumnsRenamed({"_id": f"{var}__id", **{k: f"{var}__{k}" for k in match}})
    return Written(graph.with_rels(rel_type, _add(held, new.select("_id", *names))), bound, new.count())


def set_properties(graph: PropertyGraph, label: str, updates: DataFrame, values: dict[str, Column], rels: bool = False) -> PropertyGraph:
    """SET n.k = v for the rows of updates (`_id` and what values read); null removes. Of several rows for one id, the
    greatest value of each property is taken, so the outcome does not depend on order."""
    table = (graph.rels if rels else graph.nodes)[label]
    given = updates.select("_id", *[v.alias(f"__v_{k}") for k, v in values.items()]).groupBy("_id").agg(*[F.max(f"__v_{k}").alias(f"__v_{k}") for k in values]).withColumn("__hit", F.lit(True))
    joined = table.join(given, "_id", "left")
    out = [c for c in table.columns if c not in values]
    made = [(F.when(F.col("__hit"), F.col(f"__v_{k}")).otherwise(F.col(k)) if k in table.columns else F.col(f"__v_{k}")).alias(k) for k in values]
    after = joined.select(*out, *made)
    return graph.with_rels(label, after) if rels else graph.with_nodes(label, after)


def replace_properties(graph: PropertyGraph, label: str, ids: DataFrame, values: dict) -> PropertyGraph:
    """SET n = {…}: properties that values does not name become null."""
    others = {k: F.lit(None).cast(graph.nodes[label].schema[k].dataType) for k in graph.nodes[label].columns if not k.startswith("_") and k not in values}
    return set_properties(graph, label, ids, {**others, **{k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}})


def remove_property(graph: PropertyGraph, label: str, ids: DataFrame, name: str) -> PropertyGraph:
    return set_properties(graph, label, ids, {name: F.lit(None).cast(graph.nodes[label].schema[name].dataType)})


def set_label(graph: PropertyGraph, label: str, ids: DataFrame, new: str, remove: bool = False) -> PropertyGraph:
    """Adds (or removes) a label beside the first one of the nodes of a table."""
    table = graph.nodes[label]
    if "_extra_labels" not in table.columns:
        table = table.withColumn("_extra_labels", F.array().cast("array<string>"))
    now = F.coalesce("_extra_labels", F.array().cast("array<string>"))
    changed = F.array_remove(now, new) if remove else F.array_union(now, F.array(F.lit(new)))
    hit = ids.select("_id").distinct().withColumn("__hit", F.lit(True))
    return graph.with_nodes(label, table.join(hit, "_id", "left").withColumn("_extra_labels", F.when(F.col("__hit"), changed).otherwise(now)).drop("__hit"))


def delete_rels(graph: PropertyGraph, rel_type: str, ids: DataFrame) -> PropertyGraph:
    return graph.with_rels(rel_type, graph.rels[rel_type].join(ids.select("_id"), "_id", "left_anti"))


def delete_nodes(graph: PropertyGraph, label: str, ids: DataFrame, detach: bool = False) -> PropertyGraph:
    """Without detach, nodes that still have relationships raise."""
    gone = ids.select("_id").distinct()
    rels = dict(graph.rels)
    for rel_type, table in graph.rels.items():
        if detach:
            for end in ("_src", "_dst"):
                table = table.join(gone.select(F.col("_id").alias(end)), end, "left_anti").select(*graph.rels[rel_type].columns)
            rels[rel_type] = table
        elif any(not table.join(gone.select(F.col("_id").alias(end)), end, "left_semi").isEmpty() for end in ("_src", "_dst")):
            raise ValueError(f"nodes to delete still have relationships of type {rel_type}")
    kept = graph.with_nodes(label, graph.nodes[label].join(gone, "_id", "left_anti"))
    return replace(kept, rels=rels) if detach else kept


def for_each(graph: PropertyGraph, rows: DataFrame, values: Column, name: str, write) -> PropertyGraph:
    """Runs write(graph, rows) -> Written over a row for each list element; the caller's rows stay as they are."""
    return write(graph, rows.select("*", F.explode(values).alias(name))).graph
