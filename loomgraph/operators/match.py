"""Pattern matching: scans, expansion along relationships, optional and negated patterns, paths of variable length.

Each operator takes and gives a DataFrame of bindings, one row for each match, so a pattern is a chain of joins that
Catalyst plans: it prunes properties, pushes filters to the scans and picks the join by size. A start or end variable
that is bound already is compared, not bound again, which closes cycles.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, bind
from loomgraph.plans.scratch import materialize

HOP_LIMIT = 15  # for paths without an upper bound, unless the caller sets another

#: Where a join is spread: rows of a side in a block, and about so many pairs of rows in a task.
BLOCK, PAIRS = 1 << 10, 1 << 23


def _equal(var: str, properties: dict | None) -> list[Column]:
    return [F.col(f"{var}__{k}") == F.lit(v) for k, v in (properties or {}).items()]


def _filtered(df: DataFrame, conditions: list[Column]) -> DataFrame:
    return reduce(lambda d, c: d.where(c), conditions, df)


def scan(graph: PropertyGraph, var: str, labels: str | list[str] | None = None, all_of: list[str] | None = None, properties: dict | None = None) -> DataFrame:
    """Nodes with one of the labels (any if none), every label of all_of, and equal properties."""
    df = bind(graph.node_table(labels), var)
    for label in all_of or []:
        extra = F.array_contains(f"{var}__extra_labels", label) if f"{var}__extra_labels" in df.columns else F.lit(False)
        df = df.where((F.col(f"{var}__label") == label) | F.coalesce(extra, F.lit(False)))
    return _filtered(df, _equal(var, properties))


def scan_rels(graph: PropertyGraph, var: str, types: str | list[str] | None = None, properties: dict | None = None) -> DataFrame:
    return _filtered(bind(graph.rel_table(types), var), _equal(var, properties))


def _oriented(graph: PropertyGraph, var: str, types, direction: str, properties: dict | None) -> DataFrame:
    """Relationships as var with the ends in walking order, __from and __to; a loop is walked once."""
    table = scan_rels(graph, var, types, properties)
    out = table.withColumn("__from", F.col(f"{var}__src")).withColumn("__to", F.col(f"{var}__dst"))
    back = table.withColumn("__from", F.col(f"{var}__dst")).withColumn("__to", F.col(f"{var}__src"))
    if direction == "out":
        return out
    if direction == "in":
        return back
    if direction == "both":
        return out.unionByName(back.where("__from <> __to"))
    raise ValueError("direction is out, in or both")


def _spread(left: DataFrame, right: DataFrame, key: str, left_ids: list[str], right_ids: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of the join key = __from, laid out for it by the number of pairs it makes, and what to add to its condition.

    Keys with many pairs are cut into blocks of rows, by a hash of the ids; each left block goes to each right one, so a
    pair still meets once. A few hot keys then fill as many tasks as they need, however few bytes their rows have.
    """
    count = lambda df, k, n: df.groupBy(F.col(k).alias("__key")).agg(F.count("*").alias(n))
    sizes = materialize(count(left, key, "__n").join(count(right, "__from", "__m"), "__key"), "sizes")
    pairs = sizes.agg(F.sum(F.col("__n").cast("double") * F.col("__m"))).first()[0] or 0
    if pairs <= PAIRS:
        return left, right, F.lit(True)
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    hot = sizes.where(F.col("__n").cast("double") * F.col("__m") > BLOCK * BLOCK).select("__key", blocks("__n").alias("__a"), blocks("__m").alias("__b"))
    own = lambda ids, n: F.pmod(F.xxhash64(*ids), F.coalesce(n, F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    left = left.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__i", own(left_ids, F.col("__a"))).withColumn("__j", each("__b"))
    right = right.join(hot, F.col("__from") == F.col("__key"), "left").withColumn("__k", each("__a")).withColumn("__l", own(right_ids, F.col("__b")))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / PAIRS))
    place = lambda df, *by: df.drop("__key", "__a", "__b").repartition(tasks, *by)
    return place(left, key, "__i", "__j"), place(right, "__from", "__k", "__l").hint("merge"), (F.col("__i") == F.col("__k")) & (F.col("__j") == F.col("__l"))


def expand(
    df: DataFrame, graph: PropertyGraph, start: str, types: str | list[str] | None, end: str, *, rel: str | None = None, direction: str = "out", labels: str | list[str] | None = None,
    rel_properties: dict | None = None, end_properties: dict | None = None, where: Column | None = None, optional: bool = False, distinct_from: tuple[str, ...] = (), hubs: bool = False,
) -> DataFrame:
    """Follows relationships from start to end.

    labels, end_properties: of the end; without them, and if end is not read, only `end__id` is bound and no node table
    is read. where: a condition over all bound variables. optional: rows without a match stay, with nulls.
    distinct_from: relationship variables of the same pattern that must be other relationships than this one.
    hubs: many rows meet many relationships at few nodes, so the rows that come out are counted first and spread over tasks.
    """
    if hubs and optional:
        raise ValueError("an optional expansion can't be spread")
    r = rel or f"__r_{end}_{len(df.columns)}"
    hops = _oriented(graph, r, types, direction, rel_properties)
    bound = f"{end}__id" in df.columns
    conditions = [F.col(f"{r}__id") != F.col(f"{other}__id") for other in distinct_from]
    if where is not None:
        conditions.append(where)
    on = F.col(f"{start}__id") == F.col("__from")
    if bound:
        on = on & (F.col(f"{end}__id") == F.col("__to"))
        right = hops
    else:
        named = [types] if isinstance(types, str) else types or []
        known = {graph.targets.get(t) for t in named}
        if labels is None and not end_properties and end.startswith("_"):
            right = hops.withColumn(f"{end}__id", F.col("__to"))
        else:
            if labels is None and direction == "out" and len(known) == 1 and None not in known:
                labels = next(iter(known))
            ends = _filtered(bind(graph.node_table(labels), end), _equal(end, end_properties))
            right = hops.join(ends, F.col("__to") == F.col(f"{end}__id"))
    shown = right.columns
    if hubs:
        df, right, same = _spread(df, right, f"{start}__id", [c for c in df.columns if c.endswith("__id")], [f"{r}__id", "__to"])
        on = on & same
    if optional:
        joined = df.join(right, reduce(lambda a, b: a & b, conditions, on), "left")
    else:
        joined = _filtered(df.join(right, on), conditions)
    return joined.drop("__from", "__to", "__i", "__j", "__k", "__l", *([] if rel else [c for c in shown if c.startswith(f"{r}__")]))


def where_exists(df: DataFrame, graph: PropertyGraph, start: str, types, *, direction: str = "out", labels=None, end_properties: dict | None = None, end: str | None = None, negated: bool = False) -> DataFrame:
    """Rows whose start has (negated: has not) such a relationship; end: a bound variable it must lead to."""
    hops = _oriented(graph, "__e", types, direction, None).select("__from", "__to")
    if labels is not None or end_properties:
        ends = _filtered(bind(graph.node_table(labels), "__n"), _equal("__n", end_properties)).select("__n__id")
        hops = hops.join(ends, F.col("__to") == F.col("__n__id"), "left_semi")
    on = F.col(f"{start}__id") == F.col("__from")
    if end:
        on = on & (F.col(f"{end}__id") == F.col("__to"))
    return df.join(hops, on, "left_anti" if negated else "left_semi")


def pattern_list(df: DataFrame, graph: PropertyGraph, start: str, types, value: Column, name: str, *, end: str = "__p", direction: str = "out", labels=None) -> DataFrame:
    """Adds the list of value over all matches from start; empty where there is none."""
    keys = df.select(f"{start}__id").distinct()
    found = expand(keys, graph, start, types, end, direction=direction, labels=labels or list(graph.nodes)).groupBy(f"{start}__id").agg(F.collect_list(value).alias(name))
    return df.join(found, f"{start}__id", "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))


def cartesian(a: DataFrame, b: DataFrame, on: Column | None = None) -> DataFrame:
    """Two patterns of one match without a shared variable; with a condition, Spark plans the join by it."""
    return a.crossJoin(b) if on is None else a.join(b, on)


def correlate(df: DataFrame, keys: list[str], subquery, optional: bool = False) -> DataFrame:
    """Runs subquery (DataFrame of distinct keys -> DataFrame that keeps them) once for all rows and joins its rows back."""
    inner = subquery(df.select(*keys).distinct())
    return df.join(inner, keys, "left" if optional else "inner")


def _hops(graph: PropertyGraph, types, direction: str) -> DataFrame:
    """Relationships for walks of many steps. Joins give them the hint merge: Spark may take them for small by the size
    of their files, and each step would then send them all through the driver."""
    return _oriented(graph, "__h", types, direction, None).select("__from", "__to", F.col("__h__id").alias("__rel"))


def expand_paths(
    df: DataFrame, graph: PropertyGraph, start: str, types, end: str, *, least: int = 1, most: int | None = None, direction: str = "out", labels=None, path: str | None = None, repeated_rels: bool = False, checkpoint_every: int = 4,
) -> DataFrame:
    """Paths of least to most relationships, none twice in a path (a trail); nodes may repeat.

    Binds end, `<path>__rels` (ids), `<path>__nodes` (ids) and `<path>__length`. Without most, walking stops when no path
    can be made longer, or raises beyond HOP_LIMIT. Levels are written out every checkpoint_every hops, so that a level
    reads its predecessor and does not compute it again. repeated_rels: for graphs known to have no cycles, where the
    lists of ids need not be carried.
    """
    p = path or "__path"
    hops = _hops(graph, types, direction).hint("merge")
    frontier = df.withColumn("__at", F.col(f"{start}__id")).withColumn(f"{p}__length", F.lit(0))
    carried = path is not None or not repeated_rels
    if carried:
        frontier = frontier.withColumn(f"{p}__rels", F.array().cast("array<bigint>")).withColumn(f"{p}__nodes", F.array(f"{start}__id"))
    levels = [frontier] if least == 0 else []
    length = 0
    while most is None or length < most:
        length += 1
        if most is None and length > HOP_LIMIT:
            raise ValueError(f"paths of more than {HOP_LIMIT} relationships; give an upper bound")
        step = frontier.join(hops, F.col("__at") == F.col("__from"))
        if carried:
            step = step.where(~F.array_contains(f"{p}__rels", F.col("__rel")))
            step = step.withColumn(f"{p}__rels", F.array_append(f"{p}__rels", F.col("__rel"))).withColumn(f"{p}__nodes", F.array_append(f"{p}__nodes", F.col("__to")))
        frontier = step.withColumn("__at", F.col("__to")).withColumn(f"{p}__length", F.lit(length)).drop("__from", "__to", "__rel")
        if most is None or length % checkpoint_every == 0:
            frontier = materialize(frontier, "paths")
        if most is None and frontier.isEmpty():
            break
        if length >= least:
            levels.append(frontier)
    if not levels:
        levels = [frontier.limit(0)]
    found = reduce(lambda a, b: a.unionByName(b), levels)
    drop = [] if path else [c for c in found.columns if c.startswith(f"{p}__")]
    if f"{end}__id" in df.columns:
        return found.where(F.col("__at") == F.col(f"{end}__id")).drop("__at", *drop)
    ends = bind(graph.node_table(labels), end)
    return found.join(ends, F.col("__at") == F.col(f"{end}__id")).drop("__at", *drop)


def shortest_paths(df: DataFrame, graph: PropertyGraph, start: str, types, end: str, *, most: int | None = None, direction: str = "out") -> DataFrame:
    """Length of a shortest path from each distinct start to every node it reaches: `end__id`, `<end>__distance`.

    Breadth first: each round joins the last round's new (start, node) pairs to relationships and keeps unseen ones,
    until there are none. `most` bounds the length, as `*..most` does in a pattern.
    """
    hops = _hops(graph, types, direction).select("__from", "__to").distinct().hint("merge")
    seen = df.select(f"{start}__id").distinct().select(f"{start}__id", F.col(f"{start}__id").alias(f"{end}__id"), F.lit(0).alias(f"{end}__distance"))
    frontier = seen
    for length in count(1) if most is None else range(1, most + 1):
        reached = frontier.join(hops, F.col(f"{end}__id") == F.col("__from")).select(f"{start}__id", F.col("__to").alias(f"{end}__id")).distinct()
        frontier = materialize(reached.join(seen, [f"{start}__id", f"{end}__id"], "left_anti").withColumn(f"{end}__distance", F.lit(length)), "reached")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
