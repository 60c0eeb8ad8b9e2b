"""Operators on rows of bindings: ordering with nulls last, skipping, unwinding, unions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_by(df: DataFrame, *keys) -> DataFrame:
    """Keys are names, Columns or (key, "desc"); nulls are the greatest value."""
    made = []
    for key in keys:
        key, way = key if isinstance(key, tuple) else (key, "asc")
        column = F.col(key) if isinstance(key, str) else key
        made.append(column.desc_nulls_first() if way == "desc" else column.asc_nulls_last())
    return df.orderBy(*made)


def _count(n, what: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"{what} must be a whole number of at least 0")
    return n


def skip(df: DataFrame, n: int) -> DataFrame:
    return df.offset(_count(n, "skip"))


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(_count(n, "limit"))


def unwind(df: DataFrame, value: Column, name: str) -> DataFrame:
    """A row for each element of a list; none for an empty list or null."""
    return df.select("*", F.explode(value).alias(name))


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return union_all(a, b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    if set(a.columns) != set(b.columns):
        raise ValueError("both sides of a union must return the same columns")
    return a.unionByName(b)


def aggregate(df: DataFrame, keys: list, **values: Column) -> DataFrame:
    """Groups by keys (names or aliased Columns); without keys there is one row, also for no input."""
    columns = [v.alias(k) for k, v in values.items()]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


count_rows = lambda: F.count(F.lit(1))
count = F.count
count_distinct = F.count_distinct


def collect(value: Column | str) -> Column:
    """All values as a list, nulls too; in no order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.collect_list(F.struct(value.alias("x"))), lambda s: s["x"])


def collect_distinct(value: Column | str) -> Column:
    return F.collect_set(value)


def collect_ordered(value: Column, *keys: Column) -> Column:
    """All values as a list in the order of keys."""
    names = [f"k{i}" for i in range(len(keys))]
    return F.transform(F.sort_array(F.collect_list(F.struct(*[k.alias(n) for k, n in zip(keys, names, strict=True)], value.alias("x")))), lambda s: s["x"])


def total(value: Column | str) -> Column:
    """Sum that is 0 for no values."""
    return F.coalesce(F.sum(value), F.lit(0))


def total_distinct(value: Column | str) -> Column:
    return F.coalesce(F.sum_distinct(F.col(value) if isinstance(value, str) else value), F.lit(0))


average, least, greatest = F.avg, F.min, F.max
deviation, deviation_population = F.stddev_samp, F.stddev_pop


def percentile_continuous(value: Column | str, p: float) -> Column:
    return F.percentile(F.col(value) if isinstance(value, str) else value, p)


def percentile_discrete(value: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) within group (order by {value})")
