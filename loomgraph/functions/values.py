"""Column builders with the value semantics of openCypher where Spark's own functions differ.

Built-in expressions only. Kinds that Spark cannot see from a Column (is it an integer or a float, a list or a string)
are said by the function that is called.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_LEAST = -(2**63)


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# ---------------------------------------------------------------- arithmetic


def divide_int(a, b) -> Column:
    """Truncates toward zero; null for division by zero and for the one quotient out of range."""
    a, b = col(a).cast("bigint"), col(b).cast("bigint")
    out_of_range = (a == F.lit(INT_LEAST)) & (b == -1)
    divisor = F.when((b != 0) & ~out_of_range, b)
    return _div(a, divisor)


def _div(a: Column, b: Column) -> Column:
    """The whole quotient: b divides a - a % b, and decimals keep the quotient exact."""
    return F.call_function("try_divide", F.call_function("try_subtract", a, a % b).cast("decimal(38,0)"), b.cast("decimal(20,0)")).cast("bigint")


def divide(a, b) -> Column:
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def modulo_int(a, b) -> Column:
    b = col(b).cast("bigint")
    return col(a).cast("bigint") % F.nullif(b, F.lit(0).cast("bigint"))


def modulo(a, b) -> Column:
    """NaN for a remainder by zero, as IEEE 754 has it; the sign is the dividend's."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, F.lit(float("nan"))).otherwise(a % F.nullif(b, F.lit(0.0)))


def power(a, b) -> Column:
    return F.pow(col(a).cast("double"), col(b).cast("double"))


# ---------------------------------------------------------------- comparison and logic


def equal_float(a, b) -> Column:
    """NaN equals nothing."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return (a == b) & ~F.isnan(a)


def equal_incomparable(a, b) -> Column:
    """Values of kinds that are never equal: false, or null if one is null."""
    return F.when(col(a).isNull() | col(b).isNull(), None).otherwise(F.lit(False))


def equal_list(a, b) -> Column:
    """Element by element with null for unknown."""
    a, b = col(a), col(b)
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), F.lit(False)).otherwise(F.forall(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def xor(a, b) -> Column:
    return col(a) != col(b)


def in_list(x, values) -> Column:
    """Null for a null in the list that could be it; false for an empty list."""
    values = col(values)
    return F.when(F.size(values) == 0, F.lit(False)).otherwise(F.array_contains(values, col(x)))


def matches(s, pattern: str) -> Column:
    """The pattern must match the whole string."""
    return col(s).rlike("\\A(?:" + pattern + ")\\z")


# ---------------------------------------------------------------- lists


def at(values, i) -> Column:
    """Negative positions count from the end; null outside."""
    values, i = col(values), col(i)
    return F.get(values, F.when(i < 0, F.size(values) + i).otherwise(i).cast("int"))


def _bounds(size: Column, start, end) -> tuple[Column, Column]:
    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(size, F.when(x < 0, size + x).otherwise(x)))

    return clamp(F.lit(0) if start is None else col(start)).cast("int"), clamp(size if end is None else col(end)).cast("int")


def slice_list(values, start=None, end=None) -> Column:
    values = col(values)
    a, b = _bounds(F.size(values), start, end)
    return F.slice(values, a + 1, F.greatest(b - a, F.lit(0)))


def slice_string(s, start=None, end=None) -> Column:
    s = col(s)
    a, b = _bounds(F.char_length(s), start, end)
    return F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))


def head(values) -> Column:
    return F.get(col(values), 0)


def last(values) -> Column:
    return F.try_element_at(col(values), F.lit(-1))


def tail(values) -> Column:
    values = col(values)
    return F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))


def range_list(a, b, step=1) -> Column:
    """Both ends included; empty if the step leads away from the end. A step of 0 raises."""
    a, b, step = col(a).cast("bigint"), col(b).cast("bigint"), col(step).cast("bigint")
    away = ((step > 0) & (a > b)) | ((step < 0) & (a < b))
    checked = F.when(step == 0, F.raise_error(F.lit("range: the step is 0")).cast("bigint")).otherwise(step)
    end = F.when(away, a).otherwise(b)
    made = F.sequence(a, end, F.when(away & (a == end), F.lit(1).cast("bigint")).otherwise(checked))
    return F.when(away, F.array().cast("array<bigint>")).otherwise(made)


def comprehension(values, where=None, value=None) -> Column:
    out = col(values)
    if where is not None:
        out = F.filter(out, where)
    return out if value is None else F.transform(out, value)


def reduce_list(values, start, step) -> Column:
    return F.aggregate(col(values), col(start), step)


def all_of(values, where) -> Column:
    return F.forall(col(values), where)


def any_of(values, where) -> Column:
    return F.exists(col(values), where)


def none_of(values, where) -> Column:
    return ~F.exists(col(values), where)


def single_of(values, where) -> Column:
    """True if exactly one element fits; null if nulls leave that open."""
    values = col(values)
    yes = F.size(F.filter(values, where))
    open_ = F.size(F.filter(values, lambda x: where(x).isNull()))
    return F.when(values.isNull(), None).when(yes > 1, F.lit(False)).when(open_ > 0, None).otherwise(yes == 1)


# ---------------------------------------------------------------- strings


def trim(s) -> Column:
    return F.regexp_replace(col(s), r"(?U)^\s+|\s+$", "")


def trim_left(s) -> Column:
    return F.regexp_replace(col(s), r"(?U)^\s+", "")


def trim_right(s) -> Column:
    return F.regexp_replace(col(s), r"(?U)\s+$", "")


def substring(s, start, length=None) -> Column:
    """Counts from 0; a negative start is 0; clamps to the end."""
    s, start = col(s), F.greatest(col(start), F.lit(0))
    n = F.char_length(s) if length is None else col(length)
    return F.substring(s, (start + 1).cast("int"), n.cast("int"))


def split(s, by: str) -> Column:
    """The delimiter is taken literally; an empty one also gives the empty ends."""
    s = col(s)
    if by == "":
        return F.concat(F.array(F.lit("")), F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, "")), F.array(F.lit("")))
    return F.split(s, "\\Q" + by.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def replace(s, old, new) -> Column:
    return F.replace(col(s), col(old), col(new))


def left(s, n) -> Column:
    return F.left(col(s), col(n).cast("int"))


def right(s, n) -> Column:
    return F.right(col(s), col(n).cast("int"))


# ---------------------------------------------------------------- numbers


def ceil_float(x) -> Column:
    return F.ceil(col(x)).cast("double")


def floor_float(x) -> Column:
    return F.floor(col(x)).cast("double")


def round_float(x) -> Column:
    """Halves away from zero."""
    return F.round(col(x).cast("double"), 0)


def sign(x) -> Column:
    return F.signum(col(x)).cast("bigint")


def _log(x, f) -> Column:
    x = col(x).cast("double")
    return F.when(x < 0, F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).otherwise(f(x))


def log(x) -> Column:
    return _log(x, F.ln)


def log10(x) -> Column:
    return _log(x, F.log10)


def power(x, y) -> Column:
    return F.pow(col(x).cast("double"), col(y).cast("double"))


def pi() -> Column:
    return F.pi()


def e() -> Column:
    return F.e()


def rand(seed: int | None = None) -> Column:
    """Uniform in [0, 1); with a seed the same for the same rows and partitions."""
    return F.rand() if seed is None else F.rand(seed)


def concat_lists(a, b) -> Column:
    """list + list, and list + element; null if one is null."""
    return F.concat(col(a), col(b))


# ---------------------------------------------------------------- conversion


def to_integer(s) -> Column:
    """Of a string: whole numbers, else the whole part of a decimal one; null for anything else."""
    s = trim(col(s).cast("string"))
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))


def to_float(s) -> Column:
    return trim(col(s).cast("string")).try_cast("double")


def to_boolean(s) -> Column:
    s = F.lower(trim(col(s).cast("string")))
    return F.when(s == "true", F.lit(True)).when(s == "false", F.lit(False))


def to_string(x) -> Column:
    return col(x).cast("string")


# ---------------------------------------------------------------- nodes, relationships, maps, points


def properties(var: str, names: list[str]) -> Column:
    """The properties of a bound variable as a struct, each with its own type; one that is missing is null."""
    return F.struct(*[F.col(f"{var}__{n}").alias(n) for n in names])


def labels(var: str, columns: list[str]) -> Column:
    """All labels of a bound node: the first one, then those beside it, if its columns have any."""
    first = F.array(F.col(f"{var}__label"))
    return F.concat(first, F.coalesce(F.col(f"{var}__extra_labels"), F.array().cast("array<string>"))) if f"{var}__extra_labels" in columns else first


def keys(var: str, names: list[str]) -> Column:
    """The sorted names of non-null properties of a bound variable."""
    return F.array_compact(F.array(*[F.when(F.col(f"{var}__{n}").isNotNull(), F.lit(n)) for n in sorted(names)]))


def node_value(var: str, names: list[str]) -> Column:
    return F.struct(F.col(f"{var}__id").alias("id"), F.array(f"{var}__label").alias("labels"), F.struct(*[F.col(f"{var}__{n}").alias(n) for n in names]).alias("properties"))


def point(x, y, srid=None) -> Column:
    """Missing coordinates are 0."""
    zero = F.lit(0.0)
    return F.struct(F.coalesce(col(x).cast("double"), zero).alias("x"), F.coalesce(col(y).cast("double"), zero).alias("y"), (F.lit(None) if srid is None else col(srid)).cast("int").alias("srid"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def timestamp() -> Column:
    """Milliseconds since the epoch."""
    return F.unix_millis(F.current_timestamp())
