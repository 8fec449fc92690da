"""Dynamic values: a VARIANT column holds one tree; these Columns give its kind, comparisons, order and keys.

Comparisons are two-valued: a missing side, or sides of kinds that don't compare, give false. Integers compare as integers, all
other numbers as doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def facts(v: Column) -> Column:
    """struct of kind, integer, number and string, the last three NULL where they don't apply."""
    def told(k: Column) -> Column:
        whole = F.when((k == "number") & (F.schema_of_variant(v) == "BIGINT"), F.try_variant_get(v, "$", "bigint"))
        number = F.when(k == "number", F.try_variant_get(v, "$", "double"))
        return F.struct(k.alias("kind"), whole.alias("integer"), number.alias("number"), F.when(k == "string", F.try_variant_get(v, "$", "string")).alias("string"))

    return let(kind(v), told)


def as_array(v: Column) -> Column:
    """The elements of an array; NULL for other kinds."""
    return F.try_variant_get(v, "$", "array<variant>")


def as_map(v: Column) -> Column:
    """The members of an object; NULL for other kinds."""
    return F.try_variant_get(v, "$", "map<string,variant>")


#: Kinds of scalars by the names of their types; all others are texts: strings, dates and times.
_KINDS = {"BIGINT": "number", "DOUBLE": "number", "FLOAT": "number", "DECIMAL": "number", "BOOLEAN": "boolean", "BINARY": "bytes", "VOID": "null"}


def scalar_kind(v: Column) -> Column:
    """kind() of a value that is known to be no container."""
    names = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.substring_index(F.schema_of_variant(v), "(", 1)), F.when(v.isNotNull(), "string"))


def kind(v: Column) -> Column:
    """null, boolean, number, string, bytes, array or object; SQL NULL for a missing value. Containers are not walked."""
    return F.coalesce(F.when(as_array(v).isNotNull(), "array"), F.when(as_map(v).isNotNull(), "object"), scalar_kind(v))


def number(v: Column) -> Column:
    """The value of a number; NULL for every other kind, strings of digits included."""
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double"))


def integer(v: Column) -> Column:
    """The value of an integer, exact; NULL for every other number and kind."""
    return F.when((kind(v) == "number") & (F.schema_of_variant(v) == "BIGINT"), F.try_variant_get(v, "$", "bigint"))


def string(v: Column) -> Column:
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def equal(a: Column, b: Column) -> Column:
    """Numbers compare across integer and float; all else by kind and canonical text."""
    exact = integer(a).isNotNull() & integer(b).isNotNull()
    numbers = F.when(exact, integer(a) == integer(b)).otherwise(number(a) == number(b))
    return _sure((kind(a) == kind(b)) & F.when(kind(a) == "number", numbers).otherwise(F.to_json(a) == F.to_json(b)))


def unequal(a: Column, b: Column) -> Column:
    """True for values of different kinds, false if a side is missing."""
    return _sure(a.isNotNull() & b.isNotNull()) & ~equal(a, b)


def less(a: Column, b: Column) -> Column:
    """Number with number or string with string; anything else is false."""
    exact = integer(a).isNotNull() & integer(b).isNotNull()
    return _sure(F.when(exact, integer(a) < integer(b)).otherwise(number(a) < number(b))) | _sure(string(a) < string(b))


def at_most(a: Column, b: Column) -> Column:
    """less() or equal, of numbers or of strings."""
    return less(a, b) | (equal(a, b) & kind(a).isin("number", "string"))


def _scalar_key(v: Column) -> Column:
    """Sorts scalars, and containers of a kind as equals: (rank, number, integer, string). Equal numbers of both sorts are equal keys."""
    ranks = F.create_map(*[F.lit(x) for pair in (("null", 0), ("boolean", 1), ("number", 3), ("string", 4), ("bytes", 5), ("array", 6), ("object", 7)) for x in pair])
    truth = F.when(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")) == "true", 1).otherwise(0)
    rank = F.coalesce(F.try_element_at(ranks, kind(v)), F.lit(0))
    exact = F.coalesce(integer(v), number(v).try_cast("bigint"))
    return F.struct(F.when(rank == 1, rank + truth).otherwise(rank).alias("rank"), number(v).alias("number"), exact.alias("integer"), string(v).alias("string"))


def order_key(v: Column) -> Column:
    """Sorts null < false < true < number < string < bytes < array < object; numbers and strings by value.

    Arrays go by their elements and objects by their sorted names and values, one level down by value, below that by their text.
    """
    inside = F.transform(as_array(v), lambda x: F.struct(F.lit("").alias("name"), _scalar_key(x).alias("key"), F.to_json(x).alias("text")))
    named = F.transform(
        F.array_sort(F.map_keys(as_map(v))),
        lambda k: let(F.element_at(as_map(v), k), lambda x: F.struct(k.alias("name"), _scalar_key(x).alias("key"), F.when(kind(x).isin("array", "object"), F.to_json(x)).alias("text"))),
    )
    inside = F.transform(inside, lambda x: F.struct(x["name"], x["key"], F.when(x["key"]["rank"] > 5, x["text"]).alias("text")))
    return F.struct(_scalar_key(v).alias("scalar"), F.coalesce(inside, named).alias("inside"))


def group_key(v: Column) -> Column:
    """The text under which values are grouped: missing and null are 'null', so 1 and "1" meet."""
    return F.coalesce(F.when(kind(v) == "string", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)), F.lit("null"))


def length(v: Column) -> Column:
    """Characters, bytes, elements or members; 0 for null; NULL for booleans and numbers."""
    k = kind(v)
    return (
        F.when(k == "null", 0)
        .when(k == "string", F.char_length(string(v)))
        .when(k == "array", F.size(as_array(v)))
        .when(k == "object", F.size(as_map(v)))
        .when(k == "bytes", F.octet_length(F.try_variant_get(v, "$", "binary")))
    )


def sum_numbers(items: Column) -> Column:
    """The sum of the numbers of array<variant> as a double; other elements are ignored; 0 without any."""
    return F.aggregate(F.transform(items, lambda x: F.coalesce(number(x), F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)


def exact_sum(items: Column) -> Column:
    """The sum as a VARIANT: an integer, at the ends of its range if it is beyond, if all numbers are integers, else a double."""
    wide = "decimal(38,0)"
    whole = F.aggregate(F.transform(items, lambda x: F.coalesce(integer(x).cast(wide), F.lit(0).cast(wide))), F.lit(0).cast(wide), lambda a, b: (a + b).cast(wide))
    ends = [F.lit(x).cast(wide) for x in (-(1 << 63), (1 << 63) - 1)]
    mixed = F.exists(items, lambda x: number(x).isNotNull() & integer(x).isNull())
    return F.when(mixed, sum_numbers(items).cast("variant")).otherwise(F.greatest(F.least(whole, ends[1]), ends[0]).cast("bigint").cast("variant"))


def mean_numbers(items: Column) -> Column:
    return let(F.filter(F.transform(items, number), lambda x: x.isNotNull()), lambda found: F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, b: a + b) / F.size(found)))


def least_value(items: Column) -> Column:
    """The first of the least elements in the total order: a null element wins; NULL of an empty array."""
    return F.get(sorted_values(items), F.lit(0))


def greatest_value(items: Column) -> Column:
    """The last of the greatest elements in the total order; NULL of an empty array."""
    return F.get(sorted_values(items), F.size(items) - 1)


def sorted_values(items: Column) -> Column:
    """array<variant> in the total order; equal keys keep their places."""
    keyed = F.transform(items, lambda x, i: F.struct(order_key(x).alias("key"), i.alias("place"), x.alias("value")))
    ordered = F.array_sort(F.transform(keyed, lambda k: F.struct(k["key"], k["place"])))
    return F.transform(ordered, lambda k: F.get(items, k["place"]))
