"""Navigation inside documents, as Columns: children, elements, slices, wildcards, filters, pointers, edits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtree.functions.values import as_array, as_map, kind


def child(v: Column, name: str) -> Column:
    """The member of an object; NULL if it is missing (a null member is a variant null)."""
    return F.try_variant_get(v, f"$[{_quoted(name)}]", "variant")


def _quoted(name: str) -> str:
    return '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'


def element(items: Column, n: int) -> Column:
    """Element n of an array column, from the end if n is negative; NULL out of range."""
    return F.get(items, F.lit(n) if n >= 0 else F.size(items) + n)


def members(v: Column) -> Column:
    """All elements of an array or all member values of an object (by sorted key), as array<variant>."""
    entries = F.array_sort(F.map_keys(as_map(v)))
    return F.coalesce(as_array(v), F.transform(entries, lambda k: F.element_at(as_map(v), k)))


def names(v: Column) -> Column:
    """The sorted keys of an object, or the indexes of an array as text."""
    indexes = F.transform(as_array(v), lambda x, i: i.cast("string"))
    return F.coalesce(F.array_sort(F.map_keys(as_map(v))), indexes)


def sliced(items: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """items[start:stop:step] with Python's rules; step 0 gives no elements."""
    none = F.slice(items, 1, 0)
    if step == 0:
        return none
    n = F.size(items)

    def clamped(x: int | None, default: Column, low: int, high: Column) -> Column:
        if x is None:
            return default
        at = F.lit(x) if x >= 0 else n + x
        return F.greatest(F.lit(low), F.least(at, high))

    if step > 0:
        first, last = clamped(start, F.lit(0), 0, n), clamped(stop, n, 0, n) - 1
        empty = first > last
    else:
        first, last = clamped(start, n - 1, -1, n - 1), clamped(stop, F.lit(-1), -1, n - 1) + 1
        empty = first < last
    return F.when(empty, none).otherwise(F.transform(F.sequence(first, F.when(empty, first).otherwise(last), F.lit(step)), lambda i: F.get(items, i)))


def where(items: Column, test: Callable[[Column], Column]) -> Column:
    """The elements for which the test is true; NULL counts as false."""
    return F.filter(items, lambda x: F.coalesce(test(x), F.lit(False)))


def union(*parts: Column) -> Column:
    """All selected values in the order of the selectors; duplicates stay, missing ones go."""
    return F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<variant>")) for p in parts]))


def steps(pointer: str) -> list[str]:
    """The steps of an RFC 6901 pointer."""
    if pointer and not pointer.startswith("/"):
        raise ValueError(f"a pointer starts with /: {pointer!r}")
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]


def follow(v: Column, path: Sequence[str]) -> Column:
    """Walks steps; a step of digits is an index in an array and a name in an object."""
    for step in path:
        named = child(v, step)
        v = F.when(kind(v) == "array", element(as_array(v), int(step))).otherwise(named) if step.isdigit() else named
    return v


def at_pointer(v: Column, pointer: str) -> Column:
    return follow(v, steps(pointer))


def at_dots(v: Column, path: str) -> Column:
    """a.0.b; empty segments are ignored."""
    return follow(v, [p for p in path.split(".") if p])


def required(v: Column, pointer: str, kind_: str | None = None) -> Column:
    """The value at a pointer; raises if it is missing, or not of the kind."""
    found = at_pointer(v, pointer)
    wrong = found.isNull() if kind_ is None else found.isNull() | (kind(found) != kind_)
    return F.when(wrong, F.raise_error(F.lit(f"no {kind_ or 'value'} at {pointer}")).cast("variant")).otherwise(found)


def matched(v: Column) -> Column:
    """How many nodes a path has matched: the elements of one array, 1 for another value, 0 for none."""
    return F.when(v.isNull(), 0).otherwise(F.coalesce(F.size(as_array(v)), F.lit(1)))


def set_elements(items: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """An array with every element that meets the test replaced."""
    return F.transform(items, lambda x: F.when(F.coalesce(test(x), F.lit(False)), change(x)).otherwise(x))


def escaped(key: Column) -> Column:
    """A key with its quotes and backslashes escaped."""
    return F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def normal_step(key: Column, position: Column) -> Column:
    """['key'] or [0], with quotes and backslashes of keys escaped."""
    return F.when(key.isNotNull(), F.concat(F.lit("['"), escaped(key), F.lit("']"))).otherwise(F.concat(F.lit("["), position.cast("string"), F.lit("]")))


def pointer_step(key: Column, position: Column) -> Column:
    escaped = F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.concat(F.lit("/"), F.coalesce(escaped, position.cast("string")))
