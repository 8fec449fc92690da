"""Configuration-expression functions as Columns, for typed columns: strings, arrays, maps, numbers, encodings."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trim(s: Column, cut: str) -> Column:
    return F.btrim(s, F.lit(cut))


def trimprefix(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)


def trimsuffix(s: Column, suffix: str) -> Column:
    return F.when(s.endswith(suffix), F.substr(s, F.lit(1), F.char_length(s) - len(suffix))).otherwise(s) if suffix else s


def trimspace(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def split(sep: str, s: Column) -> Column:
    return F.split(s, "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def join(sep: str, *lists: Column) -> Column:
    return F.array_join(F.flatten(F.array(*lists)), sep)


def substr(s: Column, offset: int, length: int) -> Column:
    """A negative offset counts from the end; a negative length takes the rest."""
    start = F.lit(offset) if offset >= 0 else F.greatest(F.char_length(s) + offset, F.lit(0))
    return F.substr(s, start + 1, F.lit(length) if length >= 0 else F.char_length(s))


def coalesce(*values: Column) -> Column:
    """The first that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def compact(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def flatten(items: Column, kind: T.DataType) -> Column:
    """Flattens as many levels as the array's type nests."""
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        items, kind = F.flatten(items), kind.elementType
    return items


def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def values(m: Column) -> Column:
    """By sorted key."""
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.element_at(m, k))


def lookup(m: Column, key: str, default: Column) -> Column:
    """The default only for a missing key, not for a null value."""
    return F.when(F.map_contains_key(m, key), F.try_element_at(m, F.lit(key))).otherwise(default)


def merge(*maps: Column) -> Column:
    """Later maps win."""
    out = maps[0]
    for m in maps[1:]:
        out = _over(out, m)
    return out


def _over(below: Column, above: Column) -> Column:
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)


def slice_(items: Column, start: int, end: int) -> Column:
    return F.slice(items, start + 1, max(end - start, 0))


def sort_text(items: Column) -> Column:
    return F.array_sort(F.transform(items, lambda x: x.cast("string")))


def zipmap(k: Column, v: Column) -> Column:
    """The shorter side decides."""
    n = F.least(F.size(k), F.size(v))
    return F.map_from_arrays(F.slice(k, F.lit(1), n), F.slice(v, F.lit(1), n))


def element(items: Column, n: int) -> Column:
    """The index wraps around."""
    return F.when(F.size(items) > 0, F.get(items, F.pmod(F.lit(n), F.size(items))))


def base64encode(s: Column) -> Column:
    return F.replace(F.base64(F.encode(s, "UTF-8")), F.lit("\r\n"), F.lit(""))


def base64decode(s: Column) -> Column:
    return F.decode(F.unbase64(s), "UTF-8")


def for_list(items: Column, body: Callable[[Column], Column], test: Callable[[Column], Column] | None = None) -> Column:
    """[for x in items : body if test]"""
    return F.transform(F.filter(items, test) if test else items, body)


def for_map(items: Column, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """{for x in items : key => value}"""
    return F.map_from_entries(F.transform(items, lambda x: F.struct(key(x), value(x))))


def splat(items: Column, field: str) -> Column:
    return F.transform(items, lambda x: x[field])


def integer_quotient(a: Column, b: Column) -> Column:
    """Of integers, exact; truncates toward zero; NULL for a zero divisor."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def power(base: Column, exponent: int) -> Column:
    """An integer for an integer base and an exponent of 0 or more, else a double; NULL where an integer is beyond its range."""
    wide = F.pow(base.cast("double"), F.lit(exponent))
    if exponent < 0:
        return wide
    out = F.lit(1).cast("bigint")
    for _ in range(exponent):
        out = F.try_multiply(out, base.cast("bigint"))
    return out


def formatted(pattern: str, *values: Column) -> Column:
    """%s and %v as text, %d as an integer, %f as a double without padding, %t as a boolean, %q quoted, %% a percent sign."""
    parts, left, at = [], list(values), 0
    while at < len(pattern):
        stop = pattern.find("%", at)
        if stop < 0 or stop == len(pattern) - 1:
            parts.append(F.lit(pattern[at:]))
            break
        parts.append(F.lit(pattern[at:stop]))
        verb, at = pattern[stop + 1], stop + 2
        if verb == "%":
            parts.append(F.lit("%"))
            continue
        if verb not in "svdftq" or not left:
            raise ValueError(f"no value or verb for %{verb}")
        v = left.pop(0)
        cast = {"d": "bigint", "f": "double", "t": "boolean"}.get(verb)
        text = v.cast(cast).cast("string") if cast else v.cast("string")
        parts.append(F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) if verb == "q" else text)
    return F.concat(*[F.coalesce(p, F.lit("null")) for p in parts]) if parts else F.lit("")


def template(text: str, **values: Column) -> Column:
    """A text with ${name} filled in; $${ stands for ${; an unknown name raises."""
    parts, at = [], 0
    for m in re.finditer(r"\$\$\{|\$\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}", text):
        parts += [F.lit(text[at : m.start()]), F.lit("${") if m[1] is None else F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def template_for(items: Column, body: Callable[[Column], Column], between: str = "") -> Column:
    """%{ for x in items }body%{ endfor }"""
    return F.array_join(F.transform(items, body), between)


def template_if(test: Column, then: Column, otherwise: Column | None = None) -> Column:
    """%{ if test }then%{ else }otherwise%{ endif }"""
    return F.when(F.coalesce(test, F.lit(False)), then).otherwise(F.lit("") if otherwise is None else otherwise)
