"""XPath over XML text columns by Spark's own functions; ends-with, upper-case, lower-case and replace, which XPath 1 lacks, go around the path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nodes(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path))


def text(xml: Column, path: str) -> Column:
    return F.xpath_string(xml, F.lit(path))


def number(xml: Column, path: str) -> Column:
    return F.xpath_double(xml, F.lit(path))


def test(xml: Column, path: str) -> Column:
    return F.xpath_boolean(xml, F.lit(path))


def count(xml: Column, path: str) -> Column:
    return F.xpath_long(xml, F.lit(f"count({path})"))


def ends_with(xml: Column, path: str, end: str) -> Column:
    return F.endswith(text(xml, path), F.lit(end))


def upper_case(xml: Column, path: str) -> Column:
    return F.upper(text(xml, path))


def lower_case(xml: Column, path: str) -> Column:
    return F.lower(text(xml, path))


def replaced(xml: Column, path: str, old: str, new: str) -> Column:
    return F.replace(text(xml, path), F.lit(old), F.lit(new))


def bound(path: str, **variables: str) -> str:
    """A path with $name replaced by an XPath literal."""
    for name, value in variables.items():
        quote = "'" if "'" not in value else '"'
        path = path.replace(f"${name}", f"{quote}{value}{quote}")
    return path


def element(tag: str, /, *content: Column, **attributes: Column) -> Column:
    """XML text of an element; attribute values and content must be escaped already."""
    head = [F.lit(f"<{tag}")]
    for key, value in attributes.items():
        head += [F.lit(f' {key}="'), value, F.lit('"')]
    return F.concat(*head, F.lit(">"), *content, F.lit(f"</{tag}>"))
