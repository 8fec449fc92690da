"""Schemas as data: validation of document columns by a JSON-Schema dictionary, and inference from a collection.

A schema becomes Columns over a VARIANT: an array of violations (pointer, keyword), built on the driver once from the
dictionary; rows are checked in parallel with no Python. A keyword that would be passed over raises an error. Inference is one aggregation over the nodes of
all documents, at any depth.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtree.functions.paths import child
from loomtree.functions.values import as_array, as_map, equal, facts, kind, let, string
from loomtree.operators.descend import nodes

_H16 = "[0-9A-Fa-f]{1,4}"
_IPV4 = r"((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Eight groups, the last two of which may be an IPv4 address; one :: stands for one or more groups of zeros.
_IPV6 = "|".join([f"({_H16}:){{7}}{_H16}", f"({_H16}:){{6}}{_IPV4}", *[f"({_H16}(:{_H16}){{0,{k}}})?::(({_H16}:){{0,{5 - k}}}({_H16}|{_IPV4}))?" for k in range(6)], f"({_H16}(:{_H16}){{0,6}})?::"])

#: Patterns of the string formats; an unknown format holds for every string.
FORMATS = {
    "email": r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ipv4": rf"^{_IPV4}$",
    "ipv6": f"^({_IPV6})$",
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "time": r"^([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?(Z|[+-]\d\d:\d\d)?$",
    "date-time": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]\d\d:\d\d)$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
    "uri-reference": r"^[^\s<>\"{}|\\^`]*$",
    "hostname": r"^(?=.{1,253}$)[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$",
    "duration": r"^P(?=.)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$",
    "json-pointer": r"^(/([^~/]|~[01])*)*$",
}
#: Keywords that say nothing about whether a document is valid.
ANNOTATIONS = {"$schema", "$id", "$ref", "$comment", "$anchor", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "contentEncoding", "contentMediaType"}
RULES = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "minItems", "maxItems",
    "uniqueItems", "prefixItems", "items", "contains", "minContains", "maxContains", "minProperties", "maxProperties", "required", "properties", "patternProperties",
    "additionalProperties", "propertyNames", "dependentRequired", "dependentSchemas", "allOf", "anyOf", "oneOf", "not", "if", "then", "else",
}
_NONE = "array<struct<pointer:string,keyword:string>>"


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def resolved(schema: object, root: object, depth: int = 0) -> object:
    """Local references put in place; a schema that refers to itself is refused."""
    if depth > 32:
        raise ValueError("references nest too deeply")
    if isinstance(schema, Mapping):
        if "$ref" in schema:
            at = root
            for step in schema["$ref"].lstrip("#").split("/")[1:]:
                at = at[step.replace("~1", "/").replace("~0", "~")]
            return resolved(at, root, depth + 1)
        return {k: x if k in ("enum", "const", "default", "examples") else resolved(x, root, depth + (k not in ("definitions", "$defs"))) for k, x in schema.items() if k not in ("definitions", "$defs")}
    return [resolved(x, root, depth) for x in schema] if isinstance(schema, list) else schema


def _none() -> Column:
    return F.array().cast(_NONE)


def _step(name: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


#: What rules ask of a value, each with the keywords that ask it: only this is computed.
_FACTS = {
    "scalar": ({"type", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"}, facts),
    "string": ({"minLength", "maxLength", "pattern", "format"}, string),
    "items": ({"minItems", "maxItems", "uniqueItems", "prefixItems", "items", "contains"}, as_array),
    "members": ({"minProperties", "maxProperties", "required", "properties", "patternProperties", "additionalProperties", "propertyNames", "dependentRequired", "dependentSchemas"}, as_map),
}


def _check(v: Column, schema: object, pointer: Column) -> Column:
    """The violations of one value, which is there. What the rules ask of the value is computed once."""
    if isinstance(schema, bool):
        return _none() if schema else F.array(F.struct(pointer.alias("pointer"), F.lit("false").alias("keyword")))
    if unknown := set(schema) - RULES - ANNOTATIONS:
        raise ValueError(f"no such schema keywords: {', '.join(sorted(unknown))}")
    if not set(schema) & RULES:
        return _none()
    asked = [make(v).alias(name) for name, (keywords, make) in _FACTS.items() if set(schema) & keywords]
    return let(F.struct(*asked), lambda f: _found(v, f, schema, pointer)) if asked else _found(v, F.lit(None), schema, pointer)


def _found(v: Column, f: Column, schema: Mapping, pointer: Column) -> Column:
    found: list[Column] = []
    n, whole, s, items, members = f["scalar"]["number"], f["scalar"]["integer"], f["string"], f["items"], f["members"]

    def rule(keyword: str, broken: Column) -> None:
        found.append(F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(pointer.alias("pointer"), F.lit(keyword).alias("keyword")))).otherwise(_none()))

    def inside(each: Column) -> None:
        """Violations found further down, an array of arrays; NULL for values of another kind."""
        found.append(F.coalesce(F.flatten(each), _none()))

    def literal(x: object) -> Column:
        return F.parse_json(F.lit(json.dumps(x)))

    def compared(x: float, exact: Column, rough: Column) -> Column:
        return F.when(whole.isNotNull(), exact).otherwise(rough) if isinstance(x, int) else rough

    if "type" in schema:
        allowed = F.lit(False)
        for k in [schema["type"]] if isinstance(schema["type"], str) else schema["type"]:
            allowed = allowed | (whole.isNotNull() if k == "integer" else f["scalar"]["kind"] == k)
        rule("type", _no(allowed))
    if "enum" in schema:
        allowed = F.lit(False)
        for x in schema["enum"]:
            allowed = allowed | equal(v, literal(x))
        rule("enum", ~allowed)
    if "const" in schema:
        rule("const", ~equal(v, literal(schema["const"])))
    bounds = {
        "minimum": lambda x: compared(x, whole < x, n < x),
        "maximum": lambda x: compared(x, whole > x, n > x),
        "exclusiveMinimum": lambda x: compared(x, whole <= x, n <= x),
        "exclusiveMaximum": lambda x: compared(x, whole >= x, n >= x),
        "multipleOf": lambda x: compared(x, whole % x != 0, F.abs(n / x - F.round(n / x)) > 1e-9),
        "minLength": lambda x: F.char_length(s) < x,
        "maxLength": lambda x: F.char_length(s) > x,
        "pattern": lambda x: ~s.rlike(x),
        "format": lambda x: ~s.rlike(FORMATS[x]) if x in FORMATS else F.lit(False),
        "minItems": lambda x: F.size(items) < x,
        "maxItems": lambda x: F.size(items) > x,
        "minProperties": lambda x: F.size(members) < x,
        "maxProperties": lambda x: F.size(members) > x,
    }
    for keyword, broken in bounds.items():
        if keyword in schema:
            there = items.isNotNull() if "Items" in keyword else members.isNotNull() if "Properties" in keyword else F.lit(True)
            rule(keyword, there & broken(schema[keyword]))

    def has(name: str) -> Column:
        return F.map_contains_key(members, name)

    for name in schema.get("required", []):
        rule("required", ~has(name))
    for name, others in schema.get("dependentRequired", {}).items():
        for other in others:
            rule("dependentRequired", has(name) & ~has(other))
    for name, part in schema.get("dependentSchemas", {}).items():
        found.append(F.when(F.coalesce(has(name), F.lit(False)), _check(v, part, pointer)).otherwise(_none()))
    known, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))

    def member(name: str) -> Column:
        at, part = F.concat(pointer, _step(F.lit(name))), schema["properties"][name]
        return let(child(v, name), lambda x: F.when(members.isNotNull() & x.isNotNull(), _check(x, part, at)).otherwise(_none()))

    found += [member(name) for name in known]

    def of_members(test: Callable[[Column], Column], part: object) -> Column:
        """The violations of the members whose name passes, by one schema."""
        kept = F.map_filter(members, lambda k, _: test(k))
        return F.transform(F.map_entries(kept), lambda e: _check(e["value"], part, F.concat(pointer, _step(e["key"]))))

    def of_pattern(pattern: str) -> Column:
        return of_members(lambda k: k.rlike(pattern), schema["patternProperties"][pattern])

    for pattern in patterns:
        inside(of_pattern(pattern))

    def is_extra(k: Column) -> Column:
        out = ~k.isin(known) if known else F.lit(True)
        for pattern in patterns:
            out = out & ~k.rlike(pattern)
        return out

    extra = schema.get("additionalProperties", True)
    if extra is False:
        rule("additionalProperties", F.exists(F.map_keys(members), is_extra))
    elif isinstance(extra, Mapping):
        inside(of_members(is_extra, extra))
    if "propertyNames" in schema:
        rule("propertyNames", F.exists(F.map_keys(members), lambda k: F.size(_check(k.cast("variant"), schema["propertyNames"], F.lit(""))) > 0))
    if schema.get("uniqueItems"):
        # 1 and 1.0 are equal
        def text(x: Column, g: Column) -> Column:
            whole = F.coalesce(g["integer"], F.when(g["number"] % 1 == 0, g["number"].try_cast("bigint")))
            return F.concat(g["kind"], F.when(g["kind"] == "number", F.coalesce(whole.cast("string"), g["number"].cast("string"))).otherwise(F.to_json(x)))

        texts = F.transform(items, lambda x: let(facts(x), lambda g: text(x, g)))
        rule("uniqueItems", let(texts, lambda t: F.size(F.array_distinct(t)) < F.size(t)))
    prefix = schema.get("prefixItems", [])
    for i, part in enumerate(prefix):
        found.append(F.when(F.size(items) > i, _check(F.get(items, F.lit(i)), part, F.concat(pointer, F.lit(f"/{i}")))).otherwise(_none()))
    if "items" in schema:
        rest = F.slice(items, len(prefix) + 1, 1 << 30) if prefix else items
        inside(F.transform(rest, lambda x, i: _check(x, schema["items"], F.concat(pointer, F.lit("/"), (i + len(prefix)).cast("string")))))
    if "contains" in schema:
        hits = F.size(F.filter(items, lambda x: F.size(_check(x, schema["contains"], pointer)) == 0))
        rule("contains", items.isNotNull() & ((hits < schema.get("minContains", 1)) | (hits > schema.get("maxContains", 1 << 30))))
    if "allOf" in schema:
        found += [_check(v, part, pointer) for part in schema["allOf"]]
    holds = {k: [(F.size(_check(v, part, pointer)) == 0).cast("int") for part in schema[k]] for k in ("anyOf", "oneOf") if k in schema}
    if "anyOf" in holds:
        rule("anyOf", sum(holds["anyOf"][1:], holds["anyOf"][0]) == 0)
    if "oneOf" in holds:
        rule("oneOf", sum(holds["oneOf"][1:], holds["oneOf"][0]) != 1)
    if "not" in schema:
        rule("not", F.size(_check(v, schema["not"], pointer)) == 0)
    if "if" in schema:
        met = F.size(_check(v, schema["if"], pointer)) == 0
        found.append(F.when(met, _check(v, schema.get("then", True), pointer)).otherwise(_check(v, schema.get("else", True), pointer)))
    return F.concat(*found) if len(found) > 1 else found[0] if found else _none()


def violations(document: Column, schema: object) -> Column:
    """array<struct<pointer, keyword>> of everything in the document that the schema forbids; empty if it is valid."""
    return F.coalesce(_check(document, resolved(schema, schema), F.lit("")), _none())


def is_valid(document: Column, schema: object) -> Column:
    return F.size(violations(document, schema)) == 0


#: Formats that inference looks for, the first that all strings of a place have.
INFERRED = ("uuid", "ipv4", "date-time", "date", "uri", "email")


def inferred_fields(df: DataFrame, document: str) -> DataFrame:
    """Of a collection of documents, a row for each place (pointer with * for any element): kinds, format, n_present, required.

    kinds are joined by |, integers beside other numbers are numbers; format is that of all strings there; n_present counts non-null values; a
    member is required if every object at the place above has it non-null. One explode and one aggregation with partial sums, then one of its few rows: the
    result has a row a place, however many documents there are. A place of kinds a|b is anyOf in a schema.
    """
    found = df.where(F.col(document).isNotNull()).select(F.explode(nodes(F.col(document), "place")).alias("n"))
    found = found.select(F.col("n.place").alias("place"), F.col("n.key").isNotNull().alias("named"), kind(F.col("n.value")).alias("kind"), F.col("n.value").alias("value"))
    is_whole = (F.col("kind") == "number") & (F.schema_of_variant("value") == "BIGINT")
    text = F.when(F.col("kind") == "string", F.try_variant_get("value", "$", "string"))
    rows = found.select("place", "named", F.when(is_whole, "integer").otherwise(F.col("kind")).alias("kind"), text.alias("text"))
    patterns = {**FORMATS, "uri": r"^https?://\S+$"}
    # plain counts first, by kind too: sets are made of the few rows of a place
    counts = rows.groupBy("place", "named", "kind").agg(F.count("*").alias("n"), *[F.count_if(F.col("text").rlike(patterns[f])).alias(f) for f in INFERRED])

    def nodes_of(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    k = F.col("kind")
    places = counts.groupBy("place").agg(
        F.array_sort(F.collect_set(F.when(k != "null", k))).alias("kinds"),
        nodes_of(k != "null").alias("n_present"),
        nodes_of(k == "string").alias("n_texts"),
        nodes_of(k == "object").alias("n_objects"),
        F.bool_or("named").alias("named"),
        *[F.sum(f).alias(f) for f in INFERRED],
    )
    # each place goes to its own name and to the one above, so that documents are not read again for a join
    above, none = F.regexp_replace("place", r"/[^/]*$", ""), F.lit(None).cast("bigint")
    told = F.array(F.struct(above.alias("at"), none.alias("n"), F.lit(True).alias("below")), F.struct(F.col("place").alias("at"), F.col("n_objects").alias("n"), F.lit(False).alias("below")))
    places = places.withColumn("told", F.explode(told)).withColumn("n_above", F.max("told.n").over(Window.partitionBy("told.at"))).where("told.below")
    kinds = F.when(F.array_contains("kinds", "number"), F.array_remove("kinds", "integer")).otherwise(F.col("kinds"))
    form = F.coalesce(*[F.when((F.col("n_texts") > 0) & (F.col(f) == F.col("n_texts")), f) for f in INFERRED])
    return places.select("place", F.array_join(kinds, "|").alias("kinds"), form.alias("format"), "n_present", (F.col("named") & (F.col("n_present") == F.col("n_above"))).alias("required"))


def inferred_schema(places: DataFrame) -> dict:
    """The JSON Schema of the rows of inferred_fields(): as many rows as a document has kinds of places."""
    rows = {r["place"]: r for r in places.collect()}

    def schema(place: str) -> dict:
        row = rows[place]
        below = [p for p in rows if p.startswith(place + "/") and "/" not in p[len(place) + 1 :]]
        parts = []
        for k in row["kinds"].split("|") if row["kinds"] else ["null"]:
            part: dict = {"type": k}
            if k == "string" and row["format"]:
                part["format"] = row["format"]
            if k == "object":
                part["properties"] = {p[len(place) + 1 :]: schema(p) for p in sorted(below) if not p.endswith("/*")}
                part["required"] = [name for name in part["properties"] if rows[f"{place}/{name}"]["required"]]
            if k == "array" and f"{place}/*" in rows:
                part["items"] = schema(f"{place}/*")
            parts.append(part)
        return parts[0] if len(parts) == 1 else {"anyOf": parts}

    return schema("")
