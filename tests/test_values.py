"""Dynamic values, paths and changes on cases that the tables don't have."""

import json

import pytest
from pyspark.sql import functions as F

from loomtree.functions import paths, text, values
from loomtree.operators import change, descend, schema
from loomtree.sources import text_tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def doc(x):
    return F.parse_json(F.lit(json.dumps(x)))


@pytest.mark.parametrize("a,b,same,below", [(1, 1.0, True, False), (1, "1", False, False), (None, None, True, False), ("a", "b", False, True), (1, 2, False, True), ([1], [1], True, False), ({"a": 1, "b": 2}, {"b": 2, "a": 1}, True, False), (True, 1, False, False)])
def test_compare(spark, a, b, same, below):
    assert one(spark, F.array(values.equal(doc(a), doc(b)), values.less(doc(a), doc(b)))) == [same, below]


def test_missing_compares_false(spark):
    missing = paths.child(doc({}), "a")
    assert one(spark, F.array(values.equal(missing, doc(1)), values.unequal(missing, doc(1)))) == [False, False]


@pytest.mark.parametrize("args", [(None, None, 1), (1, 3, 1), (-2, None, 1), (None, None, -1), (3, 0, -2), (5, 9, 1), (0, 5, 0), (-9, 2, 1), (None, -1, 2)])
def test_slice_is_pythons(spark, args):
    items = [0, 1, 2, 3, 4]
    want = items[slice(*args)] if args[2] else []
    assert one(spark, paths.sliced(F.array(*map(F.lit, items)), *args)) == want


def test_pointer_escapes(spark):
    d = doc({"a/b": {"~": [10, {"": 5}]}})
    assert one(spark, paths.at_pointer(d, "/a~1b/~0/1/").cast("int")) == 5
    assert one(spark, paths.at_pointer(d, "/a~1b/~0/7").isNull())
    with pytest.raises(ValueError):
        paths.at_pointer(d, "a")


def test_null_member_is_there(spark):
    d = doc({"a": None})
    assert one(spark, F.array(paths.child(d, "a").isNotNull(), paths.child(d, "b").isNotNull())) == [True, False]


def test_descendants_in_order(spark):
    df = spark.range(1).select("id", doc({"b": [1, {"c": "x"}], "a": {}}).alias("d"))
    rows = descend.descendants(df, "d", ["id"]).orderBy("order").collect()
    assert [r["path"] for r in rows] == ["$", "$['a']", "$['b']", "$['b'][0]", "$['b'][1]", "$['b'][1]['c']"]
    deep = spark.range(1).select("id", F.parse_json(F.lit("[" * 60 + "1" + "]" * 60)).alias("d"))
    assert [r["depth"] for r in descend.descendants(deep, "d", ["id"]).orderBy("depth").collect()] == list(range(61))


@pytest.mark.parametrize("value,rules,want", [
    (5, {"type": "integer"}, []), (5.5, {"type": "integer"}, ["type"]), ("a", {"type": ["string", "null"]}, []),
    ({"a": 1}, {"additionalProperties": False, "properties": {"b": True}}, ["additionalProperties"]),
    ([1, 1], {"uniqueItems": True}, ["uniqueItems"]), ([1, "1"], {"uniqueItems": True}, []),
    (3, {"oneOf": [{"minimum": 1}, {"maximum": 5}]}, ["oneOf"]), (3, {"not": {"const": 3.0}}, ["not"]),
    ({"a": 1}, {"dependentRequired": {"a": ["b"]}}, ["dependentRequired"]), ("x", {"minimum": 3}, []), (1, False, ["false"]),
    ({"x_1": 1}, {"patternProperties": {"^x_": True}, "additionalProperties": False}, []), ({"y": 1}, {"patternProperties": {"^x_": True}, "additionalProperties": False}, ["additionalProperties"]),
    ({"x_1": "a"}, {"patternProperties": {"^x_": {"type": "integer"}}}, ["type"]), ({"a": 1, "b": "c"}, {"additionalProperties": {"type": "integer"}, "properties": {"a": True}}, ["type"]),
    ({"Ab": 1}, {"propertyNames": {"pattern": "^[a-z]+$"}}, ["propertyNames"]), ({"a": 1}, {"dependentSchemas": {"a": {"required": ["b"]}}}, ["required"]), ({}, {"dependentSchemas": {"a": {"required": ["b"]}}}, []),
    ([1, "a", 2], {"prefixItems": [{"type": "integer"}, {"type": "integer"}], "items": {"type": "string"}}, ["type", "type"]), ([1], {"prefixItems": [True, False]}, []), ([1, 2], {"prefixItems": [True, False]}, ["false"]),
    (9007199254740993, {"const": 9007199254740992}, ["const"]), (9007199254740993, {"maximum": 9007199254740992}, ["maximum"]), ([1, 1.0], {"uniqueItems": True}, ["uniqueItems"]),
    ("::1", {"format": "ipv6"}, []), ("1:2:3:4:5:6:7:8", {"format": "ipv6"}, []), ("1::2::3", {"format": "ipv6"}, ["format"]), ("::ffff:1.2.3.4", {"format": "ipv6"}, []), ("1:2:3:4:5:6:7:8:9", {"format": "ipv6"}, ["format"]), ("zzz", {"format": "ipv6"}, ["format"]), ("fe80::", {"format": "ipv6"}, []), ("1:2:3:4:5:6:7::8", {"format": "ipv6"}, ["format"]),
    ("a b", {"format": "uri-reference"}, ["format"]), ("../x?y#z", {"format": "uri-reference"}, []),
    ("2024-02-30", {"format": "date"}, []), ("x@y.z", {"format": "email"}, []), ("x", {"format": "ipv4"}, ["format"]), ("1.2.3.4", {"format": "ipv4"}, []),
])
def test_schema(spark, value, rules, want):
    assert [v["keyword"] for v in one(spark, schema.violations(doc(value), rules))] == want


def test_unknown_keywords_are_refused():
    with pytest.raises(ValueError, match="unevaluatedItems"):
        schema.violations(F.lit(None), {"properties": {"a": {"unevaluatedItems": False}}})


def test_inferred_schema_holds_for_its_documents(spark):
    rows = [{"a": 1, "b": [{"c": "2024-01-02"}, {"c": "2024-03-04", "d/e": None}]}, {"a": 2.5, "b": []}, {"a": "x", "b": [{"c": "2023-01-01", "d/e": [1, "q"]}]}]
    df = spark.createDataFrame([(json.dumps(x),) for x in rows], "t string").select(F.parse_json("t").alias("d"))
    found = schema.inferred_schema(schema.inferred_fields(df, "d"))
    assert found["required"] == ["a", "b"] and found["properties"]["b"]["items"]["required"] == ["c"]
    assert found["properties"]["b"]["items"]["properties"]["c"] == {"type": "string", "format": "date"}
    assert found["properties"]["a"] == {"anyOf": [{"type": "number"}, {"type": "string"}]}


@pytest.mark.parametrize("a,b", [(9007199254740993, 9007199254740992), (-9007199254740993, -9007199254740994)])
def test_integers_are_exact(spark, a, b):
    assert one(spark, F.array(values.equal(doc(a), doc(b)), values.less(doc(b), doc(a)), values.less(doc(a), doc(b)))) == [False, True, False]
    ordered = one(spark, F.to_json(F.to_variant_object(values.sorted_values(values.as_array(doc([a, b, 1.5]))))))
    assert json.loads(ordered) == sorted([a, b, 1.5])
    assert json.loads(one(spark, F.to_json(values.exact_sum(values.as_array(doc([a, b, "7", None])))))) == a + b


def test_least_and_greatest(spark):
    items = [3, "a", [1, 2], [1, 3], {"a": 1}, {"a": 0}, True]
    assert json.loads(one(spark, F.to_json(values.greatest_value(values.as_array(doc(items)))))) == {"a": 1}
    assert one(spark, F.to_json(values.least_value(values.as_array(doc([*items, None]))))) == "null"
    assert json.loads(one(spark, F.to_json(F.to_variant_object(values.sorted_values(values.as_array(doc([[2], [1, 3], [1, 2], [], {"b": 0}, {"a": 9}]))))))) == [[], [1, 2], [1, 3], [2], {"a": 9}, {"b": 0}]


def test_recursive_schema_is_refused():
    with pytest.raises(ValueError):
        schema.resolved({"properties": {"a": {"$ref": "#"}}}, {"properties": {"a": {"$ref": "#"}}})


def test_failed_test_leaves_no_row(spark):
    row = F.struct(F.lit(1).alias("a"))
    assert one(spark, change.apply_patch(row, [{"op": "add", "path": "/b", "value": 2}, {"op": "test", "path": "/a", "value": 9}])) is None


def test_typed_cells(spark):
    cells = ["", "~", "TRUE", "12", "1.5", "1e3", "12a", " 7 "]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(text_tables.typed(F.col("c"))["kind"]).collect()] == ["null", "null", "boolean", "integer", "float", "float", "string", "integer"]


def test_text(spark):
    assert one(spark, text.base64_url(F.lit(b"\xff\xfe\xfd\xfc"))) == "__79_A"
    assert one(spark, text.line_count(F.lit("a\nb\n"))) == 2
    assert one(spark, text.indent(F.lit("a\n\nb"), "> ")) == "> a\n\n> b"


def test_files_round_trip(spark, tmp_path):
    from loomtree.plans.convert import convert_files

    spark.createDataFrame([(1, "a,b"), (2, 'q"\n')], "id int, s string").write.json(f"{tmp_path}/json")
    for kind in ("parquet", "xml", "csv", "tsv", "orc"):
        df = convert_files(spark, f"{tmp_path}/json", "json", f"{tmp_path}/{kind}", kind, "id int, s string")
        assert df.where("id = 1").first()["s"] == "a,b"
