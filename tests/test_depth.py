"""Documents at the default depth and one level beyond it."""

import json

import pytest
from pyspark.sql import functions as F

from loomtree.operators.change import apply_document_patch, create_merge_patch, diff_documents, merge_all, merge_patch, set_at
from loomtree.operators.descend import flattened


def result(spark, column, *texts):
    row = spark.createDataFrame([texts], ", ".join(f"c{k} string" for k in range(len(texts))))
    v = [F.parse_json(f"c{k}") for k in range(len(texts))]
    return json.loads(row.select(F.to_json(column(*v)).alias("x")).first()["x"])


def test_merge_patch(spark):
    target = '{"a":{"b":{"c":1,"d":2}}}'
    assert result(spark, merge_patch, target, '{"a":{"b":{"c":null,"e":3}}}') == {"a": {"b": {"d": 2, "e": 3}}}
    deep = result(spark, merge_patch, '{"a":{"b":{"c":{"d":1,"e":2}}}}', '{"a":{"b":{"c":{"d":null}}}}')
    assert deep == {"a": {"b": {"c": {"e": 2}}}}
    ten = '{"a":' * 10 + '{"x":1,"y":2}' + "}" * 10
    assert result(spark, merge_patch, ten, ten.replace('"x":1,"y":2', '"x":null')) == json.loads(ten.replace('"x":1,', ""))
    assert result(spark, merge_patch, target, '{"a":{"b":{"new":{"z":null}}}}') == {"a": {"b": {"c": 1, "d": 2, "new": {}}}}
    with pytest.raises(Exception, match="more levels"):
        result(spark, merge_patch, ten, '{"a":' * 21 + "{}" + "}" * 21)
    assert result(spark, lambda t, p: merge_patch(t, p, keep_nulls=True), target, '{"a":{"b":{"c":null}}}') == {"a": {"b": {"c": None, "d": 2}}}


@pytest.mark.parametrize("a,b", [({"x": 1, "y": {"z": 1, "w": [1]}}, {"x": 1, "y": {"w": [2], "v": None}}), ({"x": 1}, {"x": 1}), ([1], {"a": 1}), ({"a": 1}, 5), ({"a": {"b": {"c": 1}}}, {"a": {"b": {"c": 2, "d": 3}}})])
def test_created_patches(spark, a, b):
    got = result(spark, create_merge_patch, json.dumps(a), json.dumps(b))

    def naive(x, y):
        if not isinstance(x, dict) or not isinstance(y, dict):
            return y
        return {k: None for k in x if k not in y} | {k: naive(x.get(k), v) if isinstance(x.get(k), dict) else v for k, v in y.items() if k not in x or x[k] != v}

    assert got == naive(a, b)


DOC = {"a": {"b": [1, 2, {"c": 3}]}, "d": "x", "": 0, "e~f/g": 1}


@pytest.mark.parametrize("operations,want", [
    ([{"op": "add", "path": "/a/b/1", "value": 9}], {**DOC, "a": {"b": [1, 9, 2, {"c": 3}]}}),
    ([{"op": "add", "path": "/a/b/-", "value": [0]}], {**DOC, "a": {"b": [1, 2, {"c": 3}, [0]]}}),
    ([{"op": "add", "path": "/a/b/3", "value": 4}], {**DOC, "a": {"b": [1, 2, {"c": 3}, 4]}}), ([{"op": "add", "path": "/a/b/5", "value": 4}], None),
    ([{"op": "add", "path": "/no/where", "value": 4}], None), ([{"op": "replace", "path": "/no", "value": 4}], None), ([{"op": "remove", "path": "/a/b/7"}], None), ([{"op": "remove", "path": ""}], None),
    ([{"op": "replace", "path": "/a/b/2/c", "value": None}], {**DOC, "a": {"b": [1, 2, {"c": None}]}}),
    ([{"op": "remove", "path": "/e~0f~1g"}, {"op": "remove", "path": "/"}], {"a": DOC["a"], "d": "x"}),
    ([{"op": "move", "from": "/a/b/0", "path": "/d"}], {**DOC, "a": {"b": [2, {"c": 3}]}, "d": 1}),
    ([{"op": "copy", "from": "/a/b/2", "path": "/a/b/0"}], {**DOC, "a": {"b": [{"c": 3}, 1, 2, {"c": 3}]}}),
    ([{"op": "test", "path": "/a/b/2", "value": {"c": 3.0}}, {"op": "add", "path": "/n", "value": None}], {**DOC, "n": None}),
    ([{"op": "add", "path": "/n", "value": 1}, {"op": "test", "path": "/d", "value": "y"}], None), ([{"op": "add", "path": "", "value": [1]}, {"op": "add", "path": "/-", "value": 2}], [1, 2]),
])
def test_patches_of_documents(spark, operations, want):
    row = spark.createDataFrame([(json.dumps(DOC),)], "t string").select(F.to_json(apply_document_patch(F.parse_json("t"), operations)).alias("x")).first()
    assert (None if row["x"] is None else json.loads(row["x"])) == want


def test_set_makes_what_is_missing(spark):
    def made(path):
        return result(spark, lambda v: set_at(v, path, F.lit(7).cast("variant")), '{"a":{"b":[1]},"s":"x"}')

    assert made(["a", "b", "2"]) == {"a": {"b": [1, None, 7]}, "s": "x"}
    assert made(["n", "1", "m"]) == {"a": {"b": [1]}, "s": "x", "n": [None, {"m": 7}]}
    assert made(["s", "t"]) == {"a": {"b": [1]}, "s": {"t": 7}}


def test_merge_all(spark):
    assert result(spark, merge_all, '{"a":1,"b":{"c":1}}', '{"b":{"d":2}}', '{"a":null}') == {"b": {"c": 1, "d": 2}}
    assert result(spark, merge_all, '{"a":1}', "[1]", '{"z":1}') == {"z": 1}


def test_diff_of_documents(spark):
    before = {"a": 1, "b": {"c": [1, 2, 3], "d": {"e": 1}}, "gone": {"x": {"y": 1}}, "t": 5}
    after = {"a": 2, "b": {"c": [1, 9], "d": {"e": 1, "f": {"g": [1]}}}, "t": "5", "new": [{"z": 1}]}
    rows = [spark.createDataFrame([(1, json.dumps(x)), (2, json.dumps(before))], "id int, t string").select("id", F.parse_json("t").alias("d")) for x in (before, after)]
    found = diff_documents(*rows, ["id"], "d").collect()
    assert {(r["pointer"], r["op"], r["label"]) for r in found if r["id"] == 1} == {
        ("/a", "replace", "modified"), ("/b/c/1", "replace", "modified"), ("/b/c/2", "remove", "removed"), ("/b/c", None, "size changed"), ("/b/d/f", "add", "added"),
        ("/gone", "remove", "removed"), ("/t", "replace", "type changed"), ("/new", "add", "added"),
    }
    assert not [r for r in found if r["id"] == 2]
    # the operations, removals from the back, turn the one into the other
    ops = sorted((r for r in found if r["op"]), key=lambda r: (r["op"] != "remove", r["pointer"]), reverse=False)
    patch = [{"op": r["op"], "path": r["pointer"], **({} if r["op"] == "remove" else {"value": json.loads(str(r["new"]) if not isinstance(r["new"], str) else r["new"]) if not hasattr(r["new"], "toJson") else json.loads(r["new"].toJson())})} for r in ops]
    row = rows[0].where("id = 1").select(F.to_json(apply_document_patch(F.col("d"), patch)).alias("x")).first()
    assert json.loads(row["x"]) == after


def test_flattened(spark):
    assert result(spark, flattened, "[1,[2,[3,[4,[5]]]]]") == [1, 2, 3, 4, 5]
    assert result(spark, flattened, "[" * 40 + "7,8" + "]" * 40) == [7, 8]
    assert result(spark, flattened, "[]") == []
