"""What plans of document operators leave out, and limits that a plain session has."""

import json

from pyspark.sql import functions as F

from loomtree.operators import change, descend, schema
from loomtree.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", F.parse_json("t").alias("d"))


def test_f1_a_diff_joins_documents_not_nodes(spark):
    """One join, in which each side has one row a document."""
    found = change.diff_documents(documents(spark, '{"a":[1,2]}'), documents(spark, '{"a":[1]}'), ["id"], "d")
    assert plan(found).count("Join ") == 1
    assert {(r["pointer"], r["op"]) for r in found.collect()} == {("/a", None), ("/a/1", "remove")}


def test_f2_f5_merges_resolve_in_a_plain_session(spark):
    before = spark.conf.get("spark.sql.analyzer.maxIterations")
    spark.conf.set("spark.sql.analyzer.maxIterations", "100")
    try:
        rows = catalogue.QUERIES["merge_documents"](spark, "/root/testdata/sf0.001").where("c_custkey = 6").collect()
    finally:
        spark.conf.set("spark.sql.analyzer.maxIterations", before)
    assert [(r["merged"], r["patch"]) for r in rows] == [('{"c_acctbal":1,"in":{"a":[1],"k":6}}', '{"in":{"a":[1]}}')]


def test_f6_f9_f11_descent_writes_no_text(spark):
    df = documents(spark, '{"a":[1]}')
    for found in (descend.descendants(df, "d", ["id"]), descend.tree_statistics(df, "d", ["id"]), descend.named(df, "d", ["id"], "a")):
        assert "to_json" not in plan(found)


def test_descent_crosses_its_folds(spark):
    for depth in (1, 3, 4, 5, 19, 20, 21, 300):
        text = '{"a":[' * depth + "7" + "]}" * depth
        found = descend.leaves(documents(spark, text), "d", ["id"]).collect()
        assert [(r["pointer"], r["text"], r["depth"]) for r in found] == [("/a/0" * depth, "7", 2 * depth)]


def test_f7_places_keep_names_with_brackets(spark):
    found = schema.inferred_fields(documents(spark, json.dumps({"a[0]": 1, "b": [[2]]})), "d").collect()
    assert {r["place"]: r["kinds"] for r in found} == {"": "object", "/a[0]": "integer", "/b": "array", "/b/*": "array", "/b/*/*": "integer"}


def test_f8_f10_checks_compute_what_rules_ask(spark):
    df = documents(spark, '["x"]')
    assert "schema_of_variant" not in plan(df.select(schema.is_valid(F.col("d"), {"maxItems": 5})))
    assert "DoubleType" not in plan(df.select(schema.is_valid(F.col("d"), {"pattern": "x"})))


def test_f7_no_sets_of_single_nodes(spark):
    """Sets, which no generated code keeps, are made of counts by place and kind."""
    df = documents(spark, '{"a":["2024-05-01",1,null]}', '{"a":["2024-05-02",2.5]}', '{"a":{"b":[]}}')
    found = schema.inferred_fields(df, "d")
    above, below = plan(found).split("collect_set(", 1)
    assert "Aggregate [place" in below
    # documents are read once
    assert plan(found).count("LogicalRDD") == 1
    rows = {r["place"]: (r["kinds"], r["format"], r["n_present"], r["required"]) for r in found.collect()}
    assert rows == {
        "": ("object", None, 3, False),
        "/a": ("array|object", None, 3, True),
        "/a/*": ("number|string", "date", 4, False),
        "/a/b": ("array", None, 1, True),
    }


def test_f6_f9_f11_scalars_are_told_once(spark):
    """Leaves and statistics take sizes of containers from the descent and look into no value again."""
    df = documents(spark, '{"a":[1,{}],"b":{"c":"xyz","d":[]},"e":null}', "7", "[]")
    last = plan(df.select(descend._tree(F.col("d")).alias("t")))
    for found in (descend.leaves(df, "d", ["id"]), descend.named(df, "d", ["id"], "a")):
        assert plan(found.select("id", "depth")).count("array<variant>") == last.count("array<variant>")
    assert "as map<" not in plan(descend.tree_statistics(df, "d", ["id"])).split("Generate")[0]
    rows = {tuple(r) for r in descend.tree_statistics(df, "d", ["id"]).collect()}
    assert rows == {(0, 8, 2, 1, 1, 5, 3, 1, 2), (1, 1, 0, 1, 0, 0, 0, 0, 0), (2, 1, 0, 0, 0, 1, 0, 0, 0)}
    assert {(r["id"], r["pointer"], r["text"]) for r in descend.leaves(df, "d", ["id"]).collect()} == {
        (0, "/e", "null"), (0, "/a/0", "1"), (0, "/a/1", "{}"), (0, "/b/c", '"xyz"'), (0, "/b/d", "[]"), (1, "", "7"), (2, "", "[]"),
    }
