"""The registered queries of the document operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtree.functions import expressions as X
from loomtree.functions import markup, paths, text, values
from loomtree.operators import change, collection, descend, schema
from loomtree.plans import convert
from loomtree.sources import text_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(df: DataFrame, *keep: str) -> DataFrame:
    """keep, and each whole row as a document."""
    return df.select(*keep, F.parse_json(F.to_json(F.struct(*df.columns))).alias("doc"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array of structs, in the order of line numbers."""
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("items"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).drop("l_orderkey")


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders(spark, sf_dir)
    return df.select("o_orderkey", F.parse_json(F.to_json(F.struct("o_orderkey", "o_orderstatus", "items"))).alias("doc"))


# -- navigation ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def path_child(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    return df.select("event_id", F.try_variant_get(paths.child(F.col("doc"), "k"), "$", "bigint").alias("k"))


_ITEM = "SELECT o_orderkey, CAST(i.l_partkey AS BIGINT) AS part FROM (SELECT o_orderkey, {} AS i FROM (SELECT l_orderkey AS o_orderkey, list({{'n': l_linenumber, 'l_partkey': l_partkey}} ORDER BY l_linenumber, l_partkey) AS a FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1))"


@query(_ITEM.format("a[1]"))
def path_pointer(spark, sf_dir):
    df = _order_documents(spark, sf_dir)
    return df.select("o_orderkey", F.try_variant_get(paths.at_pointer(F.col("doc"), "/items/0/l_partkey"), "$", "bigint").alias("part"))


@query(_ITEM.format("a[2]"))
def path_dots(spark, sf_dir):
    df = _order_documents(spark, sf_dir)
    return df.select("o_orderkey", F.try_variant_get(paths.at_dots(F.col("doc"), "items.1.l_partkey"), "$", "bigint").alias("part"))


@query(_ITEM.format("a[-1]"))
def path_index_from_end(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", paths.element(F.col("items"), -1)["l_partkey"].alias("part"))


@query("SELECT l_orderkey AS o_orderkey, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def path_wildcard(spark, sf_dir):
    df = _order_documents(spark, sf_dir)
    item = F.explode(paths.members(paths.child(F.col("doc"), "items"))).alias("item")
    return df.select("o_orderkey", item).select("o_orderkey", F.try_variant_get(paths.child(F.col("item"), "l_quantity"), "$", "double").alias("quantity"))


_SLICE = "SELECT l_orderkey AS o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"


@query(f"SELECT o_orderkey, array_to_string(a[2:3], ',') AS parts FROM ({_SLICE})")
def path_slice(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(paths.sliced(F.col("items"), 1, 3), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query(f"SELECT o_orderkey, array_to_string(list_reverse(a), ',') AS parts FROM ({_SLICE})")
def path_slice_backwards(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(paths.sliced(F.col("items"), step=-1), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query(f"SELECT o_orderkey, array_to_string([a[i] FOR i IN range(1, len(a) + 1) IF i % 2 = 1], ',') AS parts FROM ({_SLICE})")
def path_slice_step(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(paths.sliced(F.col("items"), step=2), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT r_regionkey, unnest([r_name, CAST(r_regionkey AS VARCHAR)]) AS value FROM region")
def path_union(spark, sf_dir):
    df = _documents(_table(spark, sf_dir, "region"), "r_regionkey")
    both = paths.union(F.array(paths.child(F.col("doc"), "r_name")), F.array(paths.child(F.col("doc"), "r_regionkey")))
    return df.select("r_regionkey", F.explode(both).alias("v")).select("r_regionkey", values.group_key(F.col("v")).alias("value"))


@query("SELECT l_orderkey AS o_orderkey, l_partkey AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def path_descendant(spark, sf_dir):
    found = descend.named(_order_documents(spark, sf_dir), "doc", ["o_orderkey"], "l_partkey")
    return found.select("o_orderkey", F.try_variant_get("value", "$", "bigint").alias("part"))


@query("""SELECT l_orderkey AS o_orderkey, '$[''items''][' || n || '][''l_partkey'']' AS path, '/items/' || n || '/l_partkey' AS pointer, CAST(l_partkey AS VARCHAR) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS n FROM lineitem) JOIN orders ON l_orderkey = o_orderkey""")
def path_located(spark, sf_dir):
    found = descend.leaves(_order_documents(spark, sf_dir), "doc", ["o_orderkey"])
    return found.where(F.col("pointer").endswith("/l_partkey")).select("o_orderkey", "path", "pointer", "text")


@query("SELECT l_orderkey AS o_orderkey, string_agg(CAST(CAST(CASE WHEN l_quantity > 45 THEN 45 ELSE l_quantity END AS BIGINT) AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS quantities FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def path_update(spark, sf_dir):
    changed = paths.set_elements(F.col("items"), lambda x: x["l_quantity"] > 45, lambda x: x.withField("l_quantity", F.lit(45.0)))
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(changed, lambda x: x["l_quantity"].cast("long").cast("string")), ",").alias("quantities"))


@query("SELECT s_suppkey, array_to_string(['s_acctbal', 's_name', 's_nationkey', 's_suppkey'], ',') AS names, 4 AS n FROM supplier")
def keys_and_values(spark, sf_dir):
    df = _documents(_table(spark, sf_dir, "supplier"), "s_suppkey")
    return df.select("s_suppkey", F.array_join(paths.names(F.col("doc")), ",").alias("names"), F.size(paths.members(F.col("doc"))).alias("n"))


@query("SELECT s_name, s_suppkey FROM supplier")
def pick(spark, sf_dir):
    return collection.pick(_table(spark, sf_dir, "supplier"), "s_name", "no_such_column", "s_suppkey")


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def omit(spark, sf_dir):
    return collection.omit(_table(spark, sf_dir, "supplier"), "s_name", "s_acctbal")


@query("SELECT s_suppkey, round(s_acctbal * 2, 2) AS s_acctbal FROM supplier")
def map_values(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return collection.apply(df, lambda c: F.round(c * 2, 2), "s_acctbal")


# -- filters ---------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05")
def filter_compare(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    return collection.select(df, (F.col("l_quantity") > 45) & (F.col("l_discount") >= 0.05)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey AS o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 40 GROUP BY 1 UNION ALL SELECT o_orderkey, '' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def filter_nested(spark, sf_dir):
    kept = paths.where(F.col("items"), lambda x: x["l_quantity"] > 40)
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(kept, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT event_id, event_id % 3 < 2 AS has_k, event_id % 2 = 0 AS has_other FROM events")
def filter_exists(spark, sf_dir):
    i = F.col("event_id")
    members = F.concat_ws(",", F.when(i % 3 == 0, '"k":null').when(i % 3 == 1, '"k":1'), F.when(i % 2 == 0, '"other":[]'))
    df = _table(spark, sf_dir, "events").select("event_id", F.parse_json(F.concat(F.lit("{"), members, F.lit("}"))).alias("doc"))
    return df.select("event_id", paths.child(F.col("doc"), "k").isNotNull().alias("has_k"), paths.child(F.col("doc"), "other").isNotNull().alias("has_other"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) = 87 AS same, CAST(props->>'$.k' AS BIGINT) <> 87 AS other, event_id % 4 = 1 AS missing, CAST(props->>'$.k' AS BIGINT) < 50 AS below, event_id % 3 = 2 AS mixed FROM events")
def filter_two_valued(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    k, x = paths.child(F.col("doc"), "k"), F.parse_json(F.lit("87.0"))
    i = F.col("event_id")
    maybe = paths.child(F.parse_json(F.when(i % 4 == 1, '{"no":"87"}').otherwise("{}")), "no")  # there for one in four, of another kind than 87
    word = F.parse_json(F.when(i % 3 == 2, "1e300").otherwise('"a"'))
    below = values.less(k, F.parse_json(F.lit("50")))
    return df.select("event_id", values.equal(k, x).alias("same"), values.unequal(k, x).alias("other"), values.unequal(maybe, x).alias("missing"), below.alias("below"), values.less(k, word).alias("mixed"))


@query("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def filter_against_root(spark, sf_dir):
    df = _table(spark, sf_dir, "part")
    mean = df.agg(collection.mean(F.col("p_retailprice")).alias("mean"))  # one row
    return df.crossJoin(F.broadcast(mean)).where("p_retailprice > mean").select("p_partkey")


@query("SELECT p_partkey, length(p_name) AS n, regexp_full_match(p_name, '.*[aeiou]') AS whole, regexp_matches(p_name, 'an') AS part FROM part")
def filter_functions(spark, sf_dir):
    df, name = _table(spark, sf_dir, "part"), F.col("p_name")
    return df.select("p_partkey", F.char_length(name).alias("n"), name.rlike(r"^(?:.*[aeiou])\z").alias("whole"), name.rlike("an").alias("part"))


@query(f"SELECT o_orderkey, len(a) AS n, CASE WHEN len(a) = 1 THEN a[1] END AS only FROM ({_SLICE})")
def filter_count_and_value(spark, sf_dir):
    items = F.col("items")
    return _orders(spark, sf_dir).select("o_orderkey", F.size(items).cast("long").alias("n"), F.when(F.size(items) == 1, items[0]["l_partkey"]).alias("only"))


# -- aggregates, groups, order -----------------------------------------------------------------------------------------------


@query("SELECT round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS least, max(l_quantity) AS greatest, count(*) AS n FROM lineitem")
def aggregates(spark, sf_dir):
    q = F.col("l_quantity")
    return _table(spark, sf_dir, "lineitem").agg(F.round(collection.total(q), 2).alias("total"), F.round(collection.mean(q), 6).alias("mean"), collection.least(q).alias("least"), collection.greatest(q).alias("greatest"), F.count("*").alias("n"))


@query("SELECT arg_min(o_orderstatus, o_orderkey) AS first_status, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders")
def first_and_last(spark, sf_dir):
    df = _table(spark, sf_dir, "orders")
    return df.agg(collection.first(F.col("o_orderstatus"), "o_orderkey").alias("first_status"), collection.last(F.col("o_orderstatus"), "o_orderkey").alias("last_status"))


@query("SELECT l_orderkey AS o_orderkey, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def nested_aggregates(spark, sf_dir):
    df = _order_documents(spark, sf_dir)
    q = F.transform(paths.members(paths.child(F.col("doc"), "items")), lambda x: paths.child(x, "l_quantity"))
    return df.select("o_orderkey", F.round(values.sum_numbers(q), 2).alias("total"), F.round(values.mean_numbers(q), 6).alias("mean"))


@query("SELECT coalesce(c_mktsegment, 'null') AS key, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS items FROM customer GROUP BY 1")
def group_rows(spark, sf_dir):
    df = collection.group_rows(_table(spark, sf_dir, "customer"), F.col("c_mktsegment"), ["c_custkey"], "c_custkey")
    return df.select("key", F.array_join(F.transform("items", lambda x: x["c_custkey"].cast("string")), ",").alias("items"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS DOUBLE) AS total FROM events GROUP BY 1")
def group_agg(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    k = values.number(paths.child(F.try_parse_json("props"), "k"))
    return collection.group_agg(df, F.col("user_id"), n=F.count("*"), total=F.coalesce(F.sum(k), F.lit(0.0)))


@query("SELECT l_returnflag, l_linestatus, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1, 2")
def unique(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey")
    return collection.unique(df, ["l_returnflag", "l_linestatus"], "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 45 ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC LIMIT 10")
def top_k(spark, sf_dir):
    df = collection.select(_table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 45)
    df = df.withColumn("at", F.struct("l_orderkey", "l_linenumber"))
    return collection.top(df, F.col("l_extendedprice"), "at", 10).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size NULLS FIRST, p_partkey LIMIT 20 OFFSET 5")
def limit_offset(spark, sf_dir):
    return collection.top(_table(spark, sf_dir, "part"), F.col("p_size"), "p_partkey", 20, reverse=False, skip=5).select("p_partkey", "p_size")


@query("SELECT c_custkey FROM customer WHERE c_custkey >= 10 AND c_custkey < 100 AND (c_custkey - 10) % 7 = 0")
def slice_rows(spark, sf_dir):
    return collection.slice_rows(_table(spark, sf_dir, "customer"), "c_custkey", 10, 100, 7).select("c_custkey")


@query("SELECT n_nationkey, '[null,false,true,' || CASE WHEN n_nationkey < 8 THEN n_nationkey || ',7.5' ELSE '7.5,' || n_nationkey END || ',\"' || n_name || '\",\"~\"]' AS ordered FROM nation")
def total_order(spark, sf_dir):
    df = _table(spark, sf_dir, "nation")
    mixed = F.concat(F.lit('["~",7.5,null,true,"'), "n_name", F.lit('",'), F.col("n_nationkey").cast("string"), F.lit(",false]"))
    items = values.as_array(F.parse_json(mixed))
    return df.select("n_nationkey", F.to_json(F.to_variant_object(values.sorted_values(items))).alias("ordered"))


@query("SELECT o_orderkey, '[' || o_orderkey || ',1,2,' || o_orderkey % 10 || ']' AS flat FROM orders")
def flatten(spark, sf_dir):
    k = F.col("o_orderkey")
    nested = F.parse_json(F.concat(F.lit("["), k.cast("string"), F.lit(",[1,[2,[[[["), (k % 10).cast("string"), F.lit("]]]]]],[]]")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.to_variant_object(descend.flattened(nested))).alias("flat"))


@query("SELECT event_id, 'object' AS doc, 'number' AS k, ['string', 'null', 'array', 'boolean', 'number', 'object'][event_id % 6 + 1] AS other FROM events")
def kinds(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    other = F.parse_json(F.get(F.array(*map(F.lit, ('"1"', "null", "[1]", "true", "1.5", "{}"))), (F.col("event_id") % 6).cast("int")))
    return df.select("event_id", values.kind(F.col("doc")).alias("doc"), values.kind(paths.child(F.col("doc"), "k")).alias("k"), values.kind(other).alias("other"))


@query("SELECT o_orderkey, 4 + 4 * len(a) AS n_nodes, CASE WHEN len(a) > 0 THEN 3 ELSE 1 END AS max_depth, 1 + 3 * len(a) AS n_numbers, 1 AS n_strings, 2 + len(a) AS n_containers, 1 AS longest_string, 13 AS longest_key, len(a) AS largest_array FROM (" + _SLICE + ")")
def tree_statistics(spark, sf_dir):
    return descend.tree_statistics(_order_documents(spark, sf_dir), "doc", ["o_orderkey"])


# -- schemas ---------------------------------------------------------------------------------------------------------------

CUSTOMER = {
    "type": "object",
    "required": ["c_custkey", "c_phone"],
    "properties": {
        "c_acctbal": {"type": "number", "minimum": 0, "exclusiveMaximum": 9000},
        "c_mktsegment": {"enum": ["BUILDING", "MACHINERY", "AUTOMOBILE"]},
        "c_name": {"$ref": "#/definitions/name"},
        "c_nationkey": {"anyOf": [{"maximum": 10}, {"multipleOf": 5}], "not": {"const": 3}},
    },
    "if": {"properties": {"c_nationkey": {"const": 7}}},
    "then": {"properties": {"c_acctbal": {"minimum": 5000}}},
    "definitions": {"name": {"type": "string", "pattern": "[13579]$", "maxLength": 60}},
}
_CUSTOMER_SQL = """SELECT c_custkey, unnest(list_filter([
  '/:required',
  CASE WHEN c_acctbal < 0 THEN '/c_acctbal:minimum' END, CASE WHEN c_acctbal >= 9000 THEN '/c_acctbal:exclusiveMaximum' END,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN '/c_mktsegment:enum' END,
  CASE WHEN NOT regexp_matches(c_name, '[13579]$') THEN '/c_name:pattern' END,
  CASE WHEN NOT (c_nationkey <= 10 OR c_nationkey % 5 = 0) THEN '/c_nationkey:anyOf' END, CASE WHEN c_nationkey = 3 THEN '/c_nationkey:not' END,
  CASE WHEN c_nationkey = 7 AND c_acctbal < 5000 THEN '/c_acctbal:minimum' END], lambda x: x IS NOT NULL)) AS violation FROM customer"""


@query(_CUSTOMER_SQL)
def validate(spark, sf_dir):
    df = _documents(_table(spark, sf_dir, "customer"), "c_custkey")
    found = df.select("c_custkey", F.explode(schema.violations(F.col("doc"), CUSTOMER)).alias("v"))
    return found.select("c_custkey", F.concat(F.when(F.col("v.pointer") == "", "/").otherwise(F.col("v.pointer")), F.lit(":"), "v.keyword").alias("violation"))


@query(f"SELECT o_orderkey, len(a) <= 5 AND len(list_distinct(a)) = len(a) AND len(list_filter(q, lambda x: x > 10)) >= 1 AND len(list_filter(q, lambda x: x < 2)) = 0 AS valid FROM ({_SLICE}) JOIN (SELECT l_orderkey AS o_orderkey, list(l_quantity) AS q FROM lineitem GROUP BY 1) USING (o_orderkey)")
def validate_arrays(spark, sf_dir):
    df = _orders(spark, sf_dir)
    doc = F.parse_json(F.to_json(F.struct(F.transform("items", lambda x: x["l_partkey"]).alias("parts"), F.transform("items", lambda x: x["l_quantity"]).alias("quantities"))))
    rules = {"properties": {"parts": {"maxItems": 5, "uniqueItems": True}, "quantities": {"items": {"minimum": 2}, "contains": {"exclusiveMinimum": 10}}}}
    return df.select("o_orderkey", schema.is_valid(doc, rules).alias("valid"))


@query("""SELECT event_id, regexp_full_match(d, '\\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\\d|3[01])') AS is_date, true AS is_moment, false AS is_email
FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS d FROM events)""")
def validate_formats(spark, sf_dir):
    df, day = _table(spark, sf_dir, "events"), F.date_format("ts", "yyyy-MM-dd")
    doc = F.to_variant_object(F.struct(day.alias("d"), F.concat(day, F.lit("T10:00:00Z")).alias("t")))
    made = df.select("event_id", doc.alias("doc"))
    checks = {n: schema.is_valid(F.col("doc"), {"properties": {p: {"format": f}}}) for n, p, f in (("is_date", "d", "date"), ("is_moment", "t", "date-time"), ("is_email", "d", "email"))}
    return made.select("event_id", *[c.alias(n) for n, c in checks.items()])


@query("""WITH f AS (SELECT unnest(['/c_custkey', '/c_name', '/c_nationkey', '/c_acctbal', '/c_mktsegment']) AS place, unnest(['integer', 'string', 'integer', 'number', 'string']) AS kinds,
  unnest([count(c_custkey), count(c_name), count(c_nationkey), count(c_acctbal), count(c_mktsegment)]) AS n_present, count(*) AS n FROM customer)
SELECT place, kinds, CAST(NULL AS VARCHAR) AS format, n_present, n_present = n AS required FROM f UNION ALL SELECT '', 'object', NULL, count(*), false FROM customer""")
def infer_schema(spark, sf_dir):
    return schema.inferred_fields(_documents(_table(spark, sf_dir, "customer")), "doc")


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1), t AS (SELECT count(*) AS orders, sum(n)::BIGINT AS items FROM l),
d AS (SELECT count(DISTINCT o_orderkey) AS n FROM orders JOIN l ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 0)
SELECT unnest(['', '/day', '/key', '/items', '/items/*', '/items/*/l_linenumber', '/items/*/l_partkey', '/items/*/l_quantity']) AS place,
  unnest(['object', 'string', 'integer|string', 'array', 'object', 'integer', 'integer', 'number']) AS kinds, unnest([NULL, 'date', NULL, NULL, NULL, NULL, NULL, NULL]) AS format,
  unnest([orders, d.n, orders, orders, items, items, items, items]) AS n_present, unnest([false, d.n = orders, true, true, false, true, true, true]) AS required FROM t, d""")
def infer_nested(spark, sf_dir):
    df = _orders(spark, sf_dir)
    even = F.col("o_orderkey") % 2 == 0
    key = F.when(even, F.col("o_orderkey").cast("variant")).otherwise(F.col("o_orderkey").cast("string").cast("variant"))
    day = F.when(even, F.lit("2024-05-01"))
    return schema.inferred_fields(df.select(F.to_variant_object(F.struct(day.alias("day"), key.alias("key"), F.transform("items", lambda x: x.withField("l_quantity", x["l_quantity"] + 0.25)).alias("items"))).alias("doc")), "doc")


_OBJECT_RULES = {
    "patternProperties": {"^x_": {"type": "integer", "minimum": 5}},
    "properties": {"name": {"type": "string"}},
    "additionalProperties": {"type": "boolean"},
    "propertyNames": {"pattern": "^[a-z_0-9]+$"},
    "dependentSchemas": {"x_b": {"required": ["name"]}},
}


@query("""SELECT p_partkey, unnest(list_filter([
  CASE WHEN p_partkey % 12 < 5 THEN '/x_a:minimum' END, CASE WHEN p_partkey % 3 = 0 THEN '/x_b:type' END, CASE WHEN p_partkey % 4 = 0 THEN '/other:type' END,
  CASE WHEN p_partkey % 5 = 0 THEN ':propertyNames' END, CASE WHEN p_partkey % 5 = 0 THEN '/BIG:type' END, CASE WHEN p_partkey % 2 = 0 THEN ':required' END], lambda x: x IS NOT NULL)) AS violation FROM part""")
def validate_objects(spark, sf_dir):
    k = F.col("p_partkey")
    members = [
        F.concat(F.lit('"x_a":'), (k % 12).cast("string")),
        F.when(k % 3 == 0, '"x_b":"no"').otherwise('"x_b":7'),
        F.when(k % 4 == 0, '"other":1').otherwise('"other":true'),
        F.when(k % 5 == 0, '"BIG":0'),
        F.when(k % 2 == 1, '"name":"n"'),
    ]
    doc = F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))
    df = _table(spark, sf_dir, "part").select("p_partkey", F.explode(schema.violations(doc, _OBJECT_RULES)).alias("v"))
    return df.select("p_partkey", F.concat("v.pointer", F.lit(":"), "v.keyword").alias("violation"))


@query("""SELECT p_partkey, p_partkey % 7 > 2 AS closed, p_partkey % 3 <> 1 AS prefixed, p_partkey % 4 IN (2, 3) AS counted FROM part""")
def validate_prefix_and_counts(spark, sf_dir):
    k = F.col("p_partkey")
    df = _table(spark, sf_dir, "part")
    named = F.parse_json(F.concat(F.lit('{"x_1":1'), F.when(k % 7 <= 2, ',"y":2').otherwise(""), F.lit("}")))
    listed = F.parse_json(F.concat(F.lit('["a",'), F.when(k % 3 == 1, '"b"').otherwise("2"), F.lit(",true,false]")))
    counted = F.to_variant_object(F.transform(F.sequence(F.lit(0), k % 4), lambda i: i.cast("int")))
    return df.select(
        "p_partkey",
        schema.is_valid(named, {"patternProperties": {"^x_": True}, "additionalProperties": False}).alias("closed"),
        schema.is_valid(listed, {"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": {"type": "boolean"}}).alias("prefixed"),
        schema.is_valid(counted, {"contains": {"minimum": 1}, "minContains": 2, "maxContains": 3}).alias("counted"),
    )


@query("""SELECT s_suppkey, s_suppkey % 3 = 0 AS ipv6, s_suppkey % 2 = 0 AS reference, s_suppkey % 5 > 0 AS ipv4, s_suppkey % 4 = 1 AS email FROM supplier""")
def validate_formats_that_break(spark, sf_dir):
    k, df = F.col("s_suppkey"), _table(spark, sf_dir, "supplier")
    number = k.cast("string")
    made = F.struct(
        F.when(k % 3 == 0, F.concat(F.lit("2001:db8::"), F.lower(F.hex(k % 65536)))).when(k % 3 == 1, F.concat(F.lit("zzz"), number)).otherwise(F.concat(F.lit("1:2::3::"), F.hex(k % 65536))).alias("ipv6"),
        F.when(k % 2 == 0, F.concat(F.lit("../part?k="), number, F.lit("#top"))).otherwise(F.concat(F.lit("a b "), number)).alias("uri-reference"),
        F.when(k % 5 > 0, F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit(".1"))).otherwise(F.concat(F.lit("10.0.1."), (k % 256 + 256).cast("string"))).alias("ipv4"),
        F.when(k % 4 == 1, F.concat(F.lit("s"), number, F.lit("@example.org"))).otherwise(F.concat(F.lit("s"), number, F.lit("@"))).alias("email"),
    )
    docs = df.select("s_suppkey", F.to_variant_object(made).alias("doc"))
    names = {"ipv6": "ipv6", "reference": "uri-reference", "ipv4": "ipv4", "email": "email"}
    return docs.select("s_suppkey", *[schema.is_valid(F.col("doc"), {"properties": {f: {"format": f}}}).alias(n) for n, f in names.items()])


# -- differences, merges, patches ----------------------------------------------------------------------------------------------


def _changed(df: DataFrame) -> DataFrame:
    """customer with some rows gone, some new and some balances changed."""
    new = df.where("c_custkey % 50 = 1").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    return df.where("c_custkey % 40 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.lit(1.5)).otherwise(F.col("c_acctbal"))).unionByName(new)


@query("""SELECT c_custkey, 'remove' AS op, '' AS pointer FROM customer WHERE c_custkey % 40 = 0
UNION ALL SELECT c_custkey + 10000000, 'add', '' FROM customer WHERE c_custkey % 50 = 1
UNION ALL SELECT c_custkey, 'replace', '/c_acctbal' FROM customer WHERE c_custkey % 40 <> 0 AND c_custkey % 7 = 0 AND c_acctbal <> 1.5""")
def diff_rows(spark, sf_dir):
    df = _table(spark, sf_dir, "customer")
    return change.diff_rows(df, _changed(df), ["c_custkey"]).select("c_custkey", "op", "pointer")


@query("""SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 10 <> 0""")
def merge_rows(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    patch = df.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.lit(0.5)).alias("s_acctbal"), (F.col("s_suppkey") % 10 == 0).alias("_removed"))
    return change.merge_rows(df, patch, ["s_suppkey"])


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"tag\":{\"a\":1}}' AS doc FROM nation")
def merge_patch(spark, sf_dir):
    df = _documents(_table(spark, sf_dir, "nation"), "n_nationkey")
    merged = change.merge_patch(F.col("doc"), F.parse_json(F.lit('{"n_regionkey": null, "tag": {"a": 1, "b": null}}')))
    return df.select("n_nationkey", F.to_json(F.to_variant_object(merged)).alias("doc"))


@query("""SELECT c_custkey, '{"c_acctbal":' || CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END || ',"in":{"a":' || CASE WHEN c_custkey % 3 = 0 THEN '[1]' ELSE '[1,2]' END || ',"k":' || c_custkey || '}}' AS merged,
  CASE WHEN c_custkey % 3 = 0 THEN '{"in":{"a":[1]}}' ELSE '{}' END AS patch FROM customer""")
def merge_documents(spark, sf_dir):
    k = F.col("c_custkey")
    first = F.parse_json(F.concat(F.lit('{"gone":1,"c_acctbal":0,"in":{"a":[1,2],"k":'), k.cast("string"), F.lit("}}")))
    second = F.when(k % 2 == 0, F.parse_json(F.lit('{"c_acctbal":1}')))
    third = F.parse_json(F.when(k % 3 == 0, '{"gone":null,"in":{"a":[1]}}').otherwise('{"gone":null}'))
    merged = change.merge_all(first, second, third)
    before = change.merge_all(first, second, F.parse_json(F.lit('{"gone":null}')))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.to_json(merged).alias("merged"), F.to_json(change.create_merge_patch(before, merged)).alias("patch"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN '{"a":[' || CASE WHEN o_orderkey % 4 = 2 THEN '' ELSE '0,' END || o_orderkey || ',{"b":"x"}],"z":' || CASE WHEN o_orderkey % 2 = 0 THEN '[null,{"n":7}]' ELSE '[null,{"n":7},' || o_orderkey || ']' END || '}' END AS doc
FROM orders WHERE o_orderkey % 4 <> 3 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 3""")
def patch_documents(spark, sf_dir):
    k = F.col("o_orderkey")
    start = F.parse_json(F.concat(F.lit('{"a":[0,'), k.cast("string"), F.lit(',{"b":1}],"s":'), (k % 4).cast("string"), F.lit("}")))
    made = change.set_at(start, ["z", "1", "n"], F.lit(7).cast("variant"))
    made = F.when(k % 2 == 1, change.add_at(made, ["z", "-"], k.cast("variant"))).otherwise(made)
    made = F.when(k % 4 == 2, change.remove_at(made, ["a", "0"])).otherwise(made)
    at = F.when(k % 4 == 2, change.replace_at(made, ["a", "1", "b"], F.lit("x").cast("variant"))).otherwise(change.replace_at(made, ["a", "2", "b"], F.lit("x").cast("variant")))
    patched = change.apply_document_patch(F.when(k % 4 != 3, at), [{"op": "remove", "path": "/s"}])
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(patched).alias("doc"))


@query("""WITH l AS (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1)
SELECT o_orderkey, '/items/0/l_quantity' AS pointer, 'replace' AS op, 'modified' AS label FROM l WHERE o_orderkey % 3 = 0 AND n > 0
UNION ALL SELECT o_orderkey, '/items/' || (n - 1), 'remove', 'removed' FROM l WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, '/items', NULL, 'size changed' FROM l WHERE o_orderkey % 3 = 1
UNION ALL SELECT o_orderkey, '/o_orderstatus', 'replace', 'type changed' FROM l WHERE o_orderkey % 3 = 2 UNION ALL SELECT o_orderkey, '/more', 'add', 'added' FROM l WHERE o_orderkey % 3 = 2""")
def diff_documents(spark, sf_dir):
    before = _order_documents(spark, sf_dir)
    k, doc, items = F.col("o_orderkey"), F.col("doc"), paths.members(paths.child(F.col("doc"), "items"))
    less = change.replace_at(doc, ["items"], F.to_variant_object(F.slice(items, F.lit(1), F.size(items) - 1)))
    other = change.add_at(change.replace_at(doc, ["o_orderstatus"], F.lit(1).cast("variant")), ["more"], F.parse_json(F.lit('{"x":[1,{"y":2}]}')))
    after = before.select("o_orderkey", F.when(k % 3 == 0, change.replace_at(doc, ["items", "0", "l_quantity"], F.lit(-1).cast("variant"))).when(k % 3 == 1, less).otherwise(other).alias("doc"))
    return change.diff_documents(before, after, ["o_orderkey"], "doc").select("o_orderkey", "pointer", "op", "label")


@query("SELECT n_nationkey, n_name AS label, n_regionkey AS region, 'x' AS added FROM nation WHERE n_regionkey = 2")
def apply_patch(spark, sf_dir):
    operations = [{"op": "test", "path": "/n_regionkey", "value": 2}, {"op": "add", "path": "/added", "value": "x"}, {"op": "move", "from": "/n_name", "path": "/label"}, {"op": "copy", "from": "/n_regionkey", "path": "/region"}, {"op": "remove", "path": "/n_regionkey"}]
    df = _table(spark, sf_dir, "nation")
    out = df.select(change.apply_patch(F.struct("n_nationkey", "n_name", "n_regionkey"), operations).alias("r")).where("r IS NOT NULL")
    return out.select("r.n_nationkey", "r.label", "r.region", "r.added")


# -- scalar libraries ------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, upper(p_name) AS upper_name, replace(p_name, 'a', 'o') AS replaced, reverse(p_name) AS reversed, p_name[-3:] AS tail, trim(p_name, 'aeiou') AS trimmed, array_to_string(list_reverse(string_split(p_name, ' ')), '-') AS joined, CASE WHEN starts_with(p_brand, 'Brand#') THEN p_brand[7:] ELSE p_brand END AS brand FROM part""")
def expression_strings(spark, sf_dir):
    name = F.col("p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", F.upper(name).alias("upper_name"), X.replace(name, "a", "o").alias("replaced"), F.reverse(name).alias("reversed"), X.substr(name, -3, -1).alias("tail"), X.trim(name, "aeiou").alias("trimmed"), X.join("-", F.reverse(X.split(" ", name))).alias("joined"), X.trimprefix(F.col("p_brand"), "Brand#").alias("brand"))


@query(f"SELECT o_orderkey, a[1 + 7 % len(a)] AS wrapped, array_to_string(list_sort([CAST(x AS VARCHAR) FOR x IN a]), ',') AS sorted, array_to_string([x * 2 FOR x IN a IF x % 2 = 0], ',') AS doubled, len(list_distinct(a)) AS n, list_contains(a, 7) AS has7 FROM ({_SLICE})")
def expression_collections(spark, sf_dir):
    df = _orders(spark, sf_dir).select("o_orderkey", X.splat(F.col("items"), "l_partkey").alias("a"))
    doubled = F.transform(X.for_list(F.col("a"), lambda x: x * 2, lambda x: x % 2 == 0), lambda x: x.cast("string"))
    return df.select("o_orderkey", X.element(F.col("a"), 7).alias("wrapped"), F.array_join(X.sort_text(F.col("a")), ",").alias("sorted"), F.array_join(doubled, ",").alias("doubled"), F.size(F.array_distinct("a")).cast("long").alias("n"), F.array_contains("a", 7).alias("has7"))


@query("SELECT s_suppkey, 'b,' || CASE WHEN s_suppkey % 2 = 0 THEN 'k' ELSE 'l' END || ',x' AS names, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'none' END AS looked, CAST(s_nationkey AS VARCHAR) AS merged, s_nationkey || ',' || s_name || ',3' AS vals, s_name || '=' || s_nationkey AS pairs FROM supplier")
def expression_maps(spark, sf_dir):
    k, name, nation = F.when(F.col("s_suppkey") % 2 == 0, "k").otherwise("l"), F.col("s_name"), F.col("s_nationkey").cast("string")
    m = X.zipmap(F.array(k, F.lit("b"), F.lit("no")), F.array(name, F.lit("1")))
    both = X.merge(m, F.create_map(F.lit("b"), nation, F.lit("x"), F.lit("3")))
    pairs = X.for_map(F.array(name), lambda x: x, lambda x: nation)
    shown = F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    df = _table(spark, sf_dir, "supplier")
    return df.select("s_suppkey", F.array_join(X.keys(both), ",").alias("names"), X.lookup(m, "k", F.lit("none")).alias("looked"), X.lookup(both, "b", F.lit("none")).alias("merged"), F.array_join(X.values(both), ",").alias("vals"), shown.alias("pairs"))


@query("""SELECT o_orderkey, CAST(o_orderkey + 9007199254740992 AS BIGINT) AS total, o_orderkey % 2 = 1 AS same, o_orderkey % 3 = 2 AS below, CAST(least(o_orderkey % 7, 3) AS VARCHAR) AS least,
  CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE CAST(9007199254740992 + o_orderkey % 2 AS VARCHAR) END AS least_of_large, 9007199254740993 // 2 + 0 * o_orderkey AS half, CAST((o_orderkey % 9) * (o_orderkey % 9) * (o_orderkey % 9) AS BIGINT) AS cube FROM orders""")
def exact_numbers(spark, sf_dir):
    k, big = F.col("o_orderkey"), 1 << 53

    def doc(x):
        return x.cast("variant")

    near = doc(F.lit(big) + k % 2)
    some = F.array(near, F.when(k % 5 == 0, doc(F.lit(True))).otherwise(doc(F.lit(big + 2))))
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.try_variant_get(values.exact_sum(F.array(doc(k), doc(F.lit(big)), doc(F.lit("7")))), "$", "bigint").alias("total"),
        values.equal(near, doc(F.lit(big + 1))).alias("same"),
        values.less(doc(F.lit(big + 1)), doc(F.lit(big) + k % 3)).alias("below"),
        F.to_json(values.least_value(F.array(doc(F.lit(3).cast("bigint")), doc(k % 7)))).alias("least"),
        F.to_json(values.least_value(some)).alias("least_of_large"),
        X.integer_quotient(F.lit(big + 1), F.lit(2)).alias("half"),
        X.power(k % 9, 3).alias("cube"),
    )


@query("""SELECT p_partkey, p_name || ' costs ' || CAST(p_size AS VARCHAR) || '% "' || p_brand || '" ' || CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END AS formatted,
  'part ' || p_partkey || ': ' || p_name || ' ${x}' AS filled, CASE WHEN p_size > 20 THEN 'large' ELSE '' END AS conditional, CASE WHEN p_size > 20 THEN p_brand ELSE p_type END AS first_filled,
  trim(p_name) AS spaced, length(p_name) AS length, p_name[2:4] AS middle, array_to_string(list_filter([p_name, CASE WHEN p_size > 20 THEN p_brand ELSE '' END], lambda x: x <> ''), '|') AS compacted,
  CASE WHEN p_type LIKE '%L' THEN p_type[:-2] ELSE p_type END AS cut FROM part""")
def expression_templates(spark, sf_dir):
    name, size, large = F.col("p_name"), F.col("p_size"), F.col("p_size") > 20
    return _table(spark, sf_dir, "part").select(
        "p_partkey",
        X.formatted("%s costs %d%% %q %t", name, size, F.col("p_brand"), large).alias("formatted"),
        X.template("part ${k}: ${name} $${x}", k=F.col("p_partkey"), name=name).alias("filled"),
        X.template_if(large, F.lit("large")).alias("conditional"),
        X.coalesce(F.when(large, F.col("p_brand")).otherwise(""), F.col("p_type")).alias("first_filled"),
        X.trimspace(F.concat(F.lit(" \t"), name, F.lit("\n"))).alias("spaced"),
        values.length(name.cast("variant")).cast("long").alias("length"),
        F.array_join(X.slice_(F.split(name, ""), 1, 4), "").alias("middle"),
        X.template_for(X.compact(F.array(name, F.when(large, F.col("p_brand")).otherwise(""))), lambda x: x, "|").alias("compacted"),
        X.trimsuffix(F.col("p_type"), "L").alias("cut"),
    )


@query("""SELECT c_custkey, c_custkey % 2 = 0 AS base64, c_custkey % 3 > 0 AS url, c_name || chr(10) || 'ok' AS decoded, '"' || c_name || '\\"' || '"' AS json_text, CASE WHEN c_custkey % 2 = 0 THEN '"' || c_name || ',x"' ELSE c_name END AS cell,
  '{' || chr(10) || '  "k" : ' || c_custkey || chr(10) || '}' AS pretty, c_custkey % 4 = 0 AS small, c_custkey AS lenient, c_name AS wanted, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 1 END AS matched, upper(c_name) || 'end' AS upper_end, c_name LIKE '%7' AS ends FROM customer""")
def text_and_limits(spark, sf_dir):
    k, name = F.col("c_custkey"), F.col("c_name")
    even = k % 2 == 0
    raw = F.concat(name, F.lit("\r\nok"))
    bytes_ = F.when(k % 3 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(raw, "UTF-8"))).when(k % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(raw, "UTF-16LE"))).otherwise(F.encode(raw, "UTF-8"))
    loose = F.parse_json(F.concat(F.lit('{"a":'), F.when(even, "[1,2,3]").otherwise("5"), F.lit(',"n":'), text.json_escaped(name), F.lit("}")))
    xml = F.concat(F.lit("<c>"), text.xml_escaped(name), F.lit("</c>"))
    return _table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.is_base64(F.when(even, "QUJD").otherwise("QUJ")).alias("base64"),
        text.is_base64(F.when(k % 3 > 0, "__79_A").otherwise("a+b/"), url=True).alias("url"),
        text.decoded(bytes_).alias("decoded"),
        text.json_escaped(F.concat(name, F.lit('"'))).alias("json_text"),
        text.csv_escaped(F.when(even, F.concat(name, F.lit(",x"))).otherwise(name)).alias("cell"),
        text.json_pretty(F.struct(k.alias("k"))).alias("pretty"),
        text.within_limits(F.when(k % 4 == 0, "[[1]]").otherwise("[[[1]]]"), 100, 2).alias("small"),
        F.try_variant_get(text.lenient_json(F.concat(F.lit("{k: "), k.cast("string"), F.lit(", /* no */ 'x': ',]',}"))), "$.k", "bigint").alias("lenient"),
        F.try_variant_get(paths.required(loose, "/n", "string"), "$", "string").alias("wanted"),
        paths.matched(paths.at_pointer(loose, "/a")).alias("matched"),
        F.concat(markup.upper_case(xml, "/c"), F.lit("end")).alias("upper_end"),
        markup.ends_with(xml, "/c", "7").alias("ends"),
    )


@query("SELECT c_custkey, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, abs(c_acctbal) AS size, greatest(c_acctbal, 100.0) AS most, CAST(sign(c_acctbal) AS DOUBLE) AS side, CAST(trunc(c_nationkey / 4) AS BIGINT) AS quarter FROM customer")
def expression_numbers(spark, sf_dir):
    b = F.col("c_acctbal")
    return _table(spark, sf_dir, "customer").select("c_custkey", F.ceil(b).cast("double").alias("up"), F.floor(b).cast("double").alias("down"), F.abs(b).alias("size"), F.greatest(b, F.lit(100.0)).alias("most"), F.signum(b).alias("side"), X.integer_quotient(F.col("c_nationkey"), F.lit(4)).alias("quarter"))


@query("SELECT p_partkey, base64(encode(p_name)) AS b64, p_name AS back, lower(hex(encode(p_name))) AS hexed, '{\"p_partkey\":' || p_partkey || '}' AS json FROM part")
def expression_encodings(spark, sf_dir):
    name = F.col("p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", X.base64encode(name).alias("b64"), X.base64decode(X.base64encode(name)).alias("back"), text.hex_lower(F.encode(name, "UTF-8")).alias("hexed"), F.to_json(F.struct("p_partkey")).alias("json"))


@query("SELECT n_nationkey, 'a' || chr(10) || '  ' || n_name AS dedented, 2 + n_nationkey % 3 AS lines, replace(n_name, 'A', '&lt;A&gt;') AS escaped FROM nation")
def text_helpers(spark, sf_dir):
    df = _table(spark, sf_dir, "nation")
    body = F.concat(F.lit("  a\n    "), "n_name")
    return df.select("n_nationkey", text.dedent(body).alias("dedented"), text.line_count(F.concat(body, F.repeat(F.lit("\n-"), (F.col("n_nationkey") % 3).cast("int")))).cast("long").alias("lines"), text.xml_escaped(F.replace("n_name", F.lit("A"), F.lit("<A>"))).alias("escaped"))


@query("SELECT r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 'yaml' WHEN 1 THEN 'toml' END AS format, CASE WHEN r_regionkey % 3 < 2 THEN 'title: ' || r_name END AS frontmatter, 'body ' || r_name AS content FROM region")
def frontmatter(spark, sf_dir):
    fence = F.when(F.col("r_regionkey") % 3 == 0, "---").when(F.col("r_regionkey") % 3 == 1, "+++")
    body = F.concat(F.lit("body "), "r_name")
    page = F.coalesce(F.concat(fence, F.lit("\ntitle: "), "r_name", F.lit("\n"), fence, F.lit("\n"), body), body)
    return _table(spark, sf_dir, "region").select("r_regionkey", text.frontmatter(page).alias("p")).select("r_regionkey", "p.*")


@query("SELECT r_regionkey, count(*) AS n, CAST(sum(n_nationkey) AS DOUBLE) AS total, min(n_name) AS first_name, bool_or(n_nationkey = 3) AS has3 FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def xpath(spark, sf_dir):
    nations = F.array_sort(F.collect_list(markup.element("nation", text.xml_escaped(F.col("n_name")), key=F.col("n_nationkey").cast("string"), name=text.xml_escaped(F.col("n_name")))))
    ordered = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(nations.alias("parts"))
    xml = ordered.select("r_regionkey", F.concat(F.lit("<region>"), F.array_join("parts", ""), F.lit("</region>")).alias("xml"))
    return xml.select("r_regionkey", markup.count(F.col("xml"), "/region/nation").alias("n"), markup.number(F.col("xml"), "sum(/region/nation/@key)").alias("total"), F.array_min(markup.nodes(F.col("xml"), "//nation/text()")).alias("first_name"), markup.test(F.col("xml"), markup.bound("//nation[@key=$k]", k="3")).alias("has3"))


_REGION_XML = "SELECT n_regionkey AS r_regionkey, list(n_name ORDER BY CAST(n_nationkey AS VARCHAR)) AS names, list(n_nationkey ORDER BY CAST(n_nationkey AS VARCHAR)) AS keys FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"


@query(f"""SELECT r_regionkey, len(names) - 1 AS n_after, names[-1] AS last_name, CAST(keys[2] AS VARCHAR) AS second_key, floor(list_sum(keys) / 2) AS half, ceil(list_sum(keys) / 4) AS quarter_up, round(list_sum(keys) / 4 + 0.001) AS quarter,
  contains(names[1], 'AN') OR len(names) > 5 AS tested, names[1][2:4] AS part, translate(names[1], 'AE', 'ae') AS swapped, names[1] || ' x' AS spaced, CAST(length(names[1]) AS DOUBLE) AS n_letters, 2 AS n_union, 'nation' AS tag,
  len(list_filter(keys, lambda k: k > 10 AND k % 2 = 0)) AS n_even, split_part(names[1] || '=', '=', 1) AS before, names[1] LIKE 'A%' AS starts, len(names) AS n_attributes FROM ({_REGION_XML})""")
def xpath_functions(spark, sf_dir):
    nations = F.array_sort(F.collect_list(markup.element("nation", text.xml_escaped(F.col("n_name")), key=F.col("n_nationkey").cast("string"))))
    rows = _table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(nations.alias("parts"))
    xml = F.concat(F.lit("<region>"), F.array_join("parts", ""), F.lit("</region>"))
    first = "/region/nation[1]"
    return rows.select(
        "r_regionkey",
        markup.count(xml, f"{first}/following-sibling::nation").alias("n_after"),
        markup.text(xml, "//nation[last()]").alias("last_name"),
        markup.text(xml, "//nation[position() = 2]/@key").alias("second_key"),
        markup.number(xml, "floor(sum(//@key) div 2)").alias("half"),
        markup.number(xml, "ceiling(sum(//@key) div 4)").alias("quarter_up"),
        markup.number(xml, "round(sum(//@key) div 4 + 0.001)").alias("quarter"),
        markup.test(xml, f"contains({first}, 'AN') or count(//nation) > 5").alias("tested"),
        markup.text(xml, f"substring({first}, 2, 3)").alias("part"),
        markup.text(xml, f"translate({first}, 'AE', 'ae')").alias("swapped"),
        markup.text(xml, f"normalize-space(concat('  ', {first}, '   x '))").alias("spaced"),
        markup.number(xml, f"string-length({first})").alias("n_letters"),
        markup.count(xml, f"{first} | //nation[last()] | {first}").alias("n_union"),
        markup.text(xml, "name(//*[@key][1])").alias("tag"),
        markup.count(xml, "//nation[@key > 10 and not(@key mod 2 = 1)]").alias("n_even"),
        markup.text(xml, f"substring-before(concat({first}, '='), '=')").alias("before"),
        markup.test(xml, f"starts-with(string({first}), 'A')").alias("starts"),
        markup.count(xml, "/region/descendant::nation/attribute::key[number(.) >= 0]/parent::nation[ancestor::region]").alias("n_attributes"),
    )


# -- sources and conversions -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE event_id % 5 > 1")
def json_lines(spark, sf_dir):
    prefix = F.when(F.col("event_id") % 5 == 0, "# ").when(F.col("event_id") % 5 == 1, "// ").otherwise(" ")
    lines = _table(spark, sf_dir, "events").select("event_id", F.concat(prefix, "props").alias("value"))
    return text_tables.json_lines(lines).select("event_id", F.try_variant_get("document", "$.k", "bigint").alias("k"))


@query("""SELECT 'c_acctbal' AS "column", 'float' AS kind UNION ALL SELECT 'c_custkey', 'integer' UNION ALL SELECT 'c_name', 'string'""")
def column_kinds(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string"), "c_name", F.format_string("%.2f", "c_acctbal").alias("c_acctbal"))
    return text_tables.column_kinds(df)


@query("SELECT ';' AS delimiter, 1020 AS score UNION ALL SELECT ',', 0 UNION ALL SELECT '|', 0 UNION ALL SELECT chr(9), 0")
def sniff_delimiter(spark, sf_dir):
    lines = _table(spark, sf_dir, "customer").select(F.concat_ws(";", "c_custkey", "c_nationkey", "c_mktsegment").alias("value"))
    return text_tables.sniffed(lines)


@query("SELECT n_regionkey AS file, 'nation ' || n_nationkey AS section, 'name' AS key, n_name AS value FROM nation UNION ALL SELECT n_regionkey, 'nation ' || n_nationkey, 'active', 'true' FROM nation")
def settings(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation")
    lines = F.array(F.concat(F.lit("[nation "), F.col("n_nationkey").cast("string"), F.lit("]")), F.lit("; a comment"), F.lit("name = none"), F.concat(F.lit('name = "'), "n_name", F.lit('"')), F.lit("active"), F.lit(""))
    rows = nation.select(F.col("n_regionkey").alias("file"), "n_nationkey", F.posexplode(lines).alias("line", "value"))
    return text_tables.settings(rows.withColumn("number", F.col("n_nationkey") * 10 + F.col("line")), "file", "number")


_NATION = "n_nationkey int, n_name string, n_regionkey int"


def _round_trip(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, "nation")
        written = convert.format_as(kind, F.struct("n_nationkey", "n_name", "n_regionkey"))
        return df.select(convert.parse_as(kind, written, _NATION).alias("r")).select("r.*")

    return run


for _kind in convert.COLUMN_FORMATS:
    QUERIES[f"roundtrip_{_kind}"] = _round_trip(_kind)
    SQL[f"roundtrip_{_kind}"] = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")
def convert_csv_to_json(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", convert.format_as("csv", F.struct("n_nationkey", "n_name", "n_regionkey")).alias("csv"))
    return df.select("n_nationkey", convert.convert_column(F.col("csv"), "csv", "json", _NATION).alias("json"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 30 OFFSET 10")
def parquet_columns_limit(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey").offset(10).limit(30)


@query("SELECT p_partkey, p_partkey || ',' || p_size || ',3' AS flat FROM part")
def flatten_typed(spark, sf_dir):
    nested = F.array(F.array(F.array(F.col("p_partkey")), F.array(F.col("p_size").cast("long"))), F.array(F.array(F.lit(3).cast("long"))))
    kind = T.ArrayType(T.ArrayType(T.ArrayType(T.LongType())))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(X.flatten(nested, kind), lambda x: x.cast("string")), ",").alias("flat"))


@query("SELECT s_suppkey, 'integer' AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'string' ELSE 'integer' END AS quoted, s_name || ', \"x\"' AS name FROM supplier")
def csv_cells(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    second = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    line = F.concat_ws(",", k, second, text.csv_escaped(F.concat("s_name", F.lit(', "x"'))))
    cells = text_tables.typed_cells(line)
    return _table(spark, sf_dir, "supplier").select("s_suppkey", F.get(cells, F.lit(0))["kind"].alias("kind"), F.get(cells, F.lit(1))["kind"].alias("quoted"), F.get(cells, F.lit(2))["text"].alias("name"))


@query("SELECT s_suppkey, '{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\"}' AS json FROM supplier")
def convert_bytes(spark, sf_dir):
    csv = convert.format_as("csv", F.struct("s_suppkey", "s_name"))
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode(csv, "UTF-16BE"))).otherwise(F.encode(csv, "UTF-8"))
    out = convert.convert_bytes(raw, "csv", "json", "s_suppkey bigint, s_name string")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", F.decode(out, "UTF-8").alias("json"))
