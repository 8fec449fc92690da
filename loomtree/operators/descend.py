"""All values inside documents, as rows: recursive descent, located results and tree statistics over a VARIANT column.

One pass a row: a fold opens the nodes of the level above until there are none, and the array of all nodes is exploded
once. There is no shuffle, no second scan and no bound on depth (beyond the parser's own), and it runs on streams as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtree.functions.paths import escaped, normal_step, pointer_step
from loomtree.functions.values import as_array, as_map, kind, let, scalar_kind

#: Steps of the folds that follow each other while there is more to do: a fold copies its state in every step, idle ones included, so that shallow documents
#: get by with few. JSON texts nest no deeper than 1,000 levels.
STEPS = (4, 16, 1000)


def repeated(start: Column, more: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """step(step(... start)) as long as more(state)."""

    def run(state: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, lambda s, _: F.when(more(s), step(s)).otherwise(s))

    def next_fold(state: Column, n: Column) -> Column:
        out = run(state, STEPS[-1])
        for few in STEPS[-2::-1]:
            out = F.when(n == few, run(state, few)).otherwise(out)
        return F.when(more(state), out).otherwise(state)

    return F.aggregate(F.array(*map(F.lit, STEPS)), start, next_fold)


def every_level(first: Column, opened: Callable[[Column], Column]) -> Column:
    """first, opened(first), opened of that and so on until there is nothing, as one array."""
    levels = repeated(F.array(first), lambda s: F.size(F.element_at(s, -1)) > 0, lambda s: F.concat(s, F.array(opened(F.element_at(s, -1)))))
    return F.flatten(levels)


def sorted_members(m: Column) -> Column:
    """The entries of a map by name. Those of a VARIANT are sorted as they come, but for names beyond the Basic Multilingual Plane."""

    def ordered(entries: Column) -> Column:
        at = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("k"), i.alias("i"))))
        return F.transform(at, lambda k: F.get(entries, k["i"]))

    return F.when(F.map_keys(m) == F.sort_array(F.map_keys(m)), F.map_entries(m)).otherwise(ordered(F.map_entries(m)))


def _tree(v: Column, *fields: str) -> Column:
    """nodes() with items, the size of an array, and members, that of an object: what a node is, is asked when it is made, and only containers are opened."""
    steps = {
        "path": normal_step,
        "pointer": pointer_step,
        "order": lambda key, position: F.array(position),
        "place": lambda key, position: F.concat(F.lit("/"), F.coalesce(escaped(key), F.lit("*"))),
    }
    roots = {"path": F.lit("$"), "pointer": F.lit(""), "order": F.array().cast("array<int>"), "place": F.lit("")}

    def node(value: Column, depth: Column, key: Column, position: Column, where: dict[str, Column]) -> Column:
        sizes = [F.size(as_array(value)).alias("items"), F.size(as_map(value)).alias("members")]
        return F.struct(value.alias("value"), depth.alias("depth"), key.alias("key"), position.alias("position"), *[c.alias(name) for name, c in where.items()], *sizes)

    def below(n: Column) -> Column:
        def part(key: Column, position: Column, value: Column) -> Column:
            return node(value, n["depth"] + 1, key, position, {f: F.concat(n[f], steps[f](key, position)) for f in fields})

        none = F.lit(None).cast("string")
        listed = F.transform(as_array(n["value"]), lambda x, i: part(none, i, x))
        named = F.transform(let(as_map(n["value"]), sorted_members), lambda e, i: part(e["key"], i, e["value"]))
        return F.when(n["items"].isNotNull(), listed).otherwise(named)

    def opened(above: Column) -> Column:
        return F.flatten(F.transform(F.filter(above, lambda n: F.coalesce(n["items"], n["members"], F.lit(0)) > 0), below))

    root = node(v, F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("int"), {f: roots[f] for f in fields})
    return F.when(v.isNotNull(), every_level(F.array(root), opened))


def nodes(v: Column, *fields: str) -> Column:
    """All nodes of a document, by level: array of value, depth, key, position and those of path, pointer, order and place (the path with * for any index) that are named."""
    return F.transform(_tree(v, *fields), lambda n: F.struct(*[n[c].alias(c) for c in ("value", "depth", "key", "position", *fields)]))


def descendants(df: DataFrame, document: str, keep: list[str]) -> DataFrame:
    """keep, depth, path, pointer, key, position, order (array, sorts in pre-order) and value of every node, the root included."""
    found = df.where(F.col(document).isNotNull()).select(*keep, F.explode(nodes(F.col(document), "path", "pointer", "order")).alias("_node"))
    return found.select(*keep, *[F.col(f"_node.{c}").alias(c) for c in ("depth", "path", "pointer", "key", "position", "order", "value")])


def named(df: DataFrame, document: str, keep: list[str], key: str) -> DataFrame:
    """All members of this name at any depth: keep, depth, key, value."""
    found = F.filter(_tree(F.col(document)), lambda n: n["key"] == key)
    rows = df.select(*keep, F.explode(F.transform(found, lambda n: F.struct(n["depth"].alias("depth"), n["key"].alias("key"), n["value"].alias("value")))).alias("_node"))
    return rows.select(*keep, "_node.*")


def of_kind(df: DataFrame, document: str, keep: list[str], wanted: str) -> DataFrame:
    """All nodes of a kind at any depth: keep, path, pointer, value."""
    return descendants(df, document, keep).where(kind(F.col("value")) == wanted).select(*keep, "path", "pointer", "value")


def leaves(df: DataFrame, document: str, keep: list[str]) -> DataFrame:
    """Scalars and empty containers, with the text of each value."""
    leaf = F.filter(_tree(F.col(document), "path", "pointer"), lambda n: F.coalesce(n["items"], n["members"], F.lit(0)) == 0)
    rows = df.select(*keep, F.explode(F.transform(leaf, lambda n: F.struct(*[n[c].alias(c) for c in ("depth", "path", "pointer", "value")]))).alias("_node")).select(*keep, "_node.*")
    return rows.select(*keep, "depth", "path", "pointer", kind(F.col("value")).alias("kind"), F.to_json("value").alias("text"))


def tree_statistics(df: DataFrame, document: str, keep: list[str]) -> DataFrame:
    """Of each document: nodes, greatest depth, numbers, strings, containers, longest string, longest key and largest array."""
    # containers are known from the descent, so that only scalars are asked for their kind and go along with their value
    container = lambda n: n["items"].isNotNull() | n["members"].isNotNull()
    told = lambda n: F.struct(F.when(~container(n), n["value"]).alias("value"), n["depth"].alias("depth"), F.char_length(n["key"]).alias("key"), n["items"].alias("items"), container(n).alias("container"))
    rows = df.where(F.col(document).isNotNull()).select(*keep, F.explode(F.transform(_tree(F.col(document)), told)).alias("_node"))
    rows = rows.withColumn("kind", scalar_kind(F.col("_node.value")))
    k = F.col("kind")
    return rows.groupBy(*keep).agg(
        F.count("*").alias("n_nodes"),
        F.max("_node.depth").alias("max_depth"),
        F.count_if(k == "number").alias("n_numbers"),
        F.count_if(k == "string").alias("n_strings"),
        F.count_if("_node.container").alias("n_containers"),
        F.coalesce(F.max(F.when(k == "string", F.char_length(F.try_variant_get("_node.value", "$", "string")))), F.lit(0)).alias("longest_string"),
        F.coalesce(F.max("_node.key"), F.lit(0)).alias("longest_key"),
        F.coalesce(F.max("_node.items"), F.lit(0)).alias("largest_array"),
    )


def flattened(v: Column) -> Column:
    """All elements of nested arrays of any depth, as one array<variant>."""

    def one_level(items: Column) -> Column:
        return F.flatten(F.transform(items, lambda x: F.coalesce(as_array(x), F.array(x))))

    return repeated(as_array(v), lambda items: F.exists(items, lambda x: as_array(x).isNotNull()), one_level)
