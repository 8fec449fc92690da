"""Differences, patches and merges of keyed collections as joins, and of documents as Columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtree.functions.paths import follow, pointer_step, steps
from loomtree.functions.values import as_array, as_map, equal, kind, let
from loomtree.operators.descend import every_level


def diff_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, op, pointer, old and new (as text): what turns before into after, by one full outer join on the keys.

    Only pairs that differ reach the explode; a row that is only on one side is one add or remove at its root.
    """
    fields = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.struct(*fields).alias("a"))
    b = after.select(*keys, F.struct(*fields).alias("b"))
    both = a.join(b, keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))

    def change(op: Column | str, pointer: str, old: Column, new: Column) -> Column:
        op = F.lit(op) if isinstance(op, str) else op
        return F.struct(op.alias("op"), F.lit(pointer).alias("pointer"), old.cast("string").alias("old"), new.cast("string").alias("new"))

    null = F.lit(None).cast("string")
    parts = F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), change("replace", f"/{c}", F.col(f"a.{c}"), F.col(f"b.{c}"))) for c in fields])
    found = (
        F.when(F.col("a").isNull(), F.array(change("add", "", null, F.to_json("b"))))
        .when(F.col("b").isNull(), F.array(change("remove", "", F.to_json("a"), null)))
        .otherwise(F.filter(parts, lambda x: x.isNotNull()))
    )
    return both.select(*keys, F.explode(found).alias("change")).select(*keys, "change.*")


def merge_rows(base: DataFrame, patch: DataFrame, keys: list[str], removed: str = "_removed") -> DataFrame:
    """base with patch's rows merged in: non-null fields replace, rows with the flag go, rows of new keys come."""
    fields = [c for c in base.columns if c not in keys]
    a, b = base.select(*keys, F.struct(*fields).alias("a")), patch.select(*keys, F.struct(*[c for c in fields if c in patch.columns]).alias("b"), F.col(removed).alias("_gone"))
    both = a.join(b, keys, "full_outer").where(~F.coalesce("_gone", F.lit(False)))
    return both.select(*keys, *[(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in patch.columns else F.col(f"a.{c}")).alias(c) for c in fields])


def _label(k: Column, old: Column, new: Column) -> Column:
    return F.when(old.isNull(), "added").when(new.isNull(), "removed").when(k, "size changed").when(kind(old) != kind(new), "type changed").otherwise("modified")


def _changes(a: Column, b: Column) -> Column:
    """array<struct<pointer, old, new, shared>> of the places where two documents may differ: shared ones are arrays of other lengths, of the others values are compared later."""

    def pair(pointer: Column, x: Column, y: Column) -> Column:
        """Of two containers of a kind, inside has their parts side by side; of all else it is NULL."""
        none = F.lit(None).cast("string")
        listed = F.zip_with(as_array(x), as_array(y), lambda p, q: F.struct(none.alias("key"), p.alias("a"), q.alias("b")))
        named = F.transform(F.map_entries(F.map_zip_with(as_map(x), as_map(y), lambda _, p, q: F.struct(p.alias("a"), q.alias("b")))), lambda e: F.struct(e["key"].alias("key"), e["value"]["a"].alias("a"), e["value"]["b"].alias("b")))
        return F.struct(pointer.alias("pointer"), x.alias("old"), y.alias("new"), F.coalesce(listed, named).alias("inside"))

    def opened(above: Column) -> Column:
        inner = F.filter(above, lambda n: n["inside"].isNotNull())
        return F.flatten(F.transform(inner, lambda n: F.transform(n["inside"], lambda e, i: pair(F.concat(n["pointer"], pointer_step(e["key"], i)), e["a"], e["b"]))))

    def differ(n: Column) -> Column:
        """The lengths of two arrays, or the types or texts of what is not two containers."""
        types = ~F.schema_of_variant(n["old"]).eqNullSafe(F.schema_of_variant(n["new"]))
        texts = ~F.try_variant_get(n["old"], "$", "string").eqNullSafe(F.try_variant_get(n["new"], "$", "string"))
        last = F.get(n["inside"], F.size(n["inside"]) - 1)
        return F.when(n["inside"].isNull(), types | texts | (F.schema_of_variant(n["old"]) == "BINARY")).otherwise(F.coalesce(last["key"].isNull() & (last["a"].isNull() | last["b"].isNull()), F.lit(False)))

    levels = every_level(F.array(pair(F.lit(""), a, b)), opened)
    found = F.filter(levels, differ)
    return F.transform(found, lambda n: F.struct(n["pointer"].alias("pointer"), n["old"].alias("old"), n["new"].alias("new"), n["inside"].isNotNull().alias("shared")))


def diff_documents(before: DataFrame, after: DataFrame, keys: list[str], document: str) -> DataFrame:
    """keys, pointer, op (add, remove, replace), label, old and new (VARIANT): what turns each document before into that after.

    Objects are compared by name and arrays by place, at any depth; a part that is only on one side is one add or remove, whatever is inside it. One full outer
    join of the documents by key; what two documents share is walked side by side within their row. The label says added, removed, modified, type changed, or size
    changed for an array of another length (a row of its own, with op NULL).
    """

    def side(df: DataFrame, value: str) -> DataFrame:
        return df.where(F.col(document).isNotNull()).select(*keys, F.col(document).alias(value))

    both = side(before, "_old").join(side(after, "_new"), keys, "full_outer")
    both = both.select(*keys, F.explode(_changes(F.col("_old"), F.col("_new"))).alias("_n"))
    both = both.select(*keys, F.col("_n.pointer").alias("pointer"), F.col("_n.old").alias("old"), F.col("_n.new").alias("new"), F.col("_n.shared").alias("_shared"))
    changed = both.where(F.col("_shared") | ~equal(F.col("old"), F.col("new")))
    op = F.when(F.col("_shared"), None).when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").otherwise("replace")
    label = _label(F.col("_shared"), F.col("old"), F.col("new"))
    return changed.select(*keys, "pointer", op.alias("op"), label.alias("label"), "old", "new")


def _empty_map() -> Column:
    return F.map_from_entries(F.array().cast("array<struct<key:string,value:variant>>"))


def _zipped(a: Column, b: Column, kept: Callable, opens: Callable, value: Callable, depth: int, deeper: str) -> Column:
    """Two maps made one, as map<string,variant>: of each name kept(x, y), where a side may be NULL, value(x, y), or what comes of the two objects if opens(x, y).

    Level by level down, an object with what is already known of it and the pairs of objects to open; then up again, where each object takes its parts from the level below.
    """

    def side_by_side(name: Column, x: Column, y: Column) -> Column:
        pairs = F.map_entries(F.map_zip_with(x, y, lambda _, p, q: F.struct(p.alias("a"), q.alias("b"))))
        there = F.filter(pairs, lambda e: kept(e["value"]["a"], e["value"]["b"]))
        marked = F.transform(there, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), opens(e["value"]["a"], e["value"]["b"]).alias("opens")))

        def parted(m: Column) -> Column:
            known = F.transform(F.filter(m, lambda e: ~e["opens"]), lambda e: F.struct(e["key"].alias("key"), value(e["value"]["a"], e["value"]["b"]).alias("value")))
            return F.struct(name.alias("name"), known.alias("known"), F.filter(m, lambda e: e["opens"]).alias("open"))

        return let(marked, parted)

    def opened(above: Column) -> Column:
        return F.flatten(F.transform(above, lambda o: F.transform(o["open"], lambda e: side_by_side(e["key"], F.coalesce(as_map(e["value"]["a"]), _empty_map()), as_map(e["value"]["b"])))))

    def is_open(levels: Column) -> Column:
        return F.exists(F.element_at(levels, -1), lambda o: F.size(o["open"]) > 0)

    root = side_by_side(F.lit(""), a, b)
    rounds = F.sequence(F.lit(1), F.lit(depth - 1)) if depth > 1 else F.array().cast("array<int>")
    down = F.aggregate(rounds, F.array(F.array(root)), lambda levels, _: F.when(is_open(levels), F.concat(levels, F.array(opened(F.element_at(levels, -1))))).otherwise(levels))

    def starts(level: Column) -> Column:
        return F.aggregate(level, F.array(F.lit(0)), lambda at, o: F.concat(at, F.array(F.element_at(at, -1) + F.size(o["open"]))))

    def up(below: Column, level: Column) -> Column:
        def whole(o: Column, at: Column) -> Column:
            return F.map_from_entries(F.concat(o["known"], F.slice(below, at + 1, F.size(o["open"]))))

        return F.zip_with(level, F.slice(starts(level), F.lit(1), F.size(level)), lambda o, at: F.struct(o["name"].alias("key"), F.to_variant_object(whole(o, at)).alias("value")))

    def rebuilt(levels: Column) -> Column:
        none = F.array().cast("array<struct<key:string,value:variant>>")
        # the root's own map is given, not its object
        below = F.aggregate(F.reverse(F.slice(levels, F.lit(2), F.size(levels) - 1)), none, up)
        return F.map_from_entries(F.concat(F.get(F.get(levels, F.lit(0)), F.lit(0))["known"], below))

    too_deep = F.raise_error(F.lit(deeper)).cast("map<string,variant>")
    return let(down, lambda levels: F.when(is_open(levels), too_deep).otherwise(rebuilt(levels)))


def merge_patch(target: Column, patch: Column, depth: int = 20, keep_nulls: bool = False) -> Column:
    """Merges a patch into a document, as map<string,variant>: null members delete (or stay, with keep_nulls), objects merge.

    A patch of more than depth levels raises an error.
    """

    def kept(_: Column, y: Column) -> Column:
        return F.lit(True) if keep_nulls else y.isNull() | ~F.is_variant_null(y)

    def merged(t: Column, p: Column) -> Column:
        return _zipped(t, p, kept, lambda _, y: as_map(y).isNotNull(), lambda x, y: F.coalesce(y, x), depth, "a patch has more levels than merge_patch() merges")

    return let(F.struct(F.coalesce(as_map(target), _empty_map()).alias("t"), as_map(patch).alias("p")), lambda s: F.when(s["p"].isNotNull(), merged(s["t"], s["p"])))


def create_merge_patch(before: Column, after: Column, depth: int = 8) -> Column:
    """The merge patch that turns before into after, a VARIANT: {} if they are equal, after itself if a side is no object.

    Objects that differ more than depth levels down raise an error.
    """

    def opens(x: Column, y: Column) -> Column:
        return as_map(x).isNotNull() & as_map(y).isNotNull()

    def made(a: Column, b: Column) -> Column:
        null = F.parse_json(F.lit("null"))
        return F.to_variant_object(_zipped(a, b, lambda x, y: ~equal(x, y), opens, lambda _, y: F.coalesce(y, null), depth, "documents have more levels than create_merge_patch() compares"))

    sides = F.struct(as_map(before).alias("a"), as_map(after).alias("b"), after.alias("after"))
    return let(sides, lambda s: F.when(s["a"].isNotNull() & s["b"].isNotNull(), made(s["a"], s["b"])).otherwise(s["after"]))


def merge_all(*documents: Column, keep_nulls: bool = False) -> Column:
    """Documents merged left to right, a VARIANT; a NULL one changes nothing, one that is no object replaces all before it."""
    out = documents[0]
    for d in documents[1:]:

        def step(below: Column, above: Column) -> Column:
            return F.when(above.isNull(), below).when(as_map(above).isNotNull(), F.to_variant_object(merge_patch(below, above, keep_nulls=keep_nulls))).otherwise(above)

        out = let(F.struct(out.alias("below"), d.alias("above")), lambda s: step(s["below"], s["above"]))
    return out


# -- edits at pointers --------------------------------------------------------------------------------------------------------


def _index(step: str) -> int | None:
    return int(step) if step.isdigit() and (step == "0" or step[0] != "0") else None


def _edited(v: Column, path: Sequence[str], at_member: Callable, at_element: Callable, made: Callable | None) -> Column:
    """A document with the last step of path edited; NULL where the path leads nowhere, unless made gives what is missing."""
    step, rest = path[0], path[1:]
    n = _index(step)

    def inner(x: Column) -> Column:
        return _edited(x, rest, at_member, at_element, made)

    def in_object(m: Column) -> Column:
        if not rest:
            return F.to_variant_object(at_member(m, step))
        other = F.map_filter(m, lambda k, _: k != step)
        put = let(inner(F.try_element_at(m, F.lit(step))), lambda x: F.when(x.isNotNull(), F.to_variant_object(F.map_concat(other, F.create_map(F.lit(step), x)))))
        return put if made else F.when(F.map_contains_key(m, step), put)

    def in_array(items: Column) -> Column:
        if not rest:
            return let(at_element(items, step, n), lambda x: F.when(x.isNotNull(), F.to_variant_object(x)))
        if n is None:
            return F.lit(None).cast("variant")
        put = let(inner(F.get(items, F.lit(n))), lambda x: F.when(x.isNotNull(), F.to_variant_object(F.transform(items, lambda y, i: F.when(i == n, x).otherwise(y)))))
        return F.when(F.size(items) > n, put)

    found = F.when(as_array(v).isNotNull(), let(as_array(v), in_array)).when(as_map(v).isNotNull(), let(as_map(v), in_object))
    return found.otherwise(in_object(_empty_map())) if made else found


def _put(m: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != name), F.create_map(F.lit(name), value))


def add_at(v: Column, path: Sequence[str], value: Column) -> Column:
    """RFC 6902 add: a member is set, an element inserted, - appends; NULL if the place above is missing."""
    if not path:
        return value

    def element(items: Column, step: str, n: int | None) -> Column:
        if step == "-":
            return F.concat(items, F.array(value))
        if n is None:
            return F.lit(None).cast("array<variant>")
        return F.when(F.size(items) >= n, F.concat(F.slice(items, 1, n), F.array(value), F.slice(items, n + 1, 1 << 30)))

    return let(v, lambda d: _edited(d, path, lambda m, name: _put(m, name, value), element, None))


def replace_at(v: Column, path: Sequence[str], value: Column) -> Column:
    """RFC 6902 replace: NULL if there is nothing at the place."""
    if not path:
        return value

    def element(items: Column, step: str, n: int | None) -> Column:
        return F.lit(None).cast("array<variant>") if n is None else F.when(F.size(items) > n, F.transform(items, lambda y, i: F.when(i == n, value).otherwise(y)))

    return let(v, lambda d: _edited(d, path, lambda m, name: F.when(F.map_contains_key(m, name), _put(m, name, value)), element, None))


def remove_at(v: Column, path: Sequence[str]) -> Column:
    """RFC 6902 remove: NULL if there is nothing at the place, or for the root."""
    if not path:
        return F.lit(None).cast("variant")

    def element(items: Column, step: str, n: int | None) -> Column:
        return F.lit(None).cast("array<variant>") if n is None else F.when(F.size(items) > n, F.filter(items, lambda y, i: i != n))

    return let(v, lambda d: _edited(d, path, lambda m, name: F.when(F.map_contains_key(m, name), F.map_filter(m, lambda k, _: k != name)), element, None))


def set_at(v: Column, path: Sequence[str], value: Column) -> Column:
    """A document with the value at the path: objects that are missing on the way are made, arrays are filled with nulls up to the place."""
    if not path:
        return value
    step, n = path[0], _index(path[0])

    def in_object(m: Column) -> Column:
        return F.to_variant_object(_put(m, step, set_at(F.try_element_at(m, F.lit(step)), path[1:], value)))

    def in_array(items: Column) -> Column:
        null = F.parse_json(F.lit("null"))
        padded = F.concat(items, F.array_repeat(null, F.greatest(F.lit(n + 1) - F.size(items), F.lit(0))))
        return F.to_variant_object(F.transform(padded, lambda y, i: F.when(i == n, set_at(y, path[1:], value)).otherwise(y)))

    new = in_object(_empty_map()) if n is None else in_array(F.array().cast("array<variant>"))
    out = F.when(as_map(v).isNotNull(), let(as_map(v), in_object))
    return (out if n is None else out.when(as_array(v).isNotNull(), let(as_array(v), in_array))).otherwise(new)


def apply_document_patch(document: Column, operations: Sequence[dict]) -> Column:
    """A document after add, remove, replace, move, copy and test at pointers; NULL if any fails, so that a patch is whole or not at all.

    Values are Python values or Columns (VARIANT). More than about three operations on deep paths need a higher spark.sql.analyzer.maxIterations.
    """

    def value(op: dict) -> Column:
        return op["value"] if isinstance(op["value"], Column) else F.parse_json(F.lit(json.dumps(op["value"])))

    def run(d: Column, rest: Sequence[dict]) -> Column:
        if not rest:
            return d
        op, path = rest[0], steps(rest[0]["path"])
        if op["op"] == "add":
            new = add_at(d, path, value(op))
        elif op["op"] == "replace":
            new = replace_at(d, path, value(op))
        elif op["op"] == "remove":
            new = remove_at(d, path)
        elif op["op"] == "test":
            new = F.when(equal(follow(d, path), value(op)), d)
        elif op["op"] in ("copy", "move"):
            source = steps(op["from"])
            if op["op"] == "move" and path[: len(source)] == source and path != source:
                raise ValueError("a place can't be moved into itself")
            base = remove_at(d, source) if op["op"] == "move" else d
            new = let(follow(d, source), lambda x: F.when(x.isNotNull(), add_at(base, path, x)))
        else:
            raise ValueError(f"no such operation: {op['op']}")
        return let(new, lambda x: F.when(x.isNotNull(), run(x, rest[1:])))

    return run(document, operations)


def apply_patch(row: Column, operations: Sequence[dict]) -> Column:
    """A struct column after add, replace, remove, move and copy; NULL if a test fails, so that a patch is whole or not at all."""
    ok = F.lit(True)

    def at(path: list[str]) -> Column:
        out = row
        for p in path:
            out = out[p]
        return out

    for op in operations:
        path = steps(op["path"])
        name = ".".join(f"`{p}`" for p in path)
        if op["op"] == "test":
            ok = ok & at(path).eqNullSafe(F.lit(op["value"]))
        elif op["op"] in ("add", "replace"):
            row = row.withField(name, F.lit(op["value"]))
        elif op["op"] == "remove":
            row = row.dropFields(name)
        elif op["op"] in ("copy", "move"):
            source = steps(op["from"])
            row = row.withField(name, at(source))
            row = row.dropFields(".".join(f"`{p}`" for p in source)) if op["op"] == "move" else row
        else:
            raise ValueError(f"no such operation: {op['op']}")
    return F.when(ok, row)
