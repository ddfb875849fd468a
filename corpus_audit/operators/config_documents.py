"""Whole configuration documents of many projects, resolved layer by layer.

A document is the JSON text of one layer of one project.  It is read as a variant and taken apart level by level into
nodes: tables, arrays and scalars with the steps that lead to them.  Layers are merged from the lowest to the highest:

- tables merge key by key, at any depth;
- arrays merge by the rule of ``layered.merge_keyed_arrays``, one layer after the other: by ``code`` if every item of both
  sides is a table that has one, else by ``id``, else items are appended;
- anything else replaces what lower layers hold at that place, with all that lies below it, and what a still higher layer
  brings starts anew.

So a node counts if no table on its way was replaced by something else in its own or a higher layer.  Such places are few:
only they are joined with the nodes below them.  The rest is one aggregation by place; arrays are folded in the row of their
place, which holds as many items as the documents themselves.

Defined cases: rows without project, layer or document, texts that are no JSON and documents that are no table are left
out and returned by ``unreadable``; of several documents of one project and layer the one with the greater text counts; keys of
items are equal if they are written alike; values are JSON texts with the keys of tables in order; a table without any key
is a value of its own, ``{}``, where no layer adds a key; a key with dots makes a path that looks like a longer one, while
``steps`` tells both apart; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PLACE = ["project", "steps"]
NODE = [*PLACE, "layer", "kind", "size", "value", "items"]


def _table(value: str) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _parsed(documents: DataFrame) -> DataFrame:
    """(project, layer, root) of the documents that count; ``root`` is null if a document is no table."""
    known = documents.filter("project IS NOT NULL AND layer IS NOT NULL AND document IS NOT NULL")
    single = known.groupBy("project", F.col("layer").cast("long").alias("layer")).agg(F.max("document").alias("document"))
    return single.withColumn("parsed", F.try_parse_json("document")).select("project", "layer", _table("parsed").alias("root"))


def unreadable(documents: DataFrame) -> DataFrame:
    """(project, layer, error) for every row that ``resolve`` leaves out."""
    table = _table("parsed")
    error = (F.when(F.col("project").isNull() | F.col("layer").isNull(), "no project or layer")
             .when(F.col("document").isNull(), "no document").when(F.col("parsed").isNull(), "no JSON")
             .when(table.isNull(), "no table"))
    return (documents.withColumn("parsed", F.try_parse_json("document")).withColumn("error", error)
            .filter("error IS NOT NULL").select("project", F.col("layer").cast("long").alias("layer"), "error"))


def _items(values: Column) -> Column:
    """Items of an array with the keys by which they may be merged; null where an item has none."""
    def key(item: Column, name: str) -> Column:
        return F.nullif(F.to_json(F.try_variant_get(item, f"$.{name}", "variant")), F.lit("null"))
    return F.transform(values, lambda item: F.struct(key(item, "code").alias("code"), key(item, "id").alias("id"),
                                                     F.to_json(item).alias("item")))


def nodes(documents: DataFrame) -> DataFrame:
    """Every table, array and scalar of every document, a level of nesting per round."""
    level = _parsed(documents).filter("root IS NOT NULL").withColumn("steps", F.expr("CAST(array() AS array<string>)"))
    levels = []
    while True:
        children = level.select("project", "layer", "steps", F.explode("root").alias("key", "child"))
        children = (children.withColumn("steps", F.concat("steps", F.array("key"))).withColumn("root", _table("child"))
                    .withColumn("values", F.try_variant_get("child", "$", "array<variant>")))
        kind = F.when(F.col("root").isNotNull(), "table").when(F.col("values").isNotNull(), "array").otherwise("scalar")
        children = cut_lineage(children.select(
            *PLACE, "layer", kind.alias("kind"), F.coalesce(F.size("root"), F.lit(0)).alias("size"),
            F.when(kind == "scalar", F.to_json("child")).alias("value"), _items(F.col("values")).alias("items"), "root"))
        levels.append(children.select(*NODE))
        level = children.filter("size > 0").select("project", "layer", "steps", "root")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def _standing(every: DataFrame) -> DataFrame:
    """The nodes whose way down was not replaced by something that is no table."""
    replaced = (every.groupBy(*PLACE).agg(F.max(F.when(F.col("kind") != "table", F.col("layer"))).alias("until"),
                                          F.max(F.when(F.col("size") > 0, F.col("layer"))).alias("filled"))
                .filter("until IS NOT NULL AND filled IS NOT NULL").select("project", F.col("steps").alias("above"), "until"))
    ways = every.filter("size(steps) > 1").select(*PLACE, "layer", F.explode(
        F.transform(F.sequence(F.lit(1), F.size("steps") - 1), lambda n: F.slice("steps", 1, n))).alias("above"))
    gone = ways.join(replaced, ["project", "above"]).filter("layer <= until").select(*PLACE, "layer").distinct()
    return every.join(gone, [*PLACE, "layer"], "left_anti")


def _by_key(old: Column, new: Column, name: str) -> Column:
    """``old`` with the items of ``new``: the same key takes the place, a new key goes to the end."""
    old_keys, new_keys = (F.transform(side, lambda x: x[name]) for side in (old, new))

    def last(keys: Column, key: Column) -> Column:
        return F.size(keys) - F.array_position(F.reverse(keys), key)

    def latest(x: Column) -> Column:
        return F.get(new, last(new_keys, x[name]).cast("int"))
    placed = F.transform(old, lambda x, at: F.when(
        F.array_contains(new_keys, x[name]) & (at == last(old_keys, x[name])), latest(x)).otherwise(x))
    first = F.filter(new, lambda x, at: ~F.array_contains(old_keys, x[name]) & (F.array_position(new_keys, x[name]) == at + 1))
    return F.concat(placed, F.transform(first, latest))


def _merged(old: Column, new: Column) -> Column:
    both = F.concat(old, new)
    return (F.when(F.forall(both, lambda x: x["code"].isNotNull()), _by_key(old, new, "code"))
            .when(F.forall(both, lambda x: x["id"].isNotNull()), _by_key(old, new, "id")).otherwise(both))


def resolve(documents: DataFrame) -> DataFrame:
    """(project, steps, path, kind, value, layer) of every value of the merged documents (project, layer, document).

    ``layer`` is the highest layer that has a part in the value.
    """
    def highest(condition: Column) -> Column:
        return F.max(F.when(condition, F.col("layer")))
    kind = F.col("kind")
    places = _standing(nodes(documents)).groupBy(*PLACE).agg(
        F.max("layer").alias("layer"), F.max_by("kind", "layer").alias("kind"), F.max_by("value", "layer").alias("scalar"),
        highest(kind != "array").alias("not_array"), highest(kind != "table").alias("not_table"),
        highest(F.col("size") > 0).alias("filled"),
        F.collect_list(F.when(kind == "array", F.struct("layer", "items"))).alias("arrays"))
    lowest = F.lit(-(1 << 63))
    arrays = F.transform(F.filter(F.array_sort("arrays"), lambda a: a["layer"] > F.coalesce("not_array", lowest)), lambda a: a["items"])
    folded = F.aggregate(F.slice("own", 2, F.greatest(F.size("own"), F.lit(1))), F.col("own")[0], _merged)
    written = F.concat(F.lit("["), F.array_join(F.transform(folded, lambda x: x["item"]), ","), F.lit("]"))
    value = F.when(kind == "scalar", F.col("scalar")).when(kind == "array", written).otherwise("{}")
    bare = F.col("filled").isNull() | (F.col("filled") <= F.coalesce("not_table", lowest))
    return (places.filter((kind != "table") | bare).withColumn("own", F.when(kind == "array", arrays))
            .select(*PLACE, F.array_join("steps", ".").alias("path"), "kind", value.alias("value"), "layer"))
