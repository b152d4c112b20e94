"""Schemas of robots as trees: leaves are positions and rotations with their statistics, composites hold leaves or further composites.

A tree is a struct column of any depth. A struct with a field data (rows of numbers, a row a frame) is a leaf, and its other fields say what it is; any other struct is a composite whose field type names it.
A null field isn't there. Trees become rows by path, so that episodes are folded, merged and compared by joins and sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framewright.operators.ranges import stored
from framewright.operators.statistics import merge_stats, repeated_leaf_stats

#: What two leaves of one path must have alike, in the order in which they are compared.
LEAF_META = ("type", "is_relative", "allow_relative", "representation", "dim")
_NODE = "struct<path:string,place:int,parent:string,leaf:boolean,type:string,is_relative:boolean,allow_relative:boolean,representation:string,dim:int,data:array<array<double>>>"


def _nodes(column: Column, kind: StructType, path: str, parent: str | None) -> list[Column]:
    """All nodes of a tree in their order, the root first; null where a node isn't there."""
    names = kind.fieldNames()
    leaf = "data" in names
    field = lambda name, as_: (column[name] if name in names else F.lit(None)).cast(as_).alias(name)
    data = field("data", "array<array<double>>")
    dim = F.size(F.get(data, F.lit(0))) if leaf else F.lit(None)
    own = [F.lit(path).alias("path"), F.lit(0).alias("place"), F.lit(parent).cast("string").alias("parent"), F.lit(leaf).alias("leaf"), field("type", "string"), field("is_relative", "boolean"), field("allow_relative", "boolean"), field("representation", "string"), dim.cast("int").alias("dim"), data]
    out = [F.when(column.isNotNull(), F.struct(*own)).cast(_NODE)]
    for f in kind.fields if not leaf else []:
        if isinstance(f.dataType, StructType):
            out += _nodes(column[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, path)
    return out


def schema_rows(rows: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """keys, and a row a node of each row's tree: path ("" for the root), place (its number in the tree's order), parent, leaf, what a leaf is, and its data."""
    nodes = _nodes(F.col(tree), rows.schema[tree].dataType, "", None)
    placed = F.filter(F.transform(F.array(*nodes), lambda x, i: F.when(x.isNotNull(), x.withField("place", i.cast("int")))), lambda x: x.isNotNull())
    return rows.select(*keys, F.explode(placed).alias("__node")).select(*keys, "__node.*")


def schema_differences(nodes: DataFrame, robot: str, episode: str, position: str) -> DataFrame:
    """nodes: schema_rows with robot, episode and position (an order of a robot's episodes without ties). A row an episode that a strict merge refuses: where its tree differs first from the tree
    of the robot's first episode, in the tree's order: path, what (fields, or the part of a leaf or composite that differs), and both sides' values.

    Rows without a robot aren't compared. Field sets are compared at each composite, by the names below it; then what its fields are."""
    meta = [F.col(c).cast("string").alias(c) for c in LEAF_META]
    kind = F.when(F.col("leaf"), "leaf").otherwise("composite")
    name = F.regexp_extract("path", r"([^.]*)$", 1)
    # a row an episode, without its data: made once, and only those that differ from the first are taken apart again
    trees = nodes.where(F.col(robot).isNotNull()).groupBy(robot, episode, position).agg(F.sort_array(F.collect_list(F.struct("place", "path", "parent", name.alias("name"), kind.alias("kind"), *meta))).alias("__tree"))
    trees = stored(trees, "schema-trees")
    first = stored(trees.groupBy(robot).agg(F.min(position).alias("__first"), F.min_by("__tree", position).alias("__of")), "schema-first")
    trees = trees.join(first, robot).where((F.col(position) != F.col("__first")) & ~F.col("__tree").eqNullSafe(F.col("__of")))

    def described(rows: DataFrame, tree: str, *keys: str) -> DataFrame:
        rows = rows.select(*keys, tree, F.explode(tree).alias("__n")).select(*keys, tree, "__n.*")
        below = F.transform(F.filter(tree, lambda n: n["parent"] == F.col("path")), lambda n: n["name"])
        fields = F.when(F.size(below) > 0, F.array_join(F.array_sort(below), ","))
        values = F.create_map(*[x for c in ("fields", "kind", *LEAF_META) for x in (F.lit(c), fields if c == "fields" else F.col(c))])
        return rows.select(*keys, "path", "place", values.alias("values"))

    existing = described(first, "__of", robot).select(robot, "path", F.col("values").alias("existing"))
    met = described(trees, "__tree", robot, episode, position).join(existing, [robot, "path"])
    # a path that one side lacks is told by the fields of the composite above it
    apart = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("what"), F.col("existing")[c].alias("existing"), F.col("values")[c].alias("new")) for k, c in enumerate(("fields", "kind", *LEAF_META))]), lambda d: ~d["existing"].eqNullSafe(d["new"]))
    met = met.withColumn("__d", F.get(apart, F.lit(0))).where(F.col("__d").isNotNull())
    least = met.groupBy(robot, episode, position).agg(F.min(F.struct("place", "path", "__d")).alias("__at"))
    return least.select(robot, episode, position, "__at.path", "__at.__d.what", "__at.__d.existing", "__at.__d.new")


def fold_schemas(nodes: DataFrame, robot: str, position: str) -> DataFrame:
    """One tree a robot over all its episodes, as rows of its leaves' dimensions: robot, path, i, what the leaf is (of the first episode), first and place (the order in which robots and fields
    were first seen), and count, mean, std (n - 1), min, max, q01 and q99 over all rows of data. Episodes that schema_differences names are to be refused before."""
    leaves = nodes.where("leaf")
    described = leaves.groupBy(robot, "path").agg(F.min_by(F.struct("place", *LEAF_META), position).alias("m"), F.min(position).alias("first"))
    values = leaves.select(robot, "path", F.explode("data").alias("row")).select(robot, "path", F.posexplode("row").alias("i", "x"))
    # the trees are made twice only: for what leaves are, and for how often each value stands in its dimension
    values = stored(values.groupBy(robot, "path", "i", "x").agg(F.count(F.lit(1)).alias("__times")), "schema-values")
    stats = repeated_leaf_stats(values, [robot, "path", "i"], "x", "__times")
    return stats.join(described, [robot, "path"]).select(robot, "path", "i", "first", "m.*", *[c for c in stats.columns if c not in (robot, "path", "i")])


def merge_folds(folds: list[DataFrame], robot: str) -> DataFrame:
    """Folded trees of several corpora in one: means and quantiles weighted by rows, variances pooled about the common mean. A robot or field that only some have is kept; a leaf that two
    describe differently is an error. Robots and fields come in the order of the corpora in which they are first seen."""
    rows = reduce(DataFrame.unionByName, [f.withColumn("first", F.struct(F.lit(k).alias("corpus"), F.col("first").cast("string").alias("first"))) for k, f in enumerate(folds)])
    meta = rows.groupBy(robot, "path", "i").agg(F.min_by(F.struct("place", *LEAF_META), "first").alias("m"), F.min("first").alias("first"), F.count_distinct(F.to_json(F.struct(*LEAF_META))).alias("kinds"))
    refused = F.raise_error(F.concat(F.lit("leaves that differ: "), F.col(robot).cast("string"), F.lit(" "), "path")).cast("int")
    meta = meta.select(robot, "path", "i", "m.*", "first", F.when(F.col("kinds") > 1, refused).otherwise(F.col("kinds").cast("int")).alias("kinds"))
    merged = merge_stats(rows, [robot, "path", "i"])
    return merged.join(meta.where("kinds = 1"), [robot, "path", "i"])
