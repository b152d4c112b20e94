"""Queries on schema trees: folded over episodes, compared strictly, merged over corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import schemas
from framewright.plans.tables import rounded, table


def _nodes(spark: SparkSession, sf_dir: str, odd: bool) -> DataFrame:
    """An order's lines as an episode of the robot of its priority: arm (a position of two numbers, a rotation of one) and base. odd: some orders without a rotation, some with another representation."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("robot")), "l_orderkey")
    c = lambda *names: F.array(*names)
    rows = rows.groupBy("robot", F.col("l_orderkey").alias("episode")).agg(
        F.collect_list(c("l_quantity", "l_extendedprice")).alias("position"), F.collect_list(c("l_tax")).alias("rotation"), F.collect_list(c("l_discount", "l_tax", "l_quantity")).alias("base"))
    leaf = lambda kind, relative, name, data: F.struct(F.lit(kind).alias("type"), F.lit(relative).alias("is_relative"), F.lit(True).alias("allow_relative"), name.alias("representation"), F.col(data).alias("data"))
    other = F.lit(odd) & (F.col("episode") % 97 == 5)
    rotation = leaf("Rotation", False, F.when(other, "quat_xyzw").otherwise("euler_xyz"), "rotation")
    rotation = F.when(~(F.lit(odd) & (F.col("episode") % 89 == 7)), rotation)
    arm = F.struct(F.lit("Arm").alias("type"), leaf("Position", True, F.lit(None).cast("string"), "position").alias("position"), rotation.alias("rotation"))
    tree = F.struct(F.lit("RobotState").alias("type"), arm.alias("arm"), leaf("Position", False, F.lit(None).cast("string"), "base").alias("base"))
    return schemas.schema_rows(rows.withColumn("tree", tree), ["robot", "episode"], "tree").withColumn("position", F.col("episode"))


def schema_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each robot's tree over all its episodes, three levels deep."""
    return rounded(schemas.fold_schemas(_nodes(spark, sf_dir, False), "robot", "position"), 4)


_VALUES = "l AS (SELECT o_orderpriority AS robot, l_orderkey, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey), v AS (" + " UNION ALL ".join(
    f"SELECT robot, '{path}' AS path, {i} AS i, {place} AS place, '{kind}' AS type, {relative} AS is_relative, {name} AS representation, {dim} AS dim, {x} AS x, l_orderkey FROM l"
    for path, i, place, kind, relative, name, dim, x in [("arm.position", 0, 2, "Position", "true", "NULL::VARCHAR", 2, "q"), ("arm.position", 1, 2, "Position", "true", "NULL::VARCHAR", 2, "p"), ("arm.rotation", 0, 3, "Rotation", "false", "'euler_xyz'", 1, "t"), ("base", 0, 4, "Position", "false", "NULL::VARCHAR", 3, "d"), ("base", 1, 4, "Position", "false", "NULL::VARCHAR", 3, "t"), ("base", 2, 4, "Position", "false", "NULL::VARCHAR", 3, "q")]
) + ")"
_FOLD = f"""WITH {_VALUES} SELECT robot, path, i, min(l_orderkey) AS first, place, type, is_relative, true AS allow_relative, representation, dim, count(*) AS n, round(avg(x), 4) AS mean, round(coalesce(stddev_samp(x), 0), 4) AS std,
round(min(x), 4) AS "min", round(max(x), 4) AS "max", round(quantile_cont(x, 0.01), 4) AS q01, round(quantile_cont(x, 0.99), 4) AS q99 FROM v GROUP BY robot, path, i, place, type, is_relative, representation, dim"""


def schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees folded over two halves of the episodes, and merged without their rows."""
    nodes = _nodes(spark, sf_dir, False)
    halves = [schemas.fold_schemas(nodes.where(F.col("episode") % 2 == k), "robot", "position") for k in (0, 1)]
    return rounded(schemas.merge_folds(halves, "robot").select("robot", "path", "i", "place", "type", "dim", "n", "mean", "std", "min", "max", "q01", "q99"), 4)


_MERGE = f"""WITH {_VALUES}, h AS (SELECT robot, path, i, place, type, dim, l_orderkey % 2 AS half, count(*) AS n, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM v GROUP BY ALL),
m AS (SELECT robot, path, i, place, type, dim, sum(n)::BIGINT AS n, sum(n * mean) / sum(n) AS mean, sum(n * (std * std + mean * mean)) / sum(n) AS second, min(lo) AS lo, max(hi) AS hi, sum(n * q01) / sum(n) AS q01, sum(n * q99) / sum(n) AS q99 FROM h GROUP BY ALL)
SELECT robot, path, i, place, type, dim, n, round(mean, 4) AS mean, round(sqrt(greatest(0, second - mean * mean)), 4) AS std, round(lo, 4) AS "min", round(hi, 4) AS "max", round(q01, 4) AS q01, round(q99, 4) AS q99 FROM m"""


def schema_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes whose trees a strict merge refuses, and where each differs first."""
    return schemas.schema_differences(_nodes(spark, sf_dir, True), "robot", "episode", "position")


_DIFFERENCES = """WITH e AS (SELECT DISTINCT o_orderpriority AS robot, l_orderkey AS episode, l_orderkey % 89 = 7 AS lacks, CASE WHEN l_orderkey % 97 = 5 THEN 'quat_xyzw' ELSE 'euler_xyz' END AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT *, first(lacks) OVER w AS was_lacking, first(name) OVER w AS was, min(episode) OVER (PARTITION BY robot) AS first FROM e WINDOW w AS (PARTITION BY robot ORDER BY episode)),
d AS (SELECT *, CASE WHEN lacks <> was_lacking THEN 'fields' WHEN NOT lacks AND name <> was THEN 'representation' END AS what FROM f WHERE episode <> first)
SELECT robot, episode, episode AS position, CASE WHEN what = 'fields' THEN 'arm' ELSE 'arm.rotation' END AS path, what, CASE WHEN what <> 'fields' THEN was WHEN was_lacking THEN 'position' ELSE 'position,rotation' END AS existing,
CASE WHEN what <> 'fields' THEN name WHEN lacks THEN 'position' ELSE 'position,rotation' END AS new FROM d WHERE what IS NOT NULL"""

QUERIES = {
    "schema_fold": (schema_fold, _FOLD),
    "schema_merge": (schema_merge, _MERGE),
    "schema_conflicts": (schema_conflicts, _DIFFERENCES),
}
