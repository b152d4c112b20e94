"""Ranks and running sums within groups, against plain sorting."""

from collections import defaultdict

import pytest
from framewright.operators.ranges import running
from pyspark.sql import functions as F


def table(spark, n):
    """Two thirds of the rows in one group, some without a group, and groups of one."""
    group = F.when(F.col("id") % 3 < 2, F.lit("hot")).when(F.col("id") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("id").cast("string"))
    return spark.range(n).select(F.xxhash64("id").alias("key"), group.alias("g"), (F.col("id") % 7).alias("v"))


@pytest.mark.parametrize("n,tasks", [(0, 3), (1, 3), (5000, 2), (5000, 40)])
@pytest.mark.parametrize("group", [[], ["g"]])
@pytest.mark.parametrize("value", [None, "v"])
def test_ranks_and_sums(spark, n, tasks, group, value):
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    out = running(table(spark, n), group, [F.col("key")], "at", F.col(value) if value else None).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(out) == n
    groups = defaultdict(list)
    for r in out:
        groups[r.g if group else ""].append(r)
    for rows in groups.values():
        done = 0
        for r in sorted(rows, key=lambda r: r.key):
            assert r["at"] == done
            done += r.v if value else 1


def test_a_rank_shuffles_rows_once(spark):
    plan = running(table(spark, 500), ["g"], [F.col("key")], "at")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Window" not in plan
