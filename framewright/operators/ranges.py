"""Ranks and running sums within groups of any size: rows are dealt by ranges of their order, and the ranges' sums are put before them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: list[str] = []
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; where it is unset on a local master (tests), one of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="framewright-"))
    return _local[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, with rows in the partitions that they were in."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _stored.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> int:
    """Removes the tables that operators have stored so far, for callers that have written what depends on them; returns their number."""
    n, conf = len(_stored), spark.sparkContext._jsc.hadoopConfiguration()
    for path in _stored[:n]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del _stored[:n]
    return n


def running(rows: DataFrame, group: list[str], order: list[Column], into: str, value: Column | None = None) -> DataFrame:
    """Adds into: how many rows (or what sum of value) the group has before this one, in an ascending order (of values, not of sort directions) without ties. No task holds a group, only a range of it.

    Ranks need one shuffle: rows are sorted within their ranges, and where they lie there gives the rank once the rows of a group in the ranges before are known. Those counts, one
    a group and range, are stored, so that Spark knows their size when it chooses how to join them. Columns named __p, __g, __v, __o, __i and __k0 onwards are the function's own. Null groups are groups."""
    g = F.to_json(F.struct(*group)) if group else F.lit("")
    rows = rows.withColumn("__g", g)
    before = lambda what, w: F.coalesce(F.sum(what).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = Window.partitionBy("__g").orderBy("__p")
    if value is None:
        # the order's values as columns: a sort would work them out at each comparison
        by = {f"__k{k}": c for k, c in enumerate(order)}
        ranged = rows.withColumns(by).repartitionByRange("__g", *by).sortWithinPartitions("__g", *by).drop(*by).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
        ranged = stored(ranged, "ranges")
        sums = ranged.groupBy("__g", "__p").agg(F.count(F.lit(1)).alias("__s"), F.min("__i").alias("__f"))
        sums = stored(sums.select("__g", "__p", (before("__s", earlier) - F.col("__f")).alias("__o")), "sums")
        return ranged.join(sums, ["__g", "__p"]).withColumn(into, F.col("__o") + F.col("__i")).drop("__g", "__p", "__o", "__i")
    ranged = rows.withColumn("__v", value).repartitionByRange("__g", *order)
    ranged = stored(ranged.withColumn("__p", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__g", "__p").agg(F.sum("__v").alias("__s"))
    sums = sums.select("__g", "__p", before("__s", earlier).alias("__o"))
    inner = before("__v", Window.partitionBy("__g", "__p").orderBy(*order))
    return ranged.join(sums, ["__g", "__p"]).withColumn(into, F.col("__o") + inner).drop("__g", "__p", "__v", "__o")
