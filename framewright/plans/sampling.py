"""Queries on deterministic samples, epochs and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import sampling
from framewright.plans.tables import table


def _key(seed: int, *columns: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(columns)})), 1, 15))::BIGINT"


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: about a tenth of all orders, the same ones on every run."""
    return table(spark, sf_dir, "orders").where(sampling.selected(0.1, F.col("o_orderpriority"), F.col("o_orderkey"))).select("o_orderkey", "o_orderpriority")


_SAMPLE = f"SELECT o_orderkey, o_orderpriority FROM orders WHERE {_key(0, 'o_orderpriority', 'o_orderkey::VARCHAR')} < {int(0.1 * (1 << 60))}"


def shard_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's shard of seven, by position."""
    return table(spark, sf_dir, "orders").select("o_orderkey", *[sampling.in_shard(F.col("o_orderkey") + 1, 7, k).alias(f"in_{k}") for k in range(7)])


_SHARD = "SELECT o_orderkey, " + ", ".join(f"o_orderkey % 7 = {k} AS in_{k}" for k in range(7)) + " FROM orders"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count(F.lit(1)).alias("count"))


def locality_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all orders, in blocks of 64 orders of like length that take turns."""
    return sampling.epoch_order(_counts(spark, sf_dir), 64, 7).select("episode", "block", "rank", "turn")


_LOCALITY = f"""WITH e AS (SELECT l_orderkey AS episode, count(*)::BIGINT AS count FROM lineitem GROUP BY l_orderkey), l AS (SELECT *, floor(log2(greatest(1, count)))::BIGINT AS level FROM e),
p AS (SELECT *, {_key(7, 'episode::VARCHAR')} % ceil(count(*) OVER (PARTITION BY level) / 64)::BIGINT AS part FROM l),
r AS (SELECT *, {_key(8, 'level::VARCHAR', 'part::VARCHAR')} AS block, row_number() OVER (PARTITION BY level, part ORDER BY {_key(9, 'episode::VARCHAR')}, episode)::INTEGER AS rank FROM p)
SELECT episode, block, rank, unnest(range(count)) AS turn FROM r"""


def bucketed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4 to H7: full batches of 16 orders of one priority, as many for each of 4 replicas."""
    return sampling.rank_batches(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 16, 4)


_BUCKETED = f"""WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_key(0, 'o_orderkey::VARCHAR')}, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, o_orderkey, pos // 16 AS batch, (pos // 16 % 4) AS replica FROM r WHERE pos // 16 < n // 16 // 4 * 4"""


def weighted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: 500 picks of each market segment's customers: without repetition where there are as many, else with whole rounds first."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    out = sampling.numbered(rows, ["c_mktsegment"], "c_custkey", "at", "n")
    return out.select("c_mktsegment", "c_custkey", F.expr("500 div n + if(at < 500 % n, 1, 0)").alias("picks")).where("picks > 0")


_WEIGHTED = f"""SELECT c_mktsegment, c_custkey, 500 // n + (pos <= 500 % n)::BIGINT AS picks FROM (SELECT c_mktsegment, c_custkey, count(*) OVER (PARTITION BY c_mktsegment) AS n,
row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_key(0, 'c_custkey::VARCHAR')}, c_custkey) AS pos FROM customer) WHERE 500 // n + (pos <= 500 % n)::BIGINT > 0"""


def topk_per_group_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five customers a nation, by hash."""
    return sampling.top_by_key(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), ["c_nationkey"], "c_custkey", 5, 3)


_TOP = f"SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY {_key(3, 'c_custkey::VARCHAR')}, c_custkey) <= 5"


def read_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer without an urgent order, the next one in the fixed sequence that has one."""
    n = table(spark, sf_dir, "customer").count()
    good = table(spark, sf_dir, "orders").where(F.startswith("o_orderpriority", F.lit("1"))).select(F.col("o_custkey").alias("other")).distinct()
    bad = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i")).join(good.withColumnRenamed("other", "i"), "i", "left_anti")
    tries = bad.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumn("other", sampling.substitute(F.col("i"), F.col("attempt"), F.lit(n)))
    return tries.join(good, "other").groupBy("i").agg(F.min_by("other", "attempt").alias("other"), F.min("attempt").alias("attempt"))


_SUBSTITUTES = """WITH good AS (SELECT DISTINCT o_custkey AS other FROM orders WHERE o_orderpriority LIKE '1%'), bad AS (SELECT c_custkey AS i FROM customer WHERE c_custkey NOT IN (SELECT other FROM good)),
t AS (SELECT i, a::INTEGER AS attempt, (i + a * 9973) % (SELECT count(*) FROM customer) AS other FROM bad, (SELECT unnest(range(1, 9)) AS a))
SELECT i, arg_min(other, attempt) AS other, min(attempt) AS attempt FROM t JOIN good USING (other) GROUP BY i"""


def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What batches of a hundred orders pad."""
    return sampling.padded_lengths(_counts(spark, sf_dir).withColumn("batch", F.expr("episode div 100")), "batch", "count")


_PADDED = """SELECT episode // 100 AS batch, count(*) AS rows, max(n) AS longest, (count(*) * max(n) - sum(n))::BIGINT AS padding
FROM (SELECT l_orderkey AS episode, count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY ALL"""


def left_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and labels of orders in batches of sixteen, padded on the left to the longest, with what was there and positions."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("s"))
    rows = lines.select("l_orderkey", F.expr("l_orderkey div 16").alias("batch"), F.expr("transform(s, e -> e.l_partkey)").alias("ids"), F.expr("transform(s, e -> e.l_suppkey)").alias("labels"))
    out = sampling.padded(rows, "batch", {"ids": F.lit(0).cast("long"), "labels": F.lit(-100).cast("long")})
    text = lambda c, kind: F.array_join(F.transform(c, lambda x: x.cast(kind).cast("string")), " ").alias(c)
    return out.select("l_orderkey", text("ids", "long"), text("labels", "long"), text("mask", "int"), text("position", "int"))


_LEFT = """WITH o AS (SELECT l_orderkey, l_orderkey // 16 AS batch, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS labels FROM lineitem GROUP BY l_orderkey),
p AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) - len(ids) AS pad FROM o)
SELECT l_orderkey, repeat('0 ', pad) || array_to_string(ids, ' ') AS ids, repeat('-100 ', pad) || array_to_string(labels, ' ') AS labels,
repeat('0 ', pad) || array_to_string(list_transform(ids, lambda x: 1), ' ') AS mask, repeat('-1 ', pad) || array_to_string(range(len(ids)), ' ') AS "position" FROM p"""


def packed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each order begins and ends in its batch's packed row."""
    return sampling.packed_offsets(_counts(spark, sf_dir).withColumn("batch", F.expr("episode div 100")), "batch", "episode", "count")


_PACKED = """WITH e AS (SELECT l_orderkey AS episode, count(*)::BIGINT AS count, l_orderkey // 100 AS batch FROM lineitem GROUP BY l_orderkey)
SELECT *, (sum(count) OVER w)::BIGINT AS "end", (sum(count) OVER w)::BIGINT - count AS "begin" FROM e WINDOW w AS (PARTITION BY batch ORDER BY episode)"""

def locality_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of all orders: windows of orders sorted by count, in a random order of blocks, in which orders take turns."""
    counts = _counts(spark, sf_dir)
    window = sampling.locality_window(4, 2, 2, 3, 24)
    found = sampling.locality_rows(counts, table(spark, sf_dir, "lineitem").count(), window, 11)
    if found is None or sampling.locality_rows(counts, 1, window, 11) is not None:
        raise ValueError("the counts are those of the samples, and of nothing else")
    return found


_BLOCKS = f"""WITH e AS (SELECT l_orderkey AS episode, count(*)::BIGINT AS count FROM lineitem GROUP BY l_orderkey), r AS (SELECT *, row_number() OVER (ORDER BY count, {_key(11, 'episode::VARCHAR')}, episode) - 1 AS pos FROM e)
SELECT episode, {_key(12, '(pos // 24)::VARCHAR')} AS block, pos // 24 AS "window", pos % 24 AS rank, unnest(range(count)) AS turn FROM r"""


def epoch_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4, H5, H6: customers in a hash order as micro-batches of four, two a batch and replica, three replicas; the last batch is filled from the first ones."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    return sampling.epoch_batches(rows, rows.count(), [sampling.spread(F.col("c_custkey"), seed=3), F.col("c_custkey")], 4, 2, 3, False).drop("at")


_MICRO = f"""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {_key(3, 'c_custkey::VARCHAR')}, c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer),
a AS (SELECT c_custkey, unnest(CASE WHEN pos < ceil(n / 24) * 24 - n THEN [pos, pos + n] ELSE [pos] END) AS pos FROM r)
SELECT c_custkey, pos % 3 AS replica, pos // 3 // 8 AS batch, pos // 3 % 8 // 4 AS step, pos // 3 % 4 AS place FROM a"""

QUERIES = {
    "hash_sample": (hash_sample, _SAMPLE),
    "shard_partition": (shard_partition, _SHARD),
    "locality_order": (locality_order, _LOCALITY),
    "bucketed_batches": (bucketed_batches, _BUCKETED),
    "weighted_batches": (weighted_batches, _WEIGHTED),
    "topk_per_group_sample": (topk_per_group_sample, _TOP),
    "read_substitutes": (read_substitutes, _SUBSTITUTES),
    "left_padded": (left_padded, _LEFT),
    "padded_batches": (padded_batches, _PADDED),
    "packed_offsets": (packed_offsets, _PACKED),
    "locality_blocks": (locality_blocks, _BLOCKS),
    "epoch_micro_batches": (epoch_micro_batches, _MICRO),
}
