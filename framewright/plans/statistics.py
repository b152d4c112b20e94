"""Queries on moments, quantiles, their merges, normalisation and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalar import digest, normalize
from framewright.operators import statistics
from framewright.operators.sampling import top_by_key
from framewright.plans.tables import SERIES, frames, rounded, series, table

_DIMS = "dims AS (SELECT unnest(range(len(embedding)))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def latent_moments_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each dimension of all vectors."""
    return rounded(statistics.vector_moments(table(spark, sf_dir, "embeddings"), "embedding"))


_MOMENTS = f"WITH {_DIMS} SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, round(min(x), 6) AS \"min\", round(max(x), 6) AS \"max\" FROM dims GROUP BY dim"


def latent_quantiles_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact q01 and q99 of each dimension by label."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rounded(statistics.leaf_stats(rows, ["label", "dim"], "x").select("label", "dim", "q01", "q99"))


_QUANTILES = """WITH d AS (SELECT label, unnest(range(len(embedding)))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, dim, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99 FROM d GROUP BY label, dim"""

_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("robot"), F.col("l_linestatus").alias("part"), *_FIELDS)
    return rows.unpivot(["robot", "part"], _FIELDS, "path", "x")


_LEAVES = "leaves AS (SELECT robot, part, path, x FROM (SELECT l_returnflag AS robot, l_linestatus AS part, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (x FOR path IN (l_quantity, l_extendedprice, l_discount, l_tax)))"
_LEAF = "count(x) AS n, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std, min(x) AS \"min\", max(x) AS \"max\", quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99"


def robot_schema_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each field of each robot type."""
    return rounded(statistics.leaf_stats(_leaves(spark, sf_dir), ["robot", "path"], "x"), 4)


_SCHEMA = f"WITH {_LEAVES}, s AS (SELECT robot, path, {_LEAF} FROM leaves GROUP BY robot, path) SELECT robot, path, n, round(mean, 4) AS mean, round(std, 4) AS std, round(\"min\", 4) AS \"min\", round(\"max\", 4) AS \"max\", round(q01, 4) AS q01, round(q99, 4) AS q99 FROM s"


def pooled_stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' statistics merged without their rows."""
    parts = statistics.leaf_stats(_leaves(spark, sf_dir), ["robot", "part", "path"], "x")
    return rounded(statistics.merge_stats(parts, ["robot", "path"]), 4)


_MERGED = f"""WITH {_LEAVES}, s AS (SELECT robot, part, path, {_LEAF} FROM leaves GROUP BY robot, part, path),
m AS (SELECT robot, path, sum(n)::BIGINT AS n, sum(n * mean) / sum(n) AS mean, sum(n * (std * std + mean * mean)) / sum(n) AS second, min("min") AS "min", max("max") AS "max", sum(n * q01) / sum(n) AS q01, sum(n * q99) / sum(n) AS q99 FROM s GROUP BY robot, path)
SELECT robot, path, n, round(mean, 4) AS mean, round(sqrt(greatest(0, second - mean * mean)), 4) AS std, round("min", 4) AS "min", round("max", 4) AS "max", round(q01, 4) AS q01, round(q99, 4) AS q99 FROM m"""


def _normalized(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
        # one row a type: views have no statistics, their values stay
        stats = statistics.leaf_stats(events.where("event_type <> 'view'"), ["event_type"], "value").select("event_type", F.struct("mean", "std", "min", "max", "q01", "q99").alias("s"))
        return events.join(stats, "event_type", "left").select("event_id", F.round(normalize(F.col("value"), method, F.col("s")), 6).alias("x"))

    run.__doc__ = f"D20, I12, I13: values of events by {method}."
    return run


def _normalized_sql(offset: str, scale: str) -> str:
    return f"""WITH s AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99 FROM events WHERE event_type <> 'view' GROUP BY event_type)
SELECT event_id, round(CASE WHEN mean IS NULL THEN value ELSE (value - ({offset})) / ({scale}) END, 6) AS x FROM events LEFT JOIN s USING (event_type)"""


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and bin."""
    return statistics.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 1, 2, 4, 8])


_HISTOGRAM = "SELECT event_type, ((value >= 0.5)::INTEGER + (value >= 1)::INTEGER + (value >= 2)::INTEGER + (value >= 4)::INTEGER + (value >= 8)::INTEGER)::INTEGER AS bin, count(*) AS n FROM events GROUP BY ALL"


def motion_weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted smooth L1 of discount against tax, by flag."""
    rows = table(spark, sf_dir, "lineitem")
    loss = statistics.smooth_l1(F.col("l_discount") * 30, F.col("l_tax") * 30)
    return rounded(statistics.weighted_mean(rows, ["l_returnflag"], loss, F.col("l_quantity"), 3))


_LOSS = """SELECT l_returnflag, round(sum(CASE WHEN d < 1 THEN d * d / 2 ELSE d - 0.5::DOUBLE END * l_quantity) / (sum(l_quantity) * 3 + 1e-6::DOUBLE), 6) AS value
FROM (SELECT *, abs(l_discount * 30 - l_tax * 30) AS d FROM lineitem) GROUP BY l_returnflag"""


def ema_by_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential mean with a decay that warms up."""
    return series(spark, sf_dir).select("episode", F.round(statistics.ema(F.col("x"), 0.9), 6).alias("s"))


_EMA = f"WITH {SERIES}, e AS (SELECT episode, x, range(len(x)) AS t FROM series), p AS (SELECT episode, list_transform(t, lambda i: struct_pack(i := i, x := x[i + 1])) AS z FROM e) SELECT episode, round(list_reduce(z, lambda a, b: struct_pack(i := b.i, x := least(0.9::DOUBLE, (b.i + 1) / (b.i + 10)) * a.x + (1 - least(0.9::DOUBLE, (b.i + 1) / (b.i + 10))) * b.x)).x, 6) AS s FROM p"


def probe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population statistics of at most 40 episodes' lines a group, chosen by hash; no spread counts as 1."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    some = top_by_key(rows, ["o_orderpriority"], "o_orderkey", 40)
    std = F.stddev_pop("o_totalprice")
    return rounded(some.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std")), 4)


_KEY = "('0x' || substr(md5('{seed}|' || {key}), 1, 15))::BIGINT"
_PROBE = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_KEY.format(seed=0, key="o_orderkey::VARCHAR")}, o_orderkey) AS pos FROM orders)
SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(CASE WHEN stddev_pop(o_totalprice) < 1e-6 THEN 1 ELSE stddev_pop(o_totalprice) END, 4) AS std FROM r WHERE pos <= 40 GROUP BY o_orderpriority"""


def field_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands whose parts have more than one type: what a strict merge refuses."""
    return statistics.one_meta(table(spark, sf_dir, "part"), ["p_brand"], ["p_type"])


_CONFLICTS = "SELECT p_brand, count(DISTINCT p_type) AS kinds FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1"


def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha256 of each customer's canonical JSON."""
    return table(spark, sf_dir, "customer").select("c_custkey", digest(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey")).alias("sha256"))


_DIGESTS = """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS sha256 FROM customer"""


def epoch_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimizer steps an epoch by segment: batches of 8, four of them a step."""
    rows = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("c_mktsegment", F.ceil(F.col("n") / 8).alias("batches")).selectExpr("c_mktsegment", "batches", "greatest(batches div 4 + if(batches % 4 > 0, 1, 0), 1) AS steps")


_STEPS = "SELECT c_mktsegment, b AS batches, greatest(b // 4 + (b % 4 > 0)::BIGINT, 1) AS steps FROM (SELECT c_mktsegment, ceil(count(*) / 8)::BIGINT AS b FROM customer GROUP BY c_mktsegment)"


def variant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most frequent pairs of type and brand."""
    return table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type", "p_brand").limit(12)


_VARIANTS = "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_type, p_brand LIMIT 12"


def chunk_start_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, in hundredths, over the chunks of sixteen that start at every frame, tails filled up, from weights of the frames and not from chunks. Sums of
    hundredths are exact, so the mean isn't rounded."""
    rows = frames(spark, sf_dir).select("episode", "frame", F.round(F.col("value") * 100).alias("x"))
    rows = rows.join(rows.groupBy("episode").agg(F.count(F.lit(1)).alias("n")), "episode").withColumn("w", statistics.chunk_weight(F.col("frame"), F.col("n"), 16))
    return statistics.weighted_moments(rows.drop("n"), ["episode"], "x", "w").withColumn("std", F.round("std", 5))


_CHUNK_STATS = f"""WITH {SERIES}, s AS (SELECT episode, x, unnest(range(len(x))) AS s FROM series), c AS (SELECT episode, x, s, unnest(range(16)) AS k FROM s), v AS (SELECT episode, round(x[least(s + k, len(x) - 1) + 1] * 100) AS v FROM c)
SELECT episode, count(*) AS n, sum(v::BIGINT)::DOUBLE / count(*) AS mean, round(stddev_samp(v), 5) AS std, min(v) AS "min", max(v) AS "max" FROM v GROUP BY episode"""


def hash_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty lines of each ship date's year with the least keys, by way of reservoirs of parts that are merged; here the sample's sizes, and its parts' sums, which no split changes."""
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), (F.col("l_orderkey") % 3).alias("part"), "l_orderkey", "l_linenumber", "l_quantity")
    parts = statistics.reservoir(rows, ["year", "part"], "l_quantity", ["l_orderkey", "l_linenumber"], 40)
    merged, once = statistics.merge_reservoirs(parts, ["year"], 40), statistics.reservoir(rows, ["year"], "l_quantity", ["l_orderkey", "l_linenumber"], 40)
    sums = [df.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.bit_xor("key").alias("k")) for df in (merged, once)]
    whole = rows.groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    a, b = sums[0], sums[1].withColumnsRenamed({"n": "n2", "s": "s2", "k": "k2"})
    return whole.join(a, "year").join(b, "year").select("year", "rows", "n", ((F.col("n") == F.col("n2")) & (F.col("s") == F.col("s2")) & (F.col("k") == F.col("k2"))).alias("same"), F.expr("s / n BETWEEN lo AND hi").alias("inside"))


_RESERVOIRS = """SELECT year(l_shipdate)::INTEGER AS year, count(*) AS rows, least(count(*), 40) AS n, true AS same, true AS inside FROM lineitem GROUP BY ALL"""

QUERIES = {
    "chunk_start_stats": (chunk_start_stats, _CHUNK_STATS),
    "hash_reservoir": (hash_reservoir, _RESERVOIRS),
    "latent_moments_by_dim": (latent_moments_by_dim, _MOMENTS),
    "latent_quantiles_by_dim": (latent_quantiles_by_dim, _QUANTILES),
    "robot_schema_stats": (robot_schema_stats, _SCHEMA),
    "pooled_stats_merge": (pooled_stats_merge, _MERGED),
    "zscore_normalize": (_normalized("mean_std"), _normalized_sql("mean", "std + 1e-8::DOUBLE")),
    "minmax_normalize": (_normalized("min_max"), _normalized_sql("lo", "(hi - lo + 1e-8::DOUBLE) / 2")),
    "minmax_sym_normalize": (_normalized("min_max_sym"), _normalized_sql("(lo + hi) / 2", "(hi - lo + 1e-8::DOUBLE) / 2")),
    "q01_q99_normalize": (_normalized("q01_q99"), _normalized_sql("(q01 + q99) / 2", "(q99 - q01 + 1e-8::DOUBLE) / 2")),
    "latency_histogram": (latency_histogram, _HISTOGRAM),
    "motion_weighted_loss": (motion_weighted_loss, _LOSS),
    "ema_by_episode": (ema_by_episode, _EMA),
    "probe_stats": (probe_stats, _PROBE),
    "field_conflicts": (field_conflicts, _CONFLICTS),
    "row_digests": (row_digests, _DIGESTS),
    "epoch_steps": (epoch_steps, _STEPS),
    "variant_counts": (variant_counts, _VARIANTS),
}
