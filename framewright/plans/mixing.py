"""Queries on window counts, weights, apportionment and virtual indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import mixing
from framewright.operators.series_joins import find_episode, running_total
from framewright.plans.tables import SIZES, WINDOWS, rounded, sizes, table, windows

ALPHA = 0.7


def episode_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by dataset, with kept and dropped episodes."""
    rows = windows(spark, sf_dir)
    return rows.groupBy("dataset").agg(F.sum("windows").alias("windows"), F.count_if(F.col("windows") > 0).alias("kept"), F.count_if(F.col("windows") == 0).alias("dropped"))


_COUNTS = f"WITH {WINDOWS} SELECT dataset, sum(windows)::BIGINT AS windows, count(*) FILTER (windows > 0) AS kept, count(*) FILTER (windows = 0) AS dropped FROM windowed GROUP BY dataset"


def mixture_temperature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by a temperature and the report of shares."""
    return rounded(mixing.temperature_weights(sizes(spark, sf_dir), ALPHA))


_WEIGHTS = f"""WITH {SIZES}, w AS (SELECT *, pow(windows::DOUBLE, {ALPHA}::DOUBLE) AS weight FROM sizes),
s AS (SELECT *, windows / sum(windows) OVER () AS own, weight / sum(weight) OVER () AS effective FROM w)
SELECT dataset, windows, round(weight, 6) AS weight, round(own, 6) AS "natural", round(effective, 6) AS effective, round(effective / own, 6) AS upsample, effective / own > 8 AS flagged FROM s"""


def largest_remainder_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole targets that sum to the windows of all datasets."""
    from pyspark.sql import Window

    everything = Window.partitionBy(F.lit(1))
    rows = sizes(spark, sf_dir).withColumn("weight", F.pow(F.col("windows").cast("double"), F.lit(ALPHA))).withColumn("total", F.sum("windows").over(everything))
    rows = rows.withColumn("share", F.col("weight") / F.sum("weight").over(everything) * F.col("total"))
    return mixing.largest_remainder(rows, "share", F.col("total"), "target", ["dataset"]).select("dataset", "windows", "target")


_SHARES = f"""{SIZES}, w AS (SELECT *, pow(windows::DOUBLE, {ALPHA}::DOUBLE) AS weight, (sum(windows) OVER ())::BIGINT AS total FROM sizes),
shares AS (SELECT *, weight / sum(weight) OVER () * total AS share FROM w),
targets AS (SELECT *, floor(share)::BIGINT + (row_number() OVER (ORDER BY share - floor(share) DESC, dataset) <= total - sum(floor(share)) OVER ())::BIGINT AS target FROM shares)"""
_TARGETS = f"WITH {_SHARES} SELECT dataset, windows, target FROM targets"


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir).where("windows > 0").select("dataset", "episode", "windows")
    weights = rows.groupBy("dataset").agg(F.sum("windows").alias("n")).select("dataset", F.pow(F.col("n").cast("double"), F.lit(ALPHA)).alias("weight"))
    return mixing.weighted_slots(rows, weights)


def weighted_slots_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by dataset, then by episode."""
    return _slots(spark, sf_dir).select("dataset", "episode", "windows", "slots")


_SLOT_ROWS = f"""{_SHARES}, parts AS (SELECT w.dataset, w.episode, w.windows, greatest(1, t.target) AS target, w.windows / t.windows * greatest(1, t.target) AS exact
    FROM windowed w JOIN targets t USING (dataset) WHERE w.windows > 0),
slots AS (SELECT dataset, episode, windows, (floor(exact)::BIGINT + (row_number() OVER (PARTITION BY dataset ORDER BY exact - floor(exact) DESC, episode) <= target - sum(floor(exact)) OVER (PARTITION BY dataset))::BIGINT) AS slots FROM parts)"""
_SLOTS = f"WITH {_SLOT_ROWS} SELECT dataset, episode, windows, slots FROM slots"


def virtual_index_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that each slot stands for."""
    return mixing.virtual_index(_slots(spark, sf_dir)).select("dataset", "episode", "k", "window")


_VIRTUAL = f"WITH {_SLOT_ROWS} SELECT dataset, episode, k, k * windows // slots AS \"window\" FROM (SELECT *, unnest(range(slots)) AS k FROM slots WHERE slots > 0)"


def dataset_mix_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spread places, by rounded shares."""
    weight = F.pmod(F.ascii("dataset"), F.lit(3)) + F.lit(1.5)
    return mixing.dataset_picks(sizes(spark, sf_dir).select("dataset", F.col("windows").alias("n"), weight.alias("weight")))


_PICKS = f"""WITH {SIZES}, w AS (SELECT dataset, windows AS n, (ascii(dataset) % 3 + 1.5)::DOUBLE AS weight FROM sizes),
t AS (SELECT *, greatest(1, round_even(weight / sum(weight) OVER () * (sum(n) OVER ())::BIGINT, 0))::BIGINT AS t FROM w)
SELECT dataset, k, k * n // t AS place FROM (SELECT *, unnest(range(t)) AS k FROM t)"""

#: What the roles (part types) count for.
MULTIPLIERS = {"ECONOMY": 2.0, "SMALL": 0.0}


def _role_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("dataset"), F.col("p_type").alias("role")).agg(F.count(F.lit(1)).alias("n"))


def role_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by size, temperature and role, and the budget that follows."""
    return rounded(mixing.budgets(_role_sizes(spark, sf_dir), 10_000, 2.0, MULTIPLIERS))


_ROLES = "roles AS (SELECT p_brand AS dataset, p_type AS role, count(*)::BIGINT AS n FROM part GROUP BY p_brand, p_type)"
_BUDGET = f"""{_ROLES}, w AS (SELECT *, pow(n::DOUBLE, 0.5::DOUBLE) * CASE role WHEN 'ECONOMY' THEN 2.0 WHEN 'SMALL' THEN 0.0 ELSE 1.0 END::DOUBLE AS weight FROM roles),
budgets AS (SELECT *, (CASE WHEN weight > 0 THEN greatest(1, round_even(weight / sum(weight) OVER () * 10000, 0)) ELSE 0 END)::BIGINT AS budget FROM w)"""
_BUDGETS = f"WITH {_BUDGET} SELECT dataset, role, n, round(weight, 6) AS weight, budget FROM budgets"


def budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16 by dataset and role, as many for each of 4 replicas."""
    rows = mixing.budgets(_role_sizes(spark, sf_dir), 10_000, 2.0, MULTIPLIERS)
    return rows.groupBy("dataset").agg(F.sum(F.ceil(F.col("budget") / 16)).alias("batches")).select("dataset", "batches", F.expr("batches div 4").alias("a_replica"))


_BATCHES = f"WITH {_BUDGET} SELECT dataset, sum(ceil(budget / 16))::BIGINT AS batches, sum(ceil(budget / 16))::BIGINT // 4 AS a_replica FROM budgets GROUP BY dataset"


def global_index_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order, and the line of it, of every place among all orders' lines in order of key."""
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    spans = running_total(orders, "key", "n", "start", 4096).select("key", "start", (F.col("start") + F.col("n")).alias("end"))
    points = spark.range(0, table(spark, sf_dir, "lineitem").count()).select(F.col("id").alias("idx"))
    return find_episode(points, spans, "idx", 1024).select("idx", "key", (F.col("idx") - F.col("start")).alias("place"))


_LOOKUP = """WITH n AS (SELECT l_orderkey AS key, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey),
s AS (SELECT key, n, (sum(n) OVER (ORDER BY key) - n)::BIGINT AS start FROM n)
SELECT idx, key, idx - start AS place FROM (SELECT range AS idx FROM range(0, (SELECT count(*) FROM lineitem))) ASOF JOIN s ON idx >= start"""

QUERIES = {
    "episode_window_counts": (episode_window_counts, _COUNTS),
    "mixture_temperature_weights": (mixture_temperature_weights, _WEIGHTS),
    "largest_remainder_targets": (largest_remainder_targets, _TARGETS),
    "weighted_slots_two_level": (weighted_slots_two_level, _SLOTS),
    "virtual_index_map": (virtual_index_map, _VIRTUAL),
    "dataset_mix_picks": (dataset_mix_picks, _PICKS),
    "role_budgets": (role_budgets, _BUDGETS),
    "budget_batches": (budget_batches, _BATCHES),
    "global_index_range_lookup": (global_index_range_lookup, _LOOKUP),
}
