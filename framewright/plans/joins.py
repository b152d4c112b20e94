"""Queries on lookups, pairings, as-of joins, and checks of coverage and conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import series_joins as joins
from framewright.plans.tables import FRAMES, frames, rounded, table
from framewright.sources.manifests import keep_first


def all_views_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose lines are by known large parts' sizes, with the least quantity."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").where("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("has"))
    whole = lines.join(parts, "l_partkey", "left").groupBy("l_orderkey").agg(F.count_if(F.col("has").isNull()).alias("missing"), F.count(F.lit(1)).alias("views"), F.min("l_quantity").alias("nlat"))
    return whole.where("missing = 0").select("l_orderkey", "views", "nlat")


_VIEWS = """SELECT l_orderkey, count(*) AS views, min(l_quantity) AS nlat FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 45) ON l_partkey = p_partkey
GROUP BY l_orderkey HAVING bool_and(p_partkey IS NOT NULL)"""


def missing_frames_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (line numbers) that an order's last line promises and the table lacks."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode"), (F.col("l_linenumber") - 1).alias("frame"))
    return joins.missing_frames(lines.groupBy("episode").agg((F.max("frame") + 1).alias("length")), lines, "episode", "length", "frame")


_MISSING = """WITH l AS (SELECT l_orderkey AS episode, (l_linenumber - 1)::BIGINT AS frame FROM lineitem),
w AS (SELECT episode, unnest(range(max(frame) + 1)) AS frame FROM l GROUP BY episode) SELECT episode, frame FROM w ANTI JOIN l USING (episode, frame)"""


def frame_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of episodes that a list of wanted frames names, each once."""
    wanted = frames(spark, sf_dir).select((F.col("frame") * 3).alias("frame")).distinct()
    return frames(spark, sf_dir).join(wanted, "frame", "left_semi").select("episode", "frame", "value")


_SUBSET = f"WITH {FRAMES} SELECT episode, frame, value FROM frames WHERE frame IN (SELECT frame * 3 FROM frames)"


def row_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have no order, or more than ten."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    have = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("times"))
    return customers.join(have, "o_custkey", "left").select("o_custkey", F.coalesce("times", F.lit(0)).alias("times")).where("times = 0 OR times > 10")


_COVERAGE = "SELECT c_custkey AS o_custkey, coalesce(times, 0) AS times FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS times FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey WHERE coalesce(times, 0) = 0 OR times > 10"


def shard_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids up to the number of orders that lines never name, or more than once."""
    n = table(spark, sf_dir, "orders").count()
    return joins.coverage(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", n)


_SHARDS = """SELECT k AS l_orderkey, coalesce(times, 0) AS times FROM (SELECT range AS k FROM range((SELECT count(*) FROM orders))) LEFT JOIN (SELECT l_orderkey, count(*) AS times FROM lineitem GROUP BY l_orderkey) ON k = l_orderkey
WHERE coalesce(times, 0) <> 1"""


def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's lines of the same number the first, by part and supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


_FIRST = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1"""


def config_full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """priorities' order counts that differ between customers of even and odd nations."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
    side = lambda odd: rows.where(F.col("c_nationkey") % 2 == odd).groupBy(F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    return joins.config_diff(side(0), side(1), "key", "value")


_DIFF = """WITH r AS (SELECT c_nationkey % 2 AS odd, c_mktsegment || '/' || o_orderpriority AS key, count(*) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
a AS (SELECT * FROM r WHERE odd = 0), b AS (SELECT * FROM r WHERE odd = 1)
SELECT coalesce(a.key, b.key) AS key, a.value AS was, b.value AS now FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value"""


def frame_pairs_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, frame + 5) of every fourth frame."""
    return joins.frame_pairs(frames(spark, sf_dir).select("episode", "frame"), ["episode"], "frame", 5, 4)


_PAIRS = f"WITH {FRAMES} SELECT * FROM (SELECT episode, frame, lead(frame, 5) OVER (PARTITION BY episode ORDER BY frame) AS target FROM frames) WHERE target IS NOT NULL AND frame % 4 = 0"


def nearest_frame_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source frame of each frame at two fifths of the rate, and its value."""
    own = frames(spark, sf_dir).select("episode", "frame", "value")
    lengths = own.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    targets = lengths.withColumn("target", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n * 2 - 1) div 5"))))
    targets = targets.withColumn("frame", joins.nearest_frame(F.col("target"), F.col("n"), F.lit(5.0), F.lit(2.0)).cast("long"))
    return targets.join(own, ["episode", "frame"]).select("episode", "target", "frame", "value")


_NEAREST = f"""WITH {FRAMES}, t AS (SELECT episode, n, unnest(range((n * 2 - 1) // 5 + 1)) AS target FROM (SELECT episode, count(*) AS n FROM frames GROUP BY episode)),
u AS (SELECT episode, target, greatest(0, least(n - 1, round_even(target * 5::DOUBLE / 2, 0)))::BIGINT AS frame FROM t)
SELECT episode, target, frame, value FROM u JOIN frames USING (episode, frame)"""


def as_of_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last purchase value at each click, null before the first."""
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", "event_id")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(clicks, bought, ["user_id"], "ts", "value").select("event_id", "user_id", "value")


_AS_OF = """WITH b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT c.event_id, c.user_id, b.value FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN b ON c.user_id = b.user_id AND c.ts >= b.ts"""


def task_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers' counts by region name; unmatched ones under null."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey", "left")
    rows = rows.join(table(spark, sf_dir, "region").where("r_name <> 'ASIA'").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left")
    return rows.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


_TEXTS = "SELECT r_name, count(*) AS n FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey GROUP BY r_name"


def unknown_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers that stand together in an urgent order and in no other."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    urgent = F.startswith("o_orderpriority", F.lit("1"))
    return lines.where(urgent).select("l_partkey", "l_suppkey").distinct().join(lines.where(~urgent).select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_anti")


_UNKNOWN = "WITH l AS (SELECT l_partkey, l_suppkey, o_orderpriority LIKE '1%' AS urgent FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT l_partkey, l_suppkey FROM l GROUP BY l_partkey, l_suppkey HAVING bool_and(urgent)"


def name_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types numbered by first appearance, and their sizes."""
    coded = joins.encode_names(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", "code")
    return coded.groupBy("event_type", F.col("code").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = "SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code, count(*) AS n FROM events GROUP BY event_type"


def scene_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders stand under different states."""
    return joins.conflicts(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), "o_custkey")


_SCENES = "SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1"


def multi_archive_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that lines get from more than one supplier, and how many."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("archives"), F.count(F.lit(1)).alias("n")).where("archives > 1")


_ARCHIVES = "SELECT l_partkey, count(DISTINCT l_suppkey) AS archives, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1"


def role_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region and a role number that only one nation has, so that the map back is unique."""
    keyed = table(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_nationkey") % 4).alias("role"), "n_name")
    return keyed.groupBy("n_regionkey", "role").agg(F.count(F.lit(1)).alias("n"), F.min("n_name").alias("n_name")).where("n = 1").select("n_regionkey", "role", "n_name")


_INVERSE = "SELECT n_regionkey, n_nationkey % 4 AS role, min(n_name) AS n_name FROM nation GROUP BY ALL HAVING count(*) = 1"


def action_minus_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders' prices less their customers' balances; without a positive one the price as it is."""
    state = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("state"))
    rows = table(spark, sf_dir, "orders").join(state, "o_custkey", "left")
    return rounded(rows.select("o_orderkey", F.when(F.col("state").isNull(), F.col("o_totalprice")).otherwise(F.col("o_totalprice") - F.col("state")).alias("x")), 4)


_MINUS = "SELECT o_orderkey, round(CASE WHEN c_acctbal IS NULL THEN o_totalprice ELSE o_totalprice - c_acctbal END, 4) AS x FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey"

QUERIES = {
    "all_views_present": (all_views_present, _VIEWS),
    "missing_frames_anti": (missing_frames_anti, _MISSING),
    "frame_subset": (frame_subset, _SUBSET),
    "row_coverage_check": (row_coverage_check, _COVERAGE),
    "shard_coverage": (shard_coverage, _SHARDS),
    "first_wins_dedup": (first_wins_dedup, _FIRST),
    "config_full_outer_diff": (config_full_outer_diff, _DIFF),
    "frame_pairs_gap": (frame_pairs_gap, _PAIRS),
    "nearest_frame_join": (nearest_frame_join, _NEAREST),
    "as_of_last_value": (as_of_last_value, _AS_OF),
    "task_text_lookup": (task_text_lookup, _TEXTS),
    "unknown_robots": (unknown_robots, _UNKNOWN),
    "name_encoding": (name_encoding, _NAMES),
    "scene_conflicts": (scene_conflicts, _SCENES),
    "multi_archive_sources": (multi_archive_sources, _ARCHIVES),
    "role_inverse": (role_inverse, _INVERSE),
    "action_minus_state": (action_minus_state, _MINUS),
}
