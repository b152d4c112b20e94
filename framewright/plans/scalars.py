"""Queries on names, paths, captions, geometry, unions, ranks and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import scalar
from framewright.operators.ranges import running
from framewright.plans.tables import rounded, table
from framewright.sources.manifests import keep_first


def caption_join_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation in order, each text once, joined and cut at a word within 200 characters."""
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("double").alias("start_time"), F.regexp_replace("text", r"\s+", " ").alias("description"))).alias("parts"))
    return parts.select("conv_id", scalar.join_caption(F.col("parts"), 200).alias("caption"))


_CAPTION = r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS d FROM conversations),
f AS (SELECT conv_id, d, min(turn) AS turn FROM t WHERE d <> '' GROUP BY conv_id, d), j AS (SELECT conv_id, string_agg(d, ' ' ORDER BY turn) AS s FROM f GROUP BY conv_id),
c AS (SELECT conv_id, s, substr(s, 1, 200) AS head FROM j)
SELECT conv_id, CASE WHEN length(s) <= 200 THEN s WHEN substr(s, 201, 1) = ' ' THEN head WHEN rtrim(regexp_replace(head, '[^ ]+$', '')) = '' THEN head ELSE rtrim(regexp_replace(head, '[^ ]+$', '')) END AS caption FROM c"""


def task_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names under a prefix of their type, stripped again, where they begin with red or blue."""
    task = F.concat(F.when(F.col("p_size") % 2 == 0, "primitive: ").otherwise(" composite:"), F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", scalar.strip_task_prefix(task).alias("task"))
    return rows.where(F.startswith("task", F.lit("red")) | F.startswith("task", F.lit("blue")))


_TASK = "SELECT p_partkey, p_name AS task FROM part WHERE p_name LIKE 'red%' OR p_name LIKE 'blue%'"


def url_source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by kind of a path made from their address, and whether its last part is a safe name."""
    path = F.concat(F.element_at(F.split(F.element_at(F.split("url", "[?#]"), 1), "/"), -1), F.get(F.array(*[F.lit(s) for s in (".mp4", ".H5", ".zarr", ".txt", "")]), F.pmod("page_id", F.lit(5)).cast("int")))
    path = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit(scalar.TAR_SCHEME), path)).otherwise(path)
    return table(spark, sf_dir, "pages").select("page_id", scalar.source_kind(path).alias("kind"), scalar.is_safe_name(path).alias("safe"))


_KIND = rf"""WITH p AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '{scalar.TAR_SCHEME}' ELSE '' END || regexp_split_to_array(regexp_split_to_array(url, '[?#]')[1], '/')[-1] || ['.mp4', '.H5', '.zarr', '.txt', ''][page_id % 5 + 1] AS path FROM pages),
k AS (SELECT page_id, path, path LIKE '%/%' AS nested, string_split(path, '/')[-1] AS name FROM p)
SELECT page_id, CASE WHEN path LIKE '{scalar.TAR_SCHEME}%' THEN 'tar' WHEN lower(name) LIKE '_%.h5' THEN 'hdf5' WHEN name LIKE '_%.mp4' THEN 'video' WHEN ltrim(name, '.') LIKE '%.%' THEN 'unsupported' ELSE 'zarr' END AS kind,
path <> '' AND NOT nested AND path NOT IN ('.', '..') AND NOT contains(path, chr(92)) AS safe FROM k"""


def path_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule whose prefix ends at a slash."""
    rules = [("https://m", "/none"), ("http:/", "/mnt/plain"), ("https:", "/mnt/safe")]
    return table(spark, sf_dir, "pages").select("page_id", scalar.rewrite_prefix(F.col("url"), rules).alias("path"))


_REWRITES = "SELECT page_id, CASE WHEN url LIKE 'https://m/%' THEN '/none' || substr(url, 10) WHEN url LIKE 'http://%' THEN '/mnt/plain' || substr(url, 6) WHEN url LIKE 'https:/%' THEN '/mnt/safe' || substr(url, 7) ELSE url END AS path FROM pages"


def aspect_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket of each part's shape, and how a cover of it is cropped."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 3).alias("h"), (F.pmod("p_partkey", F.lit(37)) + 5).alias("w"))
    scale = F.greatest(336 / F.col("h"), 336 / F.col("w"))
    tall, wide = (F.floor(F.col(c) * scale + 0.5) for c in "hw")
    return rows.select("p_partkey", scalar.aspect_bucket(F.col("h"), F.col("w")).alias("bucket"), F.expr("0L").alias("zero"), F.floor((tall - 336) / 2).alias("top"), F.floor((wide - 336) / 2).alias("left")).drop("zero")


_ASPECT = """WITH p AS (SELECT p_partkey, p_size + 3 AS h, p_partkey % 37 + 5 AS w FROM part), d AS (SELECT *, greatest(336 / h, 336 / w) AS s,
abs(ln(h / w) - ln(256::DOUBLE / 448)) AS a, abs(ln(h / w)) AS b, abs(ln(h / w) - ln(448::DOUBLE / 256)) AS c FROM p)
SELECT p_partkey, CASE WHEN a <= b AND a <= c THEN 'wide' WHEN b <= c THEN 'square' ELSE 'tall' END AS bucket, floor((floor(h * s + 0.5::DOUBLE) - 336) / 2)::BIGINT AS top, floor((floor(w * s + 0.5::DOUBLE) - 336) / 2)::BIGINT AS "left" FROM d"""


def action_flatten_81(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of an order's line in fixed slots of 81 numbers, the rest zero: which of them count, and their sum by place."""
    slots = {0: "l_quantity", 9: "l_discount", 40: "l_tax"}
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.max(c).alias(c) for c in slots.values()])
    flat = F.array(*[F.col(slots[k]) if k in slots else F.lit(0.0) for k in range(81)])
    mask = F.array(*[F.lit(k in slots) for k in range(81)])
    places = F.aggregate(F.transform(flat, lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(rows.select("l_orderkey", F.size(flat).alias("width"), F.array_join(F.transform(mask, lambda on: on.cast("int").cast("string")), "").alias("mask"), places.alias("places")))


_FLATTEN = "SELECT l_orderkey, 81 AS width, '1' || repeat('0', 8) || '1' || repeat('0', 30) || '1' || repeat('0', 40) AS mask, round(max(l_quantity) + max(l_discount) * 10 + max(l_tax) * 41, 6) AS places FROM lineitem GROUP BY l_orderkey"


def concat_union_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers one after the other, with their places in the union."""
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("name"), F.col("c_custkey").alias("key"), F.lit(0).cast("long").alias("offset"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("name"), F.col("s_suppkey").alias("key"))
    n = table(spark, sf_dir, "customer").agg((F.max("c_custkey") + 1).alias("offset"))
    return a.unionByName(b.join(F.broadcast(n))).select("name", "key", (F.col("key") + F.col("offset")).alias("place"))  # n is one row


_UNION = "SELECT 'customer' AS name, c_custkey AS key, c_custkey AS place FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_suppkey + (SELECT max(c_custkey) + 1 FROM customer) FROM supplier"


def checkpoint_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders all but the last three and the milestones (keys divisible by 10)."""
    from pyspark.sql import Window

    age = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").withColumn("age", age).where((F.col("age") > 3) & (F.col("o_orderkey") % 10 != 0)).select("o_custkey", "o_orderkey")


_ROTATION = "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS age FROM orders) WHERE age > 3 AND o_orderkey % 10 <> 0"


def sorted_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' places by segment, then by key as text."""
    rows = running(table(spark, sf_dir, "customer"), ["c_mktsegment"], [F.col("c_custkey").cast("string")], "before")
    return rows.select("c_mktsegment", "c_custkey", (F.col("before") + 1).cast("long").alias("place"))


_SORTED = "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey::VARCHAR) AS place FROM customer"


def page_after_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of fifty orders after the first hundred, by price."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


_PAGE = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100"


def valid_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the right width that are finite throughout, and their largest entry."""
    fine = (F.size("embedding") == 64) & F.forall("embedding", lambda x: (F.abs(x) < 1e30) & ~F.isnan(x))
    return rounded(table(spark, sf_dir, "embeddings").where(fine).select("vec_id", F.array_max("embedding").cast("double").alias("top")))


_VALID = "SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings WHERE len(embedding) = 64"


def command_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seventh entry as a gripper state and command, and the vector's slices."""
    rows = table(spark, sf_dir, "embeddings")
    return rounded(rows.select("vec_id", (1 - F.get("embedding", F.lit(6)).cast("double")).alias("state"), (1 - 2 * F.get("embedding", F.lit(6)).cast("double")).alias("command"), F.aggregate(F.slice("embedding", 1, 3), F.lit(0.0), lambda a, x: a + x).alias("moved")))


_FLIPS = "SELECT vec_id, round(1 - embedding[7]::DOUBLE, 6) AS state, round(1 - 2 * embedding[7]::DOUBLE, 6) AS command, round(embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE, 6) AS moved FROM embeddings"


def robot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robot type of a variant's name, role number and family."""
    variant = F.concat(F.replace("event_type", F.lit("i"), F.lit("-")), F.lit("_clean_50"))
    view = F.get(F.array(*[F.lit(r) for r in [*scalar.ROLES, "other"]]), F.pmod("user_id", F.lit(7)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", scalar.variant_robot(variant).alias("robot"), F.coalesce(scalar.role_id(view), F.lit(-1)).alias("role"))


_ROBOTS = "SELECT event_id, replace(event_type, 'i', '_') AS robot, (CASE WHEN user_id % 7 = 6 THEN -1 ELSE user_id % 7 END)::INTEGER AS role FROM events"


def drop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the first of several conditions in order, or kept."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").where("p_size < 48").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey", "left")
    reason = (
        F.when(F.col("l_linenumber") > 6, "unmapped_camera").when(F.col("l_tax") == 0, "no_video_path").when(F.col("p_size").isNull(), "missing_latent")
        .when(F.col("p_size") < 3, "bad_num_latents").when(F.col("l_discount") > 0.09, "latent_dim_mismatch").otherwise("kept")
    )
    return rows.groupBy(F.col("l_returnflag").alias("dataset"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_REASONS = """SELECT l_returnflag AS dataset, CASE WHEN l_linenumber > 6 THEN 'unmapped_camera' WHEN l_tax = 0 THEN 'no_video_path' WHEN p_size IS NULL THEN 'missing_latent' WHEN p_size < 3 THEN 'bad_num_latents'
WHEN l_discount > 0.09::DOUBLE THEN 'latent_dim_mismatch' ELSE 'kept' END AS reason, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 48) ON l_partkey = p_partkey GROUP BY ALL"""


def latest_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row that an upsert by user and type leaves."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.expr("-event_id").alias("age"))
    return keep_first(rows, ["user_id", "event_type"], ["age"]).drop("age")


_LATEST = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension of our own: events by type and six hours of event time."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(rows.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "mean"))


_TUMBLING = "SELECT epoch(ts)::BIGINT // 21600 * 21600 AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, date_trunc('second', ts) AS s FROM events) GROUP BY ALL".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT")

QUERIES = {
    "caption_join_dedup": (caption_join_dedup, _CAPTION),
    "task_prefix_filter": (task_prefix_filter, _TASK),
    "url_source_kind": (url_source_kind, _KIND),
    "path_rewrites": (path_rewrites, _REWRITES),
    "aspect_bucket": (aspect_bucket, _ASPECT),
    "action_flatten_81": (action_flatten_81, _FLATTEN),
    "concat_union_offsets": (concat_union_offsets, _UNION),
    "checkpoint_rotation": (checkpoint_rotation, _ROTATION),
    "sorted_manifest": (sorted_manifest, _SORTED),
    "page_after_offset": (page_after_offset, _PAGE),
    "valid_actions": (valid_actions, _VALID),
    "command_flips": (command_flips, _FLIPS),
    "robot_types": (robot_types, _ROBOTS),
    "drop_reason_counts": (drop_reason_counts, _REASONS),
    "latest_of_each": (latest_of_each, _LATEST),
    "tumbling_windows": (tumbling_windows, _TUMBLING),
}
