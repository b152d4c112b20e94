"""Queries on names of views, scenes, paths and parts, on gates and bindings, and on logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import scalar
from framewright.functions import series as fs
from framewright.operators import sampling
from framewright.plans.tables import rounded, table


def _pick(values: list[str], by):
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(by, F.lit(len(values))).cast("int"))


def _sql_pick(values: list[str], by: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({by}) % {len(values)} + 1]"


_DATASETS = ["EgoDex", "RoboMind", "SthSthV2", "Toy"]
_CAMERAS = ["ego", "main", "head", "wrist_left", "wrist_right", "global", "side", "camera_left_rgb_images", "camera_right_external_rgb_images", "top"]


def view_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role numbers of view names, and with the older names of some datasets first; -1 where neither has one."""
    rows = table(spark, sf_dir, "events").select("event_id", _pick(_DATASETS, F.col("user_id")).alias("d"), _pick(_CAMERAS, F.col("event_id")).alias("v"))
    return rows.select("event_id", F.coalesce(scalar.view_role(F.col("v")), F.lit(-1)).alias("role"), F.coalesce(scalar.view_role(F.col("v"), F.col("d")), F.lit(-1)).alias("legacy"))


_VIEW_ROLES = f"""WITH e AS (SELECT event_id, {_sql_pick(_DATASETS, "user_id")} AS d, {_sql_pick(_CAMERAS, "event_id")} AS v FROM events),
r AS (SELECT *, CASE v WHEN 'head' THEN 0 WHEN 'wrist_left' THEN 1 WHEN 'wrist_right' THEN 2 WHEN 'global' THEN 3 WHEN 'side' THEN 4 ELSE -1 END AS role FROM e)
SELECT event_id, role::INTEGER AS role, (CASE WHEN d = 'EgoDex' AND v = 'ego' THEN 0 WHEN d = 'SthSthV2' AND v = 'main' THEN 3 WHEN d = 'RoboMind' AND v = 'camera_left_rgb_images' THEN 1
WHEN d = 'RoboMind' AND v = 'camera_right_external_rgb_images' THEN 5 ELSE role END)::INTEGER AS legacy FROM r"""

_SCENES = ["DROID", "robotwin2.0", "EgoDex", "elsewhere", "bridgev2"]
_ENDS = ["head", "exterior_image_1_left", "exterior_image_2_left", "wrist_image_left", "wrist_right", "chest"]


def scene_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene id's camera, the family of its dataset, and its view class."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws("/", _pick(_SCENES, F.col("user_id")), F.col("event_type"), F.concat(F.lit("ep"), F.col("user_id")), _pick(_ENDS, F.col("event_id"))).alias("s"))
    return rows.select("event_id", scalar.scene_role(F.col("s")).alias("camera"), scalar.scene_domain(F.col("s")).alias("family"), scalar.scene_view(F.col("s")).alias("view"))


_SCENE_CLASSES = f"""WITH e AS (SELECT event_id, {_sql_pick(_SCENES, "user_id")} AS d, {_sql_pick(_ENDS, "event_id")} AS v FROM events)
SELECT event_id, CASE v WHEN 'exterior_image_1_left' THEN 'global' WHEN 'exterior_image_2_left' THEN 'side' WHEN 'wrist_image_left' THEN 'wrist_left' ELSE v END AS camera,
(CASE d WHEN 'DROID' THEN 0 WHEN 'bridgev2' THEN 0 WHEN 'robotwin2.0' THEN 1 WHEN 'EgoDex' THEN 2 ELSE 3 END)::INTEGER AS family,
(CASE v WHEN 'head' THEN 0 WHEN 'wrist_image_left' THEN 1 WHEN 'wrist_right' THEN 2 WHEN 'exterior_image_1_left' THEN 3 WHEN 'exterior_image_2_left' THEN 4 ELSE 5 END)::INTEGER AS view FROM e"""

_TAILS = ["clean_50/ep1.hdf5", "../up/random_50/./ep2", "random_50//x/../ep3.mp4", "other/ep.4"]


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path's variant, whether it lies in a root by its text, and whether it ends as another one does."""
    path = F.concat(F.lit("/data/"), F.col("event_type"), F.lit("/"), _pick(_TAILS, F.col("event_id")))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", path.alias("p"))
    other = F.concat(F.lit("/mnt/x/data/"), F.col("event_type"), F.lit("/clean_50/ep1.hdf5"))
    stated = F.when(F.col("event_id") % 7 == 0, "stated")
    return rows.select("event_id", scalar.path_variant(stated, F.col("p"), ["clean_50", "random_50"]).alias("variant"), scalar.is_inside(F.col("p"), "/data/x/../click").alias("inside"), scalar.same_under_mounts(F.col("p"), other).alias("same"))


_PATH_RULES = """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'stated' WHEN event_id % 4 = 0 THEN 'clean_50' WHEN event_id % 4 < 3 THEN 'random_50' END AS variant,
event_type = 'click' AND event_id % 4 <> 1 AS inside, event_id % 4 = 0 AS same FROM events"""


def path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and their shards, paths by a template, and the scene folder after a keyword."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    name = scalar.part_name(F.col("event_type"), F.pmod("user_id", F.lit(16)).cast("int"), 16)
    path = scalar.chunk_path("data/chunk-{chunk}/{view}/episode_{episode}.parquet", F.col("event_id"), 1000, view=F.col("event_type"))
    video = F.concat(F.lit("/m/"), _pick(["split_videos/", "video/RDT-1B/", "x/"], F.col("event_id")), F.col("event_type"), F.lit("/a b."), F.col("user_id"), F.lit(".mp4"))
    return rows.select("event_id", name.alias("part"), scalar.part_shard(name, 16).alias("shard"), F.coalesce(scalar.part_shard(name, 8), F.lit(-1)).alias("other"), path.alias("path"), scalar.scene_folder(video).alias("scene"))


_TEMPLATES = """SELECT event_id, event_type || '.n16.shard' || lpad((user_id % 16)::VARCHAR, 4, '0') || '.jsonl' AS part, (user_id % 16)::INTEGER AS shard, -1 AS other,
'data/chunk-' || lpad((event_id // 1000)::VARCHAR, 3, '0') || '/' || event_type || '/episode_' || lpad(event_id::VARCHAR, 6, '0') || '.parquet' AS path,
CASE WHEN event_id % 3 = 2 THEN '/m/x/' ELSE '' END || event_type || '/a b.' || user_id AS scene FROM events"""


def camera_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cameras of an episode in a wanted or the sorted order, the layout that its features name, and its prompt."""
    names = F.collect_set(F.concat(F.lit("cam"), F.col("l_linenumber").cast("string")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(names.alias("have"))
    some = scalar.cameras(F.col("have"), ["cam3", "cam1"])
    every = F.reverse(scalar.cameras(F.col("have"), None))
    layout = F.when(F.array_contains("have", "cam7"), "joints").when(F.array_contains("have", "cam5"), "pose").otherwise("none")
    return rows.select("l_orderkey", F.array_join(some, ",").alias("some"), F.array_join(every, ",").alias("every"), layout.alias("layout"), scalar.camera_prompt(some, F.lit("do it")).alias("prompt"))


_CAMERA_LISTS = """WITH l AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS h FROM lineitem GROUP BY l_orderkey), s AS (SELECT *, list_filter([3, 1], lambda x: list_contains(h, x)) AS w FROM l)
SELECT l_orderkey, array_to_string(list_transform(w, lambda x: 'cam' || x), ',') AS some, array_to_string(list_transform(list_reverse_sort(h), lambda x: 'cam' || x), ',') AS every,
CASE WHEN list_contains(h, 7) THEN 'joints' WHEN list_contains(h, 5) THEN 'pose' ELSE 'none' END AS layout,
array_to_string(list_append(list_transform(w, lambda x, i: i || ': cam' || x || ';'), 'do it'), ' ') AS prompt FROM s"""


def first_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty scenes by name of those wanted, with the pairs that a stride of five leaves, and none for a single frame."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase")).groupBy(F.concat_ws("/", "event_type", "user_id").alias("scene")).agg(F.count(F.lit(1)).alias("n"))
    return rows.orderBy("scene").limit(30).select("scene", F.expr("greatest(0, (n - 1) div 5)").alias("pairs"))


_FIRST_SCENES = "SELECT event_type || '/' || user_id AS scene, greatest(0, (count(*) - 1) // 5) AS pairs FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL ORDER BY scene LIMIT 30"


def output_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each output's first fault against what its row was to be: protocol, row, shape or digest, or missing."""
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.concat(F.lit("p"), F.col("c_nationkey") % 3).alias("protocol"), F.sha2("c_name", 256).alias("digest"))
    done = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 5").select(
        F.col("c_custkey").alias("row"), F.when(F.col("c_custkey") % 13 == 1, "px").otherwise(F.concat(F.lit("p"), F.col("c_nationkey") % 3)).alias("has_protocol"),
        F.when(F.col("c_custkey") % 17 == 2, F.array(F.lit(3))).otherwise(F.array(F.lit(5), F.lit(7))).alias("shape"), F.sha2(F.when(F.col("c_custkey") % 19 == 3, "other").otherwise(F.col("c_name")), 256).alias("has_digest"),
    )
    fault = (
        F.when(F.col("shape").isNull(), "missing").when(F.col("has_protocol") != F.col("protocol"), "protocol").when(F.col("shape") != F.array(F.lit(5), F.lit(7)), "shape")
        .when(F.col("has_digest") != F.col("digest"), "digest").otherwise("bound")
    )
    return wanted.join(done, "row", "left").select("row", fault.alias("fault"))


_BINDINGS = "SELECT c_custkey AS row, CASE WHEN c_custkey % 11 = 5 THEN 'missing' WHEN c_custkey % 13 = 1 THEN 'protocol' WHEN c_custkey % 17 = 2 THEN 'shape' WHEN c_custkey % 19 = 3 THEN 'digest' ELSE 'bound' END AS fault FROM customer"


def single_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that exactly one entry of a mixture has, and the others with how often they stand there."""
    rows = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 7 * F.col("s_nationkey")).alias("name")).agg(F.count(F.lit(1)).alias("entries"), F.min("s_suppkey").alias("first"))
    return rows.select("name", "entries", F.when(F.col("entries") == 1, F.col("first")).alias("chosen"))


_SINGLE = "SELECT s_suppkey % 7 * s_nationkey AS name, count(*) AS entries, CASE WHEN count(*) = 1 THEN min(s_suppkey) END AS chosen FROM supplier GROUP BY ALL"


def shared_file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of a shared file at which an episode begins, by its time and rate (half-even), within the file."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") % 600).alias("ts"), (F.pmod("o_custkey", F.lit(3)) * 10 + 10).cast("double").alias("fps"))
    return rows.select("o_orderkey", fs.in_frames(F.bround(F.round(F.col("ts"), 2) * F.col("fps"), 0).cast("long"), F.lit(20000)).alias("frame"))


_OFFSETS = "SELECT o_orderkey, round_even(round(o_totalprice % 600, 2) * (o_custkey % 3 * 10 + 10)::DOUBLE, 0)::BIGINT AS frame FROM orders"


def distinct_latent_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An episode's latent files, each once; another episode may name the same ones again."""
    paths = F.array_distinct(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda k: F.concat(F.lit("latent"), F.floor(k / 2).cast("string"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(paths.alias("paths")).select("l_orderkey", F.posexplode("paths").alias("k", "path"))


_DISTINCT = """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber // 2 AS f FROM lineitem)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY f) - 1)::INTEGER AS k, 'latent' || f AS path FROM d"""


def covering_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the source frames that chunks of 16 at 20 a second need of a series at 30, or of one at 12."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("source", F.when(F.col("episode") % 2 == 0, 30.0).otherwise(12.0)).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 16"))))
    rows = rows.withColumn("start", F.col("start") * 8)
    found = fs.covering_slice(F.col("start"), F.col("start") + 16, F.col("n"), F.col("source"), F.lit(20.0))
    return rounded(rows.withColumn("s", found).select("episode", "start", "s.first", "s.last", "s.offset"))


_COVERING = """WITH n AS (SELECT user_id AS episode, count(*)::BIGINT AS n, CASE WHEN user_id % 2 = 0 THEN 1.5 ELSE 0.6 END::DOUBLE AS r FROM events GROUP BY user_id), k AS (SELECT *, unnest(range((n - 1) // 16 + 1)) * 8 AS start FROM n)
SELECT episode, start, floor(start * r)::BIGINT AS "first", least(n, greatest(ceil((start + 15) * r)::BIGINT + 2, floor(start * r)::BIGINT + 1)) AS "last", round(start * r - floor(start * r), 6) AS "offset" FROM k"""


def random_stride_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs of frames at multiples of six, each with a stride of two to six by a hash of its place, no longer than the scene."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scene")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.withColumn("frame", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.expr("greatest(0, (n - 1) div 6 - 1)")), lambda k: k * 6)))
    stride = F.least(F.pmod(sampling.spread(F.col("scene"), F.col("frame"), seed=5), F.lit(5)) + 2, F.col("n") - 1 - F.col("frame"))
    return rows.select("scene", "frame", (F.col("frame") + stride).alias("target"))


_GRID = """WITH n AS (SELECT user_id AS scene, count(*)::BIGINT AS n FROM events GROUP BY user_id HAVING count(*) > 1), f AS (SELECT scene, n, unnest(range(greatest(0, (n - 1) // 6 - 1) + 1)) * 6 AS frame FROM n)
SELECT scene, frame, frame + least(('0x' || substr(md5(concat_ws('|', '5', scene::VARCHAR, frame::VARCHAR)), 1, 15))::BIGINT % 5 + 2, n - 1 - frame) AS target FROM f"""


def random_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each read of a nation's customers an instruction of its region, chosen by a hash of the read."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("texts"))
    where = table(spark, sf_dir, "nation").join(nations, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), "texts")
    rows = table(spark, sf_dir, "customer").join(where, "c_nationkey")
    return rows.select("c_custkey", F.get("texts", F.pmod(sampling.spread(F.col("c_custkey"), seed=2), F.size("texts")).cast("int")).alias("text"))


_INSTRUCTIONS = """WITH t AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS texts FROM nation GROUP BY n_regionkey)
SELECT c_custkey, texts[('0x' || substr(md5(concat_ws('|', '2', c_custkey::VARCHAR)), 1, 15))::BIGINT % len(texts) + 1] AS text FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN t USING (n_regionkey)"""


def same_size_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each unreadable part the first readable one of eight tries among the parts of its size, and of ten among all; null where none is."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    numbered = sampling.numbered(rows, ["p_size"], "p_partkey", "place", "n")
    everywhere = sampling.numbered(rows, [], "p_partkey", "place", "n")
    bad = F.col("p_partkey") % 5 == 0

    def found(pool: DataFrame, on: list[str], tries: int, name: str) -> DataFrame:
        sizes = pool.select(*on, "n").distinct() if on else pool.agg(F.max("n").alias("n"))
        asked = rows.where(bad).join(sizes, on) if on else rows.where(bad).join(F.broadcast(sizes))
        asked = asked.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(tries))))
        asked = asked.withColumn("place", F.pmod(sampling.spread(F.col("p_partkey"), F.col("attempt"), seed=6), F.col("n")))
        other = pool.where(~bad).select(*on, "place", F.col("p_partkey").alias("other"))
        return asked.join(other, [*on, "place"]).groupBy("p_partkey").agg(F.min_by("other", "attempt").alias(name))

    return rows.where(bad).select("p_partkey").join(found(numbered, ["p_size"], 8, "same_size"), "p_partkey", "left").join(found(everywhere, [], 10, "any_size"), "p_partkey", "left")


_SIX = "('0x' || substr(md5(concat_ws('|', '6', p_partkey::VARCHAR, attempt::VARCHAR)), 1, 15))::BIGINT"
_NOUGHT = "('0x' || substr(md5(concat_ws('|', '0', p_partkey::VARCHAR)), 1, 15))::BIGINT"
_SAME_SIZE = f"""WITH p AS (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY {_NOUGHT}, p_partkey) - 1 AS own, row_number() OVER (ORDER BY {_NOUGHT}, p_partkey) - 1 AS every,
    count(*) OVER (PARTITION BY p_size) AS n, count(*) OVER () AS total FROM part),
t AS (SELECT *, unnest(range(1, 11)) AS attempt FROM p WHERE p_partkey % 5 = 0),
a AS (SELECT t.p_partkey, arg_min(q.p_partkey, attempt) AS same_size FROM t JOIN p q ON t.p_size = q.p_size AND {_SIX.replace('p_partkey', 't.p_partkey')} % t.n = q.own WHERE q.p_partkey % 5 <> 0 AND attempt <= 8 GROUP BY 1),
b AS (SELECT t.p_partkey, arg_min(q.p_partkey, attempt) AS any_size FROM t JOIN p q ON {_SIX.replace('p_partkey', 't.p_partkey')} % t.total = q.every WHERE q.p_partkey % 5 <> 0 GROUP BY 1)
SELECT p_partkey, same_size, any_size FROM part LEFT JOIN a USING (p_partkey) LEFT JOIN b USING (p_partkey) WHERE p_partkey % 5 = 0"""


def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least loss that a run's log lines name, and only for runs whose last epoch is there."""
    line = F.format_string("epoch %d/9 step %d loss=%.3f", F.pmod("event_id", F.lit(10)).cast("int"), F.col("event_id"), F.col("value"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), line.alias("line"))
    found = rows.select("run", F.regexp_extract("line", r"epoch (\d+)/(\d+)", 1).cast("int").alias("epoch"), F.regexp_extract("line", r"epoch (\d+)/(\d+)", 2).cast("int").alias("last"), F.regexp_extract("line", r"loss=(-?[0-9.]+)", 1).cast("double").alias("loss"))
    best = found.groupBy("run").agg(F.min("loss").alias("best"), F.bool_or(F.col("epoch") == F.col("last")).alias("whole"))
    return best.where("whole").select("run", "best")


_LOGS = "SELECT user_id AS run, min(round(value, 3)) AS best FROM events GROUP BY user_id HAVING bool_or(event_id % 10 = 9)"


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as JSON by type and read back, and whether they keep their contract of widths."""
    kind = F.when(F.col("vec_id") % 2 == 0, "position").otherwise("rotation")
    value = F.transform(F.slice("embedding", F.lit(1), F.when(F.col("vec_id") % 2 == 0, 3).otherwise(F.when(F.col("vec_id") % 7 == 0, 5).otherwise(6))), lambda x: x.cast("double"))
    text = F.to_json(F.struct(kind.alias("type"), value.alias("value")))
    back = table(spark, sf_dir, "embeddings").select("vec_id", F.from_json(text, "type string, value array<double>").alias("r"))
    contract = F.when(F.col("r.type") == "position", 3).otherwise(6)
    return rounded(back.select("vec_id", F.col("r.type").alias("type"), F.aggregate("r.value", F.lit(0.0), lambda a, x: a + x).alias("total"), (F.size("r.value") == contract).alias("kept")))


_RECORDS = """SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'position' ELSE 'rotation' END AS type, round(list_sum(list_transform(embedding[1 : CASE WHEN vec_id % 2 = 0 THEN 3 WHEN vec_id % 7 = 0 THEN 5 ELSE 6 END], lambda x: x::DOUBLE)), 6) AS total,
vec_id % 2 = 0 OR vec_id % 7 <> 0 AS kept FROM embeddings"""


def caption_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default for blank captions, and four values of a series on a grid three times as fine."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", scalar.caption_or(F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("  "), "perform the task").alias("caption"))
    fine = fs.finer(F.array(*[(F.col("turn") * k * k).cast("double") for k in range(4)]), 3)
    return rounded(rows.select("conv_id", "turn", "caption", F.size(fine).alias("n"), F.get(fine, F.lit(4)).alias("fifth"), F.element_at(fine, -1).alias("last")))


_FALLBACKS = "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE 'perform the task' END AS caption, 10 AS n, round(turn * 2.0::DOUBLE, 6) AS fifth, (turn * 9)::DOUBLE AS \"last\" FROM conversations"


def balanced_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to eight workers, longest first, each to the least loaded."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count(F.lit(1)).alias("length"))
    return sampling.least_loaded(rows, "episode", "length", 8).groupBy("worker").agg(F.count(F.lit(1)).alias("episodes"), F.sum("length").alias("load"), F.sum("episode").alias("ids"))


#: The sequential rule as a recursion over the lengths in order: the least loaded worker is a step's state.
_BALANCED = """WITH RECURSIVE e AS (SELECT l_orderkey AS episode, count(*)::BIGINT AS length FROM lineitem GROUP BY l_orderkey), o AS (SELECT *, row_number() OVER (ORDER BY length DESC, episode) AS k FROM e),
s(k, loads, worker) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], 0::BIGINT UNION ALL
  SELECT s.k + 1, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + o.length ELSE x END), (list_position(loads, list_min(loads)) - 1)::BIGINT FROM s JOIN o ON o.k = s.k + 1)
SELECT worker::INTEGER AS worker, count(*) AS episodes, sum(length)::BIGINT AS load, sum(episode)::BIGINT AS ids FROM s JOIN o USING (k) GROUP BY worker"""

QUERIES = {
    "view_roles": (view_roles, _VIEW_ROLES),
    "scene_classes": (scene_classes, _SCENE_CLASSES),
    "path_rules": (path_rules, _PATH_RULES),
    "path_templates": (path_templates, _TEMPLATES),
    "camera_lists": (camera_lists, _CAMERA_LISTS),
    "first_scenes": (first_scenes, _FIRST_SCENES),
    "output_bindings": (output_bindings, _BINDINGS),
    "single_entries": (single_entries, _SINGLE),
    "shared_file_offsets": (shared_file_offsets, _OFFSETS),
    "distinct_latent_paths": (distinct_latent_paths, _DISTINCT),
    "covering_slices": (covering_slices, _COVERING),
    "random_stride_grid": (random_stride_grid, _GRID),
    "random_instructions": (random_instructions, _INSTRUCTIONS),
    "same_size_substitutes": (same_size_substitutes, _SAME_SIZE),
    "log_metrics": (log_metrics, _LOGS),
    "json_records": (json_records, _RECORDS),
    "caption_fallbacks": (caption_fallbacks, _FALLBACKS),
    "balanced_workers": (balanced_workers, _BALANCED),
}
