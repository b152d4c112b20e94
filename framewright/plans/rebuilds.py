"""Queries on the manifest cascade: what is kept, what is dropped and why, and the index of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import manifest
from framewright.plans.tables import rounded, table

_NAMES = ["head", "wrist_left", "global"]
_SUFFIXES = [".mp4", ".hdf5", "", ".txt", ".mkv", ".ts", ".webm"]


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of one type as an episode of one to three views, with a fault here and there by its number u."""
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.col("user_id").alias("u")).agg(F.count(F.lit(1)).alias("n"))

    def view(k: int):
        name = F.when((F.col("u") % 17 == 3) & F.lit(k == 1), "chest").when((F.col("u") % 53 == 5) & F.lit(k == 2), "a/b").otherwise(_NAMES[k])
        suffix = F.get(F.array(*[F.lit(s) for s in _SUFFIXES]), F.pmod(F.col("u") + k, F.lit(len(_SUFFIXES))).cast("int"))
        path = F.when((F.col("u") % 29 == 4) & F.lit(k == 0), F.lit(None).cast("string")).otherwise(F.concat(F.lit("v/"), F.col("u"), suffix))
        return F.struct(name.alias("key"), F.struct(path.alias("video_path"), (F.col("u") % 2 == 0).alias("is_store"), F.when(F.col("u") % 3 == 0, 12.5).alias("measured_fps")).alias("value"))

    views = F.map_from_entries(F.slice(F.array(*[view(k) for k in range(3)]), F.lit(1), F.pmod("u", F.lit(3)).cast("int") + 1))
    caption = F.array(F.struct(F.lit(2.0).alias("start_time"), F.lit("and grasp").alias("description")), F.struct(F.lit(1.0).alias("start_time"), F.concat(F.lit("reach "), F.col("event_type")).alias("description")))
    return rows.select(
        F.when(F.col("u") % 19 == 5, "").otherwise(F.col("event_type")).alias("dataset"), F.when(F.col("u") % 23 == 7, "a/../b").otherwise(F.concat(F.lit("chunk/ep"), F.col("u"))).alias("episode_id"),
        (2 * F.col("u")).alias("position"),
        caption.alias("caption"), F.when(F.col("u") % 2 == 0, 7).alias("gap"), F.when(F.col("u") % 59 != 11, views).alias("views"), "u", "n",
    )


def _latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of the episodes' views: some missing, some unreadable, some of another protocol."""
    rows = _episodes(spark, sf_dir).select("dataset", "episode_id", "u", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("view")) for k, v in enumerate(_NAMES)])).alias("v")).select("dataset", "episode_id", "u", "n", "v.*")
    gone = (F.col("u") + F.col("k")) % 11 == 0
    u = F.col("u")
    meta = F.struct(
        (F.col("n") - 1).cast("int").alias("num_latents"), F.when(u % 31 == 8, F.array(F.lit(4), F.lit(4))).when(u % 31 == 9, F.array(F.lit(5))).otherwise(F.array(F.lit(4))).alias("code_shape"),
        (F.pmod(u, F.lit(4)) * 10).cast("double").alias("fps"), F.when(u % 3 == 0, 4).alias("gap"), F.when(u % 37 == 2, -1).when(u % 7 == 0, F.col("k") * 12).alias("start_frame"),
        F.when(u % 41 == 6, F.lit(None).cast("int")).when(u % 43 == 1, 2).otherwise(4).alias("pair_stride"), F.when(u % 47 == 3, "mean").otherwise("flat").alias("representation"), F.when(u % 5 == 0, F.concat(F.lit("/r/"), u)).alias("source"),
    )
    how = F.when(gone & (u % 2 == 0), "missing_latent").when(gone, "unreadable_latent").when(u % 9 == 1, "npz").otherwise("tail")
    return rows.select("dataset", "episode_id", "view", how.alias("how"), F.when(~gone, meta).alias("meta"))


def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every sixth episode comes twice; the second time it is a duplicate if the first was kept
    episodes = _episodes(spark, sf_dir)
    episodes = episodes.unionByName(episodes.where("u % 6 = 1").withColumn("position", F.col("position") + 1))
    latents = _latents(spark, sf_dir).dropDuplicates(["dataset", "episode_id", "view"])
    return manifest.rebuild(episodes, latents, 4, 4, "flat", 24, position="position")


_CASES = f"""p AS (SELECT event_type, u, n, size, unnest(range(1 + (u % 6 = 1)::INTEGER)) AS again FROM (SELECT event_type, user_id AS u, count(*) AS n, user_id % 3 + 1 AS size FROM events GROUP BY ALL)),
e AS (SELECT *, CASE WHEN u % 19 = 5 THEN '' ELSE event_type END AS dataset, CASE WHEN u % 23 = 7 THEN 'a/../b' ELSE 'chunk/ep' || u END AS episode_id,
    u % 19 = 5 OR u % 59 = 11 AS malformed, u % 23 = 7 OR (size = 3 AND u % 53 = 5) AS unsafe, size > 1 AND u % 17 = 3 AS unmapped FROM p),
v AS (SELECT *, unnest(range(size)) AS k FROM e WHERE NOT malformed AND NOT unsafe AND NOT unmapped),
s AS (SELECT *, [0, 1, 3][k + 1] AS role, ['head', 'wrist_left', 'global'][k + 1] AS view, {"[" + ", ".join(f"'{s}'" for s in _SUFFIXES) + "]"}[(u + k) % {len(_SUFFIXES)} + 1] AS suffix, (u + k) % 11 = 0 AS gone FROM v),
j AS (SELECT *, CASE WHEN u % 29 = 4 AND k = 0 THEN 'no_video_path' WHEN suffix = '' AND u % 2 = 1 THEN 'unsupported_source:dir' WHEN suffix = '.txt' THEN 'unsupported_source:.txt' WHEN gone THEN NULL WHEN n - 1 < 1 THEN 'bad_num_latents'
    WHEN u % 31 = 8 THEN 'latent_dim_mismatch:[4, 4]' WHEN u % 31 = 9 THEN 'latent_dim_mismatch:[5]' WHEN u % 37 = 2 THEN 'negative_start_frame:-1' WHEN u % 41 = 6 THEN 'pair_stride_mismatch:1' WHEN u % 43 = 1 THEN 'pair_stride_mismatch:2'
    WHEN u % 47 = 3 THEN 'representation_mismatch:mean' END AS fault, CASE WHEN u % 5 = 0 THEN '/r/' || u ELSE 'v/' || u || suffix END AS video,
    CASE WHEN u % 4 > 0 THEN u % 4 * 10.0 WHEN suffix = '.hdf5' AND u % 3 = 0 THEN 12.5 ELSE 30.0 END::DOUBLE AS fps, CASE WHEN u % 7 = 0 THEN k * 12 ELSE 0 END AS start FROM s),
g AS (SELECT event_type, u, arg_min(fault, role) FILTER (fault IS NOT NULL) AS fault, bool_or(gone) AS incomplete, count(*) AS views, arg_min(fps, role) AS fps, string_agg(view || '=' || video, ',' ORDER BY role) AS paths, sum(start)::BIGINT AS starts FROM j WHERE again = 0 GROUP BY ALL),
r AS (SELECT e.*, g.* EXCLUDE (event_type, u), CASE WHEN malformed THEN 'malformed' WHEN unsafe THEN 'unsafe_name' WHEN unmapped THEN 'unmapped_camera:chest' WHEN fault IS NOT NULL THEN fault WHEN incomplete THEN 'incomplete_views' WHEN again > 0 THEN 'duplicate_episode' END AS reason FROM e LEFT JOIN g USING (event_type, u))"""


def manifest_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each episode's reason to fall, or its views, sources and rates, its gap, and its caption."""
    rows = _rebuilt(spark, sf_dir)
    paths = F.array_join(F.transform("views", lambda v: F.concat(v["view"], F.lit("="), v["video_path"])), ",")
    starts = F.aggregate("views", F.lit(0).cast("long"), lambda a, v: a + v["start_frame"])
    return rounded(rows.groupBy("dataset", "episode_id", "reason", "caption", "gap", "latent_dim", F.size("views").alias("n"), F.get("views", F.lit(0))["fps"].alias("fps"), paths.alias("paths"), starts.alias("starts")).agg(F.count(F.lit(1)).alias("times")).withColumn("n", F.when(F.col("reason").isNull(), F.col("n"))))


_REBUILD = f"""WITH {_CASES} SELECT dataset, episode_id, reason, 'reach ' || CASE WHEN length('reach ' || event_type || ' and grasp') <= 24 THEN event_type || ' and grasp' ELSE event_type || ' and' END AS caption,
(CASE WHEN reason IS NULL THEN CASE WHEN u % 3 = 0 THEN 4 WHEN u % 2 = 0 THEN 7 ELSE 5 END END)::INTEGER AS gap, (CASE WHEN reason IS NULL THEN 4 END)::INTEGER AS latent_dim, (CASE WHEN reason IS NULL THEN views END)::INTEGER AS n,
CASE WHEN reason IS NULL THEN fps END AS fps, CASE WHEN reason IS NULL THEN paths END AS paths, CASE WHEN reason IS NULL THEN starts END AS starts, count(*) AS times FROM r GROUP BY ALL"""


def manifest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters by dataset: kept, reasons, probe statuses, where paths and rates come from."""
    return manifest.drop_counts(_rebuilt(spark, sf_dir))


_COUNTERS = f"""WITH {_CASES}, live AS (SELECT j.*, r.reason FROM j JOIN r USING (event_type, u, again) WHERE reason IS NULL OR reason IN ('incomplete_views', 'duplicate_episode')),
c AS (SELECT dataset, 'kept' AS counter FROM r WHERE reason IS NULL OR reason = 'duplicate_episode' UNION ALL SELECT dataset, 'views_' || views FROM r WHERE reason IS NULL OR reason = 'duplicate_episode' UNION ALL SELECT dataset, reason FROM r WHERE reason IS NOT NULL
UNION ALL SELECT dataset, 'probe_' || CASE WHEN gone AND u % 2 = 0 THEN 'missing_latent' WHEN gone THEN 'unreadable_latent' WHEN u % 9 = 1 THEN 'npz' ELSE 'tail' END FROM live
UNION ALL SELECT dataset, CASE WHEN u % 2 = 0 THEN 'missing_latent' ELSE 'unreadable_latent' END FROM live WHERE gone
UNION ALL SELECT dataset, 'windowed_start_frame:' || dataset FROM live WHERE NOT gone AND start <> 0
UNION ALL SELECT dataset, CASE WHEN u % 5 = 0 THEN 'video_path_resolved' ELSE 'video_path_verbatim' END FROM live WHERE NOT gone
UNION ALL SELECT dataset, 'no_protocol_source' FROM live WHERE NOT gone AND u % 5 <> 0
UNION ALL SELECT dataset, CASE WHEN suffix = '.hdf5' AND u % 3 = 0 THEN 'fps_measured_hdf5:' || dataset ELSE 'fps_fallback:' || dataset || ':30' END FROM live WHERE NOT gone AND u % 4 = 0)
SELECT dataset, counter, count(*) AS n FROM c GROUP BY ALL"""


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index rows of kept episodes: length and rate by the view of the lowest role, stride, views in order of role, and whether a chunk fits."""
    rows = manifest.index_rows(_rebuilt(spark, sf_dir), 3, 0.25)
    return rounded(rows.select("dataset", "episode_id", "nlat", "fps", "stride", "pair_stride", "start_frame", F.array_join(F.transform("views", lambda v: F.concat(v["role"].cast("string"), F.lit("@"), v["start_frame"].cast("string"))), ",").alias("views"), "kept"))


_INDEX = f"""WITH {_CASES}, w AS (SELECT event_type, u, string_agg(role || '@' || start, ',' ORDER BY role) AS slots FROM j WHERE again = 0 GROUP BY ALL),
i AS (SELECT *, greatest(1, round_even(fps * 0.25::DOUBLE / 4, 0)::INTEGER) AS stride FROM r JOIN w USING (event_type, u) WHERE reason IS NULL)
SELECT dataset, episode_id, (n - 1)::INTEGER AS nlat, fps, stride, 4 AS pair_stride, 0 AS start_frame, slots AS views, n - 1 >= 2 * stride + 1 AS kept FROM i"""

QUERIES = {
    "manifest_rebuild": (manifest_rebuild, _REBUILD),
    "manifest_counters": (manifest_counters, _COUNTERS),
    "index_build": (index_build, _INDEX),
}
