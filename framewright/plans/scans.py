"""Queries over files that are made from the driver's tables, written to the shared folder, and read back in ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.ranges import running, shared_dir, stored
from framewright.plans.tables import table
from framewright.sources import probes, scans
from framewright.sources.manifests import read_tar_index
from framewright.sources.zarr import read_zarr_frames, write_zarr_frames


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: documents as files of one JSON array each, scanned in pieces and put together again, whatever their texts hold."""
    path = _path(spark, "arrays")
    scans.write_array(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    rows = scans.read_json_array(spark, path, "doc_id long, text string, source string")
    return rows.select("doc_id", "source", F.length("text").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


_ARRAYS = "SELECT doc_id, source, length(text)::INTEGER AS n, sha256(text) AS sha256 FROM documents"


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: events as JSON lines with a blank one after each, read with their numbers: every odd number once a file."""
    path = _path(spark, "lines")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("string").alias("ts"))
    rows.select(F.concat(F.to_json(F.struct("*")), F.lit("\n"))).write.text(path)
    found = scans.read_json_lines(spark, path, "event_id long, event_type string, ts string")
    files = found.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("number").alias("s"), F.max("number").alias("last"))
    files = files.select("file", ((F.col("s") == F.col("n") * F.col("n")) & (F.col("last") == 2 * F.col("n") - 1)).alias("gapless"))
    types = found.join(files, "file").groupBy("event_type")
    return types.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.substring(F.max("ts"), 1, 19).alias("last"), F.bool_and("gapless").alias("gapless"))


_LINES = "SELECT event_type, count(*) AS n, min(event_id) AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, true AS gapless FROM events GROUP BY event_type"


def tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as members of tar archives with their indexes, read back by name, each from its own range of bytes."""
    path = _path(spark, "tars")
    rows = table(spark, sf_dir, "documents").where("text <> ''")
    scans.write_tars(rows.select(F.concat(F.lit("doc/"), "doc_id", F.lit(".txt")).alias("n"), F.col("text").cast("binary").alias("content")), path, 12)
    found = scans.read_members(read_tar_index(spark, f"{path}/*.jsonl", path))
    return found.select(F.regexp_extract("n", r"(\d+)", 1).cast("long").alias("doc_id"), F.length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


_TARS = "SELECT doc_id, octet_length(encode(text))::INTEGER AS n_bytes, sha256(text) AS sha256 FROM documents WHERE text <> ''"


def scene_frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scenes of both forms, with depth archives for two thirds of them, which are probed once; a second run opens none. Every fifth has its sizes from a manifest."""
    path = _path(spark, "scenes")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.pmod("p_partkey", F.lit(2)).alias("form"), (F.pmod("p_partkey", F.lit(17)) + 1).cast("int").alias("num_frames"), F.col("p_size").cast("int").alias("height"), F.lit(4).alias("width"))
    legacy = F.concat(F.lit("parts/"), "p_partkey", F.lit("/exports/mini_npz/results"))
    own = F.concat(F.lit("own/"), "p_partkey")
    rows = rows.withColumn("name", F.when(F.col("form") == 0, legacy).otherwise(own))
    probes.write_depths(rows.where("p_partkey % 3 <> 2"), path)
    video = F.concat(F.lit("/m/split_videos/parts/"), "p_partkey", F.lit(".mp4"))
    at = F.concat(F.lit(f"{path}/"), "name", F.lit(".npz"))
    explicit = lambda c: F.when(F.col("form") == 1, c)
    scans.write_array(rows.select(explicit(F.concat(F.lit("/v/part "), "p_partkey", F.lit(".mp4"))).alias("rgb"), explicit(at).alias("depth_npz"), explicit(at).alias("flow_npz"), F.when(F.col("form") == 0, video).alias("path")), f"{path}/lists")
    scenes = stored(probes.read_scene_list(spark, f"{path}/lists", path, path), "scenes")
    key = F.regexp_extract("scene", r"(\d+)$", 1).cast("long")
    manifest = scenes.where(key % 5 == 0).select(F.col("scene").alias("scene_id"), F.lit(7).alias("height"), F.lit(8).alias("width"), F.lit(9).alias("num_frames"))
    probes.update_counts(scenes, f"{path}/store")
    again = probes.update_counts(scenes, f"{path}/store")
    found = probes.frame_counts(scenes, f"{path}/store", 3, manifest, probe=False)
    return found.select("scene", "dataset", "role", *[F.when(F.col("height") > 0, F.col(c)).alias(c) for c in ("height", "width", "num_frames", "has_flow_npz")], "pairs", F.lit(again).cast("long").alias("opened_again"))


_SCENES = """WITH s AS (SELECT *, p_partkey % 2 = 1 AS own, p_partkey % 5 = 0 AS told, p_partkey % 3 <> 2 AS there FROM part)
SELECT CASE WHEN own THEN 'part_' ELSE 'parts/' END || p_partkey AS scene, CASE WHEN own THEN 'unknown' END AS dataset, CASE WHEN own THEN 'part_' || p_partkey END AS role,
CASE WHEN told THEN 7 WHEN there THEN p_size END::BIGINT AS height, CASE WHEN told THEN 8 WHEN there THEN 4 END::BIGINT AS width, CASE WHEN told THEN 9 WHEN there THEN p_partkey % 17 + 1 END::BIGINT AS num_frames,
CASE WHEN told THEN true WHEN there THEN own END AS has_flow_npz, CASE WHEN told THEN 2 WHEN there THEN p_partkey % 17 // 3 ELSE 1 END::BIGINT AS pairs, 0::BIGINT AS opened_again FROM s"""


def zarr_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames of a sharded Zarr array for each source, three a chunk, read back from their ranges of bytes."""
    path = _path(spark, "zarr")
    rows = running(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["source"], [F.col("doc_id")], "frame")
    store = F.concat(F.lit(f"{path}/"), F.coalesce("source", F.lit("none")))
    write_zarr_frames(rows.select(store.alias("path"), "frame", F.col("text").alias("content")), 24, 3)
    found = read_zarr_frames(rows.select(store.alias("path")))
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), "frame", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


_ZARR = """SELECT coalesce(source, 'none') AS source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS frame, octet_length(encode(coalesce(text, '')))::INTEGER AS n_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents"""

QUERIES = {
    "zarr_frames": (zarr_frames, _ZARR),
    "scene_frame_counts": (scene_frame_counts, _SCENES),
    "json_array_scan": (json_array_scan, _ARRAYS),
    "numbered_lines": (numbered_lines, _LINES),
    "tar_members": (tar_members, _TARS),
}
