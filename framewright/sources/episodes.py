"""Episode corpora as tables: frames in Parquet shards, their metadata, scene manifests, and the folders that hold them."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalar import strip_task_prefix
from framewright.operators.ranges import running
from framewright.operators.series_joins import conflicts

#: What a version 3.0 corpus has to state.
VERSION, DIMS = "v3.0", {"action": 7, "observation.state": 7}
SCENE = "scene_id string, file string, shard string, num_frames int, num_flows int, height int, width int, bucket string, depth_stride int, dataset string, role string, tensor_prefix string"


def read_info(spark: SparkSession, path: str, robot: str | None = None) -> dict:
    """A corpus's info record; another version, robot, width of actions or states, or no video is an error. One small file: it's read to the driver."""
    info = json.loads(spark.read.text(path, wholetext=True).first()[0])
    features = info.get("features", {})
    wrong = [f"version {info.get('codebase_version')}"] if info.get("codebase_version") != VERSION else []
    wrong += [f"robot {info.get('robot_type')}"] if robot is not None and info.get("robot_type") != robot else []
    wrong += [f"{name} of {features.get(name, {}).get('shape')}" for name, n in DIMS.items() if features.get(name, {}).get("shape") != [n]]
    wrong += [] if any(f.get("dtype") == "video" for f in features.values()) else ["no video"]
    if wrong:
        raise ValueError(f"{path}: {', '.join(wrong)}")
    return info


def first_task(tasks: Column) -> Column:
    """The first task that isn't blank."""
    return F.get(F.filter(tasks, lambda t: F.trim(t) != ""), F.lit(0))


def read_episode_meta(spark: SparkSession, root: str, info: dict, category: str | None = None) -> DataFrame:
    """Episodes of a version 3.0 corpus: episode_index, length, task (without its prefix), video_path by the info's template, first frame of the shared video. Only
    these columns are read. category: primitive or composite, by the first task that isn't blank; episodes of no length are left out."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/meta/episodes")
    camera = next(name for name, f in sorted(info["features"].items()) if f.get("dtype") == "video")
    chunk, file, begin = (F.col(f"`videos/{camera}/{c}`") for c in ("chunk_index", "file_index", "from_timestamp"))
    digits = lambda c: F.lpad(c.cast("string"), 3, "0")
    path = F.lit(info["video_path"])
    for name, value in {"{video_key}": F.lit(camera), "{chunk_index:03d}": digits(chunk), "{file_index:03d}": digits(file)}.items():
        path = F.replace(path, F.lit(name), value)
    rows = rows.select("episode_index", "length", first_task(F.col("tasks")).alias("task"), path.alias("video_path"), F.bround(begin * F.lit(float(info["fps"])), 0).cast("long").alias("video_frame")).where("length > 0")
    if category is not None:
        rows = rows.where(F.startswith("task", F.lit(f"{category}:")))
    return rows.withColumn("task", strip_task_prefix(F.col("task")))


def read_lines(spark: SparkSession, root: str) -> tuple[dict, DataFrame, DataFrame]:
    """A version 2.1 corpus's info record, episodes (episode_index, tasks, length) and tasks (task_index, task)."""
    info = json.loads(spark.read.text(f"{root}/meta/info.json", wholetext=True).first()[0])
    lines = lambda name, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/meta/{name}.jsonl")
    return info, lines("episodes", "episode_index long, tasks array<string>, length long"), lines("tasks", "task_index long, task string")


def state_layout(names: list[str]) -> str:
    """How a state is laid out, by its features' names."""
    have = set(names)
    return "quaternion" if {"qx", "qy", "qz", "qw"} <= have else "euler" if {"roll", "pitch", "yaw"} <= have else "axis_angle"


#: Intervals that a set of numbers is pushed to a scan as, at most.
INTERVALS = 64


def intervals(ids: DataFrame, column: str, most: int = INTERVALS) -> list[tuple[int, int]]:
    """At most so many disjoint intervals, in order, that hold all of a column's numbers: runs of neighbouring cells, as narrow as their number allows. Nulls aren't held."""
    width = 1
    while True:
        cells = ids.where(F.col(column).isNotNull()).select(F.floor(F.col(column) / width).alias("cell")).distinct()
        # neighbouring cells are one run, which begins at a cell whose neighbour below isn't there
        below = cells.select((F.col("cell") + 1).alias("cell"))
        begins = cells.join(below, "cell", "left_anti").orderBy("cell").limit(most + 1).collect()
        if len(begins) <= most:
            above = cells.select((F.col("cell") - 1).alias("cell"))
            ends = cells.join(above, "cell", "left_anti").orderBy("cell").collect()
            return [(a.cell * width, (b.cell + 1) * width - 1) for a, b in zip(begins, ends)]
        width *= 4


def read_frames(spark: SparkSession, root: str, episodes: DataFrame | None = None, columns: list[str] | None = None, complete: bool = False) -> DataFrame:
    """Frames of all shards below root/data, of the given episodes only: their numbers go to the scan as at most INTERVALS intervals, which passes over row groups that have none of them; a join
    does the rest. complete: an episode whose frames aren't 0 to length - 1, each once, is an error, and so is one without any (episodes then has length)."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data")
    rows = rows.select("episode_index", "frame_index", *(columns or [c for c in rows.columns if c not in ("episode_index", "frame_index")]))
    if episodes is None:
        return rows
    held = intervals(episodes, "episode_index")
    if not held:
        return rows.limit(0)
    rows = rows.where(reduce(or_, [F.col("episode_index").between(a, b) for a, b in held])).join(episodes.select("episode_index").distinct(), "episode_index", "left_semi")
    if complete:
        n = rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_index").alias("s"), F.min("frame_index").alias("low"), F.max("frame_index").alias("high"), F.sum(F.col("frame_index").cast("decimal(38,0)") * F.col("frame_index")).alias("q"))
        length = F.col("length")
        whole = (F.col("n") == length) & (F.col("low") == 0) & (F.col("high") == length - 1) & (F.col("s") * 2 == length * (length - 1)) & (F.col("q") * 6 == length * (length - 1) * (2 * length - 1))
        gaps = episodes.join(n, "episode_index", "left").where((length > 0) & ~F.coalesce(whole, F.lit(False))).select("episode_index").orderBy("episode_index").limit(5).collect()
        if gaps:
            raise ValueError(f"{root}: episodes {[r[0] for r in gaps]} aren't whole")
    return rows


def scattered(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Frames with their place among all episodes' frames, by the episodes' lengths in order of number. A frame outside of its episode is an error."""
    starts = running(episodes.select("episode_index", "length"), [], [F.col("episode_index")], "start", F.col("length"))
    inside = (F.col("frame_index") >= 0) & (F.col("frame_index") < F.col("length"))
    place = F.when(inside, F.col("start") + F.col("frame_index")).otherwise(F.raise_error(F.lit("a frame outside of its episode")).cast("long"))
    return frames.join(starts, "episode_index").withColumn("place", place).drop("start", "length")


def read_scenes(spark: SparkSession, paths: list[str], root: str) -> DataFrame:
    """Scene manifests in one, each scene once; a relative file lies in root. Two unequal entries of a scene are an error."""
    rows = spark.read.schema(SCENE).option("multiLine", True).json(paths).where(F.col("scene_id").isNotNull())
    file = F.coalesce("file", "shard")
    rows = rows.withColumn("file", F.when(F.startswith(file, F.lit("/")) | F.contains(file, F.lit("://")), file).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), file))).drop("shard").distinct()
    bad = conflicts(rows, "scene_id").limit(5).collect()
    if bad:
        raise ValueError(f"scenes with unequal entries: {sorted(r.scene_id for r in bad)}")
    return rows


def discover_datasets(spark: SparkSession, folder: str, skip: tuple[str, ...] = ("caption_*", "*_report")) -> DataFrame:
    """dataset, path of the episode files of a folder: JSON files that name views in their first 4096 bytes, but for names that match a pattern to skip."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    rows = rows.where(F.contains(F.substring("content", 1, 4096).cast("string"), F.lit('"views"'))).select(name.alias("dataset"), "path")
    for pattern in skip:
        rows = rows.where(~F.rlike("dataset", F.lit("^" + pattern.replace("*", ".*") + "$")))
    return rows
