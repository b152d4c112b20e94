"""Scene lists, and their sizes from the headers of depth archives, each of which is opened once and again only when it has changed."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalar import scene_folder, source_suffix
from framewright.functions.series import let
from framewright.sources.latents import npy_header
from framewright.sources.scans import _open, json_array_elements

#: An element of a scene list: explicit paths, or a video whose other files lie below roots.
ITEM = "rgb string, depth_npz string, flow_npz string, flow_mp4 string, scene_id string, dataset string, role string, start_frame long, end_frame long, path string, video_path string"
#: A probed file; height is null where its header couldn't be read.
COUNTS = "path string, stamp string, height long, width long, num_frames long"
#: Bytes of a member that are read for its header, at most.
HEADER = 1 << 16
#: Files that a task creates, asks for or opens.
FILES = 1024


def _tasks(rows: DataFrame) -> int:
    """Tasks for work that costs by file: Spark sizes tasks by bytes, of which names have few."""
    return max(1, -(-rows.count() // FILES))


def read_scene_list(spark: SparkSession, path: str, depth_root: str | None = None, flow_root: str | None = None) -> DataFrame:
    """scene, video_path, depth_npz, flow_npz, flow_mp4, original_rel, dataset, role, start_frame, end_frame of a JSON array, of any size, or of files that are one each.

    An element with rgb and depth_npz has its paths itself; its scene is scene_id or else the video's name without suffix. Another one has path or video_path, and depth and flow where the scene lies below
    their roots; without both roots it is an error. An element without a video is nothing. Blanks in names become underscores. Of elements of one scene the first counts."""
    found = json_array_elements(spark, path)
    told = lambda value: F.when(value != "", value)

    def derived(i: Column) -> Column:
        explicit = i["rgb"].isNotNull() & i["depth_npz"].isNotNull()
        video = F.when(explicit, i["rgb"]).otherwise(F.coalesce(told(i["path"]), told(i["video_path"])))
        return let(video, lambda v: let(scene_folder(v), lambda folder: let(named(i, explicit, v, folder), lambda scene: entry(i, explicit, v, folder, scene))))

    def named(i: Column, explicit: Column, video: Column, folder: Column) -> Column:
        stem = let(F.regexp_extract(video, r"([^/]*)/*$", 1), lambda name: F.substr(name, F.lit(1), F.length(name) - F.length(source_suffix(name))))
        return F.replace(F.when(explicit, F.coalesce(told(i["scene_id"]), stem)).otherwise(folder), F.lit(" "), F.lit("_"))

    def entry(i: Column, explicit: Column, video: Column, folder: Column, scene: Column) -> Column:
        if depth_root is None or flow_root is None:
            below = lambda *_: F.raise_error(F.concat(F.lit("roots of depth and flow are needed for "), video)).cast("string")
        else:
            below = lambda root, rest: F.concat(F.lit({"depth": depth_root, "flow": flow_root}[root].rstrip("/") + "/"), folder, F.lit(rest))
        either = lambda own, other: F.when(explicit, own).when(video.isNotNull(), other)
        own = lambda value: F.when(explicit, value)
        return F.struct(
            scene.alias("scene"), video.alias("video_path"), either(i["depth_npz"], below("depth", "/exports/mini_npz/results.npz")).alias("depth_npz"),
            either(F.coalesce(i["flow_npz"], F.lit("")), below("flow", "/flows.npz")).alias("flow_npz"), either(F.coalesce(i["flow_mp4"], F.lit("")), below("flow", "/flow.mp4")).alias("flow_mp4"),
            either(scene, folder).alias("original_rel"), own(F.coalesce(i["dataset"], F.lit("unknown"))).alias("dataset"), own(F.coalesce(i["role"], F.regexp_extract(scene, r"([^/]*)$", 1))).alias("role"),
            own(i["start_frame"]).alias("start_frame"), own(i["end_frame"]).alias("end_frame"),
        )

    item = F.from_json("value", ITEM, {"mode": "FAILFAST"})
    rows = found.select(F.struct("file", "number").alias("number"), let(item, derived).alias("r")).where(F.col("r.video_path").isNotNull())
    return rows.groupBy(F.col("r.scene").alias("scene")).agg(F.min_by("r", "number").alias("r")).select("r.*")


def scene_list_of(manifest: DataFrame) -> DataFrame:
    """The columns of read_scene_list for scenes of a manifest (see episodes.read_scenes) whose data lie in its own files."""
    blank = [F.lit("").alias(c) for c in ("video_path", "depth_npz", "flow_npz", "flow_mp4")]
    unknown = [F.lit(None).cast("long").alias(c) for c in ("start_frame", "end_frame")]
    return manifest.select(F.col("scene_id").alias("scene"), *blank, F.col("scene_id").alias("original_rel"), "dataset", "role", *unknown)


def _stamps(paths: list[str | None]) -> list[str | None]:
    """Size and time of change of each file, null where there is none."""
    from pyarrow import fs

    out: list[str | None] = [None] * len(paths)
    stores: dict[str, list[int]] = {}
    for k, path in enumerate(paths):
        if path:
            stores.setdefault("/".join(path.split("/")[:3]) if "://" in path else "", []).append(k)
    for head, places in stores.items():
        store = fs.FileSystem.from_uri(paths[places[0]])[0] if head else fs.LocalFileSystem()
        inner = [fs.FileSystem.from_uri(paths[k])[1] if head else paths[k] for k in places]
        for k, info in zip(places, store.get_file_info(inner)):
            if info.type == fs.FileType.File:
                out[k] = f"{info.size}@{info.mtime_ns}"
    return out


def _stamped(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """paths: one column path, each once. Adds stamp, asked for in so many tasks; no file is opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _stamps(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "stamp"])

    return paths.select("path").repartition(tasks or _tasks(paths), "path").mapInArrow(run, "path string, stamp string")


def shape_of(file, member: str = "depth.npy") -> tuple[int, ...]:
    """The shape of an npz's member, by its header: the archive's directory and the member's first bytes are read."""
    with zipfile.ZipFile(file) as archive, archive.open(member) as data:
        return npy_header(data.read(HEADER), 0)[0]["shape"]


def known_counts(spark: SparkSession, store: str) -> DataFrame:
    """path, stamp, height, width, num_frames of all files that were ever probed into a store, finished runs only."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/run-*")
    runs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return spark.read.schema(COUNTS).parquet(*[f.getPath().toString() for f in runs]) if len(runs) else spark.createDataFrame([], COUNTS)


def update_counts(scenes: DataFrame, store: str, column: str = "depth_npz", member: str = "depth.npy") -> int:
    """Probes the files of a column that the store doesn't know as they are now (by size and time of change), and returns how many were opened.

    The store grows by a folder a run, which gets its name in one step when it's whole: a run that ends midway leaves nothing that is read. A file that can't be read is kept without a shape, and opened again
    next time; one that isn't there isn't opened."""
    spark = scenes.sparkSession
    paths = scenes.where(F.coalesce(F.col(column), F.lit("")) != "").select(F.col(column).alias("path")).distinct()
    known = known_counts(spark, store).where("height IS NOT NULL").select("path", "stamp").distinct()
    tasks = _tasks(paths)
    new = _stamped(paths, tasks).where("stamp IS NOT NULL").join(known, ["path", "stamp"], "left_anti").repartition(tasks, "path")
    schema = pa.schema([("path", pa.string()), ("stamp", pa.string()), ("height", pa.int64()), ("width", pa.int64()), ("num_frames", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = []
            for path in batch.column(0).to_pylist():
                try:
                    with _open(path) as file:
                        frames, height, width = shape_of(file, member)[:3]
                    shapes.append((int(height), int(width), int(frames)))
                except (OSError, ValueError, KeyError, SyntaxError, EOFError, zipfile.BadZipFile, zipfile.zlib.error):
                    shapes.append((None, None, None))
            columns = list(zip(*shapes)) if shapes else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], schema=schema)

    name = uuid.uuid4().hex
    made = f"{store}/_new-{name}"
    new.mapInArrow(run, COUNTS).write.parquet(made)
    opened = spark.read.schema(COUNTS).parquet(made).count()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not opened:
        fs.delete(path(made), True)
    elif not fs.rename(path(made), path(f"{store}/run-{name}")):
        raise OSError(f"{made} couldn't be renamed")
    return opened


def frame_counts(scenes: DataFrame, store: str, most_stride: int, manifest: DataFrame | None = None, probe: bool = True) -> DataFrame:
    """Adds height, width, num_frames, has_flow_npz, valid and pairs to scenes (scene, depth_npz, flow_npz): from the manifest (scene_id, height, width, num_frames) where that has all three, else from
    the store, which is brought up to date first. pairs is how often most_stride fits the frames after the first; a scene whose file is missing or unreadable is not valid and has none.

    Without probe nothing is opened: scenes that neither knows are valid with sizes of 0 and one pair, until they are processed."""
    spark = scenes.sparkSession
    sizes = ["height", "width", "num_frames"]
    told = F.lit(False)
    rows = scenes
    if manifest is not None:
        # the manifest is one row a scene; of repeated ones any that is whole counts
        whole = manifest.dropna(subset=["scene_id", *sizes]).groupBy(F.col("scene_id").alias("scene")).agg(F.min(F.struct(*sizes)).alias("__told"))
        rows, told = rows.join(whole, "scene", "left"), F.col("__told").isNotNull()
    else:
        rows = rows.withColumn("__told", F.lit(None).cast("struct<height:long,width:long,num_frames:long>"))
    if probe:
        update_counts(rows.where(~told), store)
    stamps = _stamped(rows.where(~told & (F.coalesce("depth_npz", F.lit("")) != "")).select(F.col("depth_npz").alias("path")).distinct())
    known = known_counts(spark, store).where("height IS NOT NULL").groupBy("path", "stamp").agg(F.min(F.struct(*sizes)).alias("__found"))
    known = known.join(stamps, ["path", "stamp"], "left_semi").select(F.col("path").alias("depth_npz"), "__found")
    flows = _stamped(rows.where(~told & (F.coalesce("flow_npz", F.lit("")) != "")).select(F.col("flow_npz").alias("path")).distinct())
    flows = flows.select(F.col("path").alias("flow_npz"), F.col("stamp").isNotNull().alias("__flow"))
    rows = rows.join(known, "depth_npz", "left").join(flows, "flow_npz", "left")
    size = {c: F.coalesce(F.col(f"__told.{c}").cast("long"), F.col(f"__found.{c}")) for c in sizes}
    have = size["height"].isNotNull()
    guessed = F.lit(not probe)
    none = lambda value: F.when(guessed, F.lit(value))
    pairs = F.when(have, F.greatest(F.lit(0), F.floor((size["num_frames"] - 1) / most_stride))).otherwise(F.coalesce(none(1), F.lit(0))).cast("long")
    flow = F.when(told, True).when(have, F.coalesce("__flow", F.lit(False))).otherwise(none(True))
    return rows.select(*scenes.columns, *[F.coalesce(size[c], none(0)).cast("long").alias(c) for c in sizes], flow.alias("has_flow_npz"), (have | guessed).alias("valid"), pairs.alias("pairs"))


def write_depths(rows: DataFrame, folder: str) -> None:
    """rows: name, num_frames, height, width. An npz of that shape (all zero) as folder/name.npz for each; a task that runs again writes the same."""
    from framewright.sources.scans import _create

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        import numpy as np

        n = 0
        for batch in batches:
            for name, *shape in zip(*(batch.column(c).to_pylist() for c in ("name", "num_frames", "height", "width"))):
                out = io.BytesIO()
                np.savez_compressed(out, depth=np.zeros(shape, np.uint8))
                with _create(f"{folder}/{name}.npz") as file:
                    file.write(out.getvalue())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = rows.select("name", "num_frames", "height", "width")
    rows.repartition(_tasks(rows), "name").mapInArrow(run, "n long").agg(F.sum("n")).collect()
