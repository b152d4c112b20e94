"""Rebuilding a manifest: each episode becomes a row, or a reason why not; and the index that training reads."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.scalar import is_safe_name, join_caption, or_default, rewrite_prefix, source_kind, source_suffix, view_role
from framewright.operators.ranges import stored

#: Frame rates of datasets whose latents and files tell none.
STATIC_FPS = {"EPIC_KITCHENS": 59.94, "SthSthV2": 12.0, "RoboMind": 20.0, "RoboMIND2.0": 14.0, "EgoDex": 30.0, "EgoVerse": 30.0, "RDT-1B": 30.0}
#: Versions of an index that can be read.
INDEX_VERSIONS = (2, 4)


def resolved_fps(fps: Column, measured: Column, dataset: Column, default: float) -> Column:
    """The stated rate, else the measured one, else the dataset's, else the default; what isn't positive counts as none."""
    table = F.create_map(*[F.lit(x) for kv in STATIC_FPS.items() for x in kv])
    some = lambda c: F.when(c > 0, c)
    return F.coalesce(some(fps), some(measured), table[dataset], F.lit(default))


def shown(rate: Column) -> Column:
    """A rate as text, without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(rate.cast("decimal(18,4)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def rebuild(episodes: DataFrame, latents: DataFrame, dim: int = 0, pair_stride: int = 0, representation: str = "", caption_most: int = 512, fps: float = 30.0, position: str | None = None) -> DataFrame:
    """episodes: dataset, episode_id, caption, gap, views (map of view to video_path, is_store, measured_fps). latents: dataset, episode_id, view, how (the
    probe's status) and meta (num_latents, code_shape, fps, gap, start_frame, pair_stride, representation, source; null where there is no latent), a row a view.
    Adds reason (null: kept), counters (all counter keys of the episode), gap, latent_dim and views as manifest rows; a row an episode, repeated ones included.

    The first reason stands: malformed, unsafe_name, unmapped_camera, then of the views in the order of their roles the first with a fault of its own; an
    episode with a view without latents is incomplete only where no view has such a fault. Of kept episodes of one dataset and id the first by position (a column
    of episodes; without one, as Spark reads them) stays, others are duplicate_episode. An expectation of 0 or "" isn't checked. Names are judged first: only
    views of episodes with usable names are joined with latents.
    """
    rows = stored(episodes.withColumn("__row", F.monotonically_increasing_id()), "manifest-episodes")
    names = F.map_keys("views")
    malformed = (F.coalesce("dataset", F.lit("")) == "") | F.col("episode_id").isNull() | F.coalesce(F.size("views") < 1, F.lit(True))
    unsafe = ~is_safe_name(F.col("dataset")) | ~is_safe_name(F.col("episode_id"), nested=True) | F.exists(names, lambda v: ~is_safe_name(v))
    unmapped = F.array_sort(F.filter(names, lambda v: view_role(v).isNull()))
    rows = rows.withColumn("__unmapped", unmapped).withColumn("__name", F.when(malformed, "malformed").when(unsafe, "unsafe_name").when(F.size("__unmapped") > 0, F.concat(F.lit("unmapped_camera:"), F.array_join("__unmapped", ","))))

    v = rows.where("__name is null").select("__row", "dataset", "episode_id", F.explode("views").alias("view", "source"))
    v = v.join(latents.select("dataset", "episode_id", "view", "how", "meta"), ["dataset", "episode_id", "view"], "left")
    path, start = or_default(F.col("source.video_path"), ""), F.coalesce("meta.start_frame", F.lit(0))
    v = v.select("__row", "dataset", "episode_id", "view", "source", "meta", F.coalesce("how", F.lit("missing_latent")).alias("how"), path.alias("path"), F.coalesce("meta.code_shape", F.array().cast("array<int>")).alias("shape"), start.alias("start"), or_default(F.col("meta.pair_stride"), 1).alias("step"))
    v = v.withColumns({"kind": source_kind(F.col("path")), "suffix": source_suffix(F.col("path")), "role": view_role(F.col("view")), "told": F.coalesce("meta.source", F.lit("")) != ""})
    v = v.withColumns({"measured": F.when(F.col("kind") == "hdf5", F.col("source.measured_fps")), "video": F.when(F.col("told"), F.col("meta.source")).otherwise(F.col("path"))})
    v = v.withColumn("rate", resolved_fps(F.col("meta.fps"), F.col("measured"), F.col("dataset"), fps))
    there, dims = F.col("meta").isNotNull(), F.concat(F.lit("["), F.array_join(F.transform("shape", lambda x: x.cast("string")), ", "), F.lit("]"))
    fault = (
        F.when(F.col("path") == "", "no_video_path").when((F.col("kind") == "zarr") & ~F.coalesce("source.is_store", F.lit(False)), "unsupported_source:dir")
        .when(F.col("kind") == "unsupported", F.concat(F.lit("unsupported_source:"), "suffix")).when(~there, F.lit(None).cast("string"))
        .when(F.coalesce("meta.num_latents", F.lit(0)) < 1, "bad_num_latents")
        .when((F.size("shape") != 1) | (F.lit(dim > 0) & (F.get("shape", F.lit(0)) != dim)), F.concat(F.lit("latent_dim_mismatch:"), dims))
        .when(F.col("start") < 0, F.concat(F.lit("negative_start_frame:"), "start")).when(F.lit(pair_stride > 0) & (F.col("step") != pair_stride), F.concat(F.lit("pair_stride_mismatch:"), "step"))
        .when(F.lit(representation != "") & ~F.col("meta.representation").eqNullSafe(F.lit(representation)), F.concat(F.lit("representation_mismatch:"), F.coalesce("meta.representation", F.lit("None"))))
    )
    unstated = there & ~F.coalesce(F.col("meta.fps") > 0, F.lit(False))
    keys = F.array(
        F.concat(F.lit("probe_"), "how"), F.when(~there, F.col("how")), F.when(F.col("start") != 0, F.concat(F.lit("windowed_start_frame:"), "dataset")),
        F.when(there, F.when(F.col("video") == F.col("path"), "video_path_verbatim").otherwise("video_path_resolved")), F.when(there & ~F.col("told"), "no_protocol_source"),
        F.when(unstated, F.when(F.col("measured") > 0, F.concat(F.lit("fps_measured_hdf5:"), "dataset")).otherwise(F.concat(F.lit("fps_fallback:"), "dataset", F.lit(":"), shown(F.col("rate"))))),
    )
    latent = F.concat_ws("/", "dataset", "episode_id", "view", F.lit("latent.npz"))
    row = F.struct("view", F.col("video").alias("video_path"), latent.alias("latent_path"), "meta.num_latents", F.col("rate").alias("fps"), F.col("step").alias("pair_stride"), F.col("start").alias("start_frame"), "role")
    judged = F.struct("role", "view", fault.alias("fault"), (~there).alias("missing"), F.filter(keys, lambda k: k.isNotNull()).alias("keys"), row.alias("row"), or_default(F.col("meta.gap"), 0).alias("gap"), F.get("shape", F.lit(0)).alias("dim"))
    # an episode's views are as many as it has cameras
    rows = rows.join(v.groupBy("__row").agg(F.array_sort(F.collect_list(judged)).alias("__judged")), "__row", "left")
    faults = F.filter(F.transform("__judged", lambda j: j["fault"]), lambda f: f.isNotNull())
    incomplete = F.exists("__judged", lambda j: j["missing"])
    rows = rows.withColumn("__reason", F.coalesce("__name", F.get(faults, F.lit(0)), F.when(incomplete, "incomplete_views")))
    place = F.struct(*([position] if position else []), "__row")
    rows = stored(rows.withColumn("__place", place), "manifest-judged")
    first = rows.where("__reason is null").groupBy("dataset", "episode_id").agg(F.min("__place").alias("__first"))
    rows = rows.join(first, ["dataset", "episode_id"], "left")
    again = F.col("__reason").isNull() & (F.col("__place") != F.col("__first"))
    keys = F.flatten(F.transform("__judged", lambda j: j["keys"]))
    counters = (
        F.when(F.col("__reason").isNull(), F.concat(keys, F.array(F.concat(F.lit("views_"), F.size("__judged")), F.lit("kept")), F.when(again, F.array(F.lit("duplicate_episode"))).otherwise(F.array())))
        .when(F.col("__reason") == "incomplete_views", F.concat(keys, F.array("__reason")))
        .when(F.startswith("__name", F.lit("unmapped")), F.transform("__unmapped", lambda v: F.concat(F.lit("unmapped_camera:"), v))).otherwise(F.array("__reason"))
    )
    rows = rows.withColumn("reason", F.when(again, "duplicate_episode").otherwise(F.col("__reason"))).withColumn("counters", counters)
    kept, first = lambda c: F.when(F.col("reason").isNull(), c), F.get("__judged", F.lit(0))
    gap = F.coalesce(F.nullif(or_default(first["gap"], 0), F.lit(0)), F.nullif("gap", F.lit(0)), F.lit(5))
    return rows.select(
        "dataset", "episode_id", join_caption(F.col("caption"), caption_most).alias("caption"), kept(first["dim"]).alias("latent_dim"),
        kept(F.transform("__judged", lambda j: j["row"])).alias("views"), "reason", "counters", kept(gap).alias("gap"),
    )


def drop_counts(rebuilt: DataFrame) -> DataFrame:
    """All counters by dataset: kept rows, drop reasons, probe statuses."""
    return rebuilt.select("dataset", F.explode("counters").alias("counter")).groupBy("dataset", "counter").agg(F.count(F.lit(1)).alias("n"))


def index_rows(manifest: DataFrame, chunk: int, seconds: float, fps: float = 30.0, caption: str = "perform the task") -> DataFrame:
    """manifest: rebuild's rows. One row a kept episode of the index: dataset, episode_id, caption, nlat (the least of its views), fps, stride, pair_stride, start_frame
    (all of the view of the lowest role), views (role, latent_path, start_frame, in order of role), and kept (false: shorter than a chunk)."""
    rows = manifest.where("reason is null").withColumn("views", F.array_sort(F.transform("views", lambda v: F.struct(v["role"].alias("role"), v["latent_path"].alias("latent_path"), v["start_frame"].alias("start_frame"), v["num_latents"].alias("num_latents"), v["fps"].alias("fps"), v["pair_stride"].alias("pair_stride")))))
    low = F.get("views", F.lit(0))
    rate, step = or_default(low["fps"], fps), F.greatest(F.lit(1), or_default(low["pair_stride"], 1))
    stride = F.greatest(F.lit(1), F.bround(rate * seconds / step, 0).cast("int"))
    rows = rows.withColumn("nlat", F.array_min(F.transform("views", lambda v: v["num_latents"]))).withColumn("stride", stride)
    text = F.coalesce(F.nullif(F.trim("caption"), F.lit("")), F.lit(caption))
    return rows.select(
        "dataset", "episode_id", text.alias("caption"), "nlat", rate.alias("fps"), "stride", step.alias("pair_stride"), low["start_frame"].alias("start_frame"),
        F.transform("views", lambda v: F.struct(v["role"].alias("role"), v["latent_path"].alias("latent_path"), v["start_frame"].alias("start_frame"))).alias("views"),
        (F.col("nlat") >= (chunk - 1) * F.col("stride") + 1).alias("kept"),
    )


def write_index(index: DataFrame, path: str, recipe: dict) -> None:
    """The index's kept rows as Parquet, and a meta row: version, recipe, kept and dropped rows by dataset. An index that is there isn't overwritten."""
    index.where("kept").drop("kept").write.mode("errorifexists").parquet(f"{path}/rows")
    counts = index.groupBy("dataset").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))
    meta = counts.select(F.lit(INDEX_VERSIONS[-1]).alias("version"), F.to_json(F.create_map(*[F.lit(str(x)) for kv in sorted(recipe.items()) for x in kv])).alias("recipe"), "dataset", "kept", "dropped")
    meta.write.mode("errorifexists").json(f"{path}/meta")


def read_index(spark, path: str, recipe: dict | None = None, rules: list[tuple[str, str]] = [], roles: int = 6) -> DataFrame:  # noqa: B006
    """An index's rows: another version or recipe is an error, and so is a role out of range, where a task meets it. rules rewrite the paths' prefixes."""
    meta = spark.read.schema("version int, recipe string, dataset string, kept long, dropped long").json(f"{path}/meta").select("version", "recipe").distinct().limit(2).collect()
    if len(meta) != 1 or meta[0].version not in INDEX_VERSIONS:
        raise ValueError(f"{path}: versions {[m.version for m in meta]}, one of {INDEX_VERSIONS} can be read")
    if recipe is not None and json.loads(meta[0].recipe) != {k: str(v) for k, v in recipe.items()}:
        raise ValueError(f"{path} was built with {meta[0].recipe}")
    role = lambda v: F.when(v["role"].between(0, roles - 1), v["role"]).otherwise(F.raise_error(F.lit("a role out of range")).cast("int"))
    views = F.transform("views", lambda v: F.struct(role(v).alias("role"), rewrite_prefix(v["latent_path"], rules).alias("latent_path"), v["start_frame"].alias("start_frame")))
    return spark.read.parquet(f"{path}/rows").withColumn("views", views)
