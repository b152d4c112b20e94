"""The manifest's cascade on small episodes: repeated ids, blank names, rates."""

from framewright.operators import manifest

EPISODES = "dataset string, episode_id string, caption array<struct<start_time:double,description:string>>, gap int, views map<string,struct<video_path:string,is_store:boolean,measured_fps:double>>, position long"
META = "struct<num_latents:int,code_shape:array<int>,fps:double,gap:int,start_frame:int,pair_stride:int,representation:string,source:string>"


def test_first_kept_episode_stays(spark):
    view = {"head": ("a.mp4", False, None)}
    rows = [("EpicX", "e1", None, None, view, 5), ("EpicX", "e1", None, None, view, 2), ("EpicX", "e1", None, None, {"head": ("", False, None)}, 1), ("RoboMIND2.0", "e1", None, 3, view, 3), ("EpicX", "e2", None, None, view, 4)]
    rows += [("", f"e{k}", None, None, view, 10) for k in range(200)] + [(None, None, None, None, None, 11)] * 50
    latents = [(d, e, "head", "tail", (9, [4], 0.0, 4, 0, 4, "flat", None)) for d, e in (("EpicX", "e1"), ("RoboMIND2.0", "e1"))]
    table = spark.createDataFrame([(d, e, c, g, v, p) for d, e, c, g, v, p in rows], EPISODES).repartition(3)
    out = manifest.rebuild(table, spark.createDataFrame(latents, f"dataset string, episode_id string, view string, how string, meta {META}"), position="position")
    found = out.where("dataset <> ''").collect()
    by = sorted((r.dataset, r.episode_id, r.reason or "kept", r.gap, tuple(sorted(r.counters))) for r in found)
    epic = ("fps_fallback:EpicX:30", "kept", "no_protocol_source", "probe_tail", "video_path_verbatim", "views_1")
    assert by == sorted([
        ("EpicX", "e1", "kept", 4, epic), ("EpicX", "e1", "duplicate_episode", None, tuple(sorted([*epic, "duplicate_episode"]))), ("EpicX", "e1", "no_video_path", None, ("no_video_path",)),
        ("EpicX", "e2", "incomplete_views", None, ("incomplete_views", "missing_latent", "probe_missing_latent")),
        ("RoboMIND2.0", "e1", "kept", 4, ("fps_fallback:RoboMIND2.0:14", "kept", "no_protocol_source", "probe_tail", "video_path_verbatim", "views_1")),
    ], key=lambda r: (*r[:3], r[3] or 0))
    counts = {(r.dataset, r.counter): r.n for r in manifest.drop_counts(out).collect()}
    assert counts["", "malformed"] == 200 and counts[None, "malformed"] == 50 and counts["EpicX", "kept"] == 2 and counts["EpicX", "duplicate_episode"] == 1


def test_rates_as_text(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(30.0,), (59.94,), (14.0,), (12.5,), (100.0,)], "x double")
    assert [r[0] for r in rows.select(manifest.shown(F.col("x"))).collect()] == ["30", "59.94", "14", "12.5", "100"]
