"""Scene lists of both forms, and archives that are opened once."""

import json
import os

import numpy as np
import pytest
from framewright.sources import probes
from pyspark.errors import PySparkException

ITEMS = [
    {"rgb": "/v/a b.mp4", "depth_npz": "/d/a.npz"},
    {"rgb": "/v/x.mp4", "depth_npz": "/d/x.npz", "scene_id": "set/one two", "dataset": "s", "start_frame": 3, "end_frame": 9, "flow_npz": "/f/x.npz"},
    {"rgb": "/v/other.mp4", "depth_npz": "/d/other.npz", "scene_id": "set/one_two"},
    {"path": "/m/split_videos/P01/P01_1 cup.mp4"},
    {"video_path": "/m/plain/7.tar.mp4"},
    {"rgb": "/v/no depth.mp4"},
    {},
]


@pytest.fixture
def listed(tmp_path):
    path = tmp_path / "scenes.json"
    path.write_text(json.dumps(ITEMS, indent=1))
    return str(path)


def test_scene_list_has_both_forms(spark, listed):
    got = {r.scene: r for r in probes.read_scene_list(spark, listed, "/depth/", "/flow").collect()}
    assert set(got) == {"a_b", "set/one_two", "P01/P01_1_cup", "/m/plain/7.tar"}
    assert tuple(got["a_b"])[1:] == ("/v/a b.mp4", "/d/a.npz", "", "", "a_b", "unknown", "a_b", None, None)
    assert tuple(got["set/one_two"])[1:] == ("/v/x.mp4", "/d/x.npz", "/f/x.npz", "", "set/one_two", "s", "one_two", 3, 9)
    legacy = got["P01/P01_1_cup"]
    assert (legacy.depth_npz, legacy.flow_npz, legacy.flow_mp4) == ("/depth/P01/P01_1 cup/exports/mini_npz/results.npz", "/flow/P01/P01_1 cup/flows.npz", "/flow/P01/P01_1 cup/flow.mp4")
    assert (legacy.original_rel, legacy.dataset, legacy.start_frame) == ("P01/P01_1 cup", None, None)


def test_scenes_below_roots_need_them(spark, listed, tmp_path):
    with pytest.raises(PySparkException, match="roots"):
        probes.read_scene_list(spark, listed).collect()
    path = tmp_path / "explicit.json"
    path.write_text(json.dumps(ITEMS[:3]))
    assert probes.read_scene_list(spark, str(path)).count() == 2


def archive(path, shape, **more):
    np.savez_compressed(path, depth=np.zeros(shape, np.float32), **more)


def test_files_are_opened_once_and_again_when_changed(spark, tmp_path):
    names = ["a", "b", "b again", "broken", "missing", "no depth", "flat", "none"]
    archive(tmp_path / "a.npz", (11, 4, 6))
    archive(tmp_path / "b.npz", (1, 5, 7))
    (tmp_path / "broken.npz").write_bytes((tmp_path / "a.npz").read_bytes()[:50])
    np.savez(tmp_path / "no depth.npz", other=np.zeros(3))
    archive(tmp_path / "flat.npz", (3, 4))
    rows = [(n, "" if n == "none" else f"{tmp_path}/{n.split(' again')[0]}.npz", f"file://{tmp_path}/a.npz" if n == "a" else "") for n in names]
    scenes, store = spark.createDataFrame(rows, "scene string, depth_npz string, flow_npz string"), f"{tmp_path}/store"
    assert probes.update_counts(scenes, store) == 5
    # those without a shape are tried again, the others aren't
    assert probes.update_counts(scenes, store) == 3
    got = {r.scene: r for r in probes.frame_counts(scenes, store, 2).collect()}
    assert set(got) == set(names)
    assert tuple(got["a"])[3:] == (4, 6, 11, True, True, 5)
    assert tuple(got["b"])[3:] == tuple(got["b again"])[3:] == (5, 7, 1, False, True, 0)
    assert all(tuple(got[n])[3:] == (None, None, None, None, False, 0) for n in names[3:])
    archive(tmp_path / "b.npz", (9, 5, 7))
    os.utime(tmp_path / "b.npz", ns=(1, 1))
    whole = scenes.where("scene LIKE 'b%' AND scene <> 'broken' OR scene = 'a'")
    assert probes.update_counts(whole, store) == 1 and probes.update_counts(whole, store) == 0
    assert {r.scene: r.num_frames for r in probes.frame_counts(whole, store, 2).collect()} == {"a": 11, "b": 9, "b again": 9}


def test_a_run_that_ends_midway_is_not_read(spark, tmp_path):
    archive(tmp_path / "a.npz", (2, 2, 2))
    scenes, store = spark.createDataFrame([("a", f"{tmp_path}/a.npz", "")], "scene string, depth_npz string, flow_npz string"), f"{tmp_path}/store"
    spark.createDataFrame([(f"{tmp_path}/a.npz", "x", 1, 1, 1)], probes.COUNTS).write.parquet(f"{store}/_new-dead")
    assert probes.known_counts(spark, store).count() == 0
    assert probes.update_counts(scenes, store) == 1 and probes.known_counts(spark, store).count() == 1


def test_manifest_sizes_come_first_and_probing_can_be_left_out(spark, tmp_path):
    archive(tmp_path / "a.npz", (8, 2, 2))
    scenes = spark.createDataFrame([(n, f"{tmp_path}/a.npz", "") for n in ("told", "half told", "untold")], "scene string, depth_npz string, flow_npz string")
    manifest = spark.createDataFrame([("told", 10, 20, 30), ("told", None, 1, 1), ("half told", 1, None, 3)], "scene_id string, height int, width int, num_frames int")
    store = f"{tmp_path}/store"
    guessed = {r.scene: tuple(r)[3:] for r in probes.frame_counts(scenes, store, 7, manifest, probe=False).collect()}
    assert guessed == {"told": (10, 20, 30, True, True, 4), "half told": (0, 0, 0, True, True, 1), "untold": (0, 0, 0, True, True, 1)}
    got = {r.scene: tuple(r)[3:] for r in probes.frame_counts(scenes, store, 7, manifest).collect()}
    assert got == {"told": (10, 20, 30, True, True, 4), "half told": (2, 2, 8, False, True, 1), "untold": (2, 2, 8, False, True, 1)}
    assert probes.frame_counts(scenes.limit(0), store, 7, manifest).count() == 0
    assert probes.frame_counts(scenes, store, 7).where("num_frames = 8").count() == 3


def test_files_are_asked_for_in_many_tasks(spark, tmp_path, monkeypatch):
    """Names are few bytes, by which Spark would put all of them into one task."""
    monkeypatch.setattr(probes, "FILES", 4, raising=False)
    paths = [str(tmp_path / f"{k}.npz") for k in range(40)]
    for path in paths[::2]:
        archive(path, (3, 2, 2))
    rows = probes._stamped(spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1))
    assert rows.rdd.getNumPartitions() == 10
    assert {r.path for r in rows.where("stamp IS NOT NULL").collect()} == set(paths[::2])
