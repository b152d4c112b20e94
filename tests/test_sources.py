"""Readers, parts and streams on small files."""

import json

import pytest
from framewright.operators import statistics
from framewright.sources import episodes, manifests
from framewright.streaming.pairs import frame_stream, paired


def test_manifest_in_both_formats(spark, tmp_path):
    rows = [{"dataset": "a", "episode_id": "1", "caption": "x", "gap": 4, "latent_dim": 2, "views": [{"view": "head", "num_latents": 3}]}, {"dataset": "b", "episode_id": "2"}]
    (tmp_path / "m.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "m.jsonl").write_text("\n" + "\n\n".join(map(json.dumps, rows)) + "\n")
    (tmp_path / "none").write_text(" \n")
    (tmp_path / "bad").write_text("x")
    for name in ("m.json", "m.jsonl"):
        found = manifests.read_manifest(spark, str(tmp_path / name)).orderBy("dataset").collect()
        assert [(r.dataset, r.views and r.views[0].num_latents) for r in found] == [("a", 3), ("b", None)]
    assert manifests.read_manifest(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        manifests.read_manifest(spark, str(tmp_path / "bad"))


def test_tar_index_keeps_the_first_entry(spark, tmp_path):
    (tmp_path / "i").write_text('{"n":"x","o":10,"s":1}\n{"n":"y","o":20,"s":2}\n{"n":"x","o":90,"s":9}\n')
    assert sorted(map(tuple, manifests.read_tar_index(spark, str(tmp_path / "i")).collect())) == [("x", 10, 1), ("y", 20, 2)]


def test_parts_are_whole_or_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 0)], "dataset string, place int")
    manifests.write_parts(rows.where("dataset = 'a'"), str(tmp_path / "p"), "place", 2)
    assert manifests.combine_parts(spark, str(tmp_path / "p"), 2).count() == 5
    manifests.write_parts(rows, str(tmp_path / "p"), "place", 2, shards=[0])
    with pytest.raises(ValueError, match="missing shards"):
        manifests.combine_parts(spark, str(tmp_path / "p"), 2)


def test_frames_pair_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in (0, 1):
        lines = [json.dumps({"episode": e, "frame": f, "ts": f"2024-01-01 00:00:{f:02d}"}) for e in "ab" for f in range(part, 12, 2)]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(lines))
    pairs = paired(frame_stream(spark, str(tmp_path / "in"), "episode string, frame int, ts timestamp"), ["episode"], "frame", 5, 4, "ts", "1 minute")
    run = pairs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert run.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 0, 5), ("a", 4, 9), ("b", 0, 5), ("b", 4, 9)]


def test_finished_parts_are_left_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([("a", k, k * 10) for k in range(0, 8, 2)], "dataset string, place int, v int")
    path = str(tmp_path / "p")
    manifests.write_parts(rows, path, "place", 4)
    assert manifests.combine_parts(spark, path, 4).count() == 4  # shards 1 and 3 are finished and empty
    other = rows.withColumn("v", rows.v + 1)
    assert manifests.write_parts(other, path, "place", 4).count() == 0
    assert sorted(r.v for r in manifests.combine_parts(spark, path, 4).collect()) == [0, 20, 40, 60]
    manifests.write_parts(other, path, "place", 4, force=True)
    assert sorted(r.v for r in manifests.combine_parts(spark, path, 4).collect()) == [1, 21, 41, 61]
    with pytest.raises(ValueError, match="missing shards"):
        manifests.combine_parts(spark, path, 5)


def test_writers_refuse(spark, tmp_path):
    weights = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "dataset string, weight double")
    entries = [{"data_path": "x", "weight": 1}, {"data_path": "y"}]
    path = str(tmp_path / "mix")
    out = manifests.write_mixture(entries, "y", weights, path, spark)
    assert out == [entries[0], {"data_path": "y", "dataset_weights": {"a": 1.0, "b": 2.0}}] and json.loads(spark.read.text(path).first()[0]) == out
    for chosen, where in (("y", path), ("z", str(tmp_path / "other"))):
        with pytest.raises(Exception, match="already exists|not one"):
            manifests.write_mixture(entries, chosen, weights, where, spark)
    rows = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "row long, v string")
    one, two = (manifests.write_with_digest(r, ["row"], str(tmp_path / n), "v") for r, n in ((rows, "d1"), (rows.orderBy("v"), "d2")))
    assert one == two != manifests.write_with_digest(rows.where("row < 2"), ["row"], str(tmp_path / "d3"), "v")
    assert manifests.merge_reports([rows.where("row < 1"), rows.where("row > 0")], "row", 3, str(tmp_path / "m")) == {"rows": 3, "parts": 2}
    assert [r.v for r in spark.read.option("header", True).csv(str(tmp_path / "m/rows")).orderBy("row").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="not there once"):
        manifests.merge_reports([rows, rows.where("row = 1")], "row", 4, str(tmp_path / "n"))
    (tmp_path / "c.csv").write_text("a,b\n1,2\n3,\n")
    assert manifests.read_csv(spark, str(tmp_path / "c.csv"), ["a"]).count() == 2
    with pytest.raises(Exception, match="without b"):
        manifests.read_csv(spark, str(tmp_path / "c.csv"), ["b"]).collect()
    assert [tuple(r)[:3] for r in manifests.read_stats(spark, None, 2).collect()] == [(0, 0.0, 1.0), (1, 0.0, 1.0)]


def corpus(spark, root):
    features = {"action": {"shape": [7]}, "observation.state": {"shape": [7]}, "front": {"dtype": "video"}}
    info = {"codebase_version": "v3.0", "robot_type": "franka", "fps": 10, "features": features, "video_path": "videos/{video_key}/chunk-{chunk_index:03d}/file-{file_index:03d}.mp4"}
    (root / "meta").mkdir(parents=True)
    (root / "meta" / "info.json").write_text(json.dumps(info))
    meta = [(0, 3, ["", "primitive: pick"], 0, 0, 0.0), (1, 2, ["composite: stack"], 0, 1, 1.25), (2, 0, ["primitive: none"], 0, 1, 2.0), (3, 2, ["primitive:place"], 1, 12, 3.5)]
    columns = "episode_index long, length long, tasks array<string>, `videos/front/chunk_index` int, `videos/front/file_index` int, `videos/front/from_timestamp` double"
    spark.createDataFrame(meta, columns).coalesce(1).write.parquet(str(root / "meta" / "episodes"))
    frames = [(e, f, float(e * 10 + f)) for e, n, *_ in meta for f in range(n)]
    spark.createDataFrame(frames, "episode_index long, frame_index long, x double").repartition(2).write.parquet(str(root / "data"))
    return info


def test_episode_corpora(spark, tmp_path):
    root = tmp_path / "v3"
    info = corpus(spark, root)
    assert episodes.read_info(spark, str(root / "meta/info.json"), "franka") == info
    with pytest.raises(ValueError, match="robot franka"):
        episodes.read_info(spark, str(root / "meta/info.json"), "other")
    found = episodes.read_episode_meta(spark, str(root), info, "primitive").orderBy("episode_index").collect()
    assert [tuple(r) for r in found] == [(0, 3, "pick", "videos/front/chunk-000/file-000.mp4", 0), (3, 2, "place", "videos/front/chunk-001/file-012.mp4", 35)]
    some = episodes.read_episode_meta(spark, str(root), info, "primitive")
    frames = episodes.read_frames(spark, str(root), some, ["x"])
    assert sorted(r.x for r in frames.collect()) == [0.0, 1.0, 2.0, 30.0, 31.0]
    assert sorted((r.place, r.x) for r in episodes.scattered(frames, some).collect()) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 30.0), (4, 31.0)]
    with pytest.raises(Exception, match="outside of its episode"):
        episodes.scattered(frames, some.selectExpr("episode_index", "1L as length")).collect()
    (root / "meta" / "episodes.jsonl").write_text('{"episode_index": 0, "tasks": ["a"], "length": 3}\n')
    (root / "meta" / "tasks.jsonl").write_text('{"task_index": 0, "task": "a"}\n')
    _, lines, tasks = episodes.read_lines(spark, str(root))
    assert lines.collect()[0].tasks == ["a"] and tasks.collect()[0].task == "a"
    assert [episodes.state_layout(n) for n in (["qx", "qy", "qz", "qw"], ["roll", "pitch", "yaw"], ["x"])] == ["quaternion", "euler", "axis_angle"]


def test_scenes_and_datasets(spark, tmp_path):
    scene = {"scene_id": "A/1/head", "file": "s/1.safetensors", "num_frames": 5, "height": 4, "width": 6}
    (tmp_path / "m1.json").write_text(json.dumps([scene, {**scene, "scene_id": "A/2/head", "file": "/abs/2"}]))
    (tmp_path / "m2.json").write_text(json.dumps([scene]))
    (tmp_path / "m3.json").write_text(json.dumps([{**scene, "num_frames": 6}]))
    rows = episodes.read_scenes(spark, [str(tmp_path / "m1.json"), str(tmp_path / "m2.json")], "/root/x/")
    assert sorted((r.scene_id, r.file) for r in rows.collect()) == [("A/1/head", "/root/x/s/1.safetensors"), ("A/2/head", "/abs/2")]
    with pytest.raises(ValueError, match="A/1/head"):
        episodes.read_scenes(spark, [str(tmp_path / "m1.json"), str(tmp_path / "m3.json")], "/")
    (tmp_path / "d").mkdir()
    for name in ("Toy", "caption_Toy"):
        (tmp_path / "d" / f"{name}.json").write_text('[{"views": {}}]')
    (tmp_path / "d" / "other.json").write_text("[" + " " * 5000 + '{"views": {}}]')
    assert [r.dataset for r in episodes.discover_datasets(spark, str(tmp_path / "d")).collect()] == ["Toy"]


def test_statistics_are_checked(spark):
    rows = spark.createDataFrame([("a", float(k)) for k in range(1000)] + [(None, 1.0)], "k string, x double")
    found = {r.k: r for r in statistics.leaf_stats(rows, ["k"], "x").collect()}
    assert (found["a"].q01, found["a"].q99, found[None].n) == (9.99, 989.01, 1)
    vectors = spark.createDataFrame([([0.0, 1.0],), ([1.0, 1.0],)], "v array<double>")
    with pytest.raises(ValueError, match="1 without spread"):
        statistics.checked_stats(statistics.vector_moments(vectors, "v"), 2)
    with pytest.raises(ValueError, match="2 dimensions of 3"):
        statistics.checked_stats(statistics.vector_moments(vectors, "v"), 3)
