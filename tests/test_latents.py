"""Latent files and indexes: probes of whole, cut and odd files, arrays, and what an index refuses."""

import io
import json
import struct

import numpy as np
import pytest
from framewright.operators import manifest
from framewright.sources import latents

META = {"num_latents": 3, "num_frames": 13, "code_shape": [4], "fps": 20.0, "protocol": {"gap": 4, "pair_stride": 4, "start_frame": 8, "representation": "flat", "source": "/v/a.mp4"}}


def npz(meta=META, width=4, dtype=np.float16):
    return latents.npz_bytes(np.arange(3 * width, dtype=dtype).reshape(3, width), np.zeros((3, 2)), meta)


def meta_first():
    out = io.BytesIO()
    np.savez(out, meta=np.array(json.dumps(META)), latent_action=np.zeros((40_000, 4), np.float16))
    return out.getvalue()


def test_probe_finds_the_meta_record():
    assert latents.probe(npz()) == (json.dumps(META), "tail")
    assert latents.probe(meta_first()) == (json.dumps(META), "npz")
    assert latents.probe(npz()[:-30])[1] == "tail" and not latents.is_complete(npz()[:-30])
    for bad in (b"", b"junk", npz()[:300], latents.npz_bytes(np.zeros((1, 1)), np.zeros((1, 2)), {})[:200]):
        assert latents.probe(bad) == (None, "unreadable_latent")
        assert not latents.is_complete(bad)
    assert latents.is_complete(npz()) and not latents.is_complete(meta_first())


@pytest.mark.parametrize("version,kind", [(1, "<H"), (2, "<I"), (3, "<I")])
def test_npy_header(version, kind):
    text = b"{'descr': '<f4', 'fortran_order': False, 'shape': (2,), }\n"
    data = b"xx\x93NUMPY" + bytes([version, 0]) + struct.pack(kind, len(text)) + text
    assert latents.npy_header(data, 2) == ({"descr": "<f4", "fortran_order": False, "shape": (2,)}, len(data))
    with pytest.raises(ValueError):
        latents.npy_header(b"\x93NUMPY\x09" + data[9:], 0)


def lay_out(root, files):
    for path, data in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)


def test_rebuild_from_files(spark, tmp_path):
    files = {"A/c/e1/head/latent.npz": npz(), "A/c/e1/global/latent.npz": meta_first(), "A/c/e2/head/latent.npz": b"cut", "A/e3/head/latent.npz": npz({**META, "code_shape": [5]}), "A/e5/head/latent.npz": npz({**META, "num_latents": 0})}
    lay_out(tmp_path, files)
    probes = latents.probe_latents(spark, str(tmp_path))
    assert {(r.episode_id, r.view): (r.how, r.complete) for r in probes.collect()} == {("c/e1", "head"): ("tail", True), ("c/e1", "global"): ("npz", False), ("c/e2", "head"): ("unreadable_latent", False), ("e3", "head"): ("tail", True), ("e5", "head"): ("tail", True)}
    view = lambda path: (path, None, None)
    rows = [
        ("A", "c/e1", None, None, {"global": view("b.mp4"), "head": view("a.mp4")}), ("A", "c/e2", None, None, {"head": view("a.mp4")}), ("A", "e3", None, None, {"head": view("a.mp4")}),
        ("A", "e4", None, None, {"head": view("a.mp4"), "side": view("x.txt")}), ("A", "e5", None, None, {"head": view("a.mp4")}), ("A", None, None, None, {"head": view("a.mp4")}), (None, "e1", None, None, None),
        ("A", "c/e1", None, None, {"global": view("b.mp4"), "head": view("a.mp4")}), ("A", "c/../e1", None, None, {"head": view("a.mp4")}), ("A", "e6", None, None, {"top": view("a.mp4"), "chest": view("a.mp4")}), ("A", "e7", None, None, {}),
    ]
    episodes = spark.createDataFrame(rows, "dataset string, episode_id string, caption array<struct<start_time:double,description:string>>, gap int, views map<string,struct<video_path:string,is_store:boolean,measured_fps:double>>")
    found = manifest.rebuild(episodes, probes, 4, 4, "flat").collect()
    assert sorted((r.dataset or "", r.episode_id or "", r.reason or "kept") for r in found) == sorted([
        ("A", "c/e1", "kept"), ("A", "c/e1", "duplicate_episode"), ("A", "c/e2", "incomplete_views"), ("A", "e3", "latent_dim_mismatch:[5]"), ("A", "e4", "unsupported_source:.txt"), ("A", "e5", "bad_num_latents"),
        ("A", "", "malformed"), ("", "e1", "malformed"), ("A", "c/../e1", "unsafe_name"), ("A", "e6", "unmapped_camera:chest,top"), ("A", "e7", "malformed"),
    ])
    kept = next(r for r in found if r.reason is None)
    assert [(v.view, v.video_path, v.num_latents, v.fps, v.start_frame) for v in kept.views] == [("head", "/v/a.mp4", 3, 20.0, 8), ("global", "/v/a.mp4", 3, 20.0, 8)]
    assert (kept.gap, kept.latent_dim) == (4, 4)
    incomplete = next(r for r in found if r.reason == "incomplete_views")
    assert incomplete.counters == ["probe_unreadable_latent", "unreadable_latent", "incomplete_views"]


def test_latent_arrays(spark, tmp_path):
    values = np.arange(8, dtype="<f4").reshape(2, 4)
    head = json.dumps({"latent_action": {"dtype": "F32", "shape": [2, 4], "data_offsets": [0, 32]}}).encode()
    lay_out(tmp_path, {"a/latent.npz": npz(), "b/latent.safetensors": struct.pack("<Q", len(head)) + head + values.tobytes()})
    rows = latents.read_latents(spark, str(tmp_path), 4).orderBy("path", "t").collect()
    assert [r.latent for r in rows] == [*np.arange(12.0).reshape(3, 4).tolist(), *values.tolist()]
    with pytest.raises(Exception, match="not \\[T, 5\\]"):
        latents.read_latents(spark, str(tmp_path), 5).collect()


def test_index_is_written_once_and_gated(spark, tmp_path):
    views = [("head", "/old/a", 3, 20.0, 4, 8, 0), ("side", "/older/b", 2, 30.0, 4, 0, 4)]
    rows = spark.createDataFrame([("A", "e1", " ", None, 4, [(v, p, p, n, f, s, b, r) for v, p, n, f, s, b, r in views]), ("A", "e2", "text", "bad_num_latents", None, None)], "dataset string, episode_id string, caption string, reason string, gap int, views array<struct<view:string,video_path:string,latent_path:string,num_latents:int,fps:double,pair_stride:int,start_frame:int,role:int>>")
    index = manifest.index_rows(rows, 2, 0.2)
    assert [(r.nlat, r.fps, r.stride, r.start_frame, r.caption, r.kept) for r in index.collect()] == [(2, 20.0, 1, 8, "perform the task", True)]
    path = str(tmp_path / "index")
    manifest.write_index(index, path, {"chunk": 2})
    with pytest.raises(Exception, match="already exists"):
        manifest.write_index(index, path, {"chunk": 2})
    found = manifest.read_index(spark, path, {"chunk": 2}, [("/old", "/new")]).collect()
    assert [(v.role, v.latent_path, v.start_frame) for v in found[0].views] == [(0, "/new/a", 8), (4, "/older/b", 0)]
    with pytest.raises(ValueError, match="was built with"):
        manifest.read_index(spark, path, {"chunk": 3})
    with pytest.raises(Exception, match="out of range"):
        manifest.read_index(spark, path, roles=3).collect()
    (tmp_path / "v3" / "meta").mkdir(parents=True)
    (tmp_path / "v3" / "meta" / "m.json").write_text('{"version": 3, "recipe": "{}"}')
    with pytest.raises(ValueError, match="versions"):
        manifest.read_index(spark, str(tmp_path / "v3"))
