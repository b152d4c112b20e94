"""Chains, scene flow and static flow against loops over pixels."""

import math

import numpy as np
import pytest
from framewright.functions import flow as ff
from framewright.operators import flow
from pyspark.errors import PySparkException


def slow_chain(flows):
    k, h, w, _ = flows.shape
    out = np.zeros((h, w, 2))
    for y in range(h):
        for x in range(w):
            cx, cy = float(x), float(y)
            for f in flows:
                sx, sy = min(max(cx, 0.0), w - 1.0), min(max(cy, 0.0), h - 1.0)
                x0, y0 = math.floor(sx), math.floor(sy)
                x1, y1 = min(x0 + 1, w - 1), min(y0 + 1, h - 1)
                a, b = sx - x0, sy - y0
                move = (1 - a) * (1 - b) * f[y0, x0] + a * (1 - b) * f[y0, x1] + (1 - a) * b * f[y1, x0] + a * b * f[y1, x1]
                cx, cy = cx + move[0], cy + move[1]
            out[y, x] = cx - x, cy - y
    return out


def frames(spark, episodes):
    rows = [(name, k, f.ravel().tolist(), f.shape[0], f.shape[1]) for name, flows in episodes.items() for k, f in enumerate(flows)]
    return spark.createDataFrame(rows, "e string, k long, flow array<double>, h int, w int")


@pytest.mark.parametrize("stride,every", [(1, 1), (4, 1), (3, 2), (2, 5)])
def test_chains_are_those_of_a_loop(spark, monkeypatch, stride, every):
    monkeypatch.setattr(flow, "BLOCK", 1)  # runs of 8 * stride frames: episodes cross them
    rng = np.random.default_rng(1)
    episodes = {"a": rng.normal(0, 2, (37, 3, 5, 2)), "b": rng.normal(0, 1, (16, 2, 2, 2)), "short": rng.normal(0, 1, (1, 2, 3, 2)), "one pixel": rng.normal(0, 1, (9, 1, 1, 2))}
    got = {(r.e, r.start): r.flow for r in flow.chained_flows(frames(spark, episodes).repartition(5), ["e"], "k", "flow", "h", "w", stride, every).collect()}
    want = {(e, s): slow_chain(f[s : s + stride]).ravel() for e, f in episodes.items() for s in range(0, len(f) - stride + 1, every)}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_chains_without_keys_and_of_nothing(spark):
    flows = np.ones((3, 2, 2, 2))
    rows = frames(spark, {"a": flows})
    assert [r.start for r in flow.chained_flows(rows, [], "k", "flow", "h", "w", 2).orderBy("start").collect()] == [0, 1]
    assert flow.chained_flows(rows.limit(0), ["e"], "k", "flow", "h", "w", 2).count() == 0


@pytest.mark.parametrize("fault", ["k <> 3", "k <> 0", "twice", "null flow", "null frame", "size", "null number"])
def test_faulty_frames_are_errors(spark, fault):
    rows = frames(spark, {"a": np.ones((8, 2, 2, 2))})
    if fault == "twice":
        rows = rows.union(rows.where("k = 2"))
    elif fault == "null flow":
        rows = rows.selectExpr("e", "k", "if(k = 4, null, flow) AS flow", "h", "w")
    elif fault == "null frame":
        rows = rows.selectExpr("e", "if(k = 4, null, k) AS k", "flow", "h", "w")
    elif fault == "size":
        rows = rows.selectExpr("e", "k", "flow", "if(k = 4, 1, h) AS h", "if(k = 4, 4, w) AS w")
    elif fault == "null number":
        rows = rows.selectExpr("e", "k", "transform(flow, (v, i) -> if(k = 4 AND i = 1, null, v)) AS flow", "h", "w")
    else:
        rows = rows.where(fault)
    with pytest.raises(PySparkException):
        flow.chained_flows(rows, ["e"], "k", "flow", "h", "w", 2).collect()


def pose(rng):
    e = np.eye(4)
    e[:3, :3], e[:3, 3] = ff.turned(rng.normal(0, 0.5, 3)), rng.normal(0, 1, 3)
    return e


def test_scene_flow_is_that_of_a_loop(spark):
    rng = np.random.default_rng(2)
    h, w, steepest, rows, want = 5, 6, 0.3, [], []
    for _ in range(6):
        d1, d2 = 2 + rng.normal(0, 0.2, (2, h, w))
        d1[0, 0], d1[1, 1], d2[2, 2], d2[3, 3] = 0, np.nan, -1, np.inf
        k1, k2 = (np.array([[f, 0, 2.5], [0, f + 1, 2], [0, 0, 1]]) for f in (5.0, 6.0))
        e1, e2, uv = pose(rng), pose(rng), rng.normal(0, 1.5, (h, w, 2))
        rows.append((h, w, *(a.ravel().tolist() for a in (d1, d2, k1, k2, e1[:3], e2, uv))))
        steep = lambda d, y, x: math.hypot((d[y, x + 1] - d[y, x - 1]) / 2 if 0 < x < w - 1 else 0, (d[y + 1, x] - d[y - 1, x]) / 2 if 0 < y < h - 1 else 0) < steepest and d[y, x] > 0 and np.isfinite(d[y, x])
        for y in range(h):
            for x in range(w):
                tx, ty = x + uv[y, x, 0], y + uv[y, x, 1]
                qx, qy = round(tx), round(ty)
                if not (0 <= tx <= w - 1 and 0 <= ty <= h - 1 and steep(d1, y, x) and steep(d2, qy, qx)):
                    want.append((False, 0, 0, 0))
                    continue
                p1 = np.linalg.inv(k1) @ [x, y, 1] * d1[y, x]
                p2 = np.linalg.inv(k2) @ [qx, qy, 1] * d2[qy, qx]
                world = np.linalg.solve(e2, [*p2, 1])
                want.append((True, *((e1 @ world)[:3] - p1)))
    schema = "height int, width int, depth array<double>, next_depth array<double>, camera array<double>, next_camera array<double>, pose array<double>, next_pose array<double>, flow array<double>"
    out = flow.scene_flows(spark.createDataFrame(rows, schema).coalesce(1), steepest).collect()
    got = [(m, *r.flow_3d[3 * p : 3 * p + 3]) for r in out for p, m in enumerate(r.mask)]
    assert np.allclose(got, want) and 0 < sum(m[0] for m in want) < len(want)
    with pytest.raises(PySparkException):
        flow.scene_flows(spark.createDataFrame([(h, w + 1, *rows[0][2:])], schema), steepest).collect()
    # three numbers a pixel are the flow already
    three = [(*rows[0][:-1], [1.0] * (3 * h * w))]
    (r,) = flow.scene_flows(spark.createDataFrame(three, schema), steepest).collect()
    assert [r.mask[y * w + x] for y, x in ((0, 0), (1, 1), (2, 2), (3, 3), (4, 4))] == [False] * 4 + [True]
    assert r.flow_3d == [float(m) for m in r.mask for _ in range(3)]


def test_static_flow_of_no_motion_and_of_a_shift(spark):
    schema = "height int, width int, motion array<double>, depth array<double>, camera array<double>"
    k = [4.0, 0.0, 1.0, 0.0, 4.0, 0.5, 0.0, 0.0, 1.0]
    rows = [(2, 3, [0.0] * 6, [2.0] * 6, k), (2, 3, [0.0, 0.0, 0.0, 1.0, 2.0, 3.0], [2.0] * 6, k)]
    still, shifted = (r.static_flow for r in flow.static_flows(spark.createDataFrame(rows, schema).coalesce(1)).collect())
    assert np.allclose(still, 0) and np.allclose(shifted, [1.0, 2.0, 3.0] * 6)
