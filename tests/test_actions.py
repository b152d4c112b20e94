"""Rotations in all forms, and actions in their slots, against numpy."""

import math

import numpy as np
import pytest
from framewright.functions import actions as fa
from framewright.functions import rotations as fr
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def matrix(v, form):
    v = np.asarray(v, float)
    if form.startswith("euler"):
        out = np.eye(3)
        for axis, a in zip(form[-3:], v):
            c, s = math.cos(a), math.sin(a)
            turn = {"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis]
            out = np.array(turn) @ out
        return out
    if form.startswith("quat"):
        v = v / np.linalg.norm(v)
        x, y, z, w = v if form == "quat_xyzw" else (*v[1:], v[0])
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    if form == "rot_6d":
        a, b = v[0::2], v[1::2]
        x = a / np.linalg.norm(a)
        y = b - (x @ b) * x
        y /= np.linalg.norm(y)
        return np.stack([x, y, np.cross(x, y)], 1)
    n = np.linalg.norm(v)
    if n < 1e-300:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / n
    return np.eye(3) + math.sin(n) * k + (1 - math.cos(n)) * k @ k


SAMPLES = np.random.default_rng(3).normal(0, 1.5, (25, 6))


@pytest.mark.parametrize("source", fr.FORMS)
def test_every_form_as_every_other(spark, source):
    rows = spark.createDataFrame([(v[: fr.FORMS[source]].tolist(),) for v in SAMPLES], "v array<double>")
    for r in rows.select("v", *[fr.converted(F.col("v"), source, t).alias(t) for t in fr.FORMS]).collect():
        for target, n in fr.FORMS.items():
            assert len(r[target]) == n
            np.testing.assert_allclose(matrix(r[target], target), matrix(r.v, source), atol=1e-9)
        assert r[source] == r.v
        assert np.linalg.norm(r["rot_vec"]) <= math.pi + 1e-9 or source == "rot_vec"


def test_signs_small_turns_and_locked_angles(spark):
    one = lambda v, source, target: np.array(spark.range(1).select(fr.converted(F.array(*map(F.lit, v)), source, target).alias("v")).first().v)
    np.testing.assert_allclose(one([0.0, 0, 0, -2.0], "quat_xyzw", "quat_wxyz"), [-1, 0, 0, 0])  # a quaternion's own sign stays
    np.testing.assert_allclose(one([0.0, 0, 4.0], "rot_vec", "quat_xyzw"), [0, 0, math.sin(2), math.cos(2)])  # over half a turn w is below 0
    np.testing.assert_allclose(one([0.0, 0, 2 * math.pi - 4, 0][:3] + [0.0], "quat_xyzw", "rot_vec"), [0, 0, math.pi], atol=1e-12)
    np.testing.assert_allclose(one([1e-9, -2e-9, 0.0], "rot_vec", "quat_xyzw"), [5e-10, -1e-9, 0, 1], rtol=1e-12)
    np.testing.assert_allclose(one([5e-10, -1e-9, 0.0, 1.0], "quat_xyzw", "rot_vec"), [1e-9, -2e-9, 0], rtol=1e-12)
    np.testing.assert_allclose(one([0.0, 0, 0], "rot_vec", "rot_6d"), [1, 0, 0, 1, 0, 0])
    for form in ("euler_xyz", "euler_zyx"):
        locked = one(one([0.4, math.pi / 2, 0.3], form, "quat_xyzw"), "quat_xyzw", form)
        assert locked[2] == 0
        np.testing.assert_allclose(matrix(locked, form), matrix([0.4, math.pi / 2, 0.3], form), atol=1e-6)
    with pytest.raises(ValueError, match="unknown form"):
        fr.converted(F.col("v"), "quat", "rot_6d")


def test_layouts_of_six_numbers(spark):
    rows = spark.createDataFrame([(v[:3].tolist(),) for v in SAMPLES], "v array<double>")
    for r in rows.select("v", fr.vector_to_rot6d(F.col("v")).alias("a"), fr.vector_to_rot6d(F.col("v"), "legacy").alias("b")).collect():
        m = matrix(r.v, "rot_vec")
        np.testing.assert_allclose(r.a, m[:, :2].ravel(), atol=1e-9)
        np.testing.assert_allclose(r.b, m[:, :2].T.ravel(), atol=1e-9)
    with pytest.raises(ValueError, match="layout"):
        fr.vector_to_rot6d(F.col("v"), "columns")


@pytest.mark.parametrize("form", fr.FORMS)
def test_series_at_another_rate(spark, form):
    series = [v[: fr.FORMS[form]].tolist() for v in SAMPLES[:7]]
    rows = spark.createDataFrame([(series,), (series[:1],)], "s array<array<double>>")
    for r in rows.select("s", fr.resampled(F.col("s"), form, F.lit(30.0), F.lit(20.0), F.lit(6), F.lit(0.25)).alias("out")).collect():
        assert len(r.out) == 6
        if len(r.s) == 1:
            assert r.out == r.s * 6
            continue
        for k, out in enumerate(r.out):
            place = min(0.25 + 1.5 * k, 6.0)
            low = min(int(place), 5)
            a, b = matrix(r.s[low], form), matrix(r.s[low + 1], form)
            turn = a.T @ b
            angle = math.acos(max(-1, min(1, (np.trace(turn) - 1) / 2)))
            axis = np.array([turn[2, 1] - turn[1, 2], turn[0, 2] - turn[2, 0], turn[1, 0] - turn[0, 1]]) / (2 * math.sin(angle))
            np.testing.assert_allclose(matrix(out, form), a @ matrix(axis * angle * (place - low), "rot_vec"), atol=1e-7)


def leaf(dim, is_relative, allow, seed):
    r = np.random.default_rng(seed)
    low = r.normal(size=dim)
    return {"dim": dim, "is_relative": is_relative, "allow_relative": allow, "mean": r.normal(size=dim).tolist(), "std": (0.5 + r.random(dim)).tolist(), "min": low.tolist(), "max": (low + 1 + r.random(dim)).tolist(), "q01": (low + 0.1).tolist(), "q99": (low + 0.9).tolist()}


FIELDS = {"left_arm_joint_position": 6, "left_arm_eef_position": 3, "left_arm_eef_rotation": 6, "right_arm_joint_position": 7, "left_gripper": 1, "torso": 4, "head": 2}
SCHEMA = {f: leaf(d, not f.startswith("left_gripper"), not f.startswith("left_gripper"), k) for k, (f, d) in enumerate(FIELDS.items()) if f != "torso"}


def table(spark, n=6, drop=(), schema=SCHEMA, fields=FIELDS):
    rng = np.random.default_rng(11)
    kind = ", ".join(f"{p}{f} array<double>" for p in ("", "s_") for f in fields)
    rows = [tuple(None if f in drop else rng.normal(size=d).tolist() for f, d in fields.items()) + tuple(rng.normal(size=3 if f.endswith("rotation") else d).tolist() for f, d in fields.items()) for _ in range(n)]
    return spark.createDataFrame([(k, *r, schema) for k, r in enumerate(rows)], f"id int, {kind}, schema {fa.SCHEMA}")


def scaled(v, s, method):
    low, high = np.array(s["q01" if method == "q01_q99" else "min"]), np.array(s["q99" if method == "q01_q99" else "max"])
    offset, scale = (np.array(s["mean"]), np.array(s["std"]) + 1e-8) if method == "mean_std" else (low if method == "min_max" else (low + high) / 2, (high - low + 1e-8) / 2)
    return (np.array(v) - offset) / scale


def slow_flat(values, schema, method):
    out, mask = np.zeros(81), np.zeros(81, bool)
    out[17:23] = out[26:32] = [1, 0, 0, 1, 0, 0]
    for f, v in values.items():
        if v is not None:
            first = fa.SLOTS[f][0]
            out[first : first + len(v)] = scaled(v, schema[f], method) if f in schema else v
            mask[first : first + len(v)] = True
    return out, mask


def columns():
    return {f: F.col(f) for f in FIELDS}


def states():
    return {f: F.col(f"s_{f}") for f in FIELDS}


@pytest.mark.parametrize("method", ["mean_std", "min_max", "min_max_sym", "q01_q99"])
@pytest.mark.parametrize("drop", [(), ("left_arm_eef_position", "left_arm_eef_rotation", "head")])
def test_fields_in_their_slots_and_back(spark, method, drop):
    rows = table(spark, drop=drop).withColumn("flat", fa.flattened(columns(), F.col("schema"), method))
    back = {f"b_{f}": c for f, c in fa.unflattened(F.col("flat.values"), F.col("schema"), method).items()}
    for r in rows.select("*", *[c.alias(f) for f, c in back.items()], fa.slot_mask(F.col("schema")).alias("of_schema")).collect():
        want, mask = slow_flat({f: r[f] for f in FIELDS}, SCHEMA, method)
        np.testing.assert_allclose(r.flat["values"], want, rtol=1e-9)
        assert r.flat["mask"] == mask.tolist()
        for f in fa.SLOTS:
            if f not in SCHEMA:
                assert r[f"b_{f}"] is None
            elif r[f] is not None and f.endswith("rotation"):
                np.testing.assert_allclose(r[f"b_{f}"], matrix(r[f], "rot_6d")[:, :2].ravel(), atol=1e-9)
            elif r[f] is not None:
                np.testing.assert_allclose(r[f"b_{f}"], r[f], atol=1e-9)
        assert r["of_schema"] == slow_flat({f: [0.0] * d for f, d in FIELDS.items() if f in SCHEMA}, {}, method)[1].tolist()


def test_previous_actions_and_what_is_restored(spark):
    rows = table(spark).withColumn("left_arm_eef_rotation", F.slice("left_arm_eef_rotation", 1, 4))
    rows = rows.withColumn("flat", fa.previous(columns(), states(), F.col("schema"), "min_max_sym", "quat_wxyz", "rot_vec"))
    back = fa.restored(F.col("flat.values"), F.col("schema"), states(), "min_max_sym", "rot_vec")
    for r in rows.select("*", *[c.alias(f"b_{f}") for f, c in back.items()]).collect():
        state = matrix(r["s_left_arm_eef_rotation"], "rot_vec")
        own = {f: np.array(r[f]) - (0 if f == "left_gripper" else np.array(r[f"s_{f}"])) for f in FIELDS if f != "left_arm_eef_rotation"}
        own["left_arm_eef_rotation"] = (state.T @ matrix(r["left_arm_eef_rotation"], "quat_wxyz"))[:, :2].ravel()
        np.testing.assert_allclose(r.flat["values"], slow_flat(own, SCHEMA, "min_max_sym")[0], atol=1e-9)
        for f in SCHEMA:
            if f.endswith("rotation"):
                np.testing.assert_allclose(matrix(r[f"b_{f}"], "rot_vec"), matrix(r[f], "quat_wxyz"), atol=1e-7)
            else:
                np.testing.assert_allclose(r[f"b_{f}"], r[f], atol=1e-9)


def test_what_is_refused(spark):
    rows = table(spark, 1)
    flat = lambda rows: rows.select(fa.flattened(columns(), F.col("schema")).alias("f")).collect()
    with pytest.raises(PySparkException, match="longer than its 3 slots"):
        flat(table(spark, 1, schema={}).withColumn("head", F.array_repeat(F.lit(0.0), 4)))
    with pytest.raises(PySparkException, match="belong together"):
        flat(rows.withColumn("left_arm_eef_rotation", F.lit(None).cast("array<double>")))
    with pytest.raises(PySparkException, match="don't fit"):
        flat(rows.withColumn("head", F.array(F.lit(0.0))))
    with pytest.raises(PySparkException, match="differ in length"):
        rows.withColumn("s_head", F.array(F.lit(0.0))).select(fa.relative(columns(), states(), {})["head"]).collect()
    with pytest.raises(PySparkException, match="absolute already"):
        rows.select(fa.absolute(columns(), states(), F.map_from_arrays(F.array(F.lit("head")), F.array(F.struct(F.lit(True).alias("allow_relative"), F.lit(False).alias("is_relative")))), state_form="rot_vec")["head"]).collect()
    with pytest.raises(ValueError, match="no slots for wheel"):
        fa.flattened({"wheel": F.col("head")}, F.col("schema"))
    with pytest.raises(ValueError, match="unknown normalisation"):
        fa.flattened(columns(), F.col("schema"), "z")
    blank = table(spark, 1, drop=FIELDS, schema=None).select(fa.flattened(columns(), F.col("schema")).alias("f"), fa.slot_mask(F.col("schema")).alias("m")).first()
    assert blank.f["values"] == slow_flat({}, {}, "mean_std")[0].tolist() and not any(blank.f["mask"]) and not any(blank.m)
