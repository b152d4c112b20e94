"""Queries on rotations in all forms, and on actions in their slots, with vectors as actions and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import actions as fa
from framewright.functions import rotations as fr
from framewright.plans.tables import table

#: Where a vector holds the fields of an action (first entry, number of entries), and of a state: by field; rotations are vectors of three there.
_ACTION = {"left_arm_joint_position": (1, 7), "left_arm_eef_position": (8, 3), "left_arm_eef_rotation": (11, 3), "right_arm_joint_position": (14, 6), "left_gripper": (20, 1), "right_hand": (21, 12), "head": (33, 2)}
_STATE = {"left_arm_joint_position": (35, 7), "left_arm_eef_position": (42, 3), "left_arm_eef_rotation": (45, 3), "right_arm_joint_position": (48, 6), "right_hand": (49, 12)}
#: Robots are labels mod 3: which fields each one's schema lacks, and which of its fields are relative.
_LACKS = {0: [], 1: ["left_arm_eef_position", "left_arm_eef_rotation"], 2: ["right_hand", "left_gripper"]}
_RELATIVE = ["left_arm_joint_position", "left_arm_eef_position", "left_arm_eef_rotation", "right_hand"]


def _part(at: int, n: int) -> Column:
    return F.transform(F.slice("embedding", at, n), lambda v: v.cast("double"))


def _fields(places: dict[str, tuple[int, int]]) -> dict[str, Column]:
    return {f: _part(*place) for f, place in places.items()}


def _schemas(rows: DataFrame) -> DataFrame:
    """robot, schema: each field's least and largest numbers over a robot's vectors (of a rotation -1 and 1, so that they are the numbers themselves, but for the scale's 1e-8)."""
    robots = rows.groupBy("robot")
    bounds = {(f, k, s): rule(F.get("embedding", F.lit(at + k - 1)).cast("double")).alias(f"{f} {k} {s}") for f, (at, n) in _ACTION.items() if not fa.is_rotation(f) for k in range(n) for s, rule in (("min", F.min), ("max", F.max))}
    found = robots.agg(*bounds.values())

    def leaf(f: str) -> Column:
        n = 6 if fa.is_rotation(f) else _ACTION[f][1]
        ends = {s: F.array(*[F.lit(-1.0 if s == "min" else 1.0) if fa.is_rotation(f) else F.col(f"`{f} {k} {s}`") for k in range(n)]) for s in ("min", "max")}
        values = {s: ends.get(s, F.array().cast("array<double>")) for s in fa.STATISTICS}
        return F.struct(F.lit(n).alias("dim"), F.lit(f in _RELATIVE).alias("is_relative"), F.lit(f in _RELATIVE).alias("allow_relative"), *[c.alias(s) for s, c in values.items()])

    lacks = lambda f: F.col("robot").isin([r for r, fields in _LACKS.items() if f in fields])
    entries = F.array(*[F.when(~lacks(f), F.struct(F.lit(f).alias("key"), leaf(f).alias("value"))) for f in _ACTION])
    return found.select("robot", F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("schema"))


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with robot and its schema; a row a robot is joined."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 64).select("vec_id", F.pmod(F.coalesce("label", F.lit(0)), F.lit(3)).cast("int").alias("robot"), "embedding")
    return rows.join(_schemas(rows), "robot")


def _long(rows: DataFrame, value: Column, places: int = 5) -> DataFrame:
    return rows.select("vec_id", F.posexplode(value).alias("k", "v")).withColumn("v", F.round("v", places) + F.lit(0.0))


def _placed(rows: DataFrame, action: Column) -> DataFrame:
    out = rows.withColumn("flat", action).select("vec_id", F.posexplode(F.arrays_zip("flat.values", "flat.mask")).alias("k", "p"))
    return out.select("vec_id", "k", (F.round("p.values", 5) + F.lit(0.0)).alias("v"), F.col("p.mask").cast("int").alias("filled"))


def actions_in_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of three kinds of robots in their 81 slots, normalised by their robot's schema, and which slots are filled."""
    return _placed(_robots(spark, sf_dir), fa.flattened(_fields(_ACTION), F.col("schema"), "min_max_sym", "rot_vec"))


def previous_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute actions less their state where the schema has relative fields, in their slots."""
    return _placed(_robots(spark, sf_dir), fa.previous(_fields(_ACTION), _fields(_STATE), F.col("schema"), "min_max_sym", "rot_vec", "rot_vec"))


def actions_of_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """81 numbers (a vector's, the first 17 again) as absolute actions: fields that the robot's schema has, denormalised, made orthogonal, put together with the state; rotations as six numbers."""
    rows = _robots(spark, sf_dir)
    values = F.concat(_part(1, 64), _part(1, 17))
    state = _fields(_STATE) | {"left_arm_eef_rotation": fr.converted(_part(45, 3), "rot_vec", "rot_6d")}
    fields = fa.restored(values, F.col("schema"), state, "min_max_sym")
    entries = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("v")) for f, c in fields.items() if f in _ACTION])
    out = rows.select("vec_id", F.explode(F.filter(entries, lambda e: e["v"].isNotNull())).alias("e")).select("vec_id", "e.field", F.posexplode("e.v").alias("k", "v"))
    return out.withColumn("v", F.round("v", 5) + F.lit(0.0))


def rotation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation vectors as quaternions (w last, w first), six numbers (interleaved, and column after column), angles about fixed axes of both orders, and each of those as a rotation vector again."""
    vector = _part(1, 3)
    forms = {f: fr.converted(vector, "rot_vec", f) for f in fr.FORMS if f != "rot_vec"}
    back = [fr.converted(c, f, "rot_vec") for f, c in forms.items()]
    return _long(table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 64), F.concat(*forms.values(), fr.vector_to_rot6d(vector, "legacy"), *back))


def rotation_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series of up to sixteen rotation vectors, 30 a second, as 20 a second, as quaternions; the first a quarter of a sample in."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 64).select(F.expr("vec_id div 16").alias("vec"), "vec_id", fr.converted(_part(1, 3), "rot_vec", "quat_xyzw").alias("q"))
    chunks = rows.groupBy("vec").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "q"))), lambda e: e["q"]).alias("s"))
    out = fr.resampled(F.col("s"), "quat_xyzw", F.lit(30.0), F.lit(20.0), F.greatest(F.lit(1), F.bround(F.size("s") * 2 / 3, 0)), F.lit(0.25))
    return chunks.select("vec", F.posexplode(out).alias("step", "q")).select("vec", "step", F.posexplode("q").alias("k", "v")).withColumn("v", F.round("v", 5) + F.lit(0.0))


def _entry(at: int) -> str:
    return f"embedding[{at}]::DOUBLE"


def _turn(at: int) -> str:
    """Matrix entries of a rotation vector, by Rodrigues' formula written with the cross product's matrix."""
    x, y, z = (_entry(at + k) for k in range(3))
    t = f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"
    cross = ["0.0", f"-({z})", y, z, "0.0", f"-({x})", f"-({y})", x, "0.0"]
    square = [" + ".join(f"({cross[3 * r + k]}) * ({cross[3 * k + c]})" for k in range(3)) for r in range(3) for c in range(3)]
    return "[" + ", ".join(f"{float(k % 4 == 0)}::DOUBLE + sin({t}) / {t} * ({cross[k]}) + (1 - cos({t})) / ({t} * {t}) * ({square[k]})" for k in range(9)) + "]"


_LABELLED = "e AS (SELECT vec_id, (coalesce(label, 0) % 3)::INTEGER AS robot, embedding FROM embeddings WHERE len(embedding) >= 64)"
_ENDS = "ends AS (SELECT robot, pos, min(v) AS lo, max(v) AS hi FROM (SELECT robot, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM e) GROUP BY robot, pos)"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def _slot_rows(state: bool) -> str:
    """slot, field, at, of the state (0 where there is none, or the field isn't relative), without rotations."""
    rows = [(fa.SLOTS[f][0] + k, f, at + k, _STATE[f][0] + k if state and f in _STATE and f in _RELATIVE else 0) for f, (at, n) in _ACTION.items() if not fa.is_rotation(f) for k in range(n)]
    return f"places(slot, field, pos, less) AS (VALUES {_values(rows)})"


_MISSING = f"missing(robot, field) AS (VALUES {_values([(r, f) for r, fields in _LACKS.items() for f in fields])})"


def _slots_sql(state: bool) -> str:
    # a robot without a schema for the rotation keeps it absolute only where fields outside of the schema are: they are relative by default
    turn = "[" + ", ".join(" + ".join(f"s[{3 * k + r + 1}] * a[{3 * k + c + 1}]" for k in range(3)) for r in range(3) for c in range(2)) + "]" if state else "[a[1], a[2], a[4], a[5], a[7], a[8]]"
    default = "CASE WHEN m.field IS NULL THEN less ELSE 0 END"
    if state:
        absent = [(f, _STATE[f][0]) for f in _STATE if f not in _RELATIVE]
        assert all(f not in fields for f, _ in absent for fields in _LACKS.values())
        default = "less"
    return f"""WITH {_LABELLED}, {_ENDS}, {_slot_rows(state)}, {_MISSING},
filled AS (SELECT vec_id, slot, embedding[pos]::DOUBLE - CASE WHEN {default} > 0 THEN embedding[less]::DOUBLE ELSE 0 END AS v, CASE WHEN m.field IS NULL THEN lo END AS lo, hi FROM e CROSS JOIN places p JOIN ends USING (robot, pos) LEFT JOIN missing m ON m.robot = e.robot AND m.field = p.field),
turns AS (SELECT vec_id, robot, {_turn(11)} AS a, {_turn(45)} AS s FROM e),
six AS (SELECT vec_id, 17 + k AS slot, d[k + 1] / CASE WHEN robot = 1 THEN 1 ELSE 1 + 5e-9::DOUBLE END AS v FROM (SELECT vec_id, robot, {turn} AS d, unnest(range(6)) AS k FROM turns)),
known AS (SELECT vec_id, slot, CASE WHEN lo IS NULL THEN v ELSE (v - (lo + hi) / 2) / ((hi - lo + 1e-8::DOUBLE) / 2) END AS v FROM filled UNION ALL SELECT * FROM six)
SELECT vec_id, k::INTEGER AS k, round(coalesce(v, CASE WHEN k IN (26, 29) THEN 1 ELSE 0 END), 5) + 0 AS v, (v IS NOT NULL)::INTEGER AS filled
FROM (SELECT vec_id, unnest(range(81)) AS k FROM e) LEFT JOIN known USING (vec_id) WHERE known.slot = k OR known.slot IS NULL"""


def _all_slots(sql: str) -> str:
    return sql.replace("LEFT JOIN known USING (vec_id) WHERE known.slot = k OR known.slot IS NULL", "x LEFT JOIN known ON known.vec_id = x.vec_id AND slot = k").replace("SELECT vec_id, k::INTEGER", "SELECT x.vec_id, k::INTEGER")


def _back_sql() -> str:
    rows = [(fa.SLOTS[f][0] + k, f, at + k, k, _STATE[f][0] + k if f in _STATE and f in _RELATIVE else 0) for f, (at, n) in _ACTION.items() if not fa.is_rotation(f) for k in range(n)]
    slot = lambda k: f"embedding[{k + 1 if k < 64 else k - 63}]::DOUBLE"
    first, second = ("[" + ", ".join(slot(17 + 2 * k + c) for k in range(3)) + "]" for c in range(2))
    product = "[" + ", ".join(f"s[{3 * r + 1}] * {v}[1] + s[{3 * r + 2}] * {v}[2] + s[{3 * r + 3}] * {v}[3]" for r in range(3) for v in ("x", "y")) + "]"
    return f"""WITH {_LABELLED}, {_ENDS}, places(slot, field, pos, k, more) AS (VALUES {_values(rows)}), {_MISSING},
plain AS (SELECT vec_id, p.field, p.k, embedding[CASE WHEN slot < 64 THEN slot + 1 ELSE slot - 63 END]::DOUBLE * ((hi - lo + 1e-8::DOUBLE) / 2) + (lo + hi) / 2 + CASE WHEN more > 0 THEN embedding[more]::DOUBLE ELSE 0 END AS v
FROM e CROSS JOIN places p JOIN ends USING (robot, pos) ANTI JOIN missing m ON m.robot = e.robot AND m.field = p.field),
u AS (SELECT vec_id, {_turn(45)} AS s, {first} AS a, {second} AS b FROM e WHERE robot <> 1), n AS (SELECT *, list_transform(a, lambda v: v / sqrt(list_dot_product(a, a))) AS x FROM u),
o AS (SELECT *, list_transform(b, lambda v, i: v - list_dot_product(x, b) * x[i]) AS c FROM n), g AS (SELECT *, list_transform(c, lambda v: v / sqrt(list_dot_product(c, c))) AS y FROM o),
six AS (SELECT vec_id, 'left_arm_eef_rotation' AS field, k, d[k + 1] AS v FROM (SELECT vec_id, {product} AS d, unnest(range(6)) AS k FROM g))
SELECT vec_id, field, k::INTEGER AS k, round(v, 5) + 0 AS v FROM (SELECT * FROM plain UNION ALL SELECT * FROM six)"""


def _forms_sql() -> str:
    x, y, z = (_entry(k) for k in (1, 2, 3))
    parts = [
        "atan2(m[8], m[9])", "asin(-m[7])", "atan2(m[4], m[1])", "atan2(-m[2], m[1])", "asin(m[3])", "atan2(-m[6], m[9])", "q[1]", "q[2]", "q[3]", "q[4]", "q[4]", "q[1]", "q[2]", "q[3]",
        "m[1]", "m[2]", "m[4]", "m[5]", "m[7]", "m[8]", "m[1]", "m[4]", "m[7]", "m[2]", "m[5]", "m[8]", *[f"v[{k}]" for _ in range(5) for k in (1, 2, 3)],
    ]
    return f"""WITH t AS (SELECT vec_id, embedding, sqrt({x} * {x} + {y} * {y} + {z} * {z}) AS t, {_turn(1)} AS m FROM embeddings WHERE len(embedding) >= 64),
q AS (SELECT vec_id, m, [{x} / t * sin(t / 2), {y} / t * sin(t / 2), {z} / t * sin(t / 2), cos(t / 2)] AS q, [{x}, {y}, {z}] AS v FROM t), p AS (SELECT vec_id, [{", ".join(parts)}] AS p FROM q)
SELECT vec_id, k::INTEGER AS k, round(p[k + 1], 5) + 0 AS v FROM (SELECT vec_id, p, unnest(range({len(parts)})) AS k FROM p)"""


def _series_sql() -> str:
    x, y, z = (_entry(k) for k in (1, 2, 3))
    return f"""WITH t AS (SELECT vec_id, vec_id // 16 AS vec, embedding, sqrt({x} * {x} + {y} * {y} + {z} * {z}) AS t FROM embeddings WHERE len(embedding) >= 64),
q AS (SELECT vec, list([{x} / t * sin(t / 2), {y} / t * sin(t / 2), {z} / t * sin(t / 2), cos(t / 2)] ORDER BY vec_id) AS s FROM t GROUP BY vec),
k AS (SELECT vec, s, unnest(range(greatest(1, round_even(len(s) * 2 / 3, 0))::BIGINT)) AS step FROM q), p AS (SELECT *, least(len(s) - 1.0::DOUBLE, 0.25::DOUBLE + step * 1.5::DOUBLE) AS place FROM k),
n AS (SELECT vec, step, place - floor(place) AS w, s[floor(place)::BIGINT + 1] AS a, s[least(floor(place)::BIGINT + 1, len(s) - 1) + 1] AS b FROM p),
d AS (SELECT *, list_dot_product(a, b) AS d, acos(least(1, abs(list_dot_product(a, b)))) AS g FROM n)
SELECT vec, step::INTEGER AS step, k::INTEGER AS k, round(CASE WHEN g < 1e-9 THEN a[k + 1] ELSE (a[k + 1] * sin((1 - w) * g) + CASE WHEN d < 0 THEN -1 ELSE 1 END * b[k + 1] * sin(w * g)) / sin(g) END, 5) + 0 AS v FROM (SELECT *, unnest(range(4)) AS k FROM d)"""


QUERIES = {
    "actions_in_slots": (actions_in_slots, _all_slots(_slots_sql(False))),
    "previous_actions": (previous_actions, _all_slots(_slots_sql(True))),
    "actions_of_slots": (actions_of_slots, _back_sql()),
    "rotation_forms": (rotation_forms, _forms_sql()),
    "rotation_series": (rotation_series, _series_sql()),
}
