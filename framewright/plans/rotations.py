"""Queries on conversions, composition, interpolation and unwrapping of rotations, and on actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import scalar
from framewright.functions import series as fs
from framewright.operators import unwrap
from framewright.plans.tables import rounded, table


def _part(at: int, n: int, scale: float = 1.0) -> Column:
    return F.transform(F.slice("embedding", at, n), lambda v: v.cast("double") * scale)


def _vector(at: int, n: int, scale: float = 1.0) -> str:
    return "[" + ", ".join(f"embedding[{at + k}]::DOUBLE * {scale}::DOUBLE" for k in range(n)) + "]"


def _long(rows: DataFrame, value: Column, places: int = 5) -> DataFrame:
    return rows.select("vec_id", F.posexplode(value).alias("k", "v")).withColumn("v", F.round("v", places) + F.lit(0.0))


#: Elementary turns as products of three 3x3 matrices, written out by the SQL side on its own.
def _product(a: str, b: str) -> str:
    return "[" + ", ".join(" + ".join(f"{a}[{3 * r + k + 1}] * {b}[{3 * k + c + 1}]" for k in range(3)) for r in range(3) for c in range(3)) + "]"


def _turns(at: int, scale: float, order: str) -> str:
    x, y, z = (f"(embedding[{at + ('xyz' if order == 'xyz' else 'zyx').index(t)}]::DOUBLE * {scale}::DOUBLE)" for t in "xyz")
    mx = f"[1.0::DOUBLE, 0, 0, 0, cos{x}, -sin{x}, 0, sin{x}, cos{x}]"
    my = f"[cos{y}, 0.0::DOUBLE, sin{y}, 0, 1, 0, -sin{y}, 0, cos{y}]"
    mz = f"[cos{z}, -sin{z}, 0.0::DOUBLE, sin{z}, cos{z}, 0, 0, 0, 1]"
    first, last = (mx, mz) if order == "xyz" else (mz, mx)
    return f"SELECT vec_id, embedding, {first} AS a, {my} AS b, {last} AS c FROM embeddings"


def _euler(order: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select("vec_id", fs.euler_to_matrix(_part(1, 3, 4.0), order).alias("m"))
        return _long(rows, F.concat("m", fs.euler_to_matrix(fs.matrix_to_euler(F.col("m"), order), order)))

    run.__doc__ = f"I16: angles about fixed axes in the order {order} as a matrix, and the matrix of the angles that are read from it."
    return run


def _euler_sql(order: str) -> str:
    return f"""WITH t AS ({_turns(1, 4.0, order)}), p AS (SELECT vec_id, c, {_product('b', 'a')} AS q FROM t), m AS (SELECT vec_id, {_product('c', 'q')} AS m FROM p)
SELECT vec_id, k::INTEGER AS k, round(m[k % 9 + 1], 5) + 0 AS v FROM (SELECT vec_id, m, unnest(range(18)) AS k FROM m)"""


def quaternions_of_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quaternion as a matrix and back, with the sign that makes its largest part positive."""
    q = fs.matrix_to_quat(fs.quat_to_matrix(_part(1, 4)))
    return _long(table(spark, sf_dir, "embeddings"), q)


_QUATERNIONS = f"""WITH q AS (SELECT vec_id, {_vector(1, 4)} AS q FROM embeddings), n AS (SELECT vec_id, list_transform(q, lambda x: x / sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3] + q[4] * q[4])) AS q FROM q),
s AS (SELECT vec_id, q, CASE WHEN list_max(q) >= -list_min(q) THEN 1 ELSE -1 END AS s FROM n) SELECT vec_id, k::INTEGER AS k, round(q[k + 1] * s, 5) + 0 AS v FROM (SELECT vec_id, q, s, unnest(range(4)) AS k FROM s)"""


def slerp_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the way from one unit quaternion to another, the short way."""
    unit = lambda q: F.transform(q, lambda x: x / F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, y: a + y * y)))
    return _long(table(spark, sf_dir, "embeddings"), fs.slerp(unit(_part(1, 4)), unit(_part(5, 4)), F.lit(0.2)))


_SLERP = f"""WITH q AS (SELECT vec_id, {_vector(1, 4)} AS p, {_vector(5, 4)} AS q FROM embeddings),
n AS (SELECT vec_id, list_transform(p, lambda x: x / sqrt(list_dot_product(p, p))) AS p, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS q FROM q),
d AS (SELECT *, list_dot_product(p, q) AS d, acos(least(1, abs(list_dot_product(p, q)))) AS t FROM n)
SELECT vec_id, k::INTEGER AS k, round((p[k + 1] * sin(0.8::DOUBLE * t) + CASE WHEN d < 0 THEN -1 ELSE 1 END * q[k + 1] * sin(0.2::DOUBLE * t)) / sin(t), 5) + 0 AS v FROM (SELECT *, unnest(range(4)) AS k FROM d)"""


def composed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rotation relative to a state, and the state and that put together again: the rotation itself; and positions likewise."""
    a, b = fs.rotvec_to_matrix(_part(1, 3)), fs.rotvec_to_matrix(_part(4, 3))
    rows = table(spark, sf_dir, "embeddings").withColumn("delta", fs.matmul(a, b, True))
    position = F.zip_with(F.zip_with(_part(7, 3), _part(10, 3), lambda x, y: x - y), _part(10, 3), lambda d, s: d + s)
    return _long(rows, F.concat(fs.matmul(a, F.col("delta")), position))


def _rodrigues(at: int) -> str:
    x, y, z = (f"embedding[{at + k}]::DOUBLE" for k in range(3))
    return f"""(SELECT vec_id, embedding, [1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y, c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x, c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y)] AS m
FROM (SELECT *, sin(t) / t AS s, (1 - cos(t)) / (t * t) AS c FROM (SELECT vec_id, embedding, {x} AS x, {y} AS y, {z} AS z, sqrt({x} * {x} + {y} * {y} + {z} * {z}) AS t FROM embeddings)))"""


_COMPOSED = f"SELECT vec_id, k::INTEGER AS k, round(m[k + 1], 5) + 0 AS v FROM (SELECT vec_id, list_concat(m, {_vector(7, 3)}) AS m, unnest(range(12)) AS k FROM {_rodrigues(4)})"


def relative_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pose of one camera after another one's undone, as a rotation vector (turned into a matrix for comparison) and a translation."""
    pose = fs.relative_pose(fs.rotvec_to_matrix(_part(1, 3)), _part(7, 3), fs.rotvec_to_matrix(_part(4, 3)), _part(10, 3))
    rows = table(spark, sf_dir, "embeddings").withColumn("p", pose)
    return _long(rows, F.concat(fs.rotvec_to_matrix(F.slice("p", 1, 3)), F.slice("p", 4, 3)), 4)


_POSES = f"""WITH j AS (SELECT a.vec_id, a.m AS p, b.m AS q, {_vector(7, 3).replace('embedding', 'a.embedding')} AS s, {_vector(10, 3).replace('embedding', 'a.embedding')} AS t FROM {_rodrigues(1)} a JOIN {_rodrigues(4)} b USING (vec_id)),
r AS (SELECT *, [{", ".join(" + ".join(f"q[{3 * r + k + 1}] * p[{3 * c + k + 1}]" for k in range(3)) for r in range(3) for c in range(3))}] AS m FROM j),
x AS (SELECT vec_id, list_concat(m, [{", ".join(f"t[{r + 1}] - (" + " + ".join(f"m[{3 * r + k + 1}] * s[{k + 1}]" for k in range(3)) + ")" for r in range(3))}]) AS m FROM r)
SELECT vec_id, k::INTEGER AS k, round(m[k + 1], 4) + 0 AS v FROM (SELECT vec_id, m, unnest(range(12)) AS k FROM x)"""


def quaternion_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quaternions of a label's vectors in order, each with the sign nearer to the one before."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice("embedding", 1, 2).cast("array<double>").alias("q"))
    return rounded(unwrap.unwrap_quaternions(rows, ["label"], "vec_id", "q").select("vec_id", F.get("q", F.lit(0)).alias("first"), F.get("q", F.lit(1)).alias("second")))


_SIGNS = """WITH d AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, lag(embedding[1]::DOUBLE) OVER w AS px, lag(embedding[2]::DOUBLE) OVER w AS py FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
s AS (SELECT *, CASE WHEN sum((x * px + y * py < 0)::INTEGER) OVER (PARTITION BY label ORDER BY vec_id) % 2 = 1 THEN -1 ELSE 1 END AS s FROM d)
SELECT vec_id, round(x * s, 6) AS "first", round(y * s, 6) AS "second" FROM s"""


def rotation_vector_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks of sixteen rotation vectors about one axis, a third of a turn apart and more: each is taken the way round that is nearer to the one before."""
    angle = F.pmod((F.pmod("event_id", F.lit(16)) * (F.pmod("user_id", F.lit(5)) + 6)) * 0.5, F.lit(6.2)) - 3.1
    rows = table(spark, sf_dir, "events").select(F.expr("event_id div 16").alias("chunk"), "event_id", F.array(angle, F.lit(0.0), F.lit(0.0)).alias("r"))
    chunks = rows.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "r"))), lambda e: e["r"]).alias("r"))
    return rounded(unwrap.unwrap_rotation_vectors(chunks, "r", 16).select("chunk", F.posexplode(F.transform("r", lambda v: F.get(v, F.lit(0)))).alias("k", "v")), 4)


_VECTORS = """WITH RECURSIVE r AS (SELECT event_id // 16 AS chunk, (row_number() OVER (PARTITION BY event_id // 16 ORDER BY event_id) - 1)::INTEGER AS k, (event_id % 16 * (user_id % 5 + 6) * 0.5::DOUBLE) % 6.2::DOUBLE - 3.1::DOUBLE AS a FROM events),
o AS (SELECT chunk, k, a, CASE WHEN abs(a) < 1e-8 THEN a ELSE -(2 * pi() - abs(a)) * sign(a) END AS b FROM r),
u(chunk, k, v) AS (SELECT chunk, k, a FROM o WHERE k = 0 UNION ALL SELECT o.chunk, o.k, CASE WHEN abs(a - v) > abs(b - v) THEN b ELSE a END FROM u JOIN o ON o.chunk = u.chunk AND o.k = u.k + 1)
SELECT chunk, k, round(v, 4) AS v FROM u"""


def actions_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised actions taken apart, denormalised, six numbers made orthogonal again, and added to their state."""
    stats = F.struct(*[F.lit(v).alias(k) for k, v in {"mean": 0.5, "std": 2.0, "min": -1.0, "max": 1.0, "q01": -0.9, "q99": 0.9}.items()])
    position = F.transform(_part(1, 3), lambda v: scalar.denormalize(v, "mean_std", stats))
    turn = fs.rot6d_to_matrix(_part(4, 6))
    return _long(table(spark, sf_dir, "embeddings"), F.concat(F.zip_with(position, _part(10, 3), lambda d, s: d + s), fs.matmul(fs.rotvec_to_matrix(_part(13, 3)), turn)))


_RESTORED = f"""WITH c AS (SELECT vec_id, m AS s, embedding, [embedding[k]::DOUBLE for k in [4, 6, 8]] AS a, [embedding[k]::DOUBLE for k in [5, 7, 9]] AS b FROM {_rodrigues(13)}),
n AS (SELECT *, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) AS e FROM c), o AS (SELECT *, list_transform(b, lambda x, i: x - list_dot_product(e, b) * e[i]) AS f FROM n), g AS (SELECT *, list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) AS h FROM o),
m AS (SELECT vec_id, embedding, s, [e[1], h[1], e[2] * h[3] - e[3] * h[2], e[2], h[2], e[3] * h[1] - e[1] * h[3], e[3], h[3], e[1] * h[2] - e[2] * h[1]] AS r FROM g),
x AS (SELECT vec_id, list_concat([embedding[k]::DOUBLE * (2 + 1e-8::DOUBLE) + 0.5::DOUBLE + embedding[k + 9]::DOUBLE for k in [1, 2, 3]], {_product('s', 'r')}) AS m FROM m)
SELECT vec_id, k::INTEGER AS k, round(m[k + 1], 5) + 0 AS v FROM (SELECT vec_id, m, unnest(range(12)) AS k FROM x)"""

QUERIES = {
    "euler_xyz": (_euler("xyz"), _euler_sql("xyz")),
    "euler_zyx": (_euler("zyx"), _euler_sql("zyx")),
    "quaternions_of_matrices": (quaternions_of_matrices, _QUATERNIONS),
    "slerp_resample": (slerp_resample, _SLERP),
    "composed_states": (composed_states, _COMPOSED),
    "relative_poses": (relative_poses, _POSES),
    "quaternion_signs": (quaternion_signs, _SIGNS),
    "rotation_vector_unwrap": (rotation_vector_unwrap, _VECTORS),
    "actions_restored": (actions_restored, _RESTORED),
}
