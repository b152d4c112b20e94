"""Queries on displacement fields: embeddings as images of 4 x 8 pixels, their first and second half as depths, all of their numbers as a flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import flow
from framewright.operators.ranges import running
from framewright.plans.series import _rodrigues
from framewright.plans.tables import rounded, table

#: Pixels, the rows of an image, frames of a chain, every start, the slope that a depth may have.
H, W, STRIDE, EVERY, STEEPEST = 4, 8, 3, 2, 0.1
_K, _NEXT_K = (8.0, 0.0, 3.5, 0.0, 8.0, 1.5, 0.0, 0.0, 1.0), (9.0, 0.0, 3.5, 0.0, 7.0, 1.5, 0.0, 0.0, 1.0)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, e (64 doubles), depth, next_depth, flow, camera, next_camera, height, width."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 2 * H * W).select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    depth = lambda at: F.transform(F.slice("e", at, H * W), lambda x: 1 + F.abs(x))
    matrix = lambda m: F.array(*[F.lit(x) for x in m])
    return rows.select("vec_id", "e", depth(1).alias("depth"), depth(H * W + 1).alias("next_depth"), F.transform("e", lambda x: x * 8).alias("flow"), matrix(_K).alias("camera"), matrix(_NEXT_K).alias("next_camera"), F.lit(H).alias("height"), F.lit(W).alias("width"))


_PIXELS = f"""images AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings WHERE len(embedding) = {2 * H * W}),
pixels AS (SELECT vec_id, e, p, p % {W} AS x, p // {W} AS y FROM (SELECT vec_id, e, unnest(range({H * W})) AS p FROM images))"""


def _triples(rows: DataFrame, column: str, *more: str) -> DataFrame:
    """A row a pixel of a flat array of three numbers each."""
    rows = rows.select("vec_id", F.posexplode(F.sequence(F.lit(0), F.lit(H * W - 1))).alias("p", "__p"), column, *more)
    return rows.select("vec_id", "p", *[F.get(column, F.col("p") * 3 + k).alias(c) for k, c in enumerate(("dx", "dy", "dz"))], *[F.get(c, F.col("p")).alias(c) for c in more])


def flow_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows of three frames chained from every second one; seven episodes of the embeddings."""
    rows = _images(spark, sf_dir).withColumn("episode", F.pmod("vec_id", F.lit(7)))
    rows = running(rows, ["episode"], [F.col("vec_id")], "frame")
    found = flow.chained_flows(rows, ["episode"], "frame", "flow", "height", "width", STRIDE, EVERY)
    found = found.select("episode", "start", F.posexplode(F.sequence(F.lit(0), F.lit(H * W - 1))).alias("p", "__p"), "flow")
    return rounded(found.select("episode", "start", "p", F.get("flow", F.col("p") * 2).alias("u"), F.get("flow", F.col("p") * 2 + 1).alias("v")), 5)


def _chain_sql() -> str:
    steps = []
    for k in range(STRIDE):
        at = lambda row, column, c: f"f.v[2 * ({row} * {W} + {column}) + {c}]"
        mean = lambda c: f"{at('y0', 'x0', c)} * (1 - wx) * (1 - wy) + {at('y0', 'x1', c)} * wx * (1 - wy) + {at('y1', 'x0', c)} * (1 - wx) * wy + {at('y1', 'x1', c)} * wx * wy"
        steps.append(f"""s{k} AS (SELECT *, floor(sx)::INTEGER AS x0, floor(sy)::INTEGER AS y0, least(floor(sx)::INTEGER + 1, {W - 1}) AS x1, least(floor(sy)::INTEGER + 1, {H - 1}) AS y1, sx - floor(sx) AS wx, sy - floor(sy) AS wy
    FROM (SELECT *, greatest(0, least({W - 1}, cx)) AS sx, greatest(0, least({H - 1}, cy)) AS sy FROM c{k})),
c{k + 1} AS (SELECT s.episode, s.start, s.p, cx + {mean(1)} AS cx, cy + {mean(2)} AS cy FROM s{k} s JOIN f ON f.episode = s.episode AND f.frame = s.start + {k})""")
    return f"""WITH f AS (SELECT vec_id % 7 AS episode, row_number() OVER (PARTITION BY vec_id % 7 ORDER BY vec_id) - 1 AS frame, list_transform(embedding, lambda x: x::DOUBLE * 8) AS v FROM embeddings WHERE len(embedding) = {2 * H * W}),
c0 AS (SELECT episode, start, p, (p % {W})::DOUBLE AS cx, (p // {W})::DOUBLE AS cy FROM (SELECT episode, frame AS start, unnest(range({H * W})) AS p FROM f WHERE frame % {EVERY} = 0)),
{", ".join(steps)}
SELECT episode, start, p::INTEGER AS p, round(cx - p % {W}, 5) AS u, round(cy - p // {W}, 5) AS v FROM c{STRIDE}"""


def scene_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of two depth images under two poses, joined by the flow between the images."""
    rows = _images(spark, sf_dir)
    e = lambda k: F.get("e", F.lit(k))
    zero, one = F.lit(0.0), F.lit(1.0)
    about_z = F.array(F.cos(e(0)), -F.sin(e(0)), zero, e(1), F.sin(e(0)), F.cos(e(0)), zero, e(2), zero, zero, one, e(3))
    about_x = F.array(one, zero, zero, e(5), zero, F.cos(e(4)), -F.sin(e(4)), e(6), zero, F.sin(e(4)), F.cos(e(4)), e(7))
    found = flow.scene_flows(rows.withColumn("pose", about_z).withColumn("next_pose", about_x), STEEPEST)
    return rounded(_triples(found, "flow_3d", "mask"), 5)


def _smooth(at: str, x: str, y: str) -> str:
    d = lambda dx, dy: f"(1 + abs(e[{at} + ({y} + {dy}) * {W} + {x} + {dx}]))"
    gx = f"CASE WHEN {x} BETWEEN 1 AND {W - 2} THEN ({d(1, 0)} - {d(-1, 0)}) / 2 ELSE 0 END"
    gy = f"CASE WHEN {y} BETWEEN 1 AND {H - 2} THEN ({d(0, 1)} - {d(0, -1)}) / 2 ELSE 0 END"
    return f"sqrt(({gx}) * ({gx}) + ({gy}) * ({gy})) < {STEEPEST}"


_SCENE = f"""WITH {_PIXELS}, t AS (SELECT *, 1 + abs(e[p + 1]) AS d1, x + e[2 * p + 1] * 8 AS tx, y + e[2 * p + 2] * 8 AS ty FROM pixels),
r AS (SELECT *, tx >= 0 AND tx <= {W - 1} AND ty >= 0 AND ty <= {H - 1} AS inside, greatest(0, least({W - 1}, round_even(tx, 0)))::INTEGER AS qx, greatest(0, least({H - 1}, round_even(ty, 0)))::INTEGER AS qy FROM t),
s AS (SELECT *, 1 + abs(e[{H * W + 1} + qy * {W} + qx]) AS d2 FROM r),
m AS (SELECT *, inside AND {_smooth("1", "x", "y")} AND {_smooth(str(H * W + 1), "qx", "qy")} AS mask, (qx - 3.5) * d2 / 9 - e[6] AS ax, (qy - 1.5) * d2 / 7 - e[7] AS ay, d2 - e[8] AS az FROM s),
n AS (SELECT *, cos(e[5]) * ay + sin(e[5]) * az AS vy, cos(e[5]) * az - sin(e[5]) * ay AS vz FROM m)
SELECT vec_id, p::INTEGER AS p, mask, CASE WHEN mask THEN round(cos(e[1]) * ax - sin(e[1]) * vy + e[2] - (x - 3.5) * d1 / 8, 5) ELSE 0.0 END AS dx,
CASE WHEN mask THEN round(sin(e[1]) * ax + cos(e[1]) * vy + e[3] - (y - 1.5) * d1 / 8, 5) ELSE 0.0 END AS dy, CASE WHEN mask THEN round(vz + e[4] - d1, 5) ELSE 0.0 END AS dz FROM n"""


def static_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the points of a depth image move under a motion of its camera."""
    rows = _images(spark, sf_dir).withColumn("motion", F.slice("e", 1, 6))
    return rounded(_triples(flow.static_flows(rows), "static_flow"), 5)


_STATIC = f"""WITH {_PIXELS}, {_rodrigues("a", 1)}, q AS (SELECT i.vec_id, p, e, m, (x - 3.5) * (1 + abs(e[p + 1])) / 8 AS px, (y - 1.5) * (1 + abs(e[p + 1])) / 8 AS py, 1 + abs(e[p + 1]) AS pz FROM pixels i JOIN a USING (vec_id))
SELECT vec_id, p::INTEGER AS p, {", ".join(f"round(m[{3 * k + 1}] * px + m[{3 * k + 2}] * py + m[{3 * k + 3}] * pz + e[{k + 4}] - p{c}, 5) AS d{c}" for k, c in enumerate("xyz"))} FROM q"""

QUERIES = {
    "flow_chains": (flow_chains, _chain_sql()),
    "scene_flows": (scene_flows, _SCENE),
    "static_flows": (static_flows, _STATIC),
}
