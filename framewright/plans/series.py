"""Queries on chunks, resampling, deltas, unwrapping and rotations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import series as fs
from framewright.functions.scalar import ROLES
from framewright.operators.series_joins import standardised_slots as slot_rows
from framewright.operators.unwrap import unwrap_angles
from framewright.plans.tables import FRAMES, SERIES, frames, rounded, series, table


def chunk_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """starts and ends of chunks of 16, 12 apart, over each user's events."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count(F.lit(1)).alias("n"))
    starts = rows.select("episode", "n", F.explode(fs.chunk_starts(F.col("n"), 16, 12)).alias("start"))
    return starts.select("episode", "start", F.least(F.col("start") + 16, "n").alias("end"))


_STARTS = """WITH n AS (SELECT user_id AS episode, count(*)::BIGINT AS n FROM events GROUP BY user_id),
k AS (SELECT episode, n, unnest(range(greatest(0, n - 16) // 12 + 1 + (greatest(0, n - 16) % 12 <> 0)::BIGINT)) AS k FROM n)
SELECT episode, least(k * 12, greatest(0, n - 16)) AS start, least(least(k * 12, greatest(0, n - 16)) + 16, n) AS "end" FROM k"""


def strided_chunk_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eight samples three apart from the fourth last on, the last repeated, and padded to ten."""
    rows = series(spark, sf_dir).withColumn("chunk", fs.gather(F.col("x"), F.greatest(F.lit(0), F.size("x") - 10), F.lit(3), 8))
    padded = fs.pad_to(F.col("chunk"), 10)
    return rows.select("episode", F.posexplode(padded).alias("k", "v"))


_GATHER = f"""WITH {SERIES}, c AS (SELECT episode, list_transform(range(10), lambda k: x[least(greatest(0, len(x) - 10) + least(k, 7) * 3, len(x) - 1) + 1]) AS c FROM series)
SELECT episode, unnest(range(10))::INTEGER AS k, unnest(c) AS v FROM c"""


def _resample(linear: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = series(spark, sf_dir).withColumn("n", fs.resampled_length(F.size("x"), F.lit(30.0), F.lit(20.0)))
        rows = rows.select("episode", fs.resample(F.col("x"), F.lit(30.0), F.lit(20.0), F.col("n"), linear).alias("y"))
        return rounded(rows.select("episode", F.posexplode("y").alias("k", "v")))

    run.__doc__ = f"D14, F10 to F13, F15: 30 to 20 samples a second, {'between neighbours' if linear else 'the nearest'}."
    return run


_RESAMPLED = f"""WITH {SERIES}, n AS (SELECT episode, x, greatest(1, round_even(len(x) * 20::DOUBLE / 30, 0)::BIGINT) AS n FROM series),
k AS (SELECT episode, x, unnest(range(n))::INTEGER AS k FROM n), p AS (SELECT episode, x, k, least((len(x) - 1)::DOUBLE, k * 30::DOUBLE / 20) AS pos FROM k)"""
_LINEAR = f"{_RESAMPLED} SELECT episode, k, round(x[floor(pos)::BIGINT + 1] * (1 - (pos - floor(pos))) + x[least(floor(pos)::BIGINT + 1, len(x) - 1) + 1] * (pos - floor(pos)), 6) AS v FROM p"
_NEAR = f"{_RESAMPLED} SELECT episode, k, round(x[round_even(pos, 0)::BIGINT + 1], 6) AS v FROM p"


def delta_from_chunk_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: each value less the first of its chunk of 16."""
    first = F.first("value").over(Window.partitionBy("episode", F.expr("frame div 16")).orderBy("frame"))
    return rounded(frames(spark, sf_dir).select("event_id", (F.col("value") - first).alias("delta")))


_DELTA = f"WITH {FRAMES} SELECT event_id, round(value - first_value(value) OVER (PARTITION BY episode, frame // 16 ORDER BY frame), 6) AS delta FROM frames"


def euler_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values as angles, unwrapped along each user's series."""
    rows = frames(spark, sf_dir).select("episode", F.col("frame").cast("int").alias("k"), (F.pmod(F.col("value"), F.lit(2 * math.pi)) - math.pi).alias("v"))
    return rounded(unwrap_angles(rows, ["episode"], "k", "v"), 5)


_PI = f"{math.pi!r}::DOUBLE"
_UNWRAP = f"""WITH {FRAMES}, a AS (SELECT episode, frame, value % (2 * {_PI}) - {_PI} AS x FROM frames), d AS (SELECT *, x - lag(x) OVER (PARTITION BY episode ORDER BY frame) AS d FROM a),
m AS (SELECT *, (d + {_PI} + 4 * {_PI}) % (2 * {_PI}) - {_PI} AS m FROM d)
SELECT episode, frame::INTEGER AS k, round(x + sum(CASE WHEN d IS NULL OR abs(d) < {_PI} THEN 0 ELSE (CASE WHEN m = -{_PI} AND d > 0 THEN {_PI} ELSE m END) - d END) OVER (PARTITION BY episode ORDER BY frame), 5) AS v FROM m"""


def slot_pivot_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines of an order as six slots by number, zero where there is none, and their mask."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    slots = [F.coalesce(F.max(F.when(F.col("l_linenumber") == k + 1, F.col("l_quantity"))), F.lit(0.0)).alias(r) for k, r in enumerate(ROLES)]
    mask = F.concat(*[F.max(F.when(F.col("l_linenumber") == k + 1, "1").otherwise("0")) for k in range(len(ROLES))])
    return lines.agg(*slots, mask.alias("mask"))


_SLOTS = "SELECT l_orderkey, " + ", ".join(f"coalesce(max(CASE WHEN l_linenumber = {k + 1} THEN l_quantity END), 0) AS {r}" for k, r in enumerate(ROLES)) + ", " + " || ".join(f"max(CASE WHEN l_linenumber = {k + 1} THEN '1' ELSE '0' END)" for k in range(len(ROLES))) + " AS mask FROM lineitem GROUP BY l_orderkey"


def standardised_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer, chunks of four vectors of two views (vectors of a label by number mod 5, in order), less their label's mean and by its deviation; the sum of a vector's entries, each times its place, and its first."""
    own = Window.partitionBy("dataset", "view").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").where("label IS NOT NULL AND size(embedding) = 64").select(F.col("label").cast("long").alias("dataset"), F.expr("vec_id % 5").alias("view"), "vec_id", F.col("embedding").cast("array<double>").alias("latent"))
    frames = rows.select("dataset", "view", (F.row_number().over(own) - 1).alias("frame"), "latent")
    moments = rows.groupBy("dataset").agg(*[rule(F.get("latent", F.lit(k))).alias(f"{name}{k}") for k in range(64) for name, rule in (("mean", F.avg), ("std", F.stddev_samp))])
    stats = moments.select("dataset", *[F.array(*[F.col(f"{name}{k}") for k in range(64)]).alias(name) for name in ("mean", "std")])
    samples = table(spark, sf_dir, "customer").select(F.expr("c_custkey % 10").alias("dataset"), F.col("c_custkey").alias("sample"), F.expr("c_nationkey % 9").alias("start"), F.explode(F.array(F.expr("c_custkey % 5"), F.expr("(c_custkey + 2) % 5"))).alias("view"))
    places = F.aggregate(F.transform("latent", lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    exact = lambda v: F.round(v, 5) + F.lit(0.0)
    return slot_rows(samples, frames, stats, 4, 2).select("sample", "slot", "view", "k", exact(places).alias("places"), exact(F.get("latent", F.lit(0))).alias("first"))


_STANDARD = """WITH r AS (SELECT label::BIGINT AS dataset, vec_id % 5 AS "view", vec_id, embedding FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64),
f AS (SELECT *, row_number() OVER (PARTITION BY dataset, "view" ORDER BY vec_id) - 1 AS frame FROM r), n AS (SELECT dataset, "view", count(*) AS n FROM r GROUP BY ALL),
e AS (SELECT dataset, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM r), m AS (SELECT dataset, i, avg(v) AS mean, stddev_samp(v) AS std FROM e GROUP BY ALL),
z AS (SELECT dataset, vec_id, sum((v - mean) / std * i) AS places, max((v - mean) / std) FILTER (i = 1) AS "first" FROM e JOIN m USING (dataset, i) GROUP BY ALL),
s AS (SELECT c_custkey AS sample, c_custkey % 10 AS dataset, c_nationkey % 9 AS start, unnest([c_custkey % 5, (c_custkey + 2) % 5]) AS "view" FROM customer),
o AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY "view") - 1 AS slot FROM s), k AS (SELECT *, unnest(range(4)) AS k FROM o JOIN n USING (dataset, "view"))
SELECT sample, slot::INTEGER AS slot, k."view" AS "view", k.k::INTEGER AS k, round(places, 5) + 0 AS places, round("first", 5) + 0 AS "first" FROM k JOIN f ON f.dataset = k.dataset AND f."view" = k."view" AND frame = least(start + k.k * 2, n - 1) JOIN z USING (vec_id)"""


def flow_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """values summed over the next four frames, and running totals."""
    w = Window.partitionBy("episode").orderBy("frame")
    rows = frames(spark, sf_dir).select("event_id", F.sum("value").over(w.rowsBetween(0, 3)).alias("flow"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    return rounded(rows, 4)


_FLOW = f"""WITH {FRAMES} SELECT event_id, round(sum(value) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), 4) AS flow,
round(sum(value) OVER (PARTITION BY episode ORDER BY frame ROWS UNBOUNDED PRECEDING), 4) AS total FROM frames"""


def locality_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user's event has the type of the one four later, and the ceiling."""
    later = F.lead("event_type", 4).over(Window.partitionBy("episode").orderBy("frame"))
    rows = frames(spark, sf_dir).withColumn("same", F.col("event_type") == later)
    return rounded(rows.groupBy("episode").agg(F.avg(F.col("same").cast("double")).alias("periodicity"), (1 - F.count_distinct("event_type") / F.count(F.lit(1))).alias("ceiling")))


_PERIOD = f"""WITH {FRAMES}, s AS (SELECT episode, event_type, event_type = lead(event_type, 4) OVER (PARTITION BY episode ORDER BY frame) AS same FROM frames)
SELECT episode, round(avg(same::DOUBLE), 6) AS periodicity, round(1 - count(DISTINCT event_type) / count(*), 6) AS ceiling FROM s GROUP BY episode"""

_Q = [f"embedding[{k}]::DOUBLE" for k in (1, 2, 3, 4)]


def quat_to_rot6d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four dimensions as a quaternion, as six numbers and back as a matrix."""
    q = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", fs.matrix_to_rot6d(fs.quat_to_matrix(q)).alias("r"))
    return rounded(rows.select("vec_id", F.posexplode(fs.rot6d_to_matrix(F.col("r"))).alias("k", "v")), 5)


_ROT = f"""WITH q AS (SELECT vec_id, {", ".join(f"{e} AS {n}" for e, n in zip(_Q, "xyzw"))} FROM embeddings), s AS (SELECT *, 2 / (x * x + y * y + z * z + w * w) AS s FROM q),
m AS (SELECT vec_id, [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w), s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w), s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)] AS m FROM s)
SELECT vec_id, k::INTEGER AS k, round(m[k + 1], 5) AS v FROM (SELECT vec_id, m, unnest(range(9)) AS k FROM m)"""


def relative_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation vectors of three dimensions each, one relative to the other."""
    part = lambda at: fs.rotvec_to_matrix(F.transform(F.slice("embedding", at, 3), lambda v: v.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", part(1).alias("a"), part(4).alias("b"))
    return rows.select("vec_id", F.posexplode(fs.matmul(F.col("a"), F.col("b"), True)).alias("k", "v")).withColumn("v", F.round("v", 5))


def _rodrigues(names: str, at: int) -> str:
    x, y, z = (f"embedding[{at + k}]::DOUBLE" for k in range(3))
    return f"""{names}v AS (SELECT vec_id, {x} AS x, {y} AS y, {z} AS z, sqrt({x} * {x} + {y} * {y} + {z} * {z}) AS t FROM embeddings),
{names}c AS (SELECT *, CASE WHEN t < 1e-8 THEN 1 ELSE sin(t) / t END AS s, CASE WHEN t < 1e-8 THEN 0.5 ELSE (1 - cos(t)) / (t * t) END AS c FROM {names}v),
{names} AS (SELECT vec_id, [1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y, c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x, c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y)] AS m FROM {names}c)"""


_RELATIVE = f"""WITH {_rodrigues("a", 1)}, {_rodrigues("b", 4)}
SELECT vec_id, k::INTEGER AS k, round(p[k // 3 + 1] * q[k % 3 + 1] + p[k // 3 + 4] * q[k % 3 + 4] + p[k // 3 + 7] * q[k % 3 + 7], 5) AS v FROM (SELECT a.vec_id, a.m AS p, b.m AS q, unnest(range(9)) AS k FROM a JOIN b USING (vec_id))"""


def cosine_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's likeness to its label's mean, and its mean over dimensions."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    means = rows.groupBy("label", "dim").agg(F.avg("x").alias("m"))
    both = rows.join(means, ["label", "dim"]).groupBy("vec_id").agg(F.sum(F.col("x") * F.col("m")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("m") * F.col("m")).alias("b"), F.avg("x").alias("pooled"))
    return rounded(both.select("vec_id", (F.col("d") / F.sqrt(F.col("a") * F.col("b"))).alias("cosine"), "pooled"))


_COSINE = """WITH r AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS m FROM r GROUP BY label, dim)
SELECT vec_id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS cosine, round(avg(x), 6) AS pooled FROM r JOIN m USING (label, dim) GROUP BY vec_id"""

QUERIES = {
    "chunk_starts": (chunk_starts, _STARTS),
    "strided_chunk_gather": (strided_chunk_gather, _GATHER),
    "resample_linear": (_resample(True), _LINEAR),
    "resample_nearest": (_resample(False), _NEAR),
    "delta_from_chunk_start": (delta_from_chunk_start, _DELTA),
    "euler_unwrap": (euler_unwrap, _UNWRAP),
    "standardised_slots": (standardised_slots, _STANDARD),
    "slot_pivot_mask": (slot_pivot_mask, _SLOTS),
    "flow_sums": (flow_sums, _FLOW),
    "locality_periodicity": (locality_periodicity, _PERIOD),
    "quat_to_rot6d": (quat_to_rot6d, _ROT),
    "relative_rotations": (relative_rotations, _RELATIVE),
    "cosine_map": (cosine_map, _COSINE),
}
