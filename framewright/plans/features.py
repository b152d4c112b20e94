"""Queries on features: embeddings as patches of images, which their labels are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import features
from framewright.plans.tables import rounded, table


def feature_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a prediction of the next one from the one after, with contrastive and relative losses by label."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull())
    near = lambda by, name: rows.select((F.col("vec_id") - by).alias("vec_id"), F.col("embedding").alias(name))
    patches = rows.select("vec_id", "label", F.col("embedding").alias("predicted")).join(near(1, "target"), "vec_id").join(near(2, "source"), "vec_id")
    found = features.feature_losses(patches.withColumn("motion", F.abs(F.get("predicted", F.lit(0)))), ["label"], "vec_id", 0.1)
    return rounded(found, 5)


_LOSSES = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id, a.label, 1 + 10 * least(abs(a.e[1]), 0.5) AS w, list_cosine_similarity(a.e, b.e) AS pos, list_cosine_similarity(a.e, c.e) AS neg, list_distance(b.e, c.e) ** 2 AS change, list_distance(a.e, b.e) ** 2 AS err
    FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2),
r AS (SELECT *, err / (change + 1e-6) AS rel, ln(1 + exp((neg - pos) / 0.1)) AS con, row_number() OVER (PARTITION BY label ORDER BY change DESC, vec_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM p)
SELECT label, count(*) AS patches, round(avg(pos), 5) AS likeness, round(sum(con * w) / (sum(w) + 1e-6), 5) AS contrast, round(sum(rel * w) / (sum(w) + 1e-6), 5) AS relative,
round(avg(rel) FILTER (place <= greatest(1, n // 10)), 5) AS relative_moving FROM r GROUP BY label"""


def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I32: the variance of the embeddings along their first three principal components and in all; and how far the components' coordinates are from having it, from mean 0, and from being uncorrelated: nothing."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    n, mean, found = features.covariance(rows, "embedding")
    mean, parts, variances = features.principal_components(rows, "embedding", 3)
    at = features.projected(rows, "embedding", mean, parts, "c")
    c = [F.get("c", F.lit(k)) for k in range(3)]
    off = [F.abs(F.avg(c[k])) for k in range(3)] + [F.abs(F.covar_pop(c[k], c[(k + 1) % 3])) for k in range(3)] + [F.abs(F.var_pop(c[k]) - float(variances[k])) for k in range(3)]
    kept = F.lit(float(found.trace())).alias("total")
    return rounded(at.agg(F.count(F.lit(1)).alias("n"), F.greatest(*off).alias("off")).select("n", "off", kept))


_AXES = """WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL)
SELECT (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS n, 0.0::DOUBLE AS off, (SELECT round(sum(v), 6) FROM (SELECT var_pop(x) AS v FROM x GROUP BY k)) AS total"""


def feature_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I32: embeddings along their first three principal components, as colours within their label."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).select("vec_id", "label", "embedding")
    mean, parts, _ = features.principal_components(rows, "embedding", 3)
    return features.as_colours(features.projected(rows, "embedding", mean, parts, "c"), ["label"], "c").select("vec_id", "label", "rgb")


QUERIES = {
    "feature_losses": (feature_losses, _LOSSES),
    "principal_axes": (principal_axes, _AXES),
    "feature_colours": (feature_colours, None),
}
