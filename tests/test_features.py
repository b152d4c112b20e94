"""Principal components, colours and losses against numpy."""

import numpy as np
import pytest
from framewright import plans
from framewright.operators import features
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_components_are_those_of_a_decomposition(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 12)) @ rng.normal(0, 1, (12, 12)) + 1e6
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(7)
    n, mean, cov = features.covariance(rows, "v")
    assert n == 300 and np.allclose(mean, x.mean(0), rtol=1e-12) and np.allclose(cov, np.cov(x.T, bias=True), rtol=1e-6)
    mean, parts, variances = features.principal_components(rows, "v", 3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(variances, s[:3] ** 2 / 300) and np.allclose(np.abs(parts @ vt[:3].T), np.eye(3), atol=1e-6)
    assert all(p[np.abs(p).argmax()] > 0 for p in parts)
    got = {r.id: r.c for r in features.projected(rows, "v", mean, parts, "c").collect()}
    assert np.allclose([got[k] for k in range(300)], (x - x.mean(0)) @ parts.T, atol=1e-6)
    again = features.principal_components(rows.repartition(2), "v", 3)[1]
    assert np.allclose(parts, again, atol=1e-7)


@pytest.mark.parametrize("bad", [None, [1.0], [1.0, None]])
def test_vectors_of_another_kind_are_errors(spark, bad):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, bad)], "id int, v array<double>").coalesce(1)
    with pytest.raises((PySparkException, ValueError)):
        features.covariance(rows, "v")
    with pytest.raises(ValueError):
        features.covariance(rows.limit(0), "v")


def test_colours_span_an_image(spark):
    rows = spark.createDataFrame([("a", [0.0, 5.0, 1.0]), ("a", [1.0, 5.0, 2.0]), ("a", [0.5, 5.0, 4.0]), (None, [3.0, 3.0, 3.0])], "image string, c array<double>")
    got = sorted((r.image or "", r.rgb) for r in features.as_colours(rows, ["image"], "c").collect())
    assert got == [("", [127, 127, 127]), ("a", [0, 127, 0]), ("a", [127, 127, 255]), ("a", [255, 127, 85])]


def test_query_gives_colours_of_numpy(spark):
    rows = {r.vec_id: (r.label, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    x = np.array([rows[k][1] for k in sorted(rows)], float)
    labels = np.array([rows[k][0] for k in sorted(rows)])
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    parts = np.array([v * np.sign(v[np.abs(v).argmax()]) for v in vt[:3]])
    at = (x - x.mean(0)) @ parts.T
    got = {r.vec_id: r.rgb for r in plans.queries()["feature_colours"](spark, DATA).collect()}
    assert got.keys() == rows.keys()
    for label in set(labels.tolist()):
        own = at[labels == label]
        want = (own - own.min(0)) / np.maximum(own.max(0) - own.min(0), 1e-12) * 255
        have = np.array([got[k] for k in np.array(sorted(rows))[labels == label]])
        assert np.all(np.abs(have - np.floor(want)) <= 1) and have.min() == 0 and have.max() >= 254


def test_losses_of_alike_and_far_vectors(spark):
    assert [round(v, 6) for v in spark.range(1).select(features.contrastive(F.lit(1.0), F.lit(-1.0), 1e-4), features.contrastive(F.lit(-1.0), F.lit(1.0), 1e-4), features.contrastive(F.lit(0.3), F.lit(0.3), 1.0)).first()] == [0.0, 20000.0, round(np.log(2), 6)]
    schema = "image int, patch int, predicted array<float>, target array<float>, source array<float>, motion double"
    rows = [(1, k, [1.0, 0.0], [1.0, 0.0], [0.0, float(k)], 0.0) for k in range(25)] + [(2, 0, [0.0, 0.0], [3.0, 4.0], [3.0, 4.0], 9.0)]
    got = {r.image: r for r in features.feature_losses(spark.createDataFrame(rows, schema), ["image"], "patch", 1.0).collect()}
    assert (got[1].patches, round(got[1].likeness, 6), got[1].relative, got[1].relative_moving) == (25, 1.0, 0.0, 0.0)
    assert (got[2].likeness, round(got[2].contrast, 5), round(got[2].relative / 25e6, 5)) == (0.0, round(np.log(2), 5), 1.0)
    with pytest.raises(PySparkException):
        features.feature_losses(spark.createDataFrame([(1, 0, [1.0], [1.0, 2.0], [1.0], 0.0)], schema), ["image"], "patch", 1.0).collect()
