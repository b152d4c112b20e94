"""Standardised slots against a loop."""

import numpy as np
import pytest
from framewright.operators.series_joins import standardised_slots
from pyspark.errors import PySparkException


def tables(spark):
    rng = np.random.default_rng(5)
    arrays = {("a", "top"): rng.normal(size=(9, 3)), ("a", "left"): rng.normal(size=(2, 3)), ("b", "top"): rng.normal(size=(1, 3))}
    stats = {"a": (rng.normal(size=3), 0.5 + rng.random(3))}
    frames = [(d, v, k, x.tolist()) for (d, v), rows in arrays.items() for k, x in enumerate(rows)]
    samples = [("a", s, v, s - 2) for s in range(12) for v in ("top", "left")] + [("b", 1, "top", 4)]
    return (
        arrays, stats, samples, spark.createDataFrame(samples, "dataset string, sample int, view string, start int"), spark.createDataFrame(frames, "dataset string, view string, frame int, latent array<double>"),
        spark.createDataFrame([(d, m.tolist(), s.tolist()) for d, (m, s) in stats.items()], "dataset string, mean array<double>, std array<double>"),
    )


@pytest.mark.parametrize("chunk,step", [(1, 1), (4, 1), (4, 3)])
def test_slots_are_those_of_a_loop(spark, chunk, step):
    arrays, stats, samples, *given = tables(spark)
    got = {(r.dataset, r["sample"], r.slot, r.k): (r.view, r.latent) for r in standardised_slots(*given, chunk, step).collect()}
    assert len(got) == len(samples) * chunk
    for d, s, v, start in samples:
        slot = sorted(w for e, t, w, _ in samples if (e, t) == (d, s)).index(v)
        mean, std = stats.get(d, (0, 1))
        at = np.clip(start + np.arange(chunk) * step, 0, len(arrays[d, v]) - 1)
        for k, x in enumerate((arrays[d, v][at] - mean) / std):
            assert got[d, s, slot, k][0] == v
            np.testing.assert_allclose(got[d, s, slot, k][1], x)


def test_missing_views_and_wrong_statistics_are_errors(spark):
    *_, samples, frames, stats = tables(spark)
    with pytest.raises(PySparkException, match="no frames of view left"):
        standardised_slots(samples, frames.where("view <> 'left'"), stats, 2, 1).collect()
    with pytest.raises(PySparkException, match="don't fit"):
        standardised_slots(samples, frames.selectExpr("dataset", "view", "frame", "slice(latent, 1, 2) AS latent"), stats, 2, 1).collect()
    assert standardised_slots(samples.limit(0), frames, stats, 2, 1).collect() == []
