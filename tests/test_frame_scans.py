"""Frames of a set of episodes: what the scan passes over, and gaps."""

import pytest
from framewright.sources import episodes


def test_intervals_hold_all_and_few_others(spark):
    ids = [3, 4, 5, 9, 700, 701, 100_000, None, 4]
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    assert episodes.intervals(df, "k") == [(3, 5), (9, 9), (700, 701), (100_000, 100_000)]
    few = episodes.intervals(df, "k", 3)
    assert len(few) <= 3 and all(any(a <= i <= b for a, b in few) for i in ids if i is not None) and sum(b - a + 1 for a, b in few) < 200
    many = spark.range(0, 100_000, 7).withColumnRenamed("id", "k")
    held = episodes.intervals(many, "k")
    assert len(held) <= episodes.INTERVALS and held[0][0] <= 0 and held[-1][1] >= 99_995
    assert episodes.intervals(df.limit(0), "k") == []


def test_scan_is_pruned_and_gaps_are_errors(spark, tmp_path):
    rows = spark.range(200).selectExpr("id AS episode_index", "explode(sequence(0, 9)) AS frame_index").selectExpr("episode_index", "cast(frame_index AS long) AS frame_index", "episode_index * 10 + frame_index AS x")
    rows.where("NOT (episode_index = 120 AND frame_index = 4)").repartitionByRange(10, "episode_index").write.parquet(str(tmp_path / "data"))
    wanted = lambda *ids: spark.createDataFrame([(i, 10) for i in ids], "episode_index long, length long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan's nodes keep their counts
    try:
        found = episodes.read_frames(spark, str(tmp_path), wanted(0, 1, 199), complete=True)
        assert sorted(r.x for r in found.collect()) == [*range(20), *range(1990, 2000)]
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaf for leaf in (leaves.apply(k) for k in range(leaves.length())) if "Scan parquet" in leaf.nodeName()]
        read, = [leaf.metrics().apply("numOutputRows").value() for leaf in scans]
        assert 30 <= read < 500  # two row groups of ten, of some 200 rows each
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert episodes.read_frames(spark, str(tmp_path), wanted(0).limit(0)).count() == 0
    assert episodes.read_frames(spark, str(tmp_path), wanted(120)).count() == 9
    for ids in ((5, 120), (5, 300)):
        with pytest.raises(ValueError, match="aren't whole"):
            episodes.read_frames(spark, str(tmp_path), wanted(*ids), complete=True)
    twice = spark.createDataFrame([(500, k, k) for k in (0, 1, 1, 3)], "episode_index long, frame_index long, x long")
    twice.write.mode("append").parquet(str(tmp_path / "data"))
    with pytest.raises(ValueError, match="500"):
        episodes.read_frames(spark, str(tmp_path), spark.createDataFrame([(500, 4)], "episode_index long, length long"), complete=True)
