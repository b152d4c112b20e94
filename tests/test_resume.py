"""A stream that is ended midway and taken up again, and an epoch that is left off."""

import json
import os

import pytest
from framewright.operators.sampling import epoch_batches, spread
from framewright.streaming import resume
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

SCHEMA = "id long, v long, ts timestamp"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"id": i, "v": v, "ts": f"2024-01-01T00:00:{v % 60:02d}Z"}) for i, v in rows))
    # files come in order of their times
    os.utime(folder / name, (1e9 + int(name[0]), 1e9 + int(name[0])))


def run(spark, tmp_path, make=lambda rows: rows, protocol={"gap": 5}, within=None):  # noqa: B006
    rows = resume.files_in_turn(spark, str(tmp_path / "in"), SCHEMA, 1)
    resume.extract(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint"), protocol, "id", make, within).awaitTermination()
    return resume.extracted(spark, str(tmp_path / "out"), protocol)


@pytest.mark.parametrize("within", [None, ("ts", "1 hour")])
def test_each_row_once_over_a_failure_and_a_restart(spark, tmp_path, within):
    for k in range(4):
        write(tmp_path / "in", f"{k}.json", [(i, k) for i in range(k * 10, k * 10 + 15)])
    seen = []

    def fails_once(rows):
        def made(found):
            return found.withColumn("twice", F.col("v") * 2)

        seen.append(1)
        if len(seen) == 3:
            # part of this batch's rows are written when it ends
            return made(rows).withColumn("v", F.when(F.col("id") % 4 == 0, F.raise_error(F.lit("ended midway")).cast("long")).otherwise(F.col("v")))
        return made(rows)

    with pytest.raises(StreamingQueryException, match="ended midway"):
        run(spark, tmp_path, fails_once, within=within)
    first = {r.id for r in resume.extracted(spark, str(tmp_path / "out")).collect()}
    assert first == set(range(25))
    waiting = resume.unfinished(spark.range(45), resume.extracted(spark, str(tmp_path / "out")), "id")
    assert {r.id for r in waiting.collect()} == set(range(25, 45))
    got = run(spark, tmp_path, fails_once, within=within).collect()
    assert sorted(r.id for r in got) == list(range(45))
    wrong = [r for r in got if not (r.twice == 2 * r.v == 2 * min(3, max(0, (r.id - 5) // 10)) and r.row_id == str(r.id) and r.protocol_id == resume.protocol_digest({"gap": 5}))]
    assert wrong == []
    # nothing new: nothing happens; a new file: its new rows only
    assert run(spark, tmp_path, fails_once, within=within).count() == 45
    write(tmp_path / "in", "9.json", [(44, 7), (100, 7), (100, 8), (None, 9)])
    again = {r.id: r.v for r in run(spark, tmp_path, fails_once, within=within).collect()}
    assert len(again) == 46 and again[44] == 3 and again[100] in (7, 8)


def test_another_protocol_is_refused(spark, tmp_path):
    write(tmp_path / "in", "0.json", [(1, 1)])
    assert run(spark, tmp_path, protocol={"gap": 5, "stride": 2}).count() == 1
    assert run(spark, tmp_path, protocol={"stride": 2, "gap": 5}).count() == 1
    with pytest.raises(resume.OtherProtocol):
        run(spark, tmp_path, protocol={"gap": 6, "stride": 2})
    with pytest.raises(resume.OtherProtocol):
        resume.extracted(spark, str(tmp_path / "out"), {"gap": 6})


@pytest.mark.parametrize("done", [0, 1, 3, 8, 99])
def test_an_epoch_left_off_goes_on_where_it_was(spark, done):
    rows = spark.range(70)
    make = lambda n: epoch_batches(rows.repartition(n), 70, [spread(F.col("id"), seed=5), F.col("id")], 4, 2, 3, False)
    key = lambda r: (r.replica, r.batch, r.step, r.place, r.id)
    whole = {key(r) for r in make(3).collect()}
    left = {key(r) for r in resume.skipped(make(7), 2, done).collect()}
    assert left == {r for r in whole if r[1] * 2 + r[2] >= done}
