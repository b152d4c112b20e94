"""Files read in ranges: numbered lines, JSON arrays, tar members and tails."""

import hashlib
import io
import json
import random
import tarfile

import pytest
from framewright.sources import manifests, scans

ODD = ['a "quoted" word', "brace } and { in text", "back\\slash\\", 'ends with \\"', "[1, 2]", "", "line\nbreak", "é漢 ", "}}}}", '"', "\\\\\\", "},{"]


@pytest.fixture
def small_splits(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    lines = [f"line {k} " + "x" * (k % 90) if k % 7 else "" for k in range(400)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("only\none\n\n")
    found = scans.read_numbered(spark, str(tmp_path))
    assert scans._records(spark, str(tmp_path / "a.txt")).select("split").distinct().count() > 10
    by = {}
    for r in found.collect():
        by.setdefault(r.file[-5:], {})[r.number] = r.value
    assert by == {"a.txt": dict(enumerate(lines, 1)), "b.txt": {1: "only", 2: "one", 3: ""}}


@pytest.mark.parametrize("indent", [None, 2])
def test_array_elements_whatever_they_hold(spark, tmp_path, small_splits, indent):
    r = random.Random(3)
    value = lambda deep: r.choice(ODD) if deep == 0 or r.random() < 0.4 else {r.choice(ODD): value(deep - 1) for _ in range(r.randint(0, 3))} if r.random() < 0.6 else [value(deep - 1) for _ in range(r.randint(0, 3))]
    items = [{"k": k, "v": value(3), r.choice(ODD): {"x": [{}, {"y": "}"}]}} for k in range(300)]
    (tmp_path / "one.json").write_text(" \n" + json.dumps(items, indent=indent, ensure_ascii=False) + "\n\n", encoding="utf-8")
    (tmp_path / "two.json").write_text(json.dumps(items[:3]))
    (tmp_path / "none.json").write_text("[ ]")
    found = scans.json_array_elements(spark, [str(tmp_path / f"{n}.json") for n in ("one", "two", "none")])
    by = {}
    for row in found.collect():
        by.setdefault(row.file[-8:], {})[row.number] = json.loads(row.value)
    assert by == {"one.json": dict(enumerate(items, 1)), "two.json": dict(enumerate(items[:3], 1))}


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}', '[{"a": 1}]]', '[{"a": 1}, {"a": {"b": 2}]', '[{"a": "1}, {"a": 2}]', '{"a": 1}'])
def test_arrays_that_are_cut_off_or_closed_twice(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="isn't one whole JSON array"):
        scans.json_array_elements(spark, str(tmp_path / "a.json")).collect()


def test_malformed_lines_and_elements_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": "x", "o": 1, "s": 2}\n\n{"n": "y", "o": 1, "s"\n')
    with pytest.raises(Exception, match=r"a\.jsonl:3: malformed manifest line"):
        manifests.read_tar_index(spark, str(tmp_path / "a.jsonl")).collect()
    (tmp_path / "a.json").write_text('[{"n": "x"}, {"n": oops}, {"n": "z"}]')
    with pytest.raises(Exception, match=r"a\.json:2: malformed element"):
        scans.read_json_array(spark, str(tmp_path / "a.json"), "n string").collect()


def test_tar_members_by_an_index_with_bad_lines(spark, tmp_path):
    texts = {f"{k:02x}ab.txt": (f"text {k} " * (k + 1)).encode() for k in range(40)}
    for shard in ("s0", "s1"):
        (tmp_path / shard).mkdir()
        with tarfile.open(tmp_path / f"{shard}.tar", "w") as tar:
            for name, data in texts.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        with tarfile.open(tmp_path / f"{shard}.tar") as tar:
            lines = [json.dumps({"n": f"{shard}/{m.name}", "o": m.offset_data, "s": m.size}) for m in tar.getmembers()]
        lines += [json.dumps({"n": f"{shard}/00ab.txt", "o": 0, "s": 1})]  # a bad line at the end, with a smaller offset
        (tmp_path / f"{shard}.jsonl").write_text("\n".join(lines))
    index = manifests.read_tar_index(spark, [str(tmp_path / f"{s}.jsonl") for s in ("s0", "s1")], str(tmp_path))
    found = {r.n: bytes(r.content) for r in scans.read_members(index).collect()}
    assert found == {f"{s}/{n}": data for s in ("s0", "s1") for n, data in texts.items()}
    some = spark.createDataFrame([("s1/05ab.txt",), ("s1/05ab.txt",)], "n string")
    assert [(r.n, bytes(r.content)) for r in scans.read_members(index, some).collect()] == [("s1/05ab.txt", texts["05ab.txt"])]
    with pytest.raises(Exception, match="gone isn't in the index"):
        scans.read_members(index, spark.createDataFrame([("gone",)], "n string")).collect()
    for o, s in ((-1, 5), (0, 0), (10, 1 << 30)):
        bad = spark.createDataFrame([(str(tmp_path / "s0.tar"), o, s)], "path string, offset long, size long")
        with pytest.raises(Exception, match="no bytes"):
            scans.read_ranges(bad).collect()


def test_tails_read_few_bytes(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    for k in range(5):
        (tmp_path / f"f{k}.bin").write_bytes(r.randbytes(200_000 * k + 100))
    (tmp_path / "empty.bin").write_bytes(b"")
    found = {row.path.rpartition("/")[2]: row for row in scans.read_tails(spark, str(tmp_path), 1000).collect()}
    assert set(found) == {f"f{k}.bin" for k in range(5)}
    for k in range(5):
        data = (tmp_path / f"f{k}.bin").read_bytes()
        assert bytes(found[f"f{k}.bin"].content) == data[-1000:] and found[f"f{k}.bin"].length == len(data)
    assert sum(len(row.content) for row in found.values()) < 0.01 * sum(row.length for row in found.values())
    assert hashlib.sha256(found["f4.bin"].content).hexdigest() == hashlib.sha256((tmp_path / "f4.bin").read_bytes()[-1000:]).hexdigest()
