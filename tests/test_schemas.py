"""Schema trees of three depths: rows, first differences, folds and merges in any order."""

import pytest
from framewright.operators import schemas
from pyspark.sql import functions as F

LEAF = "struct<type:string,is_relative:boolean,allow_relative:boolean,representation:string,data:array<array<double>>>"
TREE = f"struct<type:string,body:struct<type:string,left:struct<type:string,hand:{LEAF},wrist:{LEAF}>,right:struct<type:string,hand:{LEAF},wrist:{LEAF}>>,head:{LEAF}>"


def leaf(data, kind="Position", relative=False, name=None):
    return (kind, relative, True, name, data)


def tree(x, wrist=True, right=True, head_dim=2, name="euler_xyz", arm="Arm"):
    left = (arm, leaf([[x], [x + 1]]), leaf([[x, x * 2, 0.0]], "Rotation", name=name) if wrist else None)
    return ("Robot", ("Body", left, ("Arm", leaf([[-x]]), None) if right else None), leaf([[x] * head_dim]))


def nodes(spark, rows):
    return schemas.schema_rows(spark.createDataFrame(rows, f"robot string, episode string, position long, tree {TREE}"), ["robot", "episode", "position"], "tree")


def test_rows_of_a_tree(spark):
    found = [(r.path, r.parent, r.leaf, r.type, r.dim) for r in nodes(spark, [("a", "e", 1, tree(1.0))]).orderBy("place").collect()]
    assert found == [
        ("", None, False, "Robot", None), ("body", "", False, "Body", None), ("body.left", "body", False, "Arm", None), ("body.left.hand", "body.left", True, "Position", 1),
        ("body.left.wrist", "body.left", True, "Rotation", 3), ("body.right", "body", False, "Arm", None), ("body.right.hand", "body.right", True, "Position", 1), ("head", "", True, "Position", 2),
    ]
    assert nodes(spark, [("a", "e", 1, None)]).collect() == []


def test_first_differences_are_named(spark):
    rows = [("a", "first", 3, tree(1.0)), ("a", "same", 4, tree(2.0)), ("a", "no wrist", 5, tree(1.0, wrist=False)), ("a", "no right, other head", 6, tree(1.0, right=False, head_dim=3)), ("a", "head", 7, tree(1.0, head_dim=3)),
            ("a", "name", 8, tree(1.0, name="rotvec")), ("a", "kind", 9, tree(1.0, arm="Leg", wrist=False)), ("b", "other robot", 1, tree(1.0, right=False)), (None, "x", 2, tree(1.0))]
    found = {r.episode: (r.path, r.what, r.existing, r.new) for r in schemas.schema_differences(nodes(spark, rows), "robot", "episode", "position").collect()}
    assert found == {
        "no wrist": ("body.left", "fields", "hand,wrist", "hand"), "no right, other head": ("body", "fields", "left,right", "left"), "head": ("head", "dim", "2", "3"),
        "name": ("body.left.wrist", "representation", "euler_xyz", "rotvec"), "kind": ("body.left", "fields", "hand,wrist", "hand"),
    }


def test_folds_merge_in_any_order(spark):
    rows = [(r, f"e{k}", k, tree(float(k % 7))) for k in range(60) for r in ("a", "b") if r == "a" or k > 20]
    all_nodes = nodes(spark, rows)
    whole = {(r.robot, r.path, r.i): r for r in schemas.fold_schemas(all_nodes, "robot", "position").collect()}
    assert whole["a", "body.left.hand", 0].n == 120 and whole["a", "body.left.hand", 0].first == 0 and whole["b", "head", 1].first == 21
    folds = [schemas.fold_schemas(all_nodes.where(F.col("position") % 3 == k), "robot", "position") for k in range(3)]
    for order in (folds, folds[::-1]):
        merged = {(r.robot, r.path, r.i): r for r in schemas.merge_folds(order, "robot").collect()}
        assert set(merged) == set(whole)
        for k, r in merged.items():
            w = whole[k]
            assert (r.n, r.min, r.max, r.type, r.dim, r.place) == (w.n, w.min, w.max, w.type, w.dim, w.place) and r.mean == pytest.approx(w.mean)
            assert r.std == pytest.approx(w.std, rel=0.03, abs=1e-9)  # pooled about the common mean, over n and not n - 1
    other = schemas.fold_schemas(nodes(spark, [("a", "x", 1, tree(1.0, name="rotvec"))]), "robot", "position")
    with pytest.raises(Exception, match="leaves that differ: a body.left.wrist"):
        schemas.merge_folds([folds[0], other], "robot").collect()


def test_trees_are_made_once_or_twice_however_many_values(spark, monkeypatch):
    """How often a tree is computed doesn't grow with the ranges that quantiles are looked for in; values that repeat count as often as they stand."""
    from framewright.operators import statistics

    monkeypatch.setattr(statistics, "FEW", 8)
    monkeypatch.setattr(statistics, "CELLS", 4)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [("a", f"e{k}", k, tree(float(k * k % 97))) for k in range(200)]
    source = spark.createDataFrame(rows, f"robot string, episode string, position long, tree {TREE}")
    found = schemas.schema_rows(source.mapInArrow(counted, source.schema), ["robot", "episode", "position"], "tree")
    got = {(r.path, r.i): r for r in schemas.fold_schemas(found, "robot", "position").collect()}["head", 1]
    x = sorted(float(k * k % 97) for k in range(200))
    assert (got.n, got.min, got.max, got.q01, got.q99) == (200, x[0], x[-1], pytest.approx(x[1] + 0.99 * (x[2] - x[1])), pytest.approx(x[197] + 0.01 * (x[198] - x[197])))
    assert got.mean == pytest.approx(sum(x) / 200) and made.value <= 2 * len(rows)
    before = made.value
    assert schemas.schema_differences(found, "robot", "episode", "position").collect() == [] and made.value == before + len(rows)
