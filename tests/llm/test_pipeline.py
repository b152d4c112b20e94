"""Quality rules, toxicity, and the pipeline's stages."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from framewright.llm.quality import BASE, FEATURES, fit_quality, judge, kept_documents
from framewright.llm.toxicity import fit_toxicity, score_documents
from framewright.llm.trees import fit_forest, fit_isotonic


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)]


def made(n=400, seed=4):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(12, 120))]
        junk, toxic = i % 5 == 0, i % 7 == 0
        if junk:
            words = [w.upper() + "!!" if r.random() < 0.8 else w + "###" for w in words]
        if toxic:
            for _ in range(4):
                words.insert(r.randint(0, len(words)), r.choice(["vilebrute", "vilebrutes", "idiot", "you"]))
        docs.append((i, " ".join(words), f"s{i % 3}"))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_base_counts_and_rejections(spark, table, odd_rows):
    docs, labels = made()
    docs = docs + [(1000 + k, t, s) for k, (_, t, s) in enumerate(odd_rows)] + [(2000, "a b c d e f " * 4, "a"), (2001, "x y\n\nx y\n \n x y\nx y z\n" * 3, "a"), (2002, "one two three four five six seven eight nine ten", "a")]
    forest = fit_quality(table(docs), labelled(spark, labels))
    rows = {r.doc_id: r for r in judge(table(docs), forest).collect()}
    for i, t, _ in docs:
        want = base_counts(t)
        assert [rows[i][c] for c in BASE] == want
        assert rows[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (rows[i].base_failed and rows[i].kept)
    assert all(rows[i].kept == bool(q) for i, q, _ in labels)
    kept = kept_documents(table(docs), forest)
    assert kept.columns == table(docs).columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    assert judge(table([]), forest).collect() == [] and kept_documents(table([]), forest).collect() == []


def test_without_labels_nothing_clean_goes(spark, table):
    docs, _ = made(60)
    forest = fit_quality(table(docs), labelled(spark, []))
    assert all(r.kept != r.base_failed for r in judge(table(docs), forest).collect())


def test_monotonic_forest():
    r = np.random.default_rng(3)
    x = r.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * r.standard_normal(3000)) > 0.6).astype(float)
    for direction in (1, -1):
        forest = fit_forest(x, y, [direction, 0, 0])
        grid = np.repeat(r.random((40, 3)), 60, 0)
        grid[:, 0] = np.tile(np.linspace(0, 1, 60), 40)
        steps = np.diff(forest.raw(grid).reshape(40, 60), axis=1) * direction
        assert (steps >= -1e-9).all()
    forest = fit_forest(x, y, [1, 0, 0])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85
    one = forest.raw(x[:50])
    assert np.allclose(one, [forest.raw(x[i : i + 1])[0] for i in range(50)])
    assert len(FEATURES) == 11


def test_isotonic():
    at, p = fit_isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0, 0, 1, 1]))
    assert p.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [1.0, 2.5, 4.0]


def test_toxicity_held_out(spark, table, odd_rows):
    import zlib

    docs, labels = made(900)
    labels = [(i, q, t) for i, q, t in labels]
    docs = docs + [(5000 + k, t, s) for k, (_, t, s) in enumerate(odd_rows)]
    model = fit_toxicity(table(docs), labelled(spark, labels))
    rows = {r.doc_id: r for r in score_documents(table(docs), model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [(t, rows[i].predicted) for i, _, t in labels if rows[i].held_out]
    assert sum(t == p for t, p in held) > 0.97 * len(held)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    again = {r.doc_id: r.score for r in score_documents(table(docs), fit_toxicity(table(docs), labelled(spark, flipped))).collect()}
    assert again == {i: r.score for i, r in rows.items()}
    assert score_documents(table([]), model).collect() == []


@pytest.mark.parametrize("small", [False, True])
def test_pipeline(spark, table, tmp_path, small):
    docs, labels = ([], []) if small else made(200)
    if not small:
        docs += [(5000, docs[3][1], "s0"), (5001, " ".join(f"own{k}" for k in range(90)) + " " + docs[6][1], "s1")]
    table(docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, labels).write.parquet(f"{tmp_path}/labels.parquet")
    now, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == 4 or out.columns == names
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(now.collect())
    if small:
        assert all(s == [] for s in seen)
        return
    quality = {i for i, q, _ in labels if not q}
    assert not quality & {r.doc_id for r in seen[0]} and 5000 in {r.doc_id for r in seen[0]}
    assert 5000 not in {r.doc_id for r in seen[1]} and 3 in {r.doc_id for r in seen[1]}
    cut = next(r.text for r in seen[2] if r.doc_id == 5001)
    assert cut.startswith("own0 own1") and docs[6][1][-20:] not in cut
    assert {r.doc_id for r in seen[4]} == {r.doc_id for r in seen[3]}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in final) == sum(r.length for r in seen[4])
