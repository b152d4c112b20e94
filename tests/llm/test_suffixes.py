"""Repeated bytes against a plain search of every window."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from framewright.llm import suffixes
from framewright.llm.suffixes import merge_runs, repeated_bytes, without_repeats
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(rows):
    first = {}
    keyed = [(2**63 if i is None else i, i, (t or "").encode()) for i, t in rows]
    for key, _, b in keyed:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(key, first.get(b[k : k + 50], key))
    out = []
    for key, i, b in keyed:
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key:
                gone[k : k + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    passages = [" ".join(word() for _ in range(r.randint(15, 60))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 3))]
        for _ in range(r.choice([0, 0, 1, 2])):
            p = r.choice(passages)
            a = r.randint(0, 20)
            parts.insert(r.randint(0, len(parts)), p[a : len(p) - r.randint(0, 20)])
        rows.append((r.randint(0, 10**9) if i % 9 else i, "".join(parts)))
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1]), (8, None), (9, ""), (10, "a" * 300), (11, "a" * 90), (12, "ab" * 80), (13, "\0" * 60), (14, "x" + "\0" * 60), (15, passages[0] * 3)]
    return rows


@pytest.mark.parametrize("seed,run_bytes,hot_slices,parts", [(1, 12 << 20, 4, 256), (2, 1500, 4, 256), (3, 400, 4, 256), (4, 400, 2, 3)])
def test_repeats_against_brute_force(table, monkeypatch, seed, run_bytes, hot_slices, parts):
    monkeypatch.setattr(suffixes, "HOT_SLICES", hot_slices)
    monkeypatch.setattr(suffixes, "PARTS", parts)
    monkeypatch.setattr(suffixes, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rows = corpus(seed)
    if hot_slices == 2:  # an anchor string in every document, with continuations that differ and some that don't
        r = random.Random(9)
        rows = [(i, (t or "") + f"a common head of all {r.randint(0, 8)} and then the same end of many for the rest {r.random() if r.random() < 0.5 else 1}") for i, t in rows]
        divided, windows = [], suffixes._windows
        monkeypatch.setattr(suffixes, "_windows", lambda d, c: (divided.append(len(c)), windows(d, c))[1])
        texts = [(t or "").encode() for _, t in rows]
        run = suffixes._Run(pa.table({"__id": [i for i, _ in rows], "__text": [t for _, t in rows]}))
        hot = np.array([b"nd of many for t", b"e same end of ma", *(run.data[a : a + 16].tobytes() for a in run.at[::7])], "S16")
        out, note = suffixes._send(run, np.ones(len(run.at), bool), np.array([], "S16"), hot, 5)
        assert divided[0] and {k for k, _ in out} > {5, 6} and texts
    docs = table([(i, t, "a") for i, t in rows])
    want = brute(rows)
    assert sum(w[2] for w in want) > 1000
    assert sorted(map(str, (tuple(r) for r in repeated_bytes(docs).collect()))) == sorted(str(w[:5]) for w in want)


def test_documents_without_repeats(table):
    rows = corpus(5)
    docs = table([(i, t, "a") for i, t in rows])
    out = without_repeats(docs)
    assert out.columns == docs.columns
    want = sorted(str((i, None if t is None else w[5].decode("utf-8", "ignore"))) for (i, t), w in zip(rows, brute(rows), strict=True))
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == want


def test_empty(table):
    assert repeated_bytes(table([])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=4).map(lambda b: bytes(x % 3 for x in b)), max_size=12).map(lambda r: sorted(set(r))), min_size=1, max_size=6))
def test_loser_tree(runs):
    def common(a, b):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k

    known = [[common(r[i], r[i - 1]) if i else 0 for i in range(len(r))] for r in runs]
    order, prefixes = merge_runs(runs, known)
    heads = [iter(r) for r in runs]
    merged = [next(heads[k]) for k in order]
    assert merged == sorted(x for r in runs for x in r)
    assert prefixes == [common(merged[i], merged[i - 1]) if i else 0 for i in range(len(merged))]


def test_characters_that_a_repeat_cuts_apart_go_whole(table):
    passage = " plus a passage of more than fifty bytes that both documents share, word for word"
    docs = table([(1, "begin é" + passage, "a"), (2, "other ũ" + passage + " end�", "a")])
    assert [r.text for r in without_repeats(docs).orderBy("doc_id").collect()] == ["begin é" + passage, "other  end�"]
