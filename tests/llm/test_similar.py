"""The pipeline's near-duplicate stage on copies edited to similarities around 0.8, against all pairs."""

import random
from fractions import Fraction

import corpus_pipeline
import pytest
from framewright.llm import meeting
from framewright.llm.similar import MISSED, WORD, band_places, differing, gathered, prints, similar_links, without_similar


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def edited(n, seed):
    """(base, copy) texts; copies have 0.6 to 0.98 of the base's shingles in common."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{i}x{r.randrange(10**6)}" for _ in range(r.randint(60, 300))]
        copy = list(words)
        for at in r.sample(range(len(copy)), max(1, int(len(copy) * r.choice([0.003, 0.01, 0.018, 0.03, 0.05])))):
            copy[at] = f"new{r.randrange(10**6)}"
        out.append((" ".join(words), " ".join(copy)))
    return out


@pytest.mark.parametrize("homes", [2048, 3])
def test_stage_drops_copies_edited_to_080(spark, table, monkeypatch, homes):
    monkeypatch.setattr(meeting, "HOMES", homes)
    pairs = edited(200 if homes > 3 else 40, 7)
    rows = [(2 * k + j, t, "a") for k, pair in enumerate(pairs) for j, t in enumerate(pair)]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table(rows), "").collect()}
    near = {2 * k + 1 for k, (a, b) in enumerate(pairs) if jaccard(a, b) >= 0.8}
    assert sum(0.8 <= jaccard(a, b) < 0.95 for a, b in pairs) > len(pairs) // 5
    dropped = {r[0] for r in rows} - kept
    assert dropped <= near and len(dropped) >= 0.97 * len(near)


def test_links_are_similar_and_rows_odd(spark, table, odd_rows):
    rows = odd_rows + [(100 + i, odd_rows[3][1].replace(f"word{i} ", "changed "), "a") for i in range(20)] + [(1000, None, None), (1001, "Same TEXT\nhere", "a")]
    found = [r.doc_id for r in without_similar(table(rows)).collect()]
    kept = set(found)
    assert len(found) == len(kept)
    assert kept == {0, 3, 4, 6, 7, None} | set(range(8, 60))
    assert without_similar(table([])).collect() == []
    assert without_similar(table(rows)).columns == table(rows).columns
    texts = [" ".join(f"t{k}" for k in range(s, s + 40)) for s in range(0, 60, 3)]  # a chain: 33 of 39 shingles, then 30 of 42
    _, sets, found = similar_links(table([(i, t, "a") for i, t in enumerate(texts)]))
    ids = {r.set: r.first for r in sets.collect()}
    assert {tuple(sorted((ids[r.a], ids[r.b]))) for r in found.collect()} == {(i, i + 1) for i in range(19)}


def test_rows_are_chosen_by_row(table):
    rows = [(5, "one two three four five six", "a"), (5, "entirely other words stand in this row", "a"), (5, "one two three four five six", "b"), (3, "entirely other words stand in this row", "a"), (None, "no id", "a"), (None, "no id", "a"), (None, "another one", "a")]
    kept = sorted(str((r.doc_id, r.text)) for r in without_similar(table(rows)).collect())
    assert kept == sorted(map(str, [(5, rows[0][1]), (3, rows[3][1]), (None, "no id"), (None, "another one")]))


def test_a_crowd_of_near_copies_costs_few_checks(spark, table, monkeypatch):
    base = [f"word{k}" for k in range(120)]
    rows = [(i, " ".join([*base[: 3 + i % 100], f"own{i}", *base[4 + i % 100 :]]), "a") for i in range(300)]
    counted, check = [], meeting.checked
    monkeypatch.setattr(meeting, "checked", lambda pairs, held, least: (counted.append(pairs.count()), check(pairs, held, least))[1])
    assert [r.doc_id for r in without_similar(table(rows)).collect()] == [0]
    assert sum(counted) < 2 * len(rows)


@pytest.mark.parametrize("homes,seed", [(2048, 1), (2048, 2), (5, 3)])
def test_a_crowd_near_the_threshold_loses_no_merges(table, monkeypatch, homes, seed):
    """Copies of one text with more and less of it changed: some link to others only, some to none. Merges due are all sets less components."""
    monkeypatch.setattr(meeting, "HOMES", homes)
    r = random.Random(seed)
    base = [f"word{k}" for k in range(150)]
    texts = []
    for i in range(260):
        words = list(base)
        for at in r.sample(range(150), r.randint(0, 9)):
            words[at] = f"new{i}x{at}"
        texts.append(" ".join(words))
    parents = list(range(len(texts)))

    def find(v):
        while parents[v] != v:
            v = parents[v]
        return v

    sets = [shingle_set(t) for t in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parents[y] = x
    due = sum(find(i) != i for i in range(len(texts)))
    kept = {r.doc_id for r in without_similar(table([(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert 40 < due < len(texts) - 20
    assert kept >= {i for i in range(len(texts)) if find(i) == i}
    assert len(texts) - len(kept) >= 0.97 * due


def test_bands_for_any_number_of_sets():
    assert band_places(10**6, 0.8).tolist() == [list(range(16 * k, 16 * k + 16)) for k in range(64)]
    for n in (10**7, 10**9, 10**11):
        where = band_places(n, 0.8)
        bands, bits = where.shape
        assert n / 2**bits <= 64 and where.max() < 1024 and all(len(set(row)) == bits for row in where.tolist())
        assert (1 - (1 - differing(0.8)) ** bits) ** bands <= 0.0085


def test_parts_meet_at_anchors_of_a_covering_code():
    """Each word's own anchor is visited from all words one bit away; parts that may differ in a bit of theirs are as many as MISSED needs."""
    code = meeting.anchors_of_words(WORD)
    assert len({c[0] for c in code}) == 1 << WORD - 3 and all(len(c) == len(set(c)) for c in code)
    assert all(code[w][0] in code[w ^ 1 << bit] for w in range(1 << WORD) for bit in range(WORD))
    for n in (10**6, 10**9, 10**11):
        parts, bits = band_places(n, 0.8, WORD).shape
        same = 1 - differing(0.8)
        meets = same ** (bits - WORD) * (same**WORD + WORD * (1 - same) * same ** (WORD - 1))
        assert (1 - meets) ** parts <= MISSED and n / 2 ** (bits - 3) <= 64


@pytest.mark.parametrize("homes", [2048, 1])
def test_sets_meet_where_a_bit_of_every_word_differs(spark, table, monkeypatch, homes):
    """No band is alike in any two sets of a pair: they are linked by the anchors that they come to. A bit beside the word is too far."""
    monkeypatch.setattr(meeting, "HOMES", homes)
    pairs = edited(30, 5)
    near = [k for k, (a, b) in enumerate(pairs) if jaccard(a, b) >= 0.8]
    docs = table([(2 * k + j, t, "a") for k, pair in enumerate(pairs) for j, t in enumerate(pair)])
    off = {0: 0, 1: 1 << 2, 2: 1 << WORD}
    rows = [(r.set, r.n, r.doc_id, r.doc_id % 2, r.doc_id // 2) for r in prints(docs, 5).collect()]
    for how in (1, 2):
        sets = [(s, n, i, [(pair * 991 + band) * 256 ^ off[how * j] for band in range(4)], [0, 0]) for s, n, i, j, pair in rows]
        found = meeting.links(spark.createDataFrame(sets, meeting.SETS), lambda some: gathered(some, docs, 5), Fraction(4, 5), differing(0.8), WORD).collect()
        ids = {s: i for s, _, i, *_ in rows}
        linked = {tuple(sorted((ids[r.set], ids[r.pivot]))) for r in found}
        assert linked == ({(2 * k, 2 * k + 1) for k in near} if how == 1 else set())


def test_a_pair_meets_at_one_anchor_of_a_part(spark):
    """Sets whose words differ in one bit: at one anchor one of them is at home and the other there, at two before."""
    sets = spark.createDataFrame([(w, 5, w, [w], [0, 0]) for w in range(1 << WORD)], meeting.SETS)
    at = {}
    for r in meeting.sent(sets, WORD).collect():
        at.setdefault(r.set, {})[r.anchor] = not r.visit
    for w in at:
        for near in (at[w ^ 1 << bit] for bit in range(WORD)):
            assert sum(at[w][a] or near[a] for a in at[w].keys() & near.keys()) == 1
    assert len(at) == 1 << WORD and sum(map(len, at.values())) * len(band_places(10**5, 0.8, WORD)) <= 107 * len(at)


def crowd(n, seed, most=9):
    """Copies of one text with more and less of it changed: some are similar to many, some to none."""
    r = random.Random(seed)
    for i in range(n):
        words = [f"word{k}" for k in range(150)]
        for at in r.sample(range(150), r.randint(0, most)):
            words[at] = f"new{i}x{at}"
        yield " ".join(words)


def rows_of(monkeypatch):
    """Rows of each table that the settling of links writes."""
    made, write = {}, meeting.written

    def counted(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(meeting, "written", counted)
    return made


@pytest.mark.parametrize("n", [100, 200])
def test_a_crowd_with_open_pairs_is_brought_to_one_place(table, monkeypatch, n):
    """A row a set, at any size of the crowd; a row for each of its bands before, some 30."""
    made = rows_of(monkeypatch)
    kept = without_similar(table([(i, t, "a") for i, t in enumerate(crowd(n, 4))])).count()
    assert 1 < kept < n and 0 < made["meeting-needed"] <= n and made["meeting-members"] <= n


def test_crowds_in_parts_and_by_bands_settle_alike(table, monkeypatch):
    texts = [*crowd(150, 5), *(" ".join(f"t{k}" for k in range(s, s + 40)) for s in range(0, 60, 3))]
    docs, found = table([(i, t, "a") for i, t in enumerate(texts)]), []
    made = rows_of(monkeypatch)
    for block, parts in ((20, 32), (20, 2)):
        made.clear()
        monkeypatch.setattr(meeting, "BLOCK", block)
        monkeypatch.setattr(meeting, "PARTS", parts)
        found.append(({r.doc_id for r in without_similar(docs).collect()}, "meeting-vast" in made))
    assert found[0][0] == found[1][0] and [vast for _, vast in found] == [False, True]


def test_chains_of_pairs_are_whole(spark, monkeypatch):
    """Pairs of a task are joined; of more than it may hold, some forests come out, which join the same."""
    pairs = [(i, i - 2) for i in range(2, 400)] + [(1001, 1000)] * 3
    for chained in (1 << 20, 50):
        monkeypatch.setattr(meeting, "CHAINED", chained)
        near = spark.createDataFrame(pairs, "set long, pivot long").repartition(3)
        of = {r.set: r.crowd for r in meeting.crowds(near).collect()}
        assert of == {i: i % 2 for i in range(400)} | {1000: 1000, 1001: 1000}
