"""Toxicity's features, lexicon and calibration against their definitions in plain Python."""

import math
import random
import re

import numpy as np
from framewright.llm import toxicity
from framewright.llm.toxicity import DISGUISE, FEATURES, SECOND_PERSON, features, learn_lexicon
from framewright.llm.trees import fit_isotonic

LEXICON = {"bad$": 2.5, "awfu": 3.0, "terri": 4.0, "nasty$": 2.2}


def plain_word(word):
    bare = word.strip(".,;:!?|\"'()").lower()
    forms, disguised = [bare], False
    if not bare.isalpha():
        bare = re.sub(r"^\W+|\W+$", "", bare)
        mixed = r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|[^\W\d_]\$|@[^\W\d_]"
        disguised = bool(re.search(mixed, bare) or re.search(mixed, word))
        forms = [bare] + ([re.sub(r"[^\w]", "", word.lower().translate(DISGUISE))] if disguised else [])
    weight = max([0.0] + [LEXICON.get(k, 0.0) for f in forms for k in (f + "$", *(f[:n] for n in (4, 5, 6, 7)))])
    return weight, bare in SECOND_PERSON, disguised, bool(re.search(r"(\w)\1\1", bare))


def plain(text):
    words = text.split()
    facts, n = [plain_word(w) for w in words], max(len(words), 1)
    hits = [k for k, f in enumerate(facts) if f[0] > 0]
    weight = sum(f[0] for f in facts)
    return {
        "hits": len(hits), "hits_a_word": len(hits) / n, "weight": weight, "weight_a_word": weight / n, "distinct_hits": len({words[k] for k in hits}), "best": max([0.0] + [f[0] for f in facts]),
        "near_second": sum(any(facts[j][1] for j in range(max(k - 3, 0), min(k + 4, len(words)))) for k in hits), "second_a_word": sum(f[1] for f in facts) / n, "disguised_a_word": sum(f[2] for f in facts) / n,
        "disguised_hits": sum(facts[k][2] for k in hits), "capitals_a_letter": len(re.findall("[A-Z]", text)) / max(len(text), 1), "shouts_a_word": text.count("!") / n, "asks_a_word": text.count("?") / n,
        "stretched_a_word": sum(f[3] for f in facts) / n, "log_words": math.log1p(len(words)),
    }


def test_features():
    r = random.Random(1)
    pieces = ["bad", "Bad!", "b4d", "b@d", "awfully", "AWFUL", "terrible,", "t3rribl3", "nasty", "you", "Your", "du", "soooo", "fine", "O'Brien", "a-b", "it.is", "$$", "nastyish", "été", "漢字", "(bad)", "x1y"]
    texts = ["", " \n", *(" ".join(r.choice(pieces) for _ in range(r.randint(1, 60))) for _ in range(200))]
    for text, found in zip(texts, features(texts, LEXICON), strict=True):
        want = plain(text)
        assert np.allclose(found, [want[f] for f in FEATURES]), text


def test_lexicon(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        toxic = i % 3 == 0
        words = [r.choice(["quiet", "river", "stone", "Lamp"]) for _ in range(8)] + (["grumbleish"] if toxic and i % 2 == 0 else []) + (["grumbling"] if toxic and i % 2 else [])
        rows.append((" ".join(words + words[:2]), float(toxic)))
    found = learn_lexicon(spark.createDataFrame(rows, "text string, label double"))
    t, c = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    want = {}
    entries = [{e for w in re.findall(r"[^\W\d_]{3,}", text.lower()) for e in (w + "$", *(w[:n] for n in toxicity.BEGINNINGS if len(w) >= n))} for text, _ in rows]
    for e in set().union(*entries):
        a, b = (sum(e in own for own, (_, y) in zip(entries, rows) if y == k) for k in (1, 0))
        odds = math.log((a + 0.5) / (t + 1)) - math.log((b + 0.5) / (c + 1))
        if a >= toxicity.SUPPORT and odds > 2:
            want[e] = odds
    assert set(found) == set(want) and "grumbl" in found and "quiet$" not in found
    assert all(abs(found[e] - want[e]) < 1e-9 for e in want)


def test_isotonic_is_the_best_rising_fit():
    r = np.random.default_rng(3)
    for _ in range(20):
        n = int(r.integers(1, 40))
        score, y = np.sort(r.normal(size=n)), r.integers(0, 2, n)
        # the best rising fit: at each place the greatest of the least means of stretches that end at or after it
        want = [max(min(y[a : b + 1].mean() for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
        at, p = fit_isotonic(score, y)
        assert np.all(np.diff(p) > 0) if len(p) > 1 else True
        assert sorted(set(np.round(want, 9))) == sorted(set(np.round(p, 9)))
