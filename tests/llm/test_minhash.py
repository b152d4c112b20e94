"""Order MinHash against a plain version, and licence scans against their rules."""

import hashlib
import re
from collections import Counter

import xxhash
from framewright.llm.licences import RULES, SENTENCES, scan_licences
from framewright.llm.minhash import BINS, PLACE, RANK_BITS, fingerprint_with_edits, likeness, order_minhash
from pyspark.sql import functions as F

MASK = 2**64 - 1


def spark_hash(*longs):
    """XXH64 of longs in a row, each seeded by the last, as xxhash64() has it."""
    seed = 42
    for v in longs:
        seed = xxhash.xxh64_intdigest((v & MASK).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >> 63 else seed


def plain(text):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if len(words) >= 3:
        kmers = [spark_hash(*words[i : i + 3]) for i in range(len(words) - 2)]
    else:
        kmers = [spark_hash(*words)] if words else []
    seen, bins = Counter(), {}
    for at, k in enumerate(kmers):
        k >>= PLACE
        g = (spark_mixed(k, seen[k]) & MASK) >> 64 - 6 - RANK_BITS
        seen[k] += 1
        bins.setdefault(g >> RANK_BITS, []).append((g, at))
    out = ""
    for b in range(BINS):
        least = sorted(sorted(bins.get(b, []))[:2], key=lambda x: x[1])
        out += f"{spark_hash(*(g for g, _ in least)) & MASK:016x}"[:4] if least else "...."
    return out


def spark_mixed(long, integer):
    first = xxhash.xxh64_intdigest((long & MASK).to_bytes(8, "little"), 42)
    out = xxhash.xxh64_intdigest(integer.to_bytes(4, "little"), first)
    return out - 2**64 if out >> 63 else out


def test_order_minhash(spark):
    texts = ["", " \n", "one", "one two", "a b c", "a b c a b c a b c a b c", "x " * 700, " ".join(f"w{i * i % 97}" for i in range(900))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", order_minhash(F.col("t"))).collect()
    assert {r[0]: r[1] for r in rows} == {t: plain(t) for t in texts}


def test_likeness_follows_order(spark):
    base = [f"w{i}" for i in range(600)]
    changed = base[:400] + [f"v{i}" for i in range(200)]
    turned = [w for i in range(0, 600, 3) for w in reversed(base[i : i + 3])]
    texts = [" ".join(x) for x in (base, changed, turned, base)]
    row = spark.createDataFrame([tuple(texts)], "a string, b string, c string, d string").select(*[likeness(order_minhash(F.col("a")), order_minhash(F.col(c))) for c in "bcd"]).first()
    assert 0.1 < row[0] < 0.8 and row[1] < 0.1 and row[2] == 1.0


def test_edits(table, odd_rows):
    rows = [r for r in odd_rows if r[0] != 6]
    keyed = sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0], reverse=True)
    want = []
    for k, (i, t, _) in enumerate(keyed):
        t, following = t or "", keyed[(k + 1) % len(keyed)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain(t), plain(edited), plain(following)))
    got = fingerprint_with_edits(table(rows)).collect()
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got))) == sorted(str(w[:5]) for w in want)

    def like(a, b):
        bins = [(a[k : k + 4], b[k : k + 4]) for k in range(0, 4 * BINS, 4)]
        filled = [p for p in bins if p != ("....", "....")]
        return sum(x == y for x, y in filled) / len(filled) if filled else 1.0

    assert {r.doc_id: (r.near_edited, r.near_next) for r in got} == {w[0]: (like(w[3], w[4]), like(w[3], w[5])) for w in want}
    repeated = fingerprint_with_edits(table(odd_rows)).collect()
    assert Counter(r.doc_id for r in repeated) == Counter(i for i, _, _ in odd_rows)
    assert fingerprint_with_edits(table([])).collect() == []
    assert [r.near_next for r in fingerprint_with_edits(table([(1, "only one here", "a")])).collect()] == [1.0]


def test_texts_without_white_space_are_one_word(spark):
    row = spark.createDataFrame([("漢字" * 40, "漢字" * 40 + "x")], "a string, b string").select(likeness(order_minhash(F.col("a")), order_minhash(F.col("b"))), likeness(order_minhash(F.col("a")), order_minhash(F.col("a")))).first()
    assert tuple(row) == (0.0, 1.0)


def test_licences(table):
    say = lambda k: SENTENCES[k].replace("*", "some one")
    full = {rule: ". ".join(map(say, rule.split())).upper() + "." for rule, _ in RULES}
    rows = [(k, f"Some words.\n{full[rule]}\nmore", "a") for k, (rule, _) in enumerate(RULES)]
    rows += [(1000, None, "a"), (1001, "", "a"), (1002, "no licence at all. Really", "a"), (1003, say("mit-grant") + ". x. y. z. w. " + say("mit-notice"), "a"), (1004, full["mit-released"] + "\n" + full["apache-licensed"] + "\n" + full["mit-released"], "a")]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in scan_licences(table(rows)).collect()}
    assert all(got[k] == ("".join(f"<{x}>" for x in rule.split()), name) for k, (rule, name) in enumerate(RULES))
    assert got[1000] == got[1001] == got[1002] == ("", "")
    assert got[1003] == ("<mit-grant>|<mit-notice>", "MIT") and got[1004] == ("<mit-released><apache-licensed><mit-released>", "MIT,Apache-2.0")
    assert scan_licences(table([])).collect() == []
