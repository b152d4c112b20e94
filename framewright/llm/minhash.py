"""Order MinHash: signatures that follow edit distance, in DataFrame functions only.

A text's k-mers are its runs of three words, numbered by occurrence, so repeats count. Each numbered k-mer is hashed
once; the hash says in which of 64 bins it falls and its rank there. A bin's two least k-mers, in the order in which
the text has them, give the bin's value: it changes when a k-mer goes, comes, or changes place. This is the one-permutation form of the
method: a bin is a tuple of two, and in texts of under about 130 words many bins hold a single k-mer, which says nothing about order.
Likeness is the share of equal values among bins that either text fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import WORD, let, written

WIDTH, BINS = 3, 64
#: Bits for a k-mer's place in a sort key: no array of Spark holds more longs than that.
PLACE = 28
#: Bits of a k-mer's bin and of its rank within it.
BIN_BITS, RANK_BITS = 6, 29
_EMPTY = "...."


def _get(array: Column, index: Column) -> Column:
    return F.get(array, index.cast("int"))


def _occurrence(keys: Column, key: Column, i: Column) -> Column:
    """How many keys before place i have the same k-mer: equal ones are neighbours, so halving steps find the first."""
    same = lambda back: (i >= back) & (F.shiftright(_get(keys, i - back), PLACE) == F.shiftright(key, PLACE))
    steps = F.array(*[F.lit(1 << k) for k in range(PLACE - 1, -1, -1)])
    search = F.aggregate(steps, F.lit(0), lambda t, step: F.when(same(t + step), t + step).otherwise(t))
    return F.when(same(F.lit(1)), search).otherwise(F.lit(0))


def order_minhash(text: Column) -> Column:
    """The fingerprint of a text: four hex digits for each bin, dots for an empty one. Equal texts have equal ones; texts
    of fewer than three words have one k-mer, all their words; a text without words fills no bin. A text without white space, as Chinese is often
    written, is one word: its likeness to any other text is 0."""
    place = (1 << PLACE) - 1
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def kmers(w):
        inner = F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[_get(w, i + k) for k in range(WIDTH)]))
        return F.when(F.size(w) >= WIDTH, inner).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    keyed = let(words, lambda w: F.transform(kmers(w), lambda h, i: F.shiftleft(F.shiftright(h, PLACE), PLACE).bitwiseOR(i.cast("long"))))
    # a number a k-mer: bin, then rank within it, then its place in the text
    ranked = let(F.sort_array(keyed), lambda s: F.transform(s, lambda x, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.shiftright(x, PLACE), _occurrence(s, x, i)), 64 - BIN_BITS - RANK_BITS), PLACE).bitwiseOR(x.bitwiseAND(F.lit(place)))))
    bin_of = lambda x: F.shiftright(x, PLACE + RANK_BITS)
    least = let(F.sort_array(ranked), lambda s: F.filter(s, lambda x, i: (i < 2) | (bin_of(_get(s, i - 2)) != bin_of(x))))

    def values(s):
        def value(x, i):
            first = (i == 0) | (bin_of(_get(s, i - 1)) != bin_of(x))
            after = _get(s, i + 1)
            pair = after.isNotNull() & (bin_of(after) == bin_of(x))
            a, b = F.shiftright(x, PLACE), F.shiftright(after, PLACE)
            in_order = x.bitwiseAND(F.lit(place)) < after.bitwiseAND(F.lit(place))
            both = F.when(in_order, F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
            return F.when(first, F.struct(bin_of(x).cast("int").alias("k"), F.lower(F.substring(F.lpad(F.hex(F.when(pair, both).otherwise(F.xxhash64(a))), 16, "0"), 1, 4)).alias("v")))

        return F.map_from_entries(F.filter(F.transform(s, value), lambda e: e.isNotNull()))

    found = let(least, values)
    return let(found, lambda m: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(m[b], F.lit(_EMPTY))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal values among bins filled in either; 1 where no bin is."""
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    part = lambda c, k: F.substr(c, k * 4 + 1, F.lit(4))
    filled = F.size(F.filter(bins, lambda k: (part(a, k) != _EMPTY) | (part(b, k) != _EMPTY)))
    equal = F.size(F.filter(bins, lambda k: (part(a, k) == part(b, k)) & (part(a, k) != _EMPTY)))
    return F.when(a == b, F.lit(1.0)).when(filled == 0, F.lit(1.0)).otherwise(equal / filled)


def _successors(keys: DataFrame) -> DataFrame:
    """keys: kid, h, distinct. Adds next_kid, next_h: the next in descending kid (then ascending h), the first after the last.

    Ranges of keys are sorted apart, and a row a range links them."""
    ranged = written(keys.repartitionByRange(F.desc("kid"), "h").withColumn("p", F.spark_partition_id()), "minhash-order")
    own, inside = F.struct("kid", "h"), Window.partitionBy("p").orderBy(F.desc("kid"), "h")
    order = F.struct(F.expr("-1 - kid").alias("down"), F.col("h"))  # -1 - kid can't overflow
    edges = ranged.groupBy("p").agg(F.min_by(own, order).alias("first"))
    across = Window.orderBy("p")
    ends = Window.partitionBy(F.lit(1)).orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("p", F.coalesce(F.lead("first").over(across), F.first("first").over(ends)).alias("onward"))
    found = ranged.withColumn("next", F.lead(own).over(inside)).join(F.broadcast(edges), "p")  # as many rows as shuffle partitions
    found = found.withColumn("next", F.coalesce("next", "onward"))
    return found.select("kid", "h", "n_chars", F.col("next.kid").alias("next_kid"), F.col("next.h").alias("next_h"))


def fingerprint_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the start of the next document's, in descending id; the last's next is the first. A
    null text counts as empty, a null id as the smallest. Rows of equal id and text are one document, its result is repeated; rows of equal id and
    different texts are ordered by a hash. Other columns aren't read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("kid"), F.xxhash64("text").alias("h"), "doc_id", "text", F.length("text").cast("long").alias("n_chars"))
    order = written(_successors(rows.select("kid", "h", "n_chars").distinct()), "minhash-next")
    rows = rows.withColumn("fingerprint", order_minhash(F.col("text"))).repartition("kid", "h")
    # the order names all columns, so that both sides of the join below read one and the same exchange
    once = rows.withColumn("copy", F.row_number().over(Window.partitionBy("kid", "h").orderBy("n_chars", "doc_id"))).where("copy = 1")
    once = once.select(F.col("kid").alias("next_kid"), F.col("h").alias("next_h"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    nexts = once.join(order, ["next_kid", "next_h"]).select("kid", "h", F.substr("next_text", F.lit(1), third).alias("start"), "next_fingerprint")
    out = rows.join(nexts, ["kid", "h"])
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.col("start"))
    out = out.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", edited.alias("edited"))
    out = out.select("*", F.sha2("edited", 256).alias("edited_sha256"), order_minhash(F.col("edited")).alias("edited_fingerprint"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
