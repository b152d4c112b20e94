"""Mixing sources to target weights.

Sources get target sizes by weight; a source that cannot give that much even with all
its epochs is held to its limit and the excess is shared again by weight. Each document has
a hash-random key; a source's documents, sorted by it, are taken until the source's budget is
met, whole epochs first. The document that the budget ends in gives just its first words, so each
source meets its target to a word.

Only the key range (cell) that a budget ends in needs its documents sorted: sums over
cells find it, so no source is ever sorted as a whole, however large its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import n_words, uniform_key, written

#: Documents a cell has, about.
CELL_ROWS = 1024


def source_targets(sizes: DataFrame, weights: list[float], share: float, most_epochs: int) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    Weights repeat over the sources in order of code points, null last. With limits most_epochs * size, the
    result of resharing the excess again and again is min(limit, level * weight) for one level: sources sorted
    by limit / weight are held to their limits up to the first that isn't above it. One row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    out = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    out = out.withColumn("limit", F.col("source_size") * F.lit(float(most_epochs))).withColumn("ratio", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy(F.lit(1))
    held = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - held) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return out.withColumn("target", F.least(F.col("limit"), F.coalesce(level, F.col("ratio")) * F.col("weight"))).drop("limit", "ratio", "level")


def mix(
    docs: DataFrame, weights: list[float], share: float = 1.5, most_epochs: int = 2, size: Column | None = None,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] = [],  # noqa: B006
) -> DataFrame:
    """One row a row of docs: doc_id, source, size, source_size, target, taken, and the columns named in keep.

    taken: words of the document in the mix, repeats counted, at most most_epochs * size. A null text has size 0,
    sources may be null (a source of its own), a source of size 0 has target 0. Rows of equal id and text
    are told apart by nothing, so they are interchangeable; reruns agree. An empty table gives an empty result.
    """
    if own := {"g", "key", "tie", "size", "cell", "bits", "budget", "epochs", "target", "source_size", "last", "before", "more", "taken"} & set(keep):
        raise ValueError(f"rename {sorted(own)} in keep: mix has columns of that name")
    size = n_words(F.col(text)) if size is None else size
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), uniform_key(F.col(doc_id)).alias("key"), F.xxhash64(text).alias("tie"), *keep)
    rows = written(rows, "mix-rows") if not keep else rows
    g = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # nulls join too
    rows = rows.withColumn("g", g)
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(totals, weights, share, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    targets = targets.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CELL_ROWS))).cast("int")).withColumn("g", g).drop("source", "n", "weight")
    targets = written(targets, "mix-targets")
    rows = rows.join(targets, "g").withColumn("cell", F.expr("shiftright(key, 60 - bits)"))
    by_cell = rows.groupBy("g", "cell").agg(F.sum("size").alias("cell_size"), F.first("budget").alias("budget"), F.first("bits").alias("bits"))
    by_cell = by_cell.withColumn("coarse", F.expr("shiftright(cell, greatest(0, bits - (bits div 2)))"))
    coarse = by_cell.groupBy("g", "coarse").agg(F.sum("cell_size").alias("coarse_size"))

    def ahead(what, *parts, order):
        return F.coalesce(F.sum(what).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    coarse = coarse.select("g", "coarse", ahead("coarse_size", "g", order=["coarse"]).alias("coarse_before"))
    by_cell = by_cell.withColumn("inner", ahead("cell_size", "g", "coarse", order=["cell"])).join(coarse, ["g", "coarse"])
    by_cell = by_cell.withColumn("before", F.col("inner") + F.col("coarse_before"))
    #: The cell in which a source's budget ends: one a source.
    last = by_cell.where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("cell_size")))
    last = written(last.select("g", F.col("cell").alias("last"), "before"), "mix-cells")
    rows = rows.join(last, "g", "left")
    # With no such cell the budget is 0 with nothing there, or all of the source.
    whole = F.when(F.col("last").isNull(), F.when(F.col("budget") > 0, F.col("size")).otherwise(0)).when(F.col("cell") < F.col("last"), F.col("size")).otherwise(0)
    outside = rows.where(F.col("last").isNull() | (F.col("cell") != F.col("last"))).withColumn("more", whole)
    inside = rows.where(F.col("cell") == F.col("last"))
    left = F.col("budget") - F.col("before") - ahead("size", "g", order=["key", "doc_id", "tie"])
    inside = inside.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    out = outside.unionByName(inside).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("more")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", *keep)


def first_words(text: Column, n: Column) -> Column:
    """A text up to its n-th word, white space between as it was."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank = F.coalesce(F.rlike(text, F.lit(r"^[\x20\x09-\x0D]")), F.lit(False)).cast("int")
    return F.array_join(F.slice(pieces, F.lit(1), (n + blank).cast("int")), "")


def mixed_documents(docs: DataFrame, weights: list[float], share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """The mix itself: rows of docs, once for each whole epoch that takes them, and cut to the first words where a budget ends.

    Columns as those of docs (doc_id, text, source needed; n_chars, where there is one, follows a cut text). A null or
    blank text has no words to take, so it's in the mix as often as the source's whole epochs.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    named = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), row)
    out = mix(named.select("doc_id", "text", "source", "__row"), weights, share, most_epochs, keep=["__row"])
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1))
    rest = F.col("taken") - F.when(F.col("size") > 0, whole * F.col("size")).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest.cast("long"))).otherwise(F.array().cast("array<long>")))
    out = out.select("__row", F.explode(copies).alias("__cut"))
    cut = first_words(F.col("__row.text"), F.col("__cut"))
    out = out.withColumn("__text", F.when(F.col("__cut") > 0, cut).otherwise(F.col("__row.text")))
    columns = [F.col("__text").alias(c) if c == "text" else F.when(F.col("__cut") > 0, F.length("__text").cast("long")).otherwise(F.col("__row.n_chars")).alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c in names]
    return out.select(*columns)
