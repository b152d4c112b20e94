"""What several operators share: tables in the shared folder, the word pattern, hash keys and running sums."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators.ranges import shared_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def fresh_table(name: str) -> str:
    """A name for a table of the catalog; where its files lie is a fresh_path."""
    table = f"{name}_{uuid.uuid4().hex}"
    _made.append(table)
    return table


def made() -> int:
    """How many intermediate tables the operators have made and not removed."""
    return len(_made)


def remove_made(spark: SparkSession, before: int, since: int = 0) -> None:
    """Removes intermediate tables, those from number since to number before: for callers that have written what depends on them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made[since:before]:
        if "/" in path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        else:
            spark.sql(f"DROP TABLE IF EXISTS {path}")
    del _made[since:before]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and not lost with an executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one key that a join deals to one task.
HOT_ROWS = 1 << 20


def hot_keys(rows: DataFrame, key: str, n: int) -> DataFrame | None:
    """The keys of more than HOT_ROWS of the n rows, with the number of parts that spread_join deals them to; None without any.
    They are at most n / HOT_ROWS narrow rows: a proven bound for a broadcast."""
    if n <= HOT_ROWS:
        return None
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_ROWS)
    found = written(found.select(key, F.ceil(F.col("__n") / HOT_ROWS).cast("int").alias("__parts")), "hot-keys")
    return None if found.isEmpty() else found


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows joined with table (a row a key). Rows of hot keys are dealt by a hash of another column, and the key's row is copied to each part."""
    if hot is None:
        return rows.join(table, key, how)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    copies = table.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copies, [key, "__part"], how).drop("__part")


def free_name(name: str, taken: list[str]) -> str:
    """name, or name with underscores after it, that is none of those taken in upper or lower case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def one_row_each(docs: DataFrame, rows: DataFrame, chosen: DataFrame, numbered) -> DataFrame:
    """The rows of docs that are chosen, one a group. rows: doc_id and number of each row of docs; chosen: doc_id and number, one a group.

    A row is known by its id where no other has it. Rows of repeated (or null) ids are known by id and number: numbered(docs, name) adds a column of that name
    to those few, and of rows that are equal in both one stays. Columns of docs may have any names.
    """
    of, number = free_name("__id", docs.columns), free_name("__number", docs.columns)
    same = lambda left, right: left["doc_id"].eqNullSafe(right[of])
    times = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__times")).withColumnRenamed("doc_id", of)
    chosen = written(chosen.join(times, same(chosen, times)).select(of, F.col("number").alias(number), "__times"), "chosen-rows")
    single, several = chosen.where("__times = 1").select(of), chosen.where("__times > 1").select(of, number)
    out = docs.join(single, same(docs, single), "left_semi")
    if several.isEmpty():
        return out
    ids = several.select(of).distinct()
    again = numbered(docs.join(ids, same(docs, ids), "left_semi"), number)
    again = again.join(several, same(again, several) & (again[number] == several[number]), "left_semi").dropDuplicates(["doc_id", number])
    return out.unionByName(again.drop(number))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform_key(*columns: Column) -> Column:
    """60 evenly spread bits of the columns' values, equal on every run and in every engine with md5."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def running_sum(df: DataFrame, group: str, key: str, value: str, ties: list[str], into: str, cell_rows: int = 2048) -> DataFrame:
    """Adds into: the sum of value over the rows of the same group before this one, by key and ties.

    key holds 60 evenly spread bits (uniform_key), so fixed key ranges are cells of near equal
    numbers of rows without sampling. Sums go up over cells, then coarse cells (1024 each), and come down again:
    a group with any share of the rows is spread over its cells, and no task sees more than a
    cell, or a coarse cell's cells, or a group's coarse cells. The group may be null.
    """
    total = df.groupBy(group).agg(F.count(F.lit(1)).alias("__rows"))
    most = total.agg(F.max("__rows")).first()[0] or 1
    fine = max(0, (most // cell_rows).bit_length())
    coarse = max(0, fine - 10)
    cells = df.withColumn("__fine", F.expr(f"shiftright({key}, {60 - fine})")).withColumn("__g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")))
    by_fine = cells.groupBy("__g", "__fine").agg(F.sum(value).alias("__sum")).withColumn("__coarse", F.expr(f"shiftright(__fine, {fine - coarse})"))
    by_coarse = by_fine.groupBy("__g", "__coarse").agg(F.sum("__sum").alias("__csum"))
    def ahead(what, *parts, order):
        return F.coalesce(F.sum(what).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    by_coarse = by_coarse.select("__g", "__coarse", ahead("__csum", "__g", order=["__coarse"]).alias("__cbefore"))
    offsets = by_fine.withColumn("__fbefore", ahead("__sum", "__g", "__coarse", order=["__fine"])).join(by_coarse, ["__g", "__coarse"])
    offsets = offsets.select("__g", "__fine", (F.col("__fbefore") + F.col("__cbefore")).alias("__offset"))
    out = cells.join(offsets, ["__g", "__fine"])
    out = out.withColumn(into, F.col("__offset") + ahead(value, "__g", "__fine", order=[key, *ties]))
    return out.drop("__g", "__fine", "__offset")
