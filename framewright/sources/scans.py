"""Large text and binary files read in ranges: numbered lines, elements of one JSON array, members of tar archives and tails of files.

A file's lines, or pieces of a JSON array, are read in as many tasks as Spark splits the file into. What needs what came before (a line's number; whether a
place is inside a string, and how deep) is a sum: each split gives its own total, totals are summed in order of the splits, and each row adds what is before it in its split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes that one read of a file asks for at most; a member is read in one go.
MOST = 1 << 31
#: Bytes of ranges that a task hands on at once.
PIECE = 4 << 20


def _records(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """file, split (where it begins), at (order within the split), value."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")]
    return reader.text(path).select(*place, "value")


def _before(totals: DataFrame, *sums: str) -> DataFrame:
    """totals: a row a split, with sums of its rows. The same with sums of the splits before it in its file: a row for each split, so a task holds a file's splits."""
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", "split", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_before") for c in sums])


def read_numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, number (from 1), value: the lines of text files, in order, blank ones included."""
    lines = _records(spark, path)
    own = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    ahead = own.join(_before(own, "n"), ["file", "split"])
    return lines.join(ahead, ["file", "split"]).select("file", (F.col("n_before") + F.col("at") - F.col("first") + 1).alias("number"), "value")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """file, number, and the columns of schema: a row a line that isn't blank. A line that is malformed or no object of this schema is an error that names it."""
    rows = read_numbered(spark, path).where(F.trim("value") != "")
    return _parsed(rows, schema, "malformed manifest line")


def _parsed(rows: DataFrame, schema: str, fault: str) -> DataFrame:
    """rows: file, number, value (JSON text)."""
    found = F.from_json("value", f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    rows = rows.withColumn("__row", found)
    bad = F.col("__row.__corrupt").isNotNull() | F.col("__row").isNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    said = F.concat_ws(":", "file", "number", F.lit(f" {fault}"))
    rows = rows.withColumn("number", F.when(bad, F.raise_error(said).cast("long")).otherwise(F.col("number")))
    return rows.select("file", "number", "__row.*").drop("__corrupt")


def json_array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, number (from 1), value: the text of each element of files that are one JSON array of objects each, of any size and however many lines.

    Files are read in pieces that end at closing braces. A piece is inside a string or not by the number of quotes before it, and as deep as the brackets before it say; an element ends where a closing
    brace leaves the depth at 1. A file that isn't closed at its end, or has a bracket too many, is an error.
    """
    pieces = _records(spark, path, "}")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters: a quote now begins or ends a string
    outside = F.regexp_replace(plain, r'"[^"]*("|$)', "")
    inside = F.regexp_replace(F.regexp_replace(plain, r'^[^"]*("|$)', ""), r'"[^"]*("|$)', "")
    count = lambda text, characters: F.length(text) - F.length(F.translate(text, characters, ""))
    deeper = lambda text: count(text, "[{") - count(text, "]}")
    quotes = count(plain, '"')
    pieces = pieces.select("file", "split", "at", "value", quotes.cast("long").alias("quotes"), deeper(outside).cast("long").alias("if_outside"), deeper(inside).cast("long").alias("if_inside"))
    piece = Window.partitionBy("file", "split").orderBy("at")
    within = piece.rowsBetween(Window.unboundedPreceding, -1)
    own = pieces.withColumn("odd", F.coalesce(F.sum("quotes").over(within), F.lit(0)) % 2)
    ends_inside = lambda odd: (odd + F.col("quotes")) % 2 == 1
    # the depth that a piece adds, its closing brace included, if its split begins outside (0) or inside (1) a string
    adds = lambda k: F.when((F.col("odd") + k) % 2 == 0, F.col("if_outside")).otherwise(F.col("if_inside")) - F.when(ends_inside(F.col("odd") + k), 0).otherwise(1)
    own = own.withColumn("adds_0", adds(0)).withColumn("adds_1", adds(1))
    totals = own.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"), F.sum("adds_0").alias("adds_0"), F.sum("adds_1").alias("adds_1"))
    begins = totals.join(_before(totals, "quotes").withColumn("inside", F.col("quotes_before") % 2), ["file", "split"])
    begins = begins.withColumn("adds", F.when(F.col("inside") == 0, F.col("adds_0")).otherwise(F.col("adds_1")))
    begins = begins.join(_before(begins, "adds"), ["file", "split"]).select("file", "split", "inside", F.col("adds_before").alias("depth_before"))
    rows = own.join(begins, ["file", "split"])
    added = F.when(F.col("inside") == 0, F.col("adds_0")).otherwise(F.col("adds_1"))
    rows = rows.withColumn("depth", F.col("depth_before") + F.sum(added).over(piece)).withColumn("closes", (F.col("depth") == 1) & ~ends_inside(F.col("odd") + F.col("inside")))
    # the last piece of a file has no brace after it, so it counts one too few
    ends = rows.groupBy("file", "split").agg(F.max_by("depth", "at").alias("depth"), F.sum(F.col("closes").cast("long")).alias("closed"), F.max("at").alias("at"))
    final = ends.groupBy("file").agg(F.max(F.struct("split", "at", "depth")).alias("last"))
    rows = rows.join(_before(ends, "closed"), ["file", "split"]).join(final, "file")
    is_last = F.struct("split", "at") == F.struct("last.split", "last.at")
    fault = (F.col("last.depth") != -1) | ((F.col("depth") < 1) & ~is_last)
    ahead = F.col("closed_before") + F.coalesce(F.sum(F.col("closes").cast("long")).over(within), F.lit(0))
    number = F.when(fault, F.raise_error(F.concat("file", F.lit(" isn't one whole JSON array"))).cast("long")).otherwise(ahead + 1)
    rows = rows.select("file", "split", "at", "value", number.alias("number"), is_last.alias("is_last"), fault.alias("fault")).where(~F.col("is_last") | F.col("fault"))
    parts = rows.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    return parts.select("file", "number", F.regexp_replace(text, r"^[\s,\[]+", "").alias("value"))


def read_json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """file, number, and the columns of schema: a row an element. An element that is malformed is an error that names its number."""
    return _parsed(json_array_elements(spark, path), schema, "malformed element")


def _open(path: str):
    """A file of any store that Arrow knows, open for reading in ranges."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    store, inner = fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_file(inner)


def ranged(names: list[str], most: int = PIECE):
    """What read_ranges does in a task: batches with these columns in, in pieces of about so many bytes of content (or one range) out, so that a task holds no more of it than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            content, held, begin = [], 0, 0
            piece = lambda end: pa.RecordBatch.from_arrays([*batch.slice(begin, end - begin).columns, pa.array(content, pa.binary())], names=[*names, "content"])  # noqa: B023, E731
            for k, (path, offset, size) in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in ("path", "offset", "size")))):
                if path != at:
                    at, file = path, _open(path)
                if offset is None or size is None or offset < 0 or size <= 0 or size > MOST or offset + size > file.size():
                    raise ValueError(f"{path}: no bytes {offset} to {offset} + {size} of {file.size()}")
                if content and held + size > most:
                    yield piece(k)
                    content, held, begin = [], 0, k
                content.append(file.read_at(size, offset))
                held += size
            yield piece(batch.num_rows)

    return run


def read_ranges(ranges: DataFrame) -> DataFrame:
    """ranges: path, offset, size, and what else there is. Adds content: these bytes of that file. A range that is empty, or reaches beyond the file, is an error that names it.

    Ranges of a file are read in order of offset by the tasks that hold them, each file opened once a batch; nothing else of the file is read."""
    return ranges.mapInArrow(ranged(ranges.columns), StructType([*ranges.schema.fields, StructField("content", BinaryType())]))


def read_members(index: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Members of tar archives by their index: path, n, o, s (see read_tar_index); names: n, of those that are wanted. n, path, content. A name without an entry is an error."""
    ranges = index.select("n", "path", F.col("o").alias("offset"), F.col("s").alias("size"))
    if names is not None:
        ranges = names.select("n").distinct().join(ranges, "n", "left")
        ranges = ranges.withColumn("path", F.coalesce("path", F.raise_error(F.concat("n", F.lit(" isn't in the index")))))
    ranges = ranges.repartition(F.col("path"), F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("path", "offset")
    return read_ranges(ranges).select("n", "path", "content")


def read_tails(spark: SparkSession, path: str | list[str], n: int, glob: str = "*") -> DataFrame:
    """path, length, content: the last n bytes (or all) of each file that isn't empty. Files are listed, not read: only their tails are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")
    size = F.least(F.col("length"), F.lit(n))
    return read_ranges(files.select("path", "length", (F.col("length") - size).alias("offset"), size.cast("long").alias("size"))).drop("offset", "size")


def write_array(rows: DataFrame, path: str) -> None:
    """Each partition's rows as a file with one JSON array, an element a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if held is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([("[" if first else "") + held + ","])], names=["value"])
                    first = False
                held = value
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([("[" if first else "") + held + "]"])], names=["value"])

    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(run, "value string").write.mode("errorifexists").text(path)


def write_tars(rows: DataFrame, path: str, parts: int) -> None:
    """rows: n, content. Members of part-0.tar to part-(parts - 1).tar below path, by a hash of their names and in their order, and beside each its index part-k.jsonl, written last.
    A task that runs again writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import json
        import tarfile

        from pyspark import TaskContext

        lines, archive, out = [], None, None
        name = f"{path}/part-{TaskContext.get().partitionId()}"
        for batch in batches:
            for n, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive is None:
                    out = _create(f"{name}.tar")
                    archive = tarfile.open(fileobj=out, mode="w|")
                info = tarfile.TarInfo(n)
                info.size = len(content)
                archive.addfile(info, io.BytesIO(content))
                lines.append(json.dumps({"n": n, "o": archive.offset - -(-len(content) // 512) * 512, "s": len(content)}))
        if archive is not None:
            archive.close()
            out.close()
            with _create(f"{name}.jsonl") as index:
                index.write("\n".join(lines).encode())
        yield pa.RecordBatch.from_arrays([pa.array([len(lines)], pa.int64())], names=["members"])

    made = rows.select("n", "content").repartition(parts, "n").sortWithinPartitions("n").mapInArrow(run, "members long")
    made.agg(F.sum("members")).collect()


def _create(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner)
