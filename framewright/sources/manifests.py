"""Manifests as DataFrames: JSON arrays or lines, tar indexes, and parts that are written once and combined when complete."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators.series_joins import coverage
from framewright.sources.scans import read_json_array, read_json_lines

VIEW = "struct<view:string,video_path:string,latent_path:string,num_latents:int,fps:double,pair_stride:int,start_frame:int>"
MANIFEST = f"dataset string, episode_id string, caption string, gap int, latent_dim int, views array<{VIEW}>"
EPISODES = "dataset string, episode_id string, caption array<struct<start_time:double,description:string>>, views map<string,struct<video_path:string,start_frame:int>>"
TAR_INDEX = "n string, o long, s long"


def manifest_format(spark: SparkSession, path: str) -> str:
    """array, jsonl or empty, by the first character that isn't blank; anything else is an error."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).limit(1).collect()
    if not first:
        return "empty"
    kinds = {"[": "array", "{": "jsonl"}
    if first[0][0] not in kinds:
        raise ValueError(f"{path} begins with {first[0][0]!r}")
    return kinds[first[0][0]]


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A manifest in either format, read in as many tasks as its size asks for. A malformed line or element is an error that names its number; blank lines are nothing."""
    kind = manifest_format(spark, path)
    if kind == "empty":
        return spark.createDataFrame([], schema)
    return (read_json_array if kind == "array" else read_json_lines)(spark, path, schema).drop("file", "number")


def read_tar_index(spark: SparkSession, path: str | list[str], root: str | None = None) -> DataFrame:
    """n, o, s: of lines of the same name the first one; later ones are malformed in some indexes. With root also path: the archive of the same name as the index there."""
    rows = read_json_lines(spark, path, TAR_INDEX)
    rows = rows.groupBy("file", "n").agg(F.min_by(F.struct("o", "s"), "number").alias("at")).select("file", "n", "at.o", "at.s")
    if root is None:
        return rows.drop("file")
    name = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    return rows.select("n", "o", "s", F.concat(F.lit(root.rstrip("/") + "/"), name, F.lit(".tar")).alias("path"))


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with a header; required columns must be there, and a row without one of them is an error where it's read."""
    rows = spark.read.option("header", True).csv(path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"{path} lacks {missing}")
    filled = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col(c)).otherwise(F.raise_error(F.lit(f"{path} has rows without {c}")).cast("string"))
    return rows.select(*[filled(c).alias(c) if c in required else F.col(c) for c in rows.columns])


def _refuse(why: str):
    raise ValueError(why)


def write_parts(rows: DataFrame, path: str, position: str, n_shards: int, force: bool = False, shards: list[int] | None = None) -> DataFrame:
    """Parquet parts by dataset and shard (position mod n_shards). A part that a run before has finished is left as it is, also an empty one, unless forced; rows that were
    written are returned. shards: those that this run is for, by default all. Which parts are finished stands in a table beside them, written last."""
    spark = rows.sparkSession
    out = rows.withColumn("num_shards", F.lit(n_shards)).withColumn("shard", F.pmod(F.col(position), F.lit(n_shards)).cast("int"))
    names = rows.select("dataset").distinct()
    own = list(range(n_shards)) if shards is None else shards
    parts = names.withColumn("num_shards", F.lit(n_shards)).withColumn("shard", F.explode(F.array(*map(F.lit, own))))
    done = finished_parts(spark, path)
    if not force:
        parts = parts.join(done, ["dataset", "num_shards", "shard"], "left_anti")
    parts = spark.createDataFrame(parts.collect(), parts.schema)  # a row a part; the table that it's read from grows below
    out = out.join(F.broadcast(parts), ["dataset", "num_shards", "shard"], "left_semi")
    out.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("num_shards", "dataset", "shard").parquet(f"{path}/rows")
    parts.write.mode("append").json(f"{path}/finished")
    return out


def finished_parts(spark: SparkSession, path: str) -> DataFrame:
    """dataset, num_shards, shard of the parts that are whole, each once; none where nothing has been written."""
    schema = "dataset string, num_shards int, shard int"
    try:
        return spark.read.schema(schema).json(f"{path}/finished").distinct()
    except AnalysisException:
        return spark.createDataFrame([], schema)


def combine_parts(spark: SparkSession, path: str, n_shards: int) -> DataFrame:
    """All parts of one sharding; a dataset without some shard is an error, an empty shard isn't."""
    have = finished_parts(spark, path).where(F.col("num_shards") == n_shards).select("dataset", "shard")
    want = have.select("dataset").distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    missing = want.join(have, ["dataset", "shard"], "left_anti").orderBy("dataset", "shard").limit(20).collect()
    if missing or have.isEmpty():
        _refuse(f"missing shards: {[tuple(r) for r in missing] or 'all'}")
    return spark.read.parquet(f"{path}/rows").where(F.col("num_shards") == n_shards).drop("num_shards")


def write_mixture(entries: list[dict], name: str, weights: DataFrame, path: str, spark: SparkSession) -> list[dict]:
    """A mixture with one entry's dataset_weights set, others untouched; not exactly one entry of that data_path is an error, and so is a file that is there."""
    chosen = [e for e in entries if e.get("data_path") == name]
    if len(chosen) != 1:
        raise ValueError(f"{len(chosen)} entries of {name}, not one")
    table = {r.dataset: r.weight for r in weights.select("dataset", "weight").orderBy("dataset").collect()}  # a row a dataset
    out = [e | {"dataset_weights": table} if e is chosen[0] else e for e in entries]
    spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return out


def write_with_digest(rows: DataFrame, keys: list[str], path: str, by: str) -> str:
    """Rows as JSON lines in order of the keys, a report of rows by a column, and the digest of all: the sum of the rows' digests, which no order changes."""
    line = F.to_json(F.struct(*sorted(rows.columns)))
    rows.orderBy(*keys).write.mode("errorifexists").json(f"{path}/rows")
    rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("errorifexists").json(f"{path}/report")
    parts = [F.sum(F.conv(F.substring(F.sha2(line, 256), 1 + 8 * k, 8), 16, 10).cast("long")).alias(f"d{k}") for k in range(8)]
    return "".join(f"{(v or 0) % (1 << 32):08x}" for v in rows.agg(*parts).first())


def merge_reports(parts: list[DataFrame], key: str, n: int, path: str) -> dict:
    """Extraction parts in one CSV, in order of their row ids, and a report. A row of 0 to n - 1 that is in no part, or in two, is an error."""
    rows = reduce(DataFrame.unionByName, parts)
    bad = coverage(rows, key, n).orderBy(key).limit(5).collect()
    if bad:
        raise ValueError(f"rows not there once: {[tuple(r) for r in bad]}")
    rows.orderBy(key).write.mode("errorifexists").option("header", True).csv(f"{path}/rows")
    report = {"rows": n, "parts": len(parts)}
    rows.sparkSession.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/report")
    return report


def write_once(rows: DataFrame, path: str) -> None:
    """JSON that is never overwritten."""
    rows.write.mode("errorifexists").json(path)


def read_stats(spark: SparkSession, path: str | None, dim: int) -> DataFrame:
    """dim, mean, std, min, max of a latent statistics record; another width or a std that isn't positive is an error. Without a path the identity: mean 0, std 1."""
    if path is None:
        return spark.range(dim).select(F.col("id").cast("int").alias("dim"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"), F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"))
    record = spark.read.option("multiLine", True).json(path)
    rows = record.select(F.posexplode(F.arrays_zip("mean", "std", "min", "max")).alias("dim", "s")).select("dim", "s.*")
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if(~(F.col("std") > 0))).first()
    return rows if n == dim and not bad else _refuse(f"{path}: {n} dimensions of {dim}, {bad} without spread")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows of equal keys the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
