"""Streams over files that are left off and taken up again: each row once, and only under the protocol that a result was begun with."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class OtherProtocol(ValueError):
    """A result was begun with another protocol."""


def protocol_digest(protocol: dict) -> str:
    """sha256 of a protocol's canonical JSON."""
    return hashlib.sha256(json.dumps(protocol, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def bind(spark: SparkSession, path: str, protocol: dict) -> str:
    """Binds a result's folder to a protocol, or refuses it if it is bound to another; returns the digest. The file that says so is created only where there is none, so of two who begin one wins."""
    digest = protocol_digest(protocol)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_protocol")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        try:
            out = fs.create(where, False)
            out.write(bytearray(digest.encode()))
            out.close()
        except Exception:  # noqa: BLE001 - another one was first; what it wrote is compared below
            if not fs.exists(where):
                raise
    stream = fs.open(where)
    found = bytes(stream.readNBytes(64)).decode()
    stream.close()
    if found != digest:
        raise OtherProtocol(f"{path} was begun with protocol {found}, not {digest}")
    return digest


def files_in_turn(spark: SparkSession, folder: str, schema: str, files: int) -> DataFrame:
    """JSON lines of a folder, so many files a micro-batch, whatever the folder holds: what a batch reads is bounded, and its files are in the checkpoint before it runs. A malformed line has only
    nulls, as JSON streams give it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def extract(rows: DataFrame, path: str, checkpoint: str, protocol: dict, key: str, make: Callable[[DataFrame], DataFrame] = lambda rows: rows, within: tuple[str, str] | None = None):
    """Starts a stream of rows that ends when what is there is done, and returns its query. make is applied to each micro-batch of rows whose key is new, and gives rows of the result, which also get
    protocol_id and row_id (the key).

    A key's first row counts; later ones, in this run or after a restart, are nothing. Keys are the stream's state, in its checkpoint; within (time column, delay) bounds that to keys of so late. A null
    key is left out. A micro-batch is a folder of the result, written anew when the batch is run again, so a stream that was ended midway gives each row once. Another protocol is refused."""
    spark = rows.sparkSession
    digest = bind(spark, path, protocol)
    rows = rows.where(F.col(key).isNotNull())
    rows = rows.withWatermark(*within).dropDuplicatesWithinWatermark([key]) if within else rows.dropDuplicates([key])

    def write(batch: DataFrame, number: int) -> None:
        made = make(batch).withColumn("protocol_id", F.lit(digest)).withColumn("row_id", F.col(key).cast("string"))
        made.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extracted(spark: SparkSession, path: str, protocol: dict | None = None) -> DataFrame:
    """The rows of a result; with a protocol, refused where it is another one's."""
    if protocol is not None:
        bind(spark, path, protocol)
    return spark.read.parquet(path)


def unfinished(rows: DataFrame, result: DataFrame, key: str) -> DataFrame:
    """Rows whose key a result doesn't have yet, null keys left out."""
    return rows.where(F.col(key).isNotNull()).join(result.select(F.col("row_id").alias("__row_id")).distinct(), F.col(key).cast("string") == F.col("__row_id"), "left_anti")


def skipped(batches: DataFrame, accumulation: int, done: int) -> DataFrame:
    """What is left of an epoch's batches (see sampling.epoch_batches: batch, step) after done micro-batches on each replica. The epoch's order hangs on its seed alone, so what is left doesn't hang on how often it
    was left off."""
    return batches.where(F.col("batch") * accumulation + F.col("step") >= done)
