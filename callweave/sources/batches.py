"""Tables of batches: each has a key, is written aside and comes in by one renamed manifest.

A folder holds ``batches`` (one JSON file a batch, named by its key) and the data folders that they
name. A batch is there once its manifest is: a writer that fails leaves data that nobody reads, one
that comes again with the same key adds nothing, and of two writers of one key one is told so.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "key string, data string, at long"
#: What each row gets: the batch's key, when it was written (nanoseconds), and the row's place in it.
STAMPS = ["ingest_batch", "ingested_at", "ingest_seq"]


def _at(spark: SparkSession, path: str):
    """The file system of ``path`` and the path on it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, at = _at(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file to ``target`` unless there is one, which is told by False."""
    jvm = spark._jvm
    (_, a), (_, b) = _at(spark, source), _at(spark, target)
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(_at(spark, target)[0].getUri(), spark._jsc.hadoopConfiguration()).rename(a, b, options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def batches(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(key, data folder, time) of each batch, oldest first; a row for each batch comes to the driver."""
    fs, at = _at(spark, f"{path}/batches")
    if not fs.exists(at):
        return []
    rows = spark.read.schema(MANIFEST).json(f"{path}/batches").collect()
    return sorted(((r["key"], f"{path}/{r['data']}", r["at"]) for r in rows), key=lambda b: (b[2], b[0]))


def append(df: DataFrame, path: str, key: str | None = None) -> bool:
    """Add ``df`` as the batch ``key`` (default: a new one); False if there is one of that key, which stays as it is."""
    spark, key = df.sparkSession, key or uuid.uuid4().hex
    manifest = f"{path}/batches/{quote(key, safe='')}.json"
    fs, there = _at(spark, manifest)
    if fs.exists(there):
        return False
    name, now = f"data-{uuid.uuid4().hex}", time.time_ns()
    stamps = {"ingest_batch": F.lit(key), "ingested_at": F.lit(now), "ingest_seq": F.monotonically_increasing_id()}
    df.withColumns(stamps).write.parquet(f"{path}/{name}")
    aside = f"{path}/batches/.{name}"
    write_bytes(spark, aside, json.dumps({"key": key, "data": name, "at": now}).encode())
    if renamed(spark, aside, manifest):
        return True
    for lost in (aside, f"{path}/{name}"):
        fs.delete(_at(spark, lost)[1], True)
    return False


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all batches with their STAMPS; None without any batch."""
    found = batches(spark, path)
    return spark.read.parquet(*[data for _, data, _ in found]) if found else None
