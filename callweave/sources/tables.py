"""Readers and writers with the schemas that the transcripts and results have."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions import text
from callweave.sources import batches
from callweave.sources.batches import _at
from callweave.sources.documents import write_json_document

#: A language is text, or an object whose JSON is kept as text.
TRANSCRIPT = """file_name string, file_path string, error string, text string,
language string, selected_language string, language_detection struct<confidence: string>,
segments array<struct<start: double, end: double, text: string>>,
words array<struct<word: string, start: double, end: double, conf: double>>,
word_count int, avg_confidence double, fallback_language_used boolean,
transcription_time_seconds double, total_time_with_detection_seconds double"""

# The columns of the result table and of the list for reviewers, in order.
RESULT_COLUMNS = "file_name status selected_language language_confidence word_count_raw word_count_cleaned is_empty_call empty_reason review_priority ready_for_classification quality_flags problem_keywords_found raw_transcript cleaned_transcript semantic_text".split()
REVIEW_COLUMNS = "file_name selected_language language_confidence is_empty_call empty_reason review_priority ready_for_classification quality_flags word_count_raw word_count_cleaned cleaning_ratio avg_confidence problem_keywords_found semantic_text removed_parts raw_transcript cleaned_transcript".split()


def read_transcripts(spark: SparkSession, path: str, mode: str = "auto") -> DataFrame:
    """Transcripts of JSON documents, one row each, all fields nullable.

    ``many``: objects ``{"results": [...]}``; ``single``: one transcript each; ``auto`` takes both.
    A document of the other kind raises ValueError.
    """
    item = T.StructType.fromDDL(TRANSCRIPT)
    results = T.StructField("results", T.ArrayType(item))
    if mode not in ("auto", "many", "single"):
        raise ValueError(f"unknown mode {mode!r}")
    whole = spark.read.schema(T.StructType([results, *item.fields])).option("multiLine", True).json(path)
    other = {"many": F.col("results").isNull(), "single": F.col("results").isNotNull()}.get(mode)
    if other is not None and whole.where(other).limit(1).count():
        raise ValueError(f"{path} holds a document that is not {mode!r}")
    single = F.array(F.struct(*[F.col(c) for c in item.fieldNames()]))
    return whole.select(F.posexplode(F.coalesce("results", single)).alias("place", "r")).select("r.*")


def spread(df: DataFrame, most: int = 64) -> DataFrame:
    """A small table dealt to all cores: one of fewer splits than ``most`` and than there are cores.

    A file of one row group is one task however many cores wait; larger tables are read where they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, most) else df


def segments(df: DataFrame, id_col: str = "file_name") -> DataFrame:
    """One row for each segment: id, ``turn`` (its place) and ``text``."""
    return df.select(id_col, F.posexplode("segments").alias("turn", "s")).select(id_col, "turn", F.col("s.text").alias("text"))


def newest(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """The ``n`` rows of the largest ``order_col``, newest first."""
    return df.orderBy(F.desc(order_col)).limit(n)


#: How CSV is written and read: quotes within values are doubled, line ends are kept.
CSV = {"header": True, "escape": '"', "multiLine": True}


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files with headers; arrays are joined by ``, ``."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.options(**CSV).csv(path)


def as_text(df: DataFrame, columns: list[str], as_they_are: tuple[str, ...] = ()) -> DataFrame:
    """``columns`` of ``df`` as text: arrays joined by ``, ``, nulls and absent columns ''; then those that stay ``as_they_are``."""
    kinds = dict(df.dtypes)
    value = lambda c: F.array_join(F.col(c).cast("array<string>"), ", ") if kinds[c].startswith("array") else F.col(c).cast("string")
    return df.select(*[F.coalesce(value(c), F.lit("")).alias(c) if c in kinds else F.lit("").alias(c) for c in columns], *as_they_are)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def clear(spark: SparkSession, *paths: str) -> int:
    """Delete the tables, files and folders that exist among ``paths``; returns how many there were."""
    found = [_at(spark, p) for p in paths if exists(spark, p)]
    for fs, at in found:
        fs.delete(at, True)
    return len(found)


def ensure_schema(spark: SparkSession, path: str, columns: list[str]) -> str | None:
    """Set a table at ``path`` aside if it has other columns than ``columns`` (or another order) and the batches' stamps.

    Returns the name that it got (``<path>_<seconds>.bak``), None if it was right, empty or absent.
    """
    if not exists(spark, path):
        return None
    fs, at = _at(spark, path)
    plain = bool(fs.globStatus(_at(spark, f"{path}/*.parquet")[1]))
    found = spark.read.parquet(path) if plain else batches.read(spark, path)
    if found is None or not plain and [c for c in found.columns if c not in batches.STAMPS] == columns:
        return None
    aside = f"{path.rstrip('/')}_{int(time.time())}.bak"
    fs.rename(at, _at(spark, aside)[1])
    return aside


def append_results(processed: DataFrame, path: str, key: str | None = None) -> bool:
    """Append the result columns to the table of batches at ``path`` (see ``batches``); False if the batch ``key`` is there already.

    Writers need not wait for one another, and one that failed may come again with its key. A table
    of other columns is set aside first (see ``ensure_schema``).
    """
    ensure_schema(processed.sparkSession, path, RESULT_COLUMNS)
    return batches.append(as_text(processed, RESULT_COLUMNS), path, key)


def read_results(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Result rows: the newest ``limit``, newest first; all, in order, if ``limit`` is 0 or less; none if there is no table."""
    rows = batches.read(spark, path)
    if rows is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in RESULT_COLUMNS))
    order = ["ingested_at", "ingest_batch", "ingest_seq"]
    if limit <= 0:
        return rows.orderBy(*order).select(*RESULT_COLUMNS)
    return rows.orderBy(*map(F.desc, order)).limit(limit).select(*RESULT_COLUMNS)


def response_rows(processed: DataFrame) -> DataFrame:
    """What a caller gets of each row: the result columns, absent lists as empty ones and absent texts as ''."""
    absent = {c: F.array().cast("array<string>") for c in ("quality_flags", "problem_keywords_found")} | {c: F.lit("") for c in ("raw_transcript", "cleaned_transcript", "semantic_text")}
    return processed.select(*[F.coalesce(c, absent[c]).alias(c) if c in absent else F.col(c) for c in RESULT_COLUMNS])


def error_rows(failed: DataFrame, name_col: str = "file_name", error_col: str = "error") -> DataFrame:
    """The rows that stand for files whose processing failed: high priority, not ready, flag ``processing_error``, no texts."""
    flag = F.array(F.lit("processing_error"))
    values = {
        "status": F.lit("error"), "is_empty_call": F.lit(True), "empty_reason": F.lit("processing_error"), "review_priority": F.lit("high"),
        "ready_for_classification": F.lit(False), "quality_flags": flag, "problem_keywords_found": F.array().cast("array<string>"),
        "word_count_raw": F.lit(None).cast("int"), "word_count_cleaned": F.lit(None).cast("int"),
    }
    return failed.select(F.col(name_col).alias("file_name"), *[values.get(c, F.lit("")).alias(c) for c in RESULT_COLUMNS[1:]], F.col(error_col).alias("error"))


def write_review(processed: DataFrame, path: str) -> None:
    """A folder of CSV files with the columns that reviewers read."""
    as_text(processed, REVIEW_COLUMNS).write.options(**CSV).csv(path)


def read_csv_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header as text columns, each value as ``parse_csv_value`` reads it; other columns are dropped.

    A missing or empty file has no rows; one with a header that lacks a column raises.
    """
    rows = spark.read.options(**CSV).csv(path) if exists(spark, path) else None
    if rows is None or not rows.columns:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    missing = set(columns) - set(rows.columns)
    if missing:
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    return rows.select(*[text.parse_csv_value(F.col(f"`{c}`")).alias(c) for c in columns])


# What clustering adds to the result table, with its types.
CLUSTERED = {"text_for_clustering": "string", "cluster_id": "int", "cluster_probability": "double", "cluster_size": "int", "cluster_status": "string"}


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of clustered results: the result columns as texts, then CLUSTERED with its types.

    Cluster ids as ``cluster_number`` reads them; other numbers that can't be read are null.
    """
    rows = read_csv_records(spark, path, [*RESULT_COLUMNS, *CLUSTERED])
    typed = {c: text.cluster_number(F.col(c)) if c == "cluster_id" else F.col(c).try_cast(t) for c, t in CLUSTERED.items()}
    return rows.withColumns(typed)


def write_envelope(processed: DataFrame, summary: DataFrame, path: str, source: str, facts: dict | None = None, overwrite: bool = False) -> None:
    """One JSON document: ``source_file``, further ``facts``, the one row of ``summary``, then ``results`` with an object for each row."""
    said = {"source_file": source, **(facts or {}), "summary": summary.first().asDict(True)}
    write_json_document(processed, path, said, overwrite=overwrite)
