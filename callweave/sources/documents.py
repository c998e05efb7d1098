"""One file from many tasks: parts are written by Spark, then joined by the file system, a piece at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.sources.batches import _at, renamed

#: Bytes that are copied at a time.
PIECE = 1 << 20
BOM = b"\xef\xbb\xbf"


def joined_parts(spark: SparkSession, folder: str, target: str, head: bytes = b"", tail: bytes = b"", skip: int = 0, overwrite: bool = False) -> None:
    """Write ``head``, the part files of ``folder`` in order (without the first ``skip`` bytes) and ``tail`` as one file, which appears when it is whole."""
    jvm, aside = spark._jvm, f"{target}.{uuid.uuid4().hex}.tmp"
    fs, at = _at(spark, aside)
    out = fs.create(at, False)
    try:
        out.write(bytearray(head))
        parts = sorted((s for s in fs.listStatus(_at(spark, folder)[1]) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
        for part in parts:
            stream = fs.open(part.getPath())
            try:
                if skip:
                    stream.seek(skip)
                    skip = 0
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, PIECE, False)
            finally:
                stream.close()
        out.write(bytearray(tail))
    finally:
        out.close()
    goal = _at(spark, target)[1]
    if overwrite:
        fs.delete(goal, True)
    if not renamed(spark, aside, target):
        fs.delete(at, False)
        raise FileExistsError(target)


def _through_parts(spark: SparkSession, target: str, write, **options) -> None:
    folder = f"{target}.{uuid.uuid4().hex}.parts"
    try:
        write(folder)
        joined_parts(spark, folder, target, **options)
    finally:
        fs, at = _at(spark, folder)
        fs.delete(at, True)


def write_csv_document(df: DataFrame, path: str, bom: bool = True, overwrite: bool = False) -> None:
    """``df`` as one CSV file with a header, in the order of its partitions; arrays are joined by ``, ``, nulls empty, quotes doubled."""
    flat = [F.array_join(F.col(f"`{c}`").cast("array<string>"), ", ").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    quoted = lambda name: '"' + name.replace('"', '""') + '"' if any(x in name for x in ',"\r\n') else name
    head = (BOM if bom else b"") + ",".join(map(quoted, df.columns)).encode() + b"\n"
    rows = df.select(*flat)
    _through_parts(df.sparkSession, path, lambda folder: rows.write.options(header=False, escape='"', emptyValue="").csv(folder), head=head, overwrite=overwrite)


def write_json_document(rows: DataFrame, path: str, facts: dict | None = None, name: str = "results", overwrite: bool = False) -> None:
    """One JSON object: ``facts``, then ``name`` with an object for each row, in the order of partitions; nulls are written."""
    lines = rows.select(F.concat(F.lit(","), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("line"))
    head = json.dumps(facts or {}, ensure_ascii=False)[:-1] + (", " if facts else "") + json.dumps(name) + ": [\n"
    _through_parts(rows.sparkSession, path, lambda folder: lines.write.text(folder), head=head.encode(), tail=b"]}\n", skip=1, overwrite=overwrite)
