"""What several corpus operators share: tables in the shared folder, and column names that can't clash."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that all executors share.

    A local session without that setting gets a temporary folder; on a cluster its absence raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="callweave-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables that other tables are built from: deleted together once those are stored."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stored(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet (compressed by ``codec``) into the shared folder and read it back: cuts the lineage durably."""
        path = shared_path(self.spark, name)
        df.write.parquet(path, compression=codec)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables; nothing that is still to be computed may read them."""
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


_OWNERS: list[Scratch] = []


@contextmanager
def owned(scratch: Scratch) -> Iterator[None]:
    """Within it, tables that ``stored`` writes belong to ``scratch``, whose owner deletes them once their result is stored itself."""
    _OWNERS.append(scratch)
    try:
        yield
    finally:
        _OWNERS.pop()


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """A table in the shared folder that stays, as the result of an operator may read it, but for an owner (see ``owned``)."""
    return (_OWNERS[-1] if _OWNERS else Scratch(df.sparkSession)).stored(df, name, codec)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` reduced to the columns an operator needs, under its own names: others can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to differ from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
