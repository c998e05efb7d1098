"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Scratch


#: Edges that one task may join: about 200 MB. More are joined by rounds of shuffles.
ONE_TASK = 500_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of ``batches`` as stars around the least node that they connect; memory as for ONE_TASK edges at most."""
    parent: dict = {}
    kind = None

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], names=["a", "b"])

    n = 0
    for batch in batches:
        kind, n = batch.schema.field("a").type, n + len(batch)
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if n >= ONE_TASK:
            yield stars()
            n = 0
    if parent:
        yield stars()


def components(edges: DataFrame, one_task: int = ONE_TASK, scratch: Scratch | None = None) -> DataFrame:
    """``node`` and ``label`` (its component's least node) for each node of ``edges`` (columns ``a``, ``b``).

    Self-links and null ends are ignored, repeated edges harmless, an empty list gives no rows.
    Partitions first reduce their edges to stars. Up to ``one_task`` stars are then joined in one
    task; more in rounds of shuffles of the edges only, as many as the logarithm of the longest path.
    Tables on the way belong to ``scratch``.
    """
    stored = (scratch or Scratch(edges.sparkSession)).stored
    edges = edges.select("a", "b").where("a <> b")
    kind = edges.schema["a"].dataType.simpleString()
    now = stored(edges.mapInArrow(_stars, f"a {kind}, b {kind}"), "edges")
    if now.count() <= min(one_task, ONE_TASK - 1):
        return _labelled(stored(now.coalesce(1).mapInArrow(_stars, f"a {kind}, b {kind}"), "edges"))
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = stored(small, "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first()
        if state == before and state[0] == state[2]:
            return _labelled(now)
        before = state


def _labelled(stars: DataFrame) -> DataFrame:
    centres = stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres)
