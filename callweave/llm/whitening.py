"""Whitening of embeddings: exact sums, covariances by pairwise merging, principal components of unit variance.

A partition's count, mean and centred scatter come from its batches, and those of all partitions from
its own, by the same formula for two disjoint sets of rows (Chan, Golub and LeVeque): the scatters add
up, with that of the two means about their common one. A tree of reduce steps merges them, so the
driver sees a few states of the size of one. The driver takes the eigenvectors; a second pass over the
whitened rows measures how far their covariance is from the identity.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Scratch, only

#: Steps of an entry's grid: entries are rounded down to parts of this.
GRID = 256
#: Entries of this magnitude on the grid and more count as not finite.
LARGEST = 1 << 40
#: Eigenvalues below this part of the largest are zero.
FLAT = 1e-13
#: Rows that are centred together.
ROWS = 4096

#: The state of a set of rows: count, exact sums (integers, None for rows that aren't), mean, centred scatter.
State = tuple[int, "list[int] | None", np.ndarray, np.ndarray]


def merged(a: State, b: State) -> State:
    """The state of two disjoint sets of rows."""
    (n, sums, mean, scatter), (m, sums_b, mean_b, scatter_b) = a, b
    if not n or not m:
        return b if not n else a
    gap = mean_b - mean
    whole = n + m
    both = [x + y for x, y in zip(sums, sums_b, strict=True)] if sums is not None else None
    return whole, both, mean + gap * (m / whole), scatter + scatter_b + np.outer(gap, gap) * (n * m / whole)


def state_of(x: np.ndarray) -> State:
    """The state of the rows of ``x``; sums are exact if they are integers."""
    exact = np.issubdtype(x.dtype, np.integer)
    rows = x.astype(np.float64)
    mean = rows.mean(0)
    centred = rows - mean
    return len(x), x.sum(0).tolist() if exact else None, mean, centred.T @ centred


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """The rows of an Arrow array of lists of ``dims`` entries."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def moments(df: DataFrame, column: str, project: np.ndarray | None = None, centre: np.ndarray | None = None) -> State:
    """The state of all rows of ``column``, vectors of one length (or of their projections from ``centre``), merged in a tree of tasks.

    There must be rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                some = batch.column(0).slice(i, ROWS)
                x = matrix(some, len(some[0]))
                new = state_of(x if project is None else (x - centre) @ project)
                own = new if own is None else merged(own, new)
        if own is not None:
            n, sums, mean, scatter = own
            said = json.dumps(sums)  # integers of any size
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([said]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([scatter.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "sums", "mean", "scatter"])

    def state(row) -> State:
        return row["n"], json.loads(row["sums"]), np.array(row["mean"]), np.array(row["scatter"]).reshape(len(row["mean"]), -1)

    states = df.select(column).mapInArrow(run, "n long, sums string, mean array<double>, scatter array<double>").rdd.map(state)
    # A step merges about eight states, so that neither a task nor the driver holds many of them.
    return states.treeReduce(merged, max(2, -(-states.getNumPartitions().bit_length() // 3)))


def squares(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row of integers below 2^62."""
    if not d.size or int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 62:
        return (d * d).sum(1).tolist()
    a, b, c = d >> 40, (d >> 20) & 0xFFFFF, d & 0xFFFFF
    parts = [(x * y).sum(1).tolist() for x, y in ((a, a), (a, b), (a, c), (b, b), (b, c), (c, c))]
    return [(aa << 80) + (ab << 61) + (ac << 41) + (bb << 40) + (bc << 21) + cc for aa, ab, ac, bb, bc, cc in zip(*parts, strict=True)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n * x - sum) ** 2; None where it doesn't fit a long."""
    far = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) >= 1 << 62
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()] if far else squares(n * x - np.array(sums, np.int64))
    return [v if v < 1 << 63 else None for v in found]


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """Per usable row and component: the id, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Entries become x = floor(GRID * entry). The model is fitted on each distinct x once: ``n`` of them,
    their sums S, and the unit eigenvectors of their covariance by falling eigenvalue e, the largest
    entry of each positive. ``deviation`` is the exact sum of (n * x - S)^2 (null if no long holds it),
    ``whitened`` the projection of x - S / n divided by the root of e, ``explained`` e's part of the
    total variance, ``identity_error`` the largest entry of the whitened covariance minus the identity.

    Rows are dropped whose vector is null, empty, of another length than most distinct ones (at a tie:
    than the longer), or holds an entry that is null, not finite or LARGEST / GRID and more. Repeated
    rows and null ids give rows each. Components without variance (all vectors alike, a single one)
    have ``whitened`` null and ``explained`` 0, and are left out of ``identity_error`` (0 if none is
    left); vectors of fewer dimensions have as many components. A table without usable rows gives none.
    """
    source = only(df, id=id_col, vector=vector_col)
    kind = source.schema["id"].dataType.simpleString()
    usable = F.forall("vector", lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST / GRID, F.lit(False))) & (F.size("vector") > 0)
    rows = source.where(usable).select("id", F.transform("vector", lambda c: F.floor(c.cast("double") * GRID)).alias("x"))

    scratch = Scratch(df.sparkSession)
    fit = scratch.stored(rows.select("x").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if lengths is None:
        scratch.drop()
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    dims = lengths["dims"]
    fit = fit.where(F.size("x") == dims)
    n, sums, _, scatter = moments(fit, "x")
    values, vectors = np.linalg.eigh(scatter / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
    total = float(np.trace(scatter)) / n
    varied = values > max(values[0], 0) * FLAT
    project, centre = vectors[:, varied] / np.sqrt(values[varied]), np.array([s / n for s in sums])
    error = 0.0
    if varied.any():
        count, _, _, spread = moments(fit, "x", project, centre)
        error = float(np.abs(spread / count - np.eye(len(spread))).max())
    scratch.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            found = np.zeros((len(x), len(varied)))
            found[:, varied] = (x - centre) @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(varied)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(deviations(x, n, sums), pa.int64()), lists], names=["id", "deviation", "found"])

    projected = rows.where(F.size("x") == dims).mapInArrow(run, f"id {kind}, deviation long, found array<double>")
    each = projected.select("id", "deviation", F.posexplode("found").alias("at", "value"))
    parts = F.array(*[F.lit(float(e) / total if ok else 0.0) for e, ok in zip(values, varied, strict=True)])
    known = F.element_at(F.array(*[F.lit(bool(ok)) for ok in varied]), F.col("at") + 1)
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(known, F.col("value")).alias("whitened"), F.element_at(parts, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
