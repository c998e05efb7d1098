"""Vectors of texts learned from the texts themselves: weighted token counts on their strongest common directions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as SparkTypes

from callweave.functions import text as T
from callweave.sources.scratch import Tables, fresh

#: Numbers that tokens are hashed to, and directions sought beside those wanted: a model has TOKENS * (dims + SPARE) entries.
TOKENS, SPARE = 1 << 14, 10
#: Tokens whose sums are added up by one task.
SLICE = 256
#: Texts that are multiplied together.
ROWS = 1000


def hashed_tokens(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(T.TOKEN), 0)
    return F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(TOKENS)).cast("int"))


def weights(hashed: pa.Array, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, token and weight of each entry of a sparse matrix: log(1 + count) times the token's rarity, texts scaled to length 1."""
    sizes = np.diff(hashed.offsets.to_numpy())
    tokens = hashed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    key, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * TOKENS + tokens, return_counts=True)
    row, token = key // TOKENS, key % TOKENS
    value = np.log1p(count) * rarity[token]
    length = np.sqrt(np.bincount(row, value**2, len(sizes)))[row]
    return row, token, np.divide(value, length, out=np.zeros(len(value)), where=length > 0)


def projected(row: np.ndarray, token: np.ndarray, value: np.ndarray, directions: np.ndarray, n: int) -> np.ndarray:
    """The sparse matrix times ``directions``."""
    out = np.zeros((n, directions.shape[1]))
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.add.reduceat(value[:, None] * directions[token], first)
    return out


def _product(coded: DataFrame, rarity: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A'A times ``directions``, for A the weighted counts of all texts; tasks' sums are added in slices of tokens."""
    k = directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(directions.shape)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.column(0).slice(i, ROWS)
                row, token, value = weights(part, rarity)
                along = projected(row, token, value, directions, len(part))
                order = np.argsort(token, kind="stable")
                if len(order):
                    first = np.flatnonzero(np.diff(token[order], prepend=-1))
                    total[token[order][first]] += np.add.reduceat(value[order, None] * along[row[order]], first)
        some = [j for j in range(0, TOKENS, SLICE) if total[j : j + SLICE].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[j : j + SLICE].tobytes() for j in some], pa.binary())], names=["slice", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros((SLICE, k))
        for raw in table["sums"]:
            total += np.frombuffer(raw.as_buffer(), float).reshape(-1, k)
        return pa.table({"slice": pa.array([table["slice"][0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(directions.shape)
    for r in coded.mapInArrow(run, "slice int, sums binary").groupBy("slice").applyInArrow(added, "slice int, sums binary").collect():  # the size of the model
        out[r["slice"] : r["slice"] + SLICE] = np.frombuffer(bytes(r["sums"]), float).reshape(-1, k)
    return out


def embed_learned(df: DataFrame, text_col: str, dims: int = 64, out_col: str = "vec", passes: int = 4, seed: int = 0) -> DataFrame:
    """``df`` with a unit vector of ``dims`` entries: a text's weighted token counts on the ``dims`` strongest right singular vectors of all texts' counts.

    Tokens are weighted by how rare they are among the texts. The directions are found by subspace
    iteration: each pass reads all texts once. The largest entry of each is positive. Texts without
    tokens, or only of tokens that all texts have, get the zero vector; so do all in an empty space.
    """
    hashes, found = fresh(df, "hashes", "found")
    coded = df.withColumn(hashes, hashed_tokens(F.col(text_col)))
    with Tables(df.sparkSession) as own:
        texts = own.stored(coded.select(hashes), "tokens")
        n = texts.count()
        counted = texts.select(F.explode(F.array_distinct(hashes)).alias("token")).groupBy("token").count().collect()  # at most TOKENS rows
        rarity = np.zeros(TOKENS)
        for r in counted:
            rarity[r["token"]] = math.log((n + 1) / (r["count"] + 1))
        rng = np.random.default_rng(seed)
        basis = np.linalg.qr(rng.normal(size=(TOKENS, dims + SPARE)))[0]
        for _ in range(passes):
            basis = np.linalg.qr(_product(texts, rarity, basis))[0]
        strength, turn = np.linalg.eigh(basis.T @ _product(texts, rarity, basis))
    directions = (basis @ turn)[:, ::-1][:, :dims]
    directions *= np.sign(directions[np.abs(directions).argmax(0), range(dims)])
    directions[:, strength[::-1][:dims] <= 1e-12 * max(strength[-1], 1e-300)] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i in range(0, len(batch), ROWS):
                part = batch.column(hashes).slice(i, ROWS)
                x = projected(*weights(part, rarity), directions, len(part))
                length = np.sqrt((x**2).sum(1, keepdims=True))
                parts.append(np.divide(x, length, out=np.zeros_like(x), where=length > 1e-12))
            flat = np.concatenate([np.zeros(0), *[p.ravel() for p in parts]])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dims), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, found])

    schema = SparkTypes.StructType([*coded.schema.fields, SparkTypes.StructField(found, SparkTypes.ArrayType(SparkTypes.DoubleType()))])
    return coded.mapInArrow(run, schema).withColumn(out_col, F.col(found)).drop(hashes, *([found] if found != out_col else []))
