"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size, and the shards
take turns claiming their next free slot until the table is full. A key goes to the shard of the
slot that it hashes to. The table has a fixed size, so it is broadcast and a key is placed by one
look-up; a shard that joins or leaves moves little more than its own share of the keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import unused

#: Slots that a broadcast table may have: about 100 MB.
MOST_SLOTS = 4_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = 65537, turns: dict[str, int] | None = None) -> list[int]:
    """The shard number of every slot; a shard with ``turns`` n claims n slots each time (default 1)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"size must be a prime from the number of shards to {MOST_SLOTS}")
    offset = [_number(f"{s}/offset") % size for s in shards]
    skip = [_number(f"{s}/skip") % (size - 1) + 1 for s in shards]
    turns_of = [(turns or {}).get(s, 1) for s in shards]
    if min(turns_of) < 0 or max(turns_of) < 1:
        raise ValueError("turns must be 0 or more, and some 1 or more")
    place, table, left = list(offset), [-1] * size, size
    while left:
        for i, n in enumerate(turns_of):
            for _ in range(min(n, left)):
                while table[place[i]] >= 0:
                    place[i] = (place[i] + skip[i]) % size
                table[place[i]] = i
                left -= 1
    return table


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the size (null counts as empty)."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(size)


def assign_shards(df: DataFrame, key_col: str, shards: list[str], size: int = 65537, turns: dict[str, int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard_no`` and ``shard`` (name), replacing columns of these names.

    Equal keys always share a shard; null keys are placed like the empty text; no row is lost,
    repeated rows stay, an empty table stays empty. Only a broadcast join of at most MOST_SLOTS
    rows is added: no shuffle, so hot keys cost nothing.
    """
    table = lookup_table(shards, size, turns)
    at, no, name = unused(df, "at", "no", "name")
    slots = df.sparkSession.createDataFrame([(i, n, shards[n]) for i, n in enumerate(table)], f"{at} long, {no} int, {name} string")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard_no", "shard")]
    placed = df.select(*kept, slot_of(F.col(f"`{key_col}`"), size).alias(at))
    return placed.join(F.broadcast(slots), at).select(*kept, F.col(at).alias("slot"), F.col(no).alias("shard_no"), F.col(name).alias("shard"))


def write_shards(df: DataFrame, path: str, key_col: str, shards: list[str], files_per_shard: int = 1, **table) -> None:
    """Write ``df`` below ``path`` in one folder per shard, each in ``files_per_shard`` files of even random parts."""
    placed = assign_shards(df, key_col, shards, **table)
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard_no", part).write.partitionBy("shard").parquet(path)
