"""URL rules and block lists by Bloom filter cascades.

The key universe is every key that the corpus can ask for: the host suffixes of its urls, alone and
with their path prefixes of the lengths that occur in the lists. Level 1 of a cascade encodes the
listed keys, level 2 the other keys that pass level 1, level 3 the listed keys that pass level 2,
and so on until nothing passes by mistake. Membership is then exact for the whole universe, and the
table of urls meets neither a join nor a shuffle: only the few keys that pass level 1 are compared
with the lists when the cascade is built.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Scratch, only, stored

ALLOW, BLOCK, HOSTS = "allow", "block", "hosts"
#: Bits of a level, of all lists together, that may be sent to every task: 64 MB, 53 million keys. Beyond it urls are judged by a join.
MOST_BITS = 1 << 29
LEAST_BITS = 64
#: Bits for each key of level 1, and of the later ones: those hold few keys, and what they let pass by mistake, about a tenth, is for the next.
BITS_PER_KEY, LATER_BITS = 10, 5
#: Bits that one group of a level's keys fills.
SEGMENT = 1 << 21
#: A prime above MOST_BITS, below what is hashed.
PRIME = 2147483647
#: Levels after which two keys are taken to share both hashes; the cascade is then built with another seed.
MOST_LEVELS = 40
#: Where urls are judged by a join, a key is hot that makes up more than one part in so many of all.
HOT = 1000


@dataclass(frozen=True)
class Level:
    """One Bloom filter."""

    number: int
    bits: int
    hashes: int
    words: np.ndarray  # of 64 bits

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for i in range(self.hashes):
            at = place(h1, h2, self.number, i, self.bits)
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def place(h1, h2, level: int, i: int, bits: int):
    """The bit of hash ``i`` of a level, of columns or arrays of 31-bit numbers: each level hashes otherwise.

    The sum is taken modulo a prime below it first: otherwise the bit would hang on h1 and h2 modulo
    ``bits`` alone, and keys that agree in these would share all bits of all levels of that size.
    """
    a, b = (int(hashlib.md5(f"{level}/{i}/{x}".encode()).hexdigest()[:7], 16) * 2 + 1 for x in "ab")
    return (h1 * a + h2 * b) % PRIME % bits


def contains(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: those that the first level to refuse them, counted from 0, is odd for."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.arange(len(h1))
    for k, level in enumerate(levels):
        passed = level.passes(h1[open_], h2[open_])
        out[open_[~passed]] = k % 2 == 1
        open_ = open_[passed]
    return out


class TooLarge(Exception):
    """A level needs more than MOST_BITS."""


def _hashes(key: Column, seed: int) -> list[Column]:
    h = F.xxhash64(F.lit(seed), key)
    return [h.bitwiseAND(F.lit(0x7FFFFFFF)).alias("h1"), F.shiftrightunsigned(h, 33).alias("h2")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, most_labels: int, lengths: list[int]) -> Column:
    """Keys of a url, longest first: its host suffixes with path prefixes of ``lengths``, then the suffixes alone."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    sizes = F.sequence(F.least(n, F.lit(most_labels)), F.lit(1))
    suffixes = F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(sizes, lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")))
    longest = sorted(lengths, reverse=True)
    heads = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in longest]), lambda p: p.isNotNull()) if longest else F.array().cast("array<string>")
    full = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))
    return F.concat(full, suffixes)


def _levels(keys: DataFrame, number: int) -> dict[str, Level]:
    """A Bloom filter for each list of ``keys`` (list, h1, h2) that has any. Their segments are collected: MOST_BITS in all at most."""
    counted = {r["list"]: r["count"] for r in keys.groupBy("list").count().collect()}  # a row for each list
    bits = {x: max(LEAST_BITS, n * (LATER_BITS if number else BITS_PER_KEY)) for x, n in sorted(counted.items())}
    if sum(bits.values()) > MOST_BITS:
        raise TooLarge(f"{sum(counted.values())} keys need more than {MOST_BITS} bits")
    hashes = {x: max(1, min(12, round(bits[x] / counted[x] * math.log(2)))) for x in bits}
    words = {x: np.zeros(-(-bits[x] // SEGMENT) * SEGMENT // 64, np.uint64) for x in bits}
    if not bits:
        return {}
    h1, h2, at = F.col("h1"), F.col("h2"), None
    for x in bits:
        own = F.array(*[place(h1, h2, number, i, bits[x]) for i in range(hashes[x])])
        at = F.when(F.col("list") == x, own) if at is None else at.when(F.col("list") == x, own)

    def filled(group: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(SEGMENT, np.uint8)
        own[group["at"].to_numpy() % SEGMENT] = 1
        return pd.DataFrame({"list": [group["list"].iloc[0]], "segment": [group["at"].iloc[0] // SEGMENT], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    segments = keys.select("list", F.explode(at).alias("at")).groupBy("list", F.expr(f"at div {SEGMENT}").alias("segment"))
    for row in segments.applyInPandas(filled, "list string, segment long, bits binary").toLocalIterator():
        words[row["list"]][row["segment"] * SEGMENT // 64 :][: SEGMENT // 64] = np.frombuffer(row["bits"], np.uint64)
    return {x: Level(number, bits[x], hashes[x], words[x]) for x in bits}


def _passing(keys: DataFrame, levels: dict[str, Level]) -> DataFrame:
    """``keys`` with each ``list`` whose level lets them pass; those that have a list already meet its level alone."""
    sent = keys.sparkSession.sparkContext.broadcast(levels)
    listed = "list" in keys.columns
    others = [c for c in keys.columns if c != "list"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, level in sent.value.items():
                own = batch.filter(pc.equal(batch.column("list"), name)) if listed else batch
                own = own.filter(pa.array(level.passes(own.column("h1").to_numpy(), own.column("h2").to_numpy()), pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), *(own.column(c) for c in others)], names=["list", *others])

    return keys.mapInArrow(run, ", ".join(["list string", *(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields if f.name != "list")]))


def cascades(asked: DataFrame, lists: DataFrame, scratch: Scratch, seed: int = 0) -> tuple[int, dict[str, list[Level]]]:
    """A seed and, for each list, levels that tell which keys of ``asked`` (column ``key``, repeats allowed) are on it.

    ``lists`` has distinct rows of ``list`` and ``key``. All lists go together: level 1 comes from them
    alone, and one pass over the keys asked for meets it. What passes is made distinct, and the join
    with the lists that finds the mistakes among it reads nothing else.
    """
    while True:
        inside = scratch.stored(lists.select("list", *_hashes(F.col("key"), seed)), "listed")
        now = _levels(inside, 0)
        levels = {x: [level] for x, level in now.items()}
        if not levels:
            return seed, {}
        passed = _passing(asked.select("key", *_hashes(F.col("key"), seed)), now).distinct()
        outside = scratch.stored(passed.join(lists, ["list", "key"], "left_anti").select("list", "h1", "h2"), "passing")
        for number in range(1, MOST_LEVELS):
            now = _levels(outside, number)
            for x, level in now.items():
                levels[x].append(level)
            if not now:
                return seed, levels
            inside, outside = outside, scratch.stored(_passing(inside, now), "passing")
        seed += 1


def cascade(asked: DataFrame, listed: DataFrame, scratch: Scratch, seed: int = 0) -> tuple[int, list[Level]]:
    """What ``cascades`` gives for one list of distinct ``key``."""
    seed, levels = cascades(asked, listed.select(F.lit("").alias("list"), "key"), scratch, seed)
    return seed, levels.get("", [])


def _judged(pages: DataFrame, seed: int, levels: dict[str, list[Level]], kind: str) -> DataFrame:
    """The rows of ``pages`` (id, host, path, keys) with what the cascades say of their keys."""
    sent = pages.sparkSession.sparkContext.broadcast(levels)
    half = lambda i: F.transform("keys", lambda k: _hashes(k, seed)[i]).alias(f"hash{i}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists_of = batch.column("keys")
            row = lists_of.value_parent_indices().to_numpy()
            key = lists_of.flatten()
            h1, h2 = (batch.column(f"hash{i}").flatten().to_numpy() for i in (0, 1))
            blocked, allowed, bad = (contains(sent.value.get(x, []), h1, h2) for x in (BLOCK, ALLOW, HOSTS))
            hits = np.flatnonzero(blocked | allowed)
            rows, first = np.unique(row[hits], return_index=True)
            rule = np.full(len(batch), -1)
            rule[rows] = hits[first]
            stop = np.zeros(len(batch), bool)
            stop[row[bad]] = True
            stop[rows] = blocked[rule[rows]]
            rules = key.take(pa.array(rule, mask=rule < 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path")), rules, pa.array(np.where(stop, BLOCK, ALLOW), pa.string())], names=["id", "host", "path", "rule", "verdict"])

    return pages.select("id", "host", "path", "keys", half(0), half(1)).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")


def _joined(pages: DataFrame, lists: DataFrame) -> DataFrame:
    """What ``_judged`` gives, by a join of all keys with lists that no filter can hold.

    Keys that make up more than one part in HOT of all (fewer than HOT) meet their lists by a
    broadcast, so that a top-level domain doesn't fill a task; the others by a shuffle.
    """
    rows = stored(pages.withColumn("row", F.monotonically_increasing_id()), "pages")
    flags = lists.groupBy("key").agg(*[F.bool_or(F.col("list") == x).alias(x) for x in (ALLOW, BLOCK, HOSTS)])
    asked = rows.select("row", F.posexplode("keys").alias("place", "key"))
    n = asked.count()
    hot = stored(asked.groupBy("key").count().where(F.col("count") * HOT > n).select("key"), "hot")
    common = F.broadcast(stored(flags.join(F.broadcast(hot), "key", "left_semi"), "hot"))
    rare = asked.join(F.broadcast(hot), "key", "left_anti").join(flags, "key")
    hits = asked.join(common, "key").unionByName(rare)
    best = F.min(F.when(F.col(ALLOW) | F.col(BLOCK), F.struct("place", "key", BLOCK)))
    told = hits.groupBy("row").agg(best.alias("best"), F.bool_or(HOSTS).alias("bad"))
    stop = F.coalesce(F.col(f"best.{BLOCK}"), F.col("bad"), F.lit(False))
    return rows.join(told, "row", "left").select("id", "host", "path", F.col("best.key").alias("rule"), F.when(stop, BLOCK).otherwise(ALLOW).alias("verdict"))


def judge_urls(df: DataFrame, lists: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    ``lists`` has columns ``list`` and ``key``: rules as host and path joined (lists ``allow`` and
    ``block``) or whole hosts (list ``hosts``). A rule fits its host and all subdomains where the
    path begins with the rule's; the rule of the longest host, then path, decides, and blocking wins
    if it is listed both ways. Without a rule, urls whose host or parent domain is in ``hosts`` are
    blocked, all others allowed (empty and null urls too). Null keys are ignored; repeated rows and
    null ids give a row each; an empty table gives none; other columns are ignored.
    """
    scratch = Scratch(df.sparkSession)
    lists = scratch.stored(lists.where("key is not null and key <> ''").select("list", "key").distinct(), "lists")
    shape = lists.agg(
        F.max(F.size(F.split(F.regexp_extract("key", "^([^/]*)", 1), r"\."))).alias("labels"),
        F.collect_set(F.length(F.regexp_extract("key", "^[^/]*(.*)$", 1))).alias("lengths"),
    ).first()
    host, path = split_url(F.col("url"))
    pages = only(df, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), shape["labels"] or 1, [n for n in shape["lengths"] if n])
    pages = pages.withColumn("keys", keys)
    asked = pages.select(F.explode("keys").alias("key"))
    try:
        judged = _judged(pages, *cascades(asked, lists.where(F.col("list").isin(ALLOW, BLOCK, HOSTS)), scratch), pages.schema["id"].dataType.simpleString())
    except TooLarge:
        judged = _joined(pages, stored(lists, "lists"))
    scratch.drop()
    return judged.withColumnRenamed("id", id_col)
