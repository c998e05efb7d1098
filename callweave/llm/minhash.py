"""MinHash near-duplicates by an LSH forest.

Documents of equal shingle sets form a class, and one member stands for it. A class stands in
several sorted orders (trees); each reads other values of its signature. In an order, classes whose
longest common prefix has ``first`` values or more make up a region, and prefixes deepen until a part
holds at most ``part`` classes, all of whose pairs are candidates; beyond the deepest prefix, and always
beside it, the neighbours in the order are. Candidates are confirmed on full sets.

Regions that were not compared in full (large ones, and those that a block of the sorted order
cuts) are compared again once components are known: all members outside of the region's largest
component meet all its members in blocks of bounded size, first on whole signatures, then those that
may be linked on full sets. This holds for every region, whatever its size, so that the links don't
depend on it. Where many members lie outside (ODD_ONES), two steps before that make the work
smaller and lose nothing: members are compared with those at the region's centre (a large group of
near copies of one text becomes one component), and members with so many shingles of their own that
nothing can be linked with them are left out (unlike documents that share a piece of text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import shingles
from callweave.llm.common import Scratch, only, stored, unused
from callweave.llm.components import components

DEEPEST, PART = 8, 8
#: Rows of a sorted order that are looked at together.
BLOCK_ROWS = 100_000
#: Members of a large region that meet in one task, on either side.
BLOCK = 1000
BLOCK_SHINGLES = 1_000_000
#: Members outside of its largest component beyond which (or beyond as many pairs as they make with BLOCK others) a region is made smaller
#: before it is compared in blocks. No link depends on it.
ODD_ONES = 2000
#: Members at the centre of such a region that meet all others first.
CENTRES = 4
#: Pairs that a shared shingle may bring to be counted one by one; those of commoner shingles are counted by products of matrices.
SINGLY = 4000
#: Candidates of a class that are confirmed first.
TRIED_FIRST = 3
#: Classes of more than this share of all rows are hot: fewer than its inverse, so they are broadcast.
HOT_SHARE = 0.001


@dataclass(frozen=True)
class Forest:
    """For a similarity in percent: values of a prefix that make a region, trees, and the least values that a link shares.

    A pair at the threshold meets in no tree with a probability below 2e-5, and shares fewer values
    than ``shared`` with one below 1e-8; both fall steeply above the threshold.
    """

    percent: int

    @property
    def first(self) -> int:
        return 4 if self.percent >= 85 else 3 if self.percent >= 75 else 2 if self.percent >= 55 else 1

    @property
    def trees(self) -> int:
        return shingles.VALUES // self.first

    @property
    def shared(self) -> int:
        p = self.percent / 100
        return max(1, int(shingles.VALUES * p - 6.5 * (shingles.VALUES * p * (1 - p)) ** 0.5))


def sketch(df: DataFrame, size: int) -> DataFrame:
    """``id``, ``n_shingles``, ``node`` (key of the set; null if empty) and ``values`` of columns ``id`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, starts in shingles.runs(batch.column("text")):
                sets = shingles.shingle_sets(data, starts, size)
                keys = [shingles.set_key(s) if len(s) else None for s in sets]
                filled = [s for s in sets if len(s)]
                rows = iter(shingles.signatures(filled)) if filled else iter(())
                values = [next(rows).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())],
                    names=["id", "n_shingles", "node", "values"],
                )

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n_shingles long, node binary, values binary")


def _paths(forest: Forest):
    """A row for each class and tree: the values that the tree's order reads first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if n:
                values = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.uint16).reshape(n, -1)
                for tree in range(forest.trees):
                    read = values[:, [(forest.first * tree + j) % values.shape[1] for j in range(DEEPEST)]].astype(">u2")
                    path = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DEEPEST), n, [None, pa.py_buffer(read.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, tree, np.int32)), path, batch.column("node")], names=["tree", "path", "node"])

    return run


def neighbours(read: np.ndarray, first: int, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows (tree, then path values): candidate places i and j, and which rows' regions need another look."""
    n = len(read)
    same = np.cumprod(read[1:] == read[:-1], axis=1).sum(1) - 1 if n > 1 else np.zeros(0, int)  # common path values of row i and i + 1; -1: other tree
    reach = np.full(n, DEEPEST)
    parts = {}
    for depth in range(DEEPEST, first - 1, -1):
        label = np.concatenate(([0], np.cumsum(same < depth)))
        size = np.bincount(label)[label]
        parts[depth] = label
        reach[size <= part] = depth
        if depth == first:
            rest = size > part
            rest |= (label == label[0]) | (label == label[-1])
    left, right = [], []
    common = np.full(n, DEEPEST)
    for step in range(1, part):
        if n <= step:
            break
        common = np.minimum(common[: n - step], same[step - 1 :])  # of row i and i + step
        i = np.flatnonzero(common >= np.where(step == 1, first, reach[: n - step]))
        left.append(i)
        right.append(i + step)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right]), np.flatnonzero(rest) if n else empty


def _regions(forest: Forest):
    """Candidate pairs (a, b) and rows of regions that need another look (a; region), from a sorted order."""

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n = len(rows)
        tree = rows.column("tree").to_numpy()
        path = np.frombuffer(b"".join(rows.column("path").to_pylist()), ">u2").reshape(n, DEEPEST)
        node = rows.column("node").combine_chunks()
        i, j, rest = neighbours(np.column_stack([tree, path]).astype(np.int64), forest.first)
        region = [b"%c" % tree[k] + path[k, : forest.first].tobytes() for k in rest]
        yield pa.RecordBatch.from_arrays([node.take(pa.array(i)), node.take(pa.array(j)), pa.nulls(len(i), pa.binary())], names=["a", "b", "region"])
        yield pa.RecordBatch.from_arrays([node.take(pa.array(rest)), pa.nulls(len(rest), pa.binary()), pa.array(region, pa.binary())], names=["a", "b", "region"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield from found(pa.Table.from_batches(held))
                held = []
        if sum(map(len, held)):
            yield from found(pa.Table.from_batches(held))

    return run


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``node`` and ``text`` of each class in ``nodes``."""
    named = nodes.select("node").distinct().join(classes.select("node", "rep"), "node")
    return docs.join(named, docs["id"] == named["rep"]).select("node", "text").mapInArrow(_own_texts(size), "node binary, text string").dropDuplicates(["node"])


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    return [s for _, data, starts in shingles.runs(texts) for s in shingles.shingle_sets(data, starts, size)]


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``pairs`` (a, b of classes) with column ``linked``: 100 * intersection >= ``percent`` * union of the full sets."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(_sets(batch.column("text_a"), size), _sets(batch.column("text_b"), size), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, linked boolean")


def _own_texts(size: int):
    """Keeps the texts whose set is the class's: rows that share an id may have other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = map(shingles.set_key, _sets(batch.column("text"), size))
            yield batch.filter(pa.array([k == n for k, n in zip(keys, batch.column("node").to_pylist(), strict=True)], pa.bool_()))

    return run


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` whose ends lie in different components."""
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _may_link(group: pd.DataFrame, forest: Forest, earlier: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The odd members of a block, its other ones, and which pairs of both may be linked across components.

    A pair is linked only if the shingles that either doesn't have alone suffice for the threshold. With
    ``earlier``, pairs that share an earlier region are left out, as they are compared there.
    """
    tree = group["region"].iloc[0][0] if earlier else 0
    odd, every = np.flatnonzero(group["odd"]), np.flatnonzero(~group["odd"])
    values = np.frombuffer(b"".join(group["values"]), np.uint16).reshape(len(group), -1)
    label = pd.factorize(group["label"])[0]
    size, most = group["n_shingles"].to_numpy(), (group["n_shingles"] - group["own"]).to_numpy()
    both = np.minimum(most[odd][:, None], most[every])
    look = (label[odd][:, None] != label[every]) & (100 * both >= forest.percent * (size[odd][:, None] + size[every] - both))
    kept, met = np.flatnonzero(look.any(1)), np.flatnonzero(look.any(0))
    odd, every, look = odd[kept], every[met], look[np.ix_(kept, met)]
    shared = np.zeros(look.shape, np.uint8)
    left, right = (np.ascontiguousarray(values[x].T) for x in (odd, every))
    for first in range(0, shingles.VALUES, forest.first):
        together = np.ones(look.shape, bool)
        for k in range(first, min(first + forest.first, shingles.VALUES)):
            same = left[k][:, None] == right[k]
            shared += same
            together &= same
        if first < forest.first * tree:
            look &= ~together
    return odd, every, look & (shared >= forest.shared)


def _hopeful(forest: Forest, earlier: bool):
    """The members of a block that may be linked across components."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        odd, every, look = _may_link(group, forest, earlier)
        return group.iloc[np.sort(np.concatenate([odd[look.any(1)], every[look.any(0)]]))]

    return run


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``left`` shares with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not out.size:
        return out
    flat, owner = [np.concatenate(x) for x in (left, right)], [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right)]
    every = np.intersect1d(flat[0], flat[1])
    place, n = [], []
    for side in (0, 1):
        at = np.minimum(np.searchsorted(every, flat[side]), max(0, len(every) - 1))
        found = every[at] == flat[side] if len(every) else np.zeros(len(at), bool)
        order = np.argsort(at[found], kind="stable")
        place.append(at[found][order])
        owner[side] = owner[side][found][order]
        n.append(np.bincount(place[side], minlength=len(every)))
    many = n[0] * n[1] > SINGLY
    number = np.cumsum(many) - 1
    for first in range(0, int(many.sum()), 2048):
        sides = []
        for side, x in enumerate((left, right)):
            own = many[place[side]] & (number[place[side]] >= first) & (number[place[side]] < first + 2048)
            dense = np.zeros((len(x), 2048), np.float32)
            dense[owner[side][own], number[place[side][own]] - first] = 1
            sides.append(dense)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    few = np.flatnonzero(~many[place[0]])
    starts, counts = (np.cumsum(n[1]) - n[1])[place[0][few]], n[1][place[0][few]]
    ends = np.cumsum(counts)
    i = 0
    while i < len(few):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 2_000_000, side="right")))
        own = counts[i:j]
        within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        pairs = np.repeat(owner[0][few[i:j]], own) * len(right) + owner[1][np.repeat(starts[i:j], own) + within]
        out += np.bincount(pairs, minlength=out.size).reshape(out.shape)
        i = j
    return out


def _links_of_block(size: int, forest: Forest, earlier: bool):
    """Links that join components, of a block of odd members with a block of all members of a region."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        odd, every, look = _may_link(group, forest, earlier)
        kept, met = np.flatnonzero(look.any(1)), np.flatnonzero(look.any(0))
        odd, every, look = odd[kept], every[met], look[np.ix_(kept, met)]
        left, right = (_sets(pa.array(group["text"].iloc[x], pa.large_string()), size) for x in (odd, every))
        both = common(left, right)
        union = np.array([len(x) for x in left], np.int64)[:, None] + np.array([len(x) for x in right], np.int64) - both
        linked = look & (100 * both >= forest.percent * union)
        nodes, (labels, names) = group["node"].to_list(), pd.factorize(group["label"])
        merged = np.arange(len(names))  # the components that this block has joined
        out = []
        for i in np.flatnonzero(linked.any(1)):
            others = every[linked[i]]
            joined, at = np.unique(merged[labels[others]], return_index=True)
            own = merged[labels[odd[i]]]
            out += [(*sorted((nodes[odd[i]], nodes[others[k]])), True) for c, k in zip(joined, at, strict=True) if c != own]
            merged[np.isin(merged, joined)] = own
        return pd.DataFrame(out, columns=["a", "b", "linked"])

    return run


def spread_join(rows: DataFrame, named: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``named``, which has a row for each key with its number of ``rows`` in column ``size``.

    Keys of more than HOT_SHARE of all ``total`` rows are fewer than its inverse: they are broadcast, so
    that no task gathers them. The others are joined by Spark's own choice.
    """
    hot = F.col(size) > total * HOT_SHARE
    many, few = named.where(hot).drop(size), named.where(~hot).drop(size)
    others = rows.join(F.broadcast(many.select(key)), key, "left_anti").join(few, key)
    return rows.join(F.broadcast(many), key).unionByName(others)


def near_in_order(read: np.ndarray, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows (group, then values): places i and j of rows of one group in a part of at most ``part`` rows, as deep as it takes; neighbours always."""
    n, deepest = len(read), read.shape[1] - 1
    same = np.cumprod(read[1:] == read[:-1], axis=1).sum(1) - 1 if n > 1 else np.zeros(0, int)
    reach = np.full(n, deepest)
    for depth in range(deepest, 0, -1):
        label = np.concatenate(([0], np.cumsum(same < depth)))
        small = np.bincount(label)[label] <= part
        reach[small] = depth
        if not small.any():
            break
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    common = np.full(n, deepest)
    for step in range(1, min(part, n)):
        common = np.minimum(common[: n - step], same[step - 1 :])
        i = np.flatnonzero(common >= (0 if step == 1 else reach[: n - step]))
        left.append(i)
        right.append(i + step)
    return np.concatenate(left), np.concatenate(right)


def _mixed(rows: DataFrame) -> DataFrame:
    """The regions of ``rows`` (region, label, n_shingles) with several components: the largest one, sizes, and those of the members outside of it."""
    sizes = rows.groupBy("region", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    mixed = sizes.groupBy("region").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"),
        F.sum("n").alias("every"),
        F.sum("weight").alias("weight"),
        (F.sum("n") - F.max("n")).alias("odd_ones"),
        (F.sum("weight") - F.max_by("weight", F.struct("n", "label"))).alias("odd_weight"),
        F.count("*").alias("parts"),
        F.sum("n").alias("size"),
    )
    return mixed.where("parts > 1").drop("parts")


def _blocks(n: str, weight: str):
    return F.ceil(F.greatest(F.col(n) / F.lit(BLOCK), F.col(weight) / F.lit(BLOCK_SHINGLES))).cast("int")


def _own_block(kind: str, blocks):
    return F.pmod(F.xxhash64("node", F.lit(kind)), blocks).cast("int")


#: What the blocks of a region's members hold.
_MET = ["region", "node", "label", "n_shingles", "own", "values"]


def _links_of(met: DataFrame, texts: DataFrame, size: int, forest: Forest, scratch: Scratch, earlier: bool) -> DataFrame:
    """Links (a, b, linked) of blocks ``met`` (_MET, odd, i, j)."""
    hopeful = scratch.stored(met.groupBy("region", "i", "j").applyInPandas(_hopeful(forest, earlier), met.schema), "hopeful")
    return hopeful.join(texts, "node").groupBy("region", "i", "j").applyInPandas(_links_of_block(size, forest, earlier), "a binary, b binary, linked boolean")


def _central(group: pd.DataFrame) -> pd.DataFrame:
    """The members of a block that agree most with its commonest values."""
    values = np.frombuffer(b"".join(group["values"]), np.uint16).reshape(len(group), -1)
    common_values = np.array([np.bincount(v).argmax() for v in values.T])
    agree = (values == common_values).sum(1)
    best = np.argsort(-agree, kind="stable")[:CENTRES]
    return group.iloc[best][["region", "node"]].assign(agree=agree[best].astype(np.int64))


def links_at_centres(rows: DataFrame, mixed: DataFrame, total: int, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b, linked) of members with the CENTRES members at the centre of a region in ``mixed``; each member meets those of one region."""
    rows = scratch.stored(spread_join(rows, mixed.select("region", "size", _blocks("every", "weight").alias("blocks")), "region", "size", total).withColumn("j", _own_block("every", F.col("blocks"))), "hot")
    central = rows.select("region", "node", "values", "j").groupBy("region", "j").applyInPandas(_central, "region binary, node binary, agree long")
    best = central.groupBy("region").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("agree", "node")))), 1, CENTRES).alias("best"))
    chosen = scratch.stored(best.select("region", F.explode("best.node").alias("node")), "centres")
    odd = rows.join(chosen, ["region", "node"]).select(*_MET, F.lit(True).alias("odd"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    once = rows.groupBy("node").agg(F.min("region").alias("region"))
    every = rows.join(once, ["node", "region"]).select(*_MET, F.lit(False).alias("odd"), F.lit(0).alias("i"), "j")
    return _links_of(every.unionByName(odd), texts, size, Forest(percent), scratch, earlier=False)


def own_shingles(texts: DataFrame, size: int) -> DataFrame:
    """``node`` and ``own``: how many shingles each class has that no other class of ``texts`` has (without those that have none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, starts in shingles.runs(batch.column("text")):
                sets = shingles.shingle_sets(data, starts, size)
                found, at, n = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
                node = batch.column("node").take(pa.array(first + np.repeat(np.arange(len(sets)), [len(s) for s in sets])[at]))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), node, pa.array(n)], names=["shingle", "node", "n"])

    counted = texts.select("node", "text").mapInArrow(run, "shingle long, node binary, n long").groupBy("shingle").agg(F.sum("n").alias("n"), F.any_value("node").alias("node"))
    return counted.where("n = 1").groupBy("node").agg(F.count("*").alias("own"))


def links_across(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b, linked) that join different components in the regions of ``members`` (region, node)."""
    forest, found = Forest(percent), []
    rows = scratch.stored(members.join(classes.select("node", "n_shingles"), "node").withColumn("own", F.lit(0).cast("long")), "members")
    total, kept = rows.count(), ["region", "node", "n_shingles", "own"]

    def joined(links: DataFrame) -> DataFrame:
        found.append(scratch.stored(links, "links"))
        edges = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found[-1].where("linked").select("a", "b"))
        return scratch.stored(components(edges, scratch=scratch), "labels")

    def crowded() -> DataFrame:
        pairs = F.col("odd_ones") * F.col("every") > ODD_ONES * BLOCK
        return scratch.stored(_mixed(_labelled(rows, labels)).where((F.col("odd_ones") > ODD_ONES) | pairs), "mixed")

    def signed() -> DataFrame:
        return _labelled(rows, labels).join(classes.select("node", "values"), "node")

    hot = crowded()
    if not hot.isEmpty():
        labels = joined(links_at_centres(signed(), hot, total, texts, size, percent, scratch))
        hot = crowded()
    if not hot.isEmpty():
        inside = scratch.stored(spread_join(rows.select(*kept), hot.select("region", "size"), "region", "size", total), "hot")
        # Only members of these regions are counted, so the counts say nothing about members of other regions.
        own = own_shingles(texts.join(inside.select("node").distinct(), "node", "left_semi"), size)
        inside = scratch.stored(inside.drop("own").join(own, "node", "left").fillna(0, "own").where(100 * (F.col("n_shingles") - F.col("own")) >= percent * F.col("n_shingles")), "hot")
        outside = rows.join(F.broadcast(hot.select("region")), "region", "left_anti")
        rows = scratch.stored(outside.select(*kept).unionByName(inside.select(*kept)), "members")
    rows = scratch.stored(_labelled(rows, labels), "members")
    rows = scratch.stored(spread_join(rows, scratch.stored(_mixed(rows), "mixed"), "region", "size", total), "members")
    kinds = {"every": _blocks("every", "weight"), "odd": _blocks("odd_ones", "odd_weight")}
    last = lambda kind: F.sequence(F.lit(0), kinds[kind] - 1)
    signatures = rows.join(classes.select("node", "values"), "node")
    every = signatures.select(*_MET, F.lit(False).alias("odd"), F.explode(last("odd")).alias("i"), _own_block("every", kinds["every"]).alias("j"))
    odd = signatures.where(F.col("label") != F.col("main")).select(*_MET, F.lit(True).alias("odd"), _own_block("odd", kinds["odd"]).alias("i"), F.explode(last("every")).alias("j"))
    out = _links_of(every.unionByName(odd), texts, size, forest, scratch, earlier=True)
    for links in found:
        out = out.unionByName(links)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (least id reachable over links) and ``kept`` (it is the own id).

    Texts are linked where 100 * intersection >= ``percent`` * union of their sets of ``size``-word
    shingles; a null, empty or wordless text has no shingle and no link. Rows of equal sets share a
    component. Rows with a null id take no part: no component, not kept. Rows that repeat an id are
    judged by their own text. An empty table gives no rows; other columns are ignored.
    """
    docs, forest, scratch = only(df, id=id_col, text=text_col), Forest(percent), Scratch(df.sparkSession)
    keep = scratch.stored
    sketched = stored(sketch(docs, size), "sketches")
    told = sketched.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("rep"), F.any_value("values").alias("values"), F.any_value("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    classes = keep(told, "classes")
    ordered = classes.select("node", "values").mapInArrow(_paths(forest), "tree int, path binary, node binary").repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    found = keep(ordered.mapInArrow(_regions(forest), "a binary, b binary, region binary"), "regions")
    members = found.where("region is not null").select("region", F.col("a").alias("node"))
    pairs = found.where("region is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("met"))
    pairs = keep(pairs, "pairs")
    # The one shuffle of whole texts: later steps join those of classes that may have links.
    texts = keep(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")), classes, docs, size), "texts")

    # The candidates met in most trees come first; most others then lie within one component.
    sides = pairs.select(F.col("a").alias("node"), "a", "b", "met").unionByName(pairs.select(F.col("b").alias("node"), "a", "b", "met"))
    ranked = sides.groupBy("node").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("met", F.xxhash64("a", "b").alias("h"), "a", "b")))), 1, TRIED_FIRST).alias("best"))
    first = ranked.select(F.explode("best").alias("p")).select("p.a", "p.b").distinct()
    tried = keep(confirmed(first, texts, size, percent), "links")
    labels = keep(components(tried.where("linked"), scratch=scratch), "labels")

    more = keep(links_across(members, labels, classes, texts, size, percent, scratch), "links")
    rest = across(pairs.select("a", "b"), labels).join(tried, ["a", "b"], "left_anti")
    later = keep(confirmed(keep(rest, "pairs"), texts, size, percent), "links")
    labels = keep(components(tried.unionByName(later).unionByName(more).where("linked"), scratch=scratch), "labels")

    named = labels.join(classes.select("node", "rep"), "node")
    linked = named.join(named.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("node", "component_id")
    ids = stored(classes.select("node", "rep", "n").join(linked, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"), "n"), "components")
    scratch.drop()

    # Rows of hot classes take a broadcast of fewer than 1 / HOT_SHARE rows, rows without a class none: neither gathers in a task.
    total = ids.agg(F.sum("n")).first()[0] or 0
    rows = sketched.select("id", "n_shingles", "node")
    single = F.col("node").isNull() | F.col("id").isNull()
    alone = rows.where(single).withColumn("component_id", F.col("id"))
    shared = spread_join(rows.where(~single), ids, "node", "n", total)
    columns = ["id", "n_shingles", "component_id"]
    out = alone.select(*columns).unionByName(shared.select(*columns))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``df`` for each component of ``near_duplicates``, that of the least id, with its own columns.

    Here a row goes by its id and text together: each row of a repeated id is judged by its own text,
    and of rows that repeat both one stays. Rows with a null id take part, after all others. Rows
    without a shingle are no copies and stay.
    """
    mark, copy_id, copy_digest, keep = unused(df, "digest", "copy_id", "copy_digest", "keep")
    # Never null, so that both joins below ask for the same exchange: whole texts are shuffled once at most.
    digest = F.coalesce(F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))), F.lit(b""))
    own_id = F.col(f"`{id_col}`")
    named = df.select(F.struct(own_id.isNull().alias("absent"), own_id.alias("id"), digest.alias("digest")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    judged = near_duplicates(named, "id", "text", size, percent)
    seen = judged.groupBy("id").agg(F.count("*").alias("n"), F.first("kept").alias(keep), F.first("n_shingles").alias("n_shingles"))
    # The copies grow with the rows, so they are merged, not broadcast, at every size: both joins below share one shuffle of the texts.
    copies = stored(seen.where(f"not {keep} or n > 1 and n_shingles > 0").select(F.col("id.id").alias(copy_id), F.col("id.digest").alias(copy_digest), keep), "copies").hint("merge")
    keyed = df.withColumn(mark, digest)
    same = own_id.eqNullSafe(F.col(copy_id)) & (F.col(mark) == F.col(copy_digest))
    single = keyed.join(copies, same, "left_anti").drop(mark)
    # Of rows that repeat id and text, the first by all columns: which one stays doesn't depend on partitions.
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    repeated = keyed.join(copies.where(keep), same, "left_semi").groupBy(own_id, mark).agg(F.min_by(whole, F.to_json(whole)).alias(mark + "_row"))
    return single.unionByName(repeated.select(F.col(mark + "_row").alias("row")).select("row.*"))
