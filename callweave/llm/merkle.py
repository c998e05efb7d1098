"""A Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

Leaves are digests of rows, made by Spark. Rows get their place in their group by a range shuffle of
digests and counts of its partitions. Every 2^HEIGHT places from a multiple of it are a bucket:
tasks read whole buckets as Arrow tables, in which recursive DuckDB queries join each run of two
nodes by an ordered string_agg and sha256, level by level. A bucket's root is a leaf of the next
tree of buckets, until one node of a group remains; Spark then joins the siblings that lie outside
a bucket to those within.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import Scratch

#: Levels of a bucket: at most 4,096 nodes are hashed together.
HEIGHT = 12
#: Rows of whole buckets that one query hashes.
ROWS = 1 << 15

LEVELS = """
WITH RECURSIVE tree(bucket, height, depth, pos, h) AS (
  SELECT bucket, height, 0, pos, h FROM leaves
  UNION ALL
  SELECT bucket, height, depth + 1, pos >> 1, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE depth < height GROUP BY bucket, height, depth, pos >> 1),
every AS MATERIALIZED (SELECT * FROM tree),
beside AS (
  SELECT l.bucket, l.pos, list(unhex(coalesce(t.h, '')) ORDER BY k.depth) AS siblings
  FROM leaves l JOIN range(64) k(depth) ON k.depth < l.height LEFT JOIN every t ON t.bucket = l.bucket AND t.depth = k.depth AND t.pos = xor(l.pos >> k.depth, 1)
  GROUP BY ALL)
SELECT l.row, coalesce(siblings, []) AS siblings, t.h AS root
FROM leaves l LEFT JOIN beside USING (bucket, pos) JOIN every t ON t.bucket = l.bucket AND t.depth = l.height ORDER BY l.row
"""


def counted(value: Column) -> Column:
    """A value as the digests take it: its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[counted(v) for v in values]), 256)


def numbered(df: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``df`` with ``pos`` (its place in its group, from 0) and ``n`` (the group's rows), by a range shuffle; nothing is gathered.

    ``order`` sorts a group's rows; rows that are equal in it take any order. Null is a group too.
    """
    rows = scratch.stored(df.withColumn("tie", F.monotonically_increasing_id()), "rows")  # the tie spreads equal rows
    placed = rows.repartitionByRange(group, *order, "tie").sortWithinPartitions(group, *order, "tie")
    # The row's number within its partition, and the partition's, as the sorted rows are written.
    placed = scratch.stored(placed.drop("tie").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "placed")
    parts = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    # One row for each partition that holds rows of the group.
    starts = parts.select(F.col(group).alias("of"), F.col("part").alias("in"), (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("size").over(whole).alias("n"))
    starts = scratch.stored(starts, "starts")
    both = placed.join(starts, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return both.withColumn("pos", F.col("at") + F.col("shift")).drop("of", "in", "part", "at", "shift")


def hashed(nodes: DataFrame, group: str, height: int = HEIGHT) -> DataFrame:
    """``nodes`` (``group``, ``pos``, ``n``, ``h``, others) with ``bucket``, ``siblings`` on the way to its root, and the bucket's ``root``.

    A sibling is empty where the last run of a level holds one node only. ``n`` nodes make a tree of
    as many levels as it takes to reach one node, of which a bucket holds up to ``height``.
    """
    levels = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    given = nodes.withColumns({"bucket": F.shiftright("pos", height), "height": F.least(levels, F.lit(height))})
    dealt = given.repartition(group, "bucket").sortWithinPartitions(group, "bucket", "pos")
    kept = [f for f in dealt.schema if f.name != "height"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})

        def done(table: pa.Table, numbers: list[int]) -> Iterator[pa.RecordBatch]:
            row, bucket = pa.array(range(len(table)), pa.int64()), pa.array(numbers, pa.int64())
            db.register("leaves", pa.table({"row": row, "bucket": bucket, **{c: table[c] for c in ("pos", "height", "h")}}))
            found = db.sql(LEVELS).to_arrow_table()
            db.unregister("leaves")
            whole = table.select([f.name for f in kept])
            whole = whole.append_column("siblings", found["siblings"].cast(pa.list_(pa.binary()))).append_column("root", found["root"].cast(pa.string()))
            yield from whole.combine_chunks().to_batches(max_chunksize=4096)

        held, numbers, last, bucket = [], [], None, 0
        for batch in batches:
            begin = 0
            for i, key in enumerate(zip(batch[group].to_pylist(), batch["bucket"].to_pylist(), strict=True)):
                if key != last:
                    last, bucket = key, bucket + 1
                    if len(numbers) >= ROWS:  # of whole buckets
                        yield from done(pa.Table.from_batches([*held, batch.slice(begin, i - begin)]), numbers)
                        held, numbers, begin = [], [], i
                numbers.append(bucket)
            held.append(batch.slice(begin))
        if numbers:
            yield from done(pa.Table.from_batches(held), numbers)

    return dealt.mapInArrow(run, f"{kinds}, siblings array<binary>, root string")


def joined(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Rows of ``left`` with what ``right`` holds of their bucket; a bucket has a bounded number of rows, so no key is hot."""
    named = right.withColumnsRenamed({group: "of", "bucket": "in"})
    return left.join(named, F.col(group).eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in"))).drop("of", "in")


def tree(leaves: DataFrame, group: str, scratch: Scratch, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """The trees of ``leaves`` (``group``, ``pos``, ``n``, ``h``, others), in two stored tables.

    The first has the leaves with ``bucket`` and ``siblings`` within it; the second each ``group, bucket``
    with the siblings from there on (``outer``) and the group's ``root``. Buckets' roots are the leaves
    of a smaller tree, and so on, once for each ``height`` levels of the largest.
    """
    inner = scratch.stored(hashed(leaves, group, height), "nodes")
    buckets = inner.groupBy(group, "bucket").agg(F.first("root").alias("h"), F.first(F.shiftright(F.col("n") + ((1 << height) - 1), height)).alias("n"))
    rows = inner.drop("root", "n")
    if (inner.agg(F.max("n")).first()[0] or 0) <= 1 << height:
        return rows, scratch.stored(buckets.select(group, "bucket", F.array().cast("array<binary>").alias("outer"), F.col("h").alias("root")), "outer")
    above, rest = tree(buckets.withColumnRenamed("bucket", "pos"), group, scratch, height)
    outer = joined(above, rest, group).select(group, F.col("pos").alias("bucket"), F.concat("siblings", "outer").alias("outer"), "root")
    return rows, scratch.stored(outer, "outer")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and ``steps`` (from the leaf up: whether the node is ``right`` in its run, and its ``sibling``, '' if it has none) give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.when(s["right"], F.concat(s["sibling"], h)).otherwise(F.concat(h, s["sibling"])), 256))


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", value_cols: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """Per row: the id, its ``leaf``, its group's ``subroot``, the ``root`` over all groups, ``proof`` (siblings from the leaf up), ``folded_root`` and ``verified``.

    A leaf is the digest of ``value_cols``; a group's leaves ascend by id, rows of one id by leaf, null
    ids first. Groups ascend by their text, null first. ``tampered`` has columns and what they hold in
    rows that were changed after the manifest was made (null: not changed): proofs are checked
    against such rows. Null values, empty and long texts and repeated rows are leaves as others are;
    equal rows are interchangeable. An empty table gives no rows. Other columns are ignored.
    """
    temporary, kept = Scratch(df.sparkSession), Scratch(df.sparkSession)
    changes = tampered or {}
    values = {c: F.col(f"`{c}`") for c in value_cols}
    other = F.when(reduce(or_, [v.isNotNull() for v in changes.values()]), leaf_of(*[F.coalesce(changes[c], v) if c in changes else v for c, v in values.items()])) if changes else F.lit(None).cast("string")
    leaves = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").cast("string").alias("of_group"), leaf_of(*values.values()).alias("h"), other.alias("other"))

    rows, outer = tree(numbered(leaves, "of_group", ["id", "h"], temporary), "of_group", kept, height)
    groups = outer.select("of_group", F.col("root").alias("h"), F.lit(0).alias("all")).distinct()
    tops, above = tree(numbered(groups, "all", ["of_group"], temporary), "all", kept, height)
    temporary.drop()
    top = joined(tops, above, "all").select(F.col("of_group").alias("its_group"), F.col("pos").alias("at"), F.concat("siblings", "outer").alias("above"), "root")
    places = outer.withColumnRenamed("root", "subroot").join(top, F.col("of_group").eqNullSafe(F.col("its_group"))).drop("its_group")

    def steps(siblings: str, pos: str) -> Column:
        right = lambda i: F.call_function("shiftright", F.col(pos), i) % 2 == 1
        return F.transform(siblings, lambda s, i: F.struct(right(i).alias("right"), F.lower(F.hex(s)).alias("sibling")))

    both = joined(rows, kept.stored(places, "places"), "of_group")
    both = both.withColumn("group_steps", F.concat("siblings", "outer"))
    both = both.withColumn("steps", F.concat(steps("group_steps", "pos"), steps("above", "at")))
    proof = F.filter(F.transform("steps", lambda s: s["sibling"]), lambda s: s != "")
    out = both.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof"), folded(F.coalesce("other", "h"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
