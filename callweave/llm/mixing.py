"""Mixing sources to target weights by Poisson replication.

The mean repetition of a source is its share of the target over what it holds. The count of a
document is the Poisson quantile, at that mean, of a number that a seed and the document hash to:
the smallest k whose cumulative probability reaches it. Each document is repeated that often, and
all copies are shuffled by a hash of the document, the copy and the seed.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import unused

#: The name under which ``weights`` may hold all sources that it doesn't name (null too).
OTHERS = "*"
#: Up to this mean the steps are added up from a count of 0, as the SQL adds them; above it, around the mode.
FROM_ZERO = 64.0
#: Copies of a document that one array lists.
LISTED = 65_536


def unit(*parts: Column | str) -> Column:
    """A number from 0 to below 1 (52 bits) that the joined texts of ``parts`` hash to."""
    text = F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_steps(mean: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... until they no longer grow; means above FROM_ZERO lose precision."""
    term = total = math.exp(-mean)
    out = [total]
    while len(out) < 8 or len(out) <= mean or term > 1e-18:
        term *= mean / len(out)
        total += term
        out.append(total)
    return out


def poisson_table(mean: float) -> tuple[int, list[float]]:
    """The first count and the cumulative probabilities from it on, for any mean from 0.

    Above FROM_ZERO the terms are taken relative to the mode's, outwards as long as they matter, and
    divided by their sum. What is left out on either side is far below 2**-52, the least ``unit``
    above 0, so a table has about 18 square roots of the mean as steps.
    """
    if not 0 <= mean < math.inf:
        raise ValueError(f"mean repetition {mean}: a number from 0 is needed")
    if mean <= FROM_ZERO:
        return 0, poisson_steps(mean)
    first = last = int(mean)
    below, above, term = [], [], 1.0
    while first > 0 and term > 1e-22:
        term *= first / mean
        first -= 1
        below.append(term)
    term = 1.0
    while term > 1e-22:
        last += 1
        term *= mean / last
        above.append(term)
    terms = [*reversed(below), 1.0, *above]
    whole = math.fsum(terms)
    return first, [x / whole for x in accumulate(terms)]


def _group(weights: dict[str, float], source_col: str) -> Column:
    """The name in ``weights`` that a row counts under; null: none."""
    named, source = [s for s in weights if s != OTHERS], F.col(f"`{source_col}`")
    return F.when(source.isin(named), source).otherwise(F.lit(OTHERS if OTHERS in weights else None).cast("string"))


def source_means(df: DataFrame, weights: dict[str, float], source_col: str = "source", total: int | None = None) -> dict[str, float]:
    """Mean repetition of each weighted source, from counts of all rows.

    ``total``: rows wanted (default: the rows that the weighted sources hold). Sources that the
    table lacks get no mean, and the weights of the others are scaled up.
    """
    counted = df.groupBy(_group(weights, source_col).alias("source")).count().where("source is not null").collect()  # a row for each name at most
    sizes = {r["source"]: r["count"] for r in counted}
    whole = sum(weights[s] for s in sizes)
    if any(w < 0 for w in weights.values()) or sizes and whole <= 0:
        raise ValueError("weights must be 0 or more, with some above 0")
    wanted = sum(sizes.values()) if total is None else total
    return {s: wanted * weights[s] / whole / n for s, n in sorted(sizes.items())}


def replicate(df: DataFrame, means: dict[str, float], id_col: str = "doc_id", source_col: str = "source", seed: str = "mix-1", copy_col: str = "copy_no", key_col: str = "mix_key") -> DataFrame:
    """``df`` repeated by Poisson counts and globally shuffled, with ``copy_col`` (from 1) and ``key_col``.

    Rows of sources without a mean are left out, as their target weight is 0; with a mean for
    OTHERS there are none. Repeated ids of a source get the same count; null texts, ids and sources
    are values like others; columns named as the two new ones are replaced; an empty table stays empty.
    """
    group, u, n, part = unused(df, "group", "u", "n", "part")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (copy_col, key_col)]
    ident, count = F.col(f"`{id_col}`"), F.lit(0)
    for source, mean in means.items():
        first, steps = poisson_table(mean)
        steps = F.split(F.lit(" ".join(map(repr, steps))), " ").cast("array<double>")  # folded into one literal
        times = F.size(F.filter(steps, lambda x: x <= F.col(u)))
        count = F.when(F.col(group) == source, F.when(F.col(u) > 0, F.lit(first) + times).otherwise(0) if first else times).otherwise(count)
    drawn = df.select(*kept, _group(means, source_col).alias(group), unit(seed, F.col(f"`{source_col}`"), ident).alias(u))
    counted = drawn.select(*kept, count.alias(n)).where(F.col(n) > 0)
    parts = counted.select(*kept, n, F.explode(F.sequence(F.lit(0), ((F.col(n) - 1) / LISTED).cast("int"))).alias(part))
    copies = parts.select(*kept, F.explode(F.sequence(F.col(part) * LISTED + 1, F.least(n, (F.col(part) + 1) * LISTED))).alias(copy_col))
    keyed = copies.withColumn(key_col, F.md5(F.concat_ws("/", F.lit(seed + "/order"), F.coalesce(ident.cast("string"), F.lit("")), F.col(copy_col).cast("string")).cast("binary")))
    return keyed.repartition(F.col(key_col)).sortWithinPartitions(key_col)


def mix(df: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source_col: str = "source", total: int | None = None, seed: str = "mix-1", **names: str) -> DataFrame:
    """``replicate`` with the means that bring the sources to ``weights``."""
    return replicate(df, source_means(df, weights, source_col, total), id_col, source_col, seed, **names)
