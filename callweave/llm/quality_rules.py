"""Quality rules by weak supervision.

Each rule votes good (1) or bad (-1) or abstains (0). The votes of all documents are counted by
pattern (at most 3 to the number of rules), expectation-maximisation over that table estimates the
share of good documents and how often each rule gives each vote to good and to bad ones, and the
posterior probability of being good decides. Only the pattern counts reach the driver; the posterior
of a document is a sum of log odds, one literal for each rule and vote.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.llm import shingles
from callweave.llm.common import only, stored, unused

WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_exclaims", "n_runs", "n_plain", "n_ends")
#: Odd multipliers of the words of a window.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Pairs of spans whose bytes are compared together.
_PAIRS = 100_000


def _bytes_in(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _MARK, _SPACE = _bytes_in("#*$%&|<>"), _bytes_in(",.;:?!"), _bytes_in("\t\n\x0b\x0c\r ")
_LOWER, _UPPER = (_bytes_in("".join(map(chr, range(a, a + 26)))) for a in (97, 65))
_ALNUM = _LOWER | _UPPER | _bytes_in("0123456789")
_ALNUM[128:] = True


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at each place of ``a`` equal those at ``b``."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), _PAIRS):
        n = size[i : i + _PAIRS]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(a[i : i + _PAIRS], n) + step] != data[np.repeat(b[i : i + _PAIRS], n) + step]
        out[i + np.repeat(np.arange(len(n)), n)[differ]] = False
    return out


def _equal_before(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (earlier, later) with equal keys in one text, such that equal places form chains."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    same = (keys[order[1:]] == keys[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return order[:-1][same], order[1:][same]


def repeated_words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words stand in a five-word window that their text holds twice or more (the first included)."""
    n = len(keys) - WINDOW + 1
    covered = np.zeros(len(keys), bool)
    if n < 2:
        return covered
    windows = np.zeros(n, np.uint64)
    for k, odd in enumerate(_ODD):
        windows += keys[k : k + n] * np.uint64(odd)
    own = np.where(doc[:n] == doc[WINDOW - 1 :], doc[:n], -1 - np.arange(n))  # windows across texts equal none
    a, b = _equal_before(windows, own)
    for k in range(WINDOW):  # hashes only propose: the words decide
        size = ends[a + k] - begins[a + k]
        ok = size == ends[b + k] - begins[b + k]
        a, b, size = a[ok], b[ok], size[ok]
        ok = same_bytes(data, begins[a + k], begins[b + k], size)
        a, b = a[ok], b[ok]
    again = np.zeros(n, bool)
    again[a] = again[b] = True
    for k in range(WINDOW):
        covered[k : k + n] |= again
    return covered


def text_stats(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The counts named in STATS of consecutive texts (their bytes, and where each begins and the last ends): a column for each text."""
    n = len(starts) - 1
    out = np.zeros((len(STATS), n), np.int64)
    if not len(data):
        return out
    begins, ends = shingles.word_spans(data, starts[:-1])
    doc = np.searchsorted(starts, begins, side="right") - 1
    keys = shingles.span_hashes(data, begins, ends, exact=True)
    of_doc = lambda places: np.bincount(np.searchsorted(starts, places, side="right") - 1, minlength=n)
    by_doc = lambda flag: np.bincount(doc[flag], minlength=n)

    def within(flag: np.ndarray) -> np.ndarray:
        """How many flagged bytes each word has."""
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flag, out=total[1:])
        return total[ends] - total[begins]

    before = np.concatenate((np.zeros(1, np.uint8), data[:-1]))
    after = np.concatenate((data[1:], np.full(1, 32, np.uint8)))
    after[starts[1:-1][starts[1:-1] > 0] - 1] = 32
    tail = (data & 0xC0) == 0x80
    chars = within(~tail)
    # Letters with two cases: A-Z, and the accented and Cyrillic ones of two bytes.
    upper = _UPPER[data] | tail & ((before == 0xC3) & (data <= 0x9E) & (data != 0x97) | (before == 0xD0) & (data <= 0xAF))
    lower = _LOWER[data] | tail & ((before == 0xC3) & (data >= 0x9F) & (data != 0xB7) | (before == 0xD0) & (data >= 0xB0) | (before == 0xD1) & (data <= 0x9F))
    shouted = (within(upper) > 0) & (within(lower) == 0)
    # Letters and digits with at most one mark behind them; of wide characters the general marks are none.
    sign = ~_ALNUM[data] | (data == 0xE2) & ((after == 0x80) | (after == 0x81)) | tail & (before == 0xC2) & (data >= 0xA0)
    last = data[ends - 1] if len(ends) else data[:0]
    marked = _MARK[last]
    plain = (within(sign) == marked) & (~marked | (ends - begins > 1))
    lines = np.unique(np.concatenate((starts[:-1], np.flatnonzero(data == 10) + 1)))
    lines = lines[lines < len(data)]
    stops = np.concatenate((lines[1:], [len(data)]))
    stops = stops - (data[stops - 1] == 10)
    worded = np.searchsorted(begins, stops) > np.searchsorted(begins, lines)
    lines, stops = lines[worded], stops[worded]
    line_doc = np.searchsorted(starts, lines, side="right") - 1
    a, b = _equal_before(shingles.span_hashes(data, lines, stops, exact=True), line_doc)
    size = stops[a] - lines[a]
    ok = size == stops[b] - lines[b]
    a, b, size = a[ok], b[ok], size[ok]
    copies = b[same_bytes(data, lines[a], lines[b], size)]
    full = (data == 46) | (data == 63)
    runs = np.flatnonzero((keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])) + 1
    out[:] = (
        np.bincount(doc, minlength=n),
        np.bincount(doc, weights=chars, minlength=n),
        of_doc(np.flatnonzero(_SYMBOL[data])),
        np.bincount(line_doc[copies], minlength=n),
        by_doc(repeated_words(data, begins, ends, keys, doc)),
        np.bincount(line_doc, minlength=n),
        by_doc(shouted),
        of_doc(np.flatnonzero(data == 33)),
        np.bincount(doc[runs], minlength=n),
        by_doc(plain),
        of_doc(np.flatnonzero(full & ((after == 32) | (after == 10)))),
    )
    return out


def with_stats(df: DataFrame, text_col: str = "text", out_col: str = "stats") -> DataFrame:
    """``df`` with one struct column ``out_col`` of the counts in STATS (null texts: all 0)."""
    fields = [pa.field(n, pa.int64()) for n in STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, starts in shingles.runs(batch.column(text_col)):
                stats = pa.StructArray.from_arrays([pa.array(c) for c in text_stats(data, starts)], fields=fields)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(stats)).columns, stats], names=[*batch.schema.names, out_col])

    added = T.StructField(out_col, T.StructType([T.StructField(n, T.LongType()) for n in STATS]))
    return df.mapInArrow(run, T.StructType([*df.schema.fields, added]))


@dataclass(frozen=True)
class Rule:
    """Votes on the ratio of two counts: bad where ``bad`` holds of it, else good where ``good`` holds, else abstains.

    Both are pairs (least, below) or None for a rule that never votes so.
    """

    name: str
    over: str
    under: str
    bad: tuple[float, float] | None = None
    good: tuple[float, float] | None = None

    def vote(self, stats: Column) -> Column:
        ratio = stats[self.over] / F.greatest(stats[self.under], F.lit(1))
        out = F.lit(0)
        for bounds, value in ((self.good, 1), (self.bad, -1)):
            if bounds:
                out = F.when((ratio >= bounds[0]) & (ratio < bounds[1]), value).otherwise(out)
        return out


ANY = float("inf")
RULES = (
    Rule("repeated_windows", "n_repeat_words", "n_words", bad=(0.2, ANY)),
    Rule("symbols", "n_symbols", "n_words", bad=(0.2, ANY)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", bad=(0.3, ANY)),
    Rule("upper_case", "n_upper_words", "n_words", bad=(0.5, ANY)),
    Rule("exclamations", "n_exclaims", "n_words", bad=(0.4, ANY)),
    Rule("word_runs", "n_runs", "n_words", bad=(0.2, ANY)),
    Rule("plain_words", "n_plain", "n_words", bad=(0.0, 0.55), good=(0.9, ANY)),
    Rule("sentences", "n_ends", "n_words", good=(0.03, 0.5)),
)
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20


def votes(stats: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array(*[r.vote(stats) for r in rules])


@dataclass(frozen=True)
class LabelModel:
    """What expectation-maximisation found: the share of good documents, and of each rule the rates of its votes.

    ``good`` and ``bad`` hold (rate of vote 1, rate of vote -1) of each rule among good and bad documents.
    """

    prior: float
    good: tuple[tuple[float, float], ...]
    bad: tuple[tuple[float, float], ...]

    def weights(self, rule: int) -> dict[int, float]:
        """The log odds of being good that a vote of ``rule`` adds; abstaining (0) adds some too."""
        (gp, gm), (bp, bm) = self.good[rule], self.bad[rule]
        return {1: math.log(gp / bp), -1: math.log(gm / bm), 0: math.log((1 - gp - gm) / (1 - bp - bm))}

    def log_odds(self, votes: Column) -> Column:
        out = F.lit(math.log(self.prior / (1 - self.prior)))
        for i in range(len(self.good)):
            w, vote = self.weights(i), F.get(votes, F.lit(i))
            out = out + F.when(vote == 1, w[1]).when(vote == -1, w[-1]).otherwise(w[0])
        return out


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 500, least: float = 1e-4) -> LabelModel:
    """Expectation-maximisation over counted vote patterns; only their shares matter, so size doesn't.

    Rules vote independently among the good and among the bad; with three rules or more that overlap,
    how often pairs and triples of them agree beyond their own rates determines the share of good
    documents and all rates, up to which class is called good. That is settled by the start (eight of
    ten documents good, a vote right four times of five) and a bound: no vote is rarer in its own
    class than in the other. Rates stay ``least`` or more away from 0 and 1; rules that never vote add nothing.
    """
    prior, rates = 0.8, np.zeros((2, n_rules, 2))  # class (good, bad), rule, vote (1, -1)
    v = np.array([p for p, _ in sorted(patterns)], float).reshape(len(patterns), n_rules)
    said = np.stack([v > 0, v < 0], 2).astype(float)
    share = np.array([n for _, n in sorted(patterns)], float)
    share /= max(share.sum(), 1)
    voted = np.clip(np.einsum("p,prv->rv", share, said), least, 1 - 2 * least)
    rates[0], rates[1] = voted * (0.8, 0.2) / (0.8 * 0.8 + 0.2 * 0.2), voted * (0.2, 0.8) / (0.8 * 0.2 + 0.2 * 0.8)

    def bounded(rates: np.ndarray) -> np.ndarray:
        rates = np.maximum(rates, least)
        for k, own in ((0, 0), (1, 1)):  # vote 1 is the good ones' own, vote -1 the bad ones'
            wrong = rates[1 - own, :, k] > rates[own, :, k]
            rates[:, wrong, k] = voted[wrong, k]
        return rates / np.maximum(1, rates.sum(2, keepdims=True) + least)

    for _ in range(rounds if patterns else 0):
        r = bounded(rates)
        log = (said[None] * np.log(r)[:, None]).sum((2, 3)) + ((1 - said.sum(2))[None] * np.log(1 - r.sum(2))[:, None]).sum(2)
        good = 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + log[0] - log[1], -700, 700)))
        old = prior
        prior = float(np.clip((share * good).sum(), 0.01, 0.99))
        for k, own in enumerate((good, 1 - good)):
            rates[k] = np.einsum("p,prv->rv", share * own, said) / max((share * own).sum(), 1e-12)
        if abs(prior - old) < 1e-10:
            break
    pairs = lambda x: tuple((float(a), float(b)) for a, b in x)
    final = bounded(rates)
    return LabelModel(prior, pairs(final[0]), pairs(final[1]))


def fit_votes(voted: DataFrame, n_rules: int = len(RULES)) -> LabelModel:
    """Count the patterns of column ``votes`` (at most 3 ** n_rules rows reach the driver) and fit."""
    counted = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    return fit([(tuple(r["votes"]), r["n"]) for r in counted], n_rules)


def judged(stats: Column, model: LabelModel, rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """Columns ``base_failed``, ``quality`` (posterior of good, six decimals) and ``kept``."""
    base = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEATED_PERCENT * stats["n_words"])
    odds = model.log_odds(votes(stats, rules))
    return {"base_failed": base, "quality": F.round(1 / (1 + F.exp(-odds)), 6), "kept": ~base & (odds >= 0)}


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the base counts, ``base_failed``, ``quality`` and ``kept``.

    Null texts have no words and fail; null ids and repeated rows are judged like others; ties at
    even odds are kept; an empty table gives no rows; other columns are ignored.
    """
    stats = stored(with_stats(only(df, id=id_col, text=text_col)).select("id", "stats"), "rule-stats")
    model = fit_votes(stats.select(votes(F.col("stats")).alias("votes")))
    base = [F.col("stats")[n].alias(n) for n in STATS[:5]]
    return stats.select(F.col("id").alias(id_col), *base, *[c.alias(n) for n, c in judged(F.col("stats"), model).items()])


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, with its own columns.

    The rows are stored once with their counts, so texts are read by Python once. Null, empty and
    short texts go; repeated rows share their fate; an empty table stays empty.
    """
    (name,) = unused(df, "stats")
    counted = stored(with_stats(df, text_col, name), "counted")
    model = fit_votes(counted.select(votes(F.col(name)).alias("votes")))
    return counted.where(judged(F.col(name), model)["kept"]).drop(name)
