"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries (see ``pieces``), so the counts of the pieces add up to the count of
the text. Pieces repeat: a worker keeps the counts of short ones and encodes each new piece once, in
batches of about ``batch_bytes`` each whatever the lengths of the texts. Pieces that stay long are
split into the pre-tokeniser's words, and long words into overlapping windows (``pieces.joined``).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import shingles
from callweave.llm.common import only
from callweave.llm.pieces import cut, joined

#: Longer pieces (in bytes) are encoded each time instead of being kept.
KEPT_BYTES = 48
#: Longer pieces are split into words, and longer words into windows, instead of being encoded whole.
LONG = 8192
#: Bytes of text that are cut together.
TEXT_BYTES = 4 << 20


class PieceCounter:
    """Token counts of texts through one byte-level tokenizer, with a bounded memory of short pieces."""

    def __init__(self, path: str, batch_bytes: int = 1 << 20, keep: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.batch_bytes, self.keep = batch_bytes, keep
        self.known: dict[bytes, int] = {}
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)  # a character of a token stands for a byte
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.length[list(vocabulary.values())] = list(map(len, vocabulary))

    def encoded(self, parts: list[bytes]) -> Iterator[list[int]]:
        """The ids of ``parts``, encoded in batches of about equal bytes."""
        start, size = 0, 0
        for i, part in enumerate(parts):
            size += len(part) + 32
            if size >= self.batch_bytes or i + 1 == len(parts):
                for x in self.tokenizer.encode_batch_fast([p.decode() for p in parts[start : i + 1]], add_special_tokens=False):
                    yield x.ids
                start, size = i + 1, 0

    def long_count(self, piece: bytes) -> int:
        """The count of a long piece: of its special tokens and its words, long ones by windows."""
        text, n, words, long = piece.decode(), 0, [], []
        parts = [text]
        if self.special:
            parts = self.special.split(text)
            n += len(parts) - 1
        for part in filter(None, parts):
            for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                word = part[a:b].encode()
                (words if len(word) <= LONG else long).append(word)
        contract = lambda windows: [np.array(ids, "<i4").tobytes() for ids in self.encoded(windows)]
        return n + sum(map(len, self.encoded(words))) + sum(len(x) // 4 for x in joined(long, contract, self.length))

    def counts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Token counts of consecutive texts: their bytes, and where each begins and the last ends."""
        if len(self.known) > self.keep:
            self.known.clear()
        known = self.known
        pieces, first = cut(data, starts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in known]
        short = [p for p in new if len(p) <= LONG]
        fresh = dict(zip(short, map(len, self.encoded(short)), strict=True))
        fresh.update((p, self.long_count(p)) for p in new if len(p) > LONG)
        known.update((p, n) for p, n in fresh.items() if len(p) <= KEPT_BYTES)
        each = np.array([fresh[p] if p in fresh else known[p] for p in distinct], np.int64)
        total = np.concatenate(([0], np.cumsum(each[coded.indices.to_numpy()])))
        return np.diff(total[first])


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One counter per Python worker and tokenizer file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    ``tokenizer`` is the path of a byte-level BPE file for the tokenizers library, readable on
    every executor. Null texts count as empty (0 bytes, 0 tokens); repeated rows and null ids give
    one row each; an empty table gives none; other columns are ignored. No text is cut short.
    """
    source = only(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).counts
        for batch in batches:
            for first, data, starts in shingles.runs(batch.column("text"), TEXT_BYTES):
                n = count(data, starts)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(n)), pa.array(np.diff(starts), pa.int64()), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
