"""Byte-level BPE in linear time by backtracking over longest token matches.

An Aho-Corasick automaton finds the longest token that begins at each byte of a word. Going left to
right, the encoder takes the longest token there, or a shorter one that begins it, which may follow
the token before and doesn't end at a place known to be wrong; where none is left, the place is
marked as wrong and the token before it is tried again. Each place is marked once, so the work is
linear. Whether a token may follow another is a table of pairs, filled as pairs are met: two tokens
are the encoding of their bytes exactly if no merge crosses the boundary between them while they are
built up. A sequence all of whose neighbours are such pairs is the exact encoding. Decoding gathers
the bytes of ids from one array by a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callweave.llm import shingles
from callweave.llm.bpe import TEXT_BYTES, Codec, _lists
from callweave.llm.common import only

#: Longer words are encoded anew each time they are met.
KEPT_WORD = 64
#: Ids that are gathered together.
GATHERED = 500_000
#: Up to this character all versions of Unicode agree on letters, digits and white space; texts with others are split by the library's own pre-tokeniser.
UNDISPUTED = "\u0557"
_NEVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printed ones themselves, the others from U+0100 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}


def tables_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``parts`` one after another, where each begins, and its length."""
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length


def gathered(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``ids`` in a row, and where each id's begin and the last one's end."""
    flat, offset, length = table
    ends = np.concatenate(([0], np.cumsum(length[ids])))
    out = np.empty(ends[-1], np.uint8)
    for i in range(0, len(ids), GATHERED):
        some, at = ids[i : i + GATHERED], ends[i : i + GATHERED + 1]
        index = np.repeat(offset[some] - at[:-1], length[some])
        index += np.arange(at[0], at[-1])
        out[at[0] : at[-1]] = flat[index]
    return out, ends


class LinearCodec(Codec):
    """A byte-level BPE tokenizer from a file of the tokenizers library; pieces and words met before are looked up as in ``Codec``."""

    def __init__(self, path: str, pattern: str, keep: int = 300_000):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, byte = said["model"], byte_alphabet()
        if model["type"] != "BPE" or said.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("only plain byte-level BPE is supported")
        ids = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        from tokenizers import Tokenizer

        self.find_words, self.find_newer = regex.compile(pattern).findall, regex.compile(f"[^\0-{UNDISPUTED}]").search
        self.cut_words = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.keep, self.pieces, self.words, self.older = keep, {}, {}, {}
        self.rank: dict[int, int] = {}
        #: Of a token that is merged from two: those, and the rank of the merge.
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right = (bytes(map(byte.__getitem__, x)) for x in (a, b))
            pair, whole = ids[left] << 20 | ids[right], ids[left + right]
            if whole in self.halves:
                raise ValueError("a token with two merges is not supported")
            self.rank[pair], self.halves[whole] = rank, (ids[left], ids[right], rank)
        self.fits: dict[int, bool] = {}
        missing = [i for i in range(256) if bytes([i]) not in ids]
        if missing or max(ids.values()) >= 1 << 20:
            raise ValueError("the vocabulary lacks single bytes, or has ids of 2^20 and more")
        #: Tokens that their own bytes give; no text has others.
        usable = {t: i for t, i in ids.items() if len(t) == 1 or (i in self.halves and self._first_crossing(*self.halves[i][:2]) == self.halves[i][2])}
        self.whole = {t: np.int32(i).tobytes() for t, i in usable.items()}
        size = max([*ids.values(), *(t["id"] for t in said["added_tokens"])]) + 1
        self.length = [0] * size
        #: The longest usable token that begins a token, itself left out; -1 if there is none.
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for t, i in usable.items():
            self.length[i] = len(t)
            self.shorter[i] = next((usable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), -1)
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: Special tokens are met in texts before anything else, as the library does by default.
        self.special = {t["content"].encode(): t["id"] for t in said["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in said["added_tokens"]):
            raise ValueError("added tokens with conditions are not supported")
        self.find_special = regex.compile(b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).finditer if self.special else None
        spelled = [b""] * size
        for t, i in [*ids.items(), *self.special.items()]:
            spelled[i] = t
        self.known = np.array([bool(t) for t in spelled])
        self.spelled = tables_of(spelled)
        self.decimal = tables_of([b",%d" % i for i in range(size)])

    def words_of(self, text: str) -> list[str]:
        """The matches of the pre-tokeniser's pattern, which leave out nothing."""
        return [text[a:b] for _, (a, b) in self.cut_words(text)] if self.find_newer(text) else self.find_words(text)

    def _first_crossing(self, a: int, b: int) -> int:
        """The rank of the first merge across the boundary of two tokens that are built up side by side; _NEVER if they stay apart.

        At the boundary stand the last part of ``a`` and the first part of ``b`` so far; their merge
        comes first if its rank is below that of the next merge on either side. Equal ranks are
        merged from the left.
        """
        left, right = [(a, _NEVER)], [(b, _NEVER)]
        while (h := self.halves.get(left[-1][0])) is not None:
            left.append((h[1], h[2]))
        while (h := self.halves.get(right[-1][0])) is not None:
            right.append((h[0], h[2]))
        (x, x_until), (y, y_until) = left.pop(), right.pop()
        while True:
            merge = self.rank.get(x << 20 | y, _NEVER)
            if merge < x_until and merge <= y_until:
                return merge
            if x_until == y_until == _NEVER:
                return _NEVER
            if x_until <= y_until:
                x, x_until = left.pop()
            else:
                y, y_until = right.pop()

    def encode_word(self, word: bytes) -> bytes:
        """The ids of one word (little-endian, 32 bits)."""
        n, length, shorter, fits = len(word), self.length, self.shorter, self.fits
        longest = array("i", bytes(4 * n))
        for end, token in self.automaton.iter(word.decode("latin-1")):
            longest[end + 1 - length[token]] = token
        wrong, taken, at = bytearray(n + 1), array("i"), 0
        while at < n:
            token = longest[at]
            while True:
                while token >= 0:
                    if not wrong[at + length[token]]:
                        if not taken:
                            break
                        pair = taken[-1] << 20 | token
                        ok = fits.get(pair)
                        if ok is None:
                            ok = fits[pair] = self._first_crossing(taken[-1], token) == _NEVER
                        if ok:
                            break
                    token = shorter[token]
                if token >= 0:
                    break
                if not taken:
                    raise ValueError("no tokens for a word")
                wrong[at] = 1
                token = taken.pop()
                at -= length[token]
                token = shorter[token]
            taken.append(token)
            at += length[token]
        return np.array(taken, "<i4").tobytes()

    def word_ids(self, words: set[str]) -> dict[str, bytes]:
        """The ids of distinct words; those that are a token, and those met before, are looked up."""
        if len(self.words) > self.keep:  # words not asked for since the last time are forgotten
            self.words, self.older = {}, self.words
        if len(self.fits) > 8 * self.keep:
            self.fits.clear()
        out = {}
        for w in words:
            ids = self.words.get(w)
            if ids is None:
                ids = self.older.get(w)
                if ids is None:
                    raw = w.encode()
                    ids = self.whole.get(raw) or self.encode_word(raw)
                if len(w) <= KEPT_WORD:
                    self.words[w] = ids
            out[w] = ids
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``Codec.encode``; special tokens in the texts are found first, and what lies between is encoded by itself."""
        raw = data.tobytes() if self.find_special else b""
        found = [(m.start(), m.end()) for m in self.find_special(raw)] if self.find_special and any(s in raw for s in self.special) else []
        if any(np.searchsorted(starts, a, side="right") != np.searchsorted(starts, b, side="left") for a, b in found):  # one that two texts make up together
            found = [(a + i, b + i) for i, j in zip(starts.tolist(), starts[1:].tolist(), strict=False) for m in self.find_special(raw[i:j]) for a, b in [m.span()]]
        if not found:
            return super().encode(data, starts)
        keep = np.ones(len(data), bool)
        for a, b in found:
            keep[a:b] = False
        place = np.concatenate(([0], np.cumsum(keep)))
        ids = np.array([self.special[raw[a:b]] for a, b in found], np.int32)
        # Sections: texts, cut where special tokens were; a section's end is where its special token goes.
        begins = np.concatenate((starts, [b for _, b in found]))
        order = np.argsort(begins, kind="stable")
        coded, at = super().encode(data[keep], place[begins[order]])
        section = np.empty(len(order), np.int64)
        section[order] = np.arange(len(order))
        of_special = at[section[len(starts) :]]
        return np.insert(coded, of_special, ids), at[section[: len(starts)]] + np.searchsorted(np.array([a for a, _ in found]), starts)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The bytes of consecutive lists of ids; unknown ids raise."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("unknown token id")
        flat, ends = gathered(self.spelled, ids)
        at = ends[starts].tolist()
        return [flat[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]

    def decimals(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """Consecutive lists of ids as decimals joined by commas."""
        flat, ends = gathered(self.decimal, ids)
        at = ends[starts].tolist()
        return [flat[a + 1 : b].tobytes() for a, b in zip(at, at[1:], strict=False)]


_CODECS: dict[tuple[str, str], LinearCodec] = {}


def codec(path: str, pattern: str) -> LinearCodec:
    """One codec per Python worker and tokenizer file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = LinearCodec(path, pattern)
    return _CODECS[path, pattern]


def encode_texts(df: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``ids`` (array of int) of the whole text; null texts have none."""
    source = only(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)
        for batch in batches:
            for first, data, starts in shingles.runs(batch.column("text"), TEXT_BYTES):
                lists = _lists(*own.encode(data, starts))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(lists)), lists], names=["id", "ids"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and ``decoded`` (the text of its token ids, special ones too; bytes that are no UTF-8 as U+FFFD); null lists give ''."""
    source = only(df, id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            raw = own.decode(np.concatenate([np.zeros(0, np.int64), *lists]), np.cumsum([0, *map(len, lists)]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.decode(errors="replace") for x in raw], pa.string())], names=["id", "decoded"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, decoded string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas) and ``decoded_sha256`` (of the decoded text).

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library, readable on every
    executor; ``pattern`` its pre-tokeniser's. Special tokens in a text are themselves. Null texts
    count as empty; null ids and repeated rows give a row each; an empty table gives none; other
    columns are ignored. Texts are taken whole; one that doesn't decode to itself raises an error.
    """
    source = only(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)
        for batch in batches:
            for first, data, starts in shingles.runs(batch.column("text"), TEXT_BYTES):
                ids, at = own.encode(data, starts)
                decoded = own.decode(ids, at)
                if any(d != data[a:b].tobytes() for d, a, b in zip(decoded, starts, starts[1:], strict=False)):
                    raise ValueError("a text does not decode to itself")
                digests = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (own.decimals(ids, at), decoded)]
                columns = [batch.column("id").slice(first, len(decoded)), pa.array(np.diff(at), pa.int64()), *[pa.array(d, pa.string()) for d in digests]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, kinds).withColumnRenamed("id", id_col)
