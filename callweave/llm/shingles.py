"""Word shingles, set keys and MinHash signatures of whole texts, vectorised over Arrow batches.

Words are the runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A shingle is a
64-bit hash of its words. Texts are read where Arrow keeps them; batches are cut by bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

VALUES = 64  # of a signature
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_EXACT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BYTE = _EXACT.copy()
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[32, *range(9, 14)]] = False
_MULTIPLIERS = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * _U(2) + _U(1)
_ADDENDS = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64)
_PLACES = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


#: Bytes that are hashed together, and the powers of the base and of its inverse up to there.
_BLOCK = 1 << 20
_POWER, _INVERSES = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(_BLOCK, b, np.uint64)))) for b in (_BASE, _INVERSE))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_spans(data: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``data`` (bytes of consecutive texts) begins and ends."""
    inside = _WORD_BYTE[data]
    first = starts_of_docs[starts_of_docs < len(data)]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[first] = False
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, exact: bool = False) -> np.ndarray:
    """A hash of each span of ``data`` (in order, not overlapping); A-Z count as a-z unless ``exact``."""
    table, out, i = _EXACT if exact else _BYTE, np.zeros(len(begins), np.uint64), 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + _BLOCK, side="right")))
        low, high = int(begins[i]), int(ends[j - 1])
        if high - low <= _BLOCK:
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(table[data[low:high]] * _POWER[: high - low], out=total[1:])
            out[i:j] = (total[ends[i:j] - low] - total[begins[i:j] - low]) * _INVERSES[begins[i:j] - low]
        else:  # one span that is longer than a block
            for k in range(low, high, _BLOCK):
                part = data[k : min(k + _BLOCK, high)]
                out[i] += (table[part] * _POWER[: len(part)]).sum() * _U(pow(_BASE, k - low, 1 << 64))
        i = j
    return mixed(out + (ends - begins).astype(np.uint64))


def word_hashes(data: np.ndarray, starts_of_docs: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of ``data`` and the number of its text."""
    begins, ends = word_spans(data, starts_of_docs)
    return span_hashes(data, begins, ends, exact), np.searchsorted(starts_of_docs, begins, side="right") - 1


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; ``starts``: where each begins, and the end of the last.

    Texts of fewer words than ``size`` have all of them as one shingle, texts without words none.
    """
    n = len(starts) - 1
    words, doc = word_hashes(data, starts[:-1]) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    edges = np.searchsorted(doc, np.arange(n + 1))
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * _PLACES[k]
    rolled = mixed(rolled)
    out = []
    for i in range(n):
        a, b = edges[i], edges[i + 1]
        if b - a >= size:
            u = np.sort(rolled[a : b - size + 1])
            out.append(u[np.concatenate(([True], u[1:] != u[:-1]))])
        elif b > a:
            out.append(mixed((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + _U(int(b - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES 16-bit values for each non-empty set: hashes of the least member under as many orders."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    for k in range(VALUES):
        least = np.minimum.reduceat(flat * _MULTIPLIERS[k] + _ADDENDS[k], at)
        out[:, k] = mixed(least) >> _U(48)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def runs(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``most`` bytes: number of the first, their bytes, and where each begins and the last ends."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
