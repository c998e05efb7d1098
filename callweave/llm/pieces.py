"""Cutting texts where a byte-level tokenizer always begins a new token, vectorised over their bytes.

A cut stands before white space that follows a character that is none. In longer pieces it also
stands between an ASCII letter, digit and punctuation mark, and between Han letters and full-width
marks. No alternative of the byte-level pre-tokeniser's pattern matches across such a place, no
special token holds one (they are made of letters and of marks that are left out here), and the
pattern looks at nothing before it: the tokens of a text are those of its pieces, one after another.

``joined`` extends this to single words of any length by the property of byte-pair encoding that a
sequence of tokens is the encoding of its bytes exactly where each two neighbours are the encoding
of theirs: merges cross no boundary that they don't cross in the two neighbours alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Pieces of more bytes are also cut between kinds of characters.
LONG_PIECE = 256
#: Bytes of a window of a long word at first; windows overlap by half.
WINDOW = 64

_WHITE, _PRINTED, _WIDE = 1, 2, 3
_SPACING = np.zeros(256, np.uint8)
_SPACING[list(b" \n\t\r")] = _WHITE
_SPACING[33:127] = _PRINTED
_SPACING[128:] = _WIDE
_LETTER, _DIGIT, _MARK, _QUOTE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[ord("'")], _KIND[ord("|")] = _QUOTE, 0  # a contraction begins with the one, special tokens hold the other
_CUT = np.zeros((5, 5), bool)
for _a, _b in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2)):
    _CUT[_a, _b] = True
#: Full-width marks, and the first bytes of Han letters that every Unicode version has (U+5000 to U+8FFF).
_FULL_WIDTH = ["、", "。", "，", "！", "？", "：", "；"]
_HAN = (0xE5, 0xE8)


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space of two or three bytes (or may be)."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A))


def _between_kinds(data: np.ndarray) -> np.ndarray:
    """Places within one long piece where it may be cut."""
    kind = _KIND[data]
    cut = _CUT[kind[:-1], kind[1:]]
    if len(data) > 5:
        mark = np.zeros(len(data) - 2, bool)
        for c in _FULL_WIDTH:
            a, b, c_ = c.encode()
            mark |= (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c_)
        han = (data[:-2] >= _HAN[0]) & (data[:-2] <= _HAN[1])
        cut[2:-2] |= mark[:-3] & han[3:] | han[:-3] & mark[3:]
    return np.flatnonzero(cut) + 1


def cut(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces (binary) of the texts in ``data``, and the number of each text's first piece and of all.

    ``starts``: where each text begins, and where the last ends. Empty texts have no piece.
    """
    n = len(data)
    safe = np.zeros(n + 1, bool)
    if n > 1:
        spacing = _SPACING[data]
        white = np.flatnonzero((spacing[1:] == _WHITE) & (spacing[:-1] >= _PRINTED)) + 1
        wide = white[spacing[white - 1] == _WIDE]
        safe[white] = True
        safe[wide[_wide_space(data, wide)]] = False
    safe[starts] = True
    edges = np.flatnonzero(safe)
    for k in np.flatnonzero(np.diff(edges) > LONG_PIECE):
        safe[edges[k] + _between_kinds(data[edges[k] : edges[k + 1]])] = True
    edges = np.flatnonzero(safe).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.searchsorted(edges, starts)


def _windows(word: bytes, width: int) -> list[tuple[int, int]]:
    """Overlapping spans that cover ``word``, none of which cuts a character of UTF-8 text."""

    def whole(i: int) -> int:
        return next((k for k in range(i, max(i - 4, 0), -1) if word[k] & 0xC0 != 0x80), i) if i < len(word) else len(word)

    begins = [whole(i) for i in range(0, max(len(word) - width // 2, 1), width // 2)]
    return [(a, whole(min(a + width, len(word)))) for a in begins[:-1]] + [(begins[-1], len(word))]


def _met(left: tuple, right: tuple) -> int | None:
    """A place where two overlapping windows have both a token that ends and one that begins in common."""
    (ids_a, at_a), (ids_b, at_b) = left, right
    shared, i, j = np.intersect1d(at_a[1:-1], at_b[1:-1], assume_unique=True, return_indices=True)
    ok = (ids_a[i] == ids_b[j]) & (ids_a[i + 1] == ids_b[j + 1])
    found = shared[ok]
    return int(found[len(found) // 2]) if len(found) else None


def joined(words: list[bytes], contract: Callable[[list[bytes]], list[bytes]], length: np.ndarray, width: int = WINDOW) -> list[bytes]:
    """The ids (little-endian, 32 bits) of long ``words`` by way of overlapping windows, which ``contract`` encodes.

    Neighbouring windows are joined where they agree on the tokens at both sides of a place. A word
    with windows that don't agree is done again with windows of twice the width, at last as a whole.
    """
    out = [b""] * len(words)
    todo = list(range(len(words)))
    while todo:
        spans = {k: _windows(words[k], width) for k in todo}
        distinct = list({words[k][a:b] for k in todo for a, b in spans[k]})
        known = dict(zip(distinct, (np.frombuffer(x, "<i4") for x in contract(distinct)), strict=True))
        again = []
        for k in todo:
            coded = []
            for a, b in spans[k]:
                ids = known[words[k][a:b]]
                coded.append((ids, np.concatenate(([a], a + np.cumsum(length[ids])))))
            places = [_met(x, y) for x, y in zip(coded, coded[1:], strict=False)]
            if None in places:
                again.append(k)
                continue
            edges = [0, *places, len(words[k])]
            out[k] = np.concatenate([ids[np.searchsorted(at, a) : np.searchsorted(at, b)] for (ids, at), a, b in zip(coded, edges, edges[1:], strict=False)]).tobytes()
        todo, width = again, width * 2
    return out
