"""Byte-level BPE by recursive DuckDB queries inside each partition.

Texts are cut into pieces at places where a token always begins, and new pieces into the matches of
a pre-tokeniser pattern. The words that a worker hasn't met go into a table of token positions, one
row for each byte. A recursive query joins neighbouring rows with the merge table and contracts each
word's leftmost pair of minimum rank, until no pair has a rank. Ordered aggregation makes the lists
of ids, and likewise joins the bytes of ids on decoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callweave.llm import pieces, shingles
from callweave.llm.common import only

#: Words of more bytes are contracted in overlapping windows and joined (see ``pieces.joined``).
WHOLE_WORD = 64
#: Rows that the rounds of one recursive query may keep, about (a word of n bytes counts n * n / 2): few enough for a core's cache.
ROWS = 500_000
#: Tokens that one query decodes.
DECODED = 500_000
#: Bytes of text that are encoded together.
TEXT_BYTES = 4 << 20
#: Longer pieces are looked up only within their batch.
KEPT_BYTES = 48

# A row's place is its word's number times 2^31, plus its position; ``nxt`` is the place of the row
# after it. A pair's ``best`` holds the merged token, its position (31 bits) and its length (12 bits),
# so that the least is the leftmost of minimum rank.
CONTRACT = """
WITH RECURSIVE step(round, place, nxt, token) AS (
  SELECT 0, place, place + 1, token FROM start
  UNION ALL
  SELECT round, place, nxt, token FROM (
    WITH pairs AS (
      SELECT a.place >> 31 AS word, min(m.best | ((a.place & 2147483647) << 12)) AS best
      FROM step a JOIN step b ON a.nxt = b.place JOIN merges m ON m.pair = (a.token::BIGINT << 20) | b.token
      GROUP BY a.place >> 31),
    chosen AS (SELECT word, (word << 31) | ((best >> 12) & 2147483647) AS hit, best & 4095 AS size, (best >> 43)::INTEGER AS merged FROM pairs)
    SELECT s.round + 1 AS round, s.place,
      CASE WHEN s.place = hit THEN hit + size ELSE s.nxt END AS nxt,
      CASE WHEN s.place = hit THEN merged ELSE s.token END AS token
    FROM step s JOIN chosen ON s.place >> 31 = word
    WHERE NOT (s.place > hit AND s.place < hit + size))),
every AS MATERIALIZED (SELECT * FROM step),
ends AS (SELECT place >> 31 AS word, max(round) AS last FROM every GROUP BY place >> 31)
SELECT word, list(token ORDER BY place) AS ids FROM every JOIN ends ON place >> 31 = word AND round = last GROUP BY word ORDER BY word
"""

DECODE = """
SELECT doc, unhex(array_to_string(list(piece ORDER BY pos), '')) AS bytes
FROM (SELECT doc, pos, piece FROM tokens JOIN vocabulary USING (id)) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """One vocabulary in an in-memory DuckDB of one thread, with the ids of the pieces and words met so far."""

    def __init__(self, path: str, pattern: str, keep: int = 300_000, memory: str = "500MB"):
        import duckdb
        import regex

        ranks = read_ranks(path)
        self.words_of = regex.compile(pattern).findall
        self.keep = keep
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        if max(ranks.values()) >= 1 << 20 or max(map(len, ranks)) >= 1 << 12:
            raise ValueError("ranks of 2^20 and more, or tokens of 4,096 bytes and more, are not supported")
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole = {t: np.int32(r).tobytes() for t, r in ranks.items()}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        self.length[list(ranks.values())] = list(map(len, ranks))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        pair, best = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pair.append(a << 20 | b), best.append(rank << 43 | len(token))
        self._table("merges", pair=pa.array(pair, pa.int64()), best=pa.array(best, pa.int64()))
        self._table("vocabulary", id=pa.array(list(ranks.values()), pa.int32()), piece=pa.array([t.hex() for t in ranks], pa.string()))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _run(self, sql: str, name: str, **columns) -> pa.Table:
        self.db.register(name, pa.table(columns))
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, each contracted by itself; words are batched by the rows that their rounds keep."""
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        batch = np.cumsum(sizes * sizes // 2 + 1) // ROWS
        out: list[bytes] = []
        for i, j in zip(edges := np.flatnonzero(np.diff(batch, prepend=-1)).tolist(), [*edges[1:], len(words)], strict=True):
            n, flat = sizes[i:j], np.frombuffer(b"".join(words[i:j]), np.uint8)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            found = self._run(CONTRACT, "start", place=(np.repeat(np.arange(j - i, dtype=np.int64), n) << 31) + pos, token=self.bytes[flat])
            ids = found.column("ids").combine_chunks()
            raw, ends = ids.values.to_numpy().astype("<i4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
            out += [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def word_ids(self, words: set[str]) -> dict[str, bytes]:
        """The ids of distinct words, each as little-endian unsigned 32-bit integers.

        Words that are a token, and those met before, are looked up. The others are contracted: those
        of up to WHOLE_WORD bytes as they are, longer ones in overlapping windows, all of a call together.
        """
        if len(self.words) > self.keep:  # words not asked for since the last time are forgotten
            self.words, self.older = {}, self.words
        out, short, long = {}, [], []
        for w in words:
            ids = self.words.get(w)
            if ids is None and (ids := self.older.get(w)) is not None:
                self.words[w] = ids
            if ids is None:
                raw = w.encode()
                ids = self.whole.get(raw)
                if ids is None:
                    (short if len(raw) <= WHOLE_WORD else long).append((w, raw))
                    continue
            out[w] = ids
        found = dict(zip((w for w, _ in short), self._contract([r for _, r in short]), strict=True))
        self.words.update(found)
        out.update(found)
        out.update(zip((w for w, _ in long), pieces.joined([r for _, r in long], self._contract, self.length), strict=True))
        return out

    def _cut(self, new: list[bytes]) -> list[list[str]]:
        """The words of each piece. Pieces that begin with white space and end with a printed character are cut in one go."""
        out: list[list[str]] = [[]] * len(new)
        plain = [i for i, p in enumerate(new) if p[0] in b" \n\t\r" and 32 < p[-1] < 127]
        texts = [new[i].decode() for i in plain]
        words = self.words_of("".join(texts))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        at = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        if len(ends) and (not len(at) or at[-1] != ends[-1]):
            raise ValueError("the pattern does not match every character")
        stop = np.searchsorted(at, ends, side="right").tolist()
        for i, a, b in zip(plain, [0, *stop], stop, strict=False):
            out[i] = words[a:b]
        for i in set(range(len(new))).difference(plain):
            out[i] = self.words_of(new[i].decode())
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of consecutive texts (their bytes, and where each begins and the last ends), and where each one's begin and the last's end."""
        cut, first = pieces.cut(data, starts)
        coded = cut.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        known = self.pieces
        if len(known) > self.keep:
            known.clear()
        new = [p for p in distinct if p not in known]
        words = self._cut(new)
        ids = self.word_ids(set().union(*words)).__getitem__
        fresh = {p: b"".join(map(ids, w)) for p, w in zip(new, words, strict=True)}
        known.update((p, x) for p, x in fresh.items() if len(p) <= KEPT_BYTES)
        lists = [fresh[p] if p in fresh else known[p] for p in distinct]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        each = sizes[code]
        ends = np.concatenate(([0], np.cumsum(each)))
        flat = np.frombuffer(b"".join(lists), "<i4")
        index = np.repeat(((np.cumsum(sizes) - sizes)[code] - ends[:-1]).astype(np.int32), each)
        index += np.arange(len(index), dtype=np.int32)
        return flat[index], ends[first]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The bytes of consecutive lists of ids; unknown ids raise."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or not self.length[ids].all()):
            raise ValueError("unknown token id")
        parts: list[list[bytes]] = [[] for _ in starts[1:]]
        for i in range(0, len(ids), DECODED):
            pos = np.arange(i, min(i + DECODED, len(ids)))
            doc = np.searchsorted(starts, pos, side="right") - 1
            found = self._run(DECODE, "tokens", doc=doc, pos=pos, id=ids[pos[0] : pos[-1] + 1])
            for k, raw in zip(found.column("doc").to_pylist(), found.column("bytes").to_pylist(), strict=True):
                parts[k].append(raw)
        return [p[0] if len(p) == 1 else b"".join(p) for p in parts]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _lists(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``ids`` (array of int) of the whole text; null texts have none."""
    source = only(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            for first, data, starts in shingles.runs(batch.column("text"), TEXT_BYTES):
                lists = _lists(*own.encode(data, starts))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(lists)), lists], names=["id", "ids"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the id and ``decoded`` (binary) of its token ids; null lists decode to nothing."""
    source = only(df, id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
            raw = own.decode(np.concatenate([np.zeros(0, np.int32), *lists]), np.cumsum([0, *map(len, lists)]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], names=["id", "decoded"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: the id, ``n_tokens`` and the digests of the ids and of the bytes that they decode to; ``with_ids`` adds ``ids``.

    Null texts count as empty; null ids and repeated rows give a row each; an empty table gives
    none; other columns are ignored. Texts are taken whole; those that don't decode to themselves
    raise an error.
    """
    source = only(df, id=id_col, text=text_col)
    columns = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            for first, data, starts in shingles.runs(batch.column("text"), TEXT_BYTES):
                ids, at = own.encode(data, starts)
                decoded = own.decode(ids, at)
                if any(d != data[a:b].tobytes() for d, a, b in zip(decoded, starts, starts[1:], strict=False)):
                    raise ValueError("a text does not decode to itself")
                spans = list(zip(at.tolist(), at[1:].tolist(), strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, len(spans)),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in spans], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                        *[_lists(ids, at)] * with_ids,
                    ],
                    names=columns,
                )

    kinds = f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return source.mapInArrow(run, kinds).withColumnRenamed("id", id_col)
