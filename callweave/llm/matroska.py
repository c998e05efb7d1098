"""Media columns in Matroska: EBML elements, clusters, laced blocks and cues, as packet tables.

A payload is stored as one PCM track of 8-bit samples: frames of FRAME bytes, up to eight of them
laced in a block (equal sizes: fixed lacing, else EBML lacing), blocks in clusters, one cue for
each cluster. The parser reads any lacing and unknown-size elements, and gives every packet's
track, time and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from callweave.llm.common import only, stored

# Fixed values of the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TIMESTAMP_SCALE, TRACK_NUMBER, DEFAULT_DURATION = 0x2AD7B1, 0xD7, 0x23E383
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS}

RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 8
FRAME_MS = FRAME * 1000 // RATE


def vint(n: int) -> bytes:
    """``n`` as a size of variable length."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


HEAD = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
TRACK_TABLE = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(0x73C5, 1) + number(0x83, 2) + number(0x9C, 1) + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(0x86, b"A_PCM/INT/LIT") + element(AUDIO, element(0xB5, struct.pack(">d", RATE)) + number(0x9F, 1) + number(0x6264, 8))))


def block(frames: list[bytes], at: int) -> bytes:
    """A SimpleBlock of track 1 with ``frames`` laced, ``at`` ms from its cluster."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        flags, lace = 0x80, b""
    elif len(set(sizes)) == 1:
        flags, lace = 0x84, bytes([len(frames) - 1])
    else:
        steps = b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
        flags, lace = 0x86, bytes([len(frames) - 1]) + vint(sizes[0]) + steps
    return element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", at, flags) + lace + b"".join(frames))


def signed_vint(n: int) -> bytes:
    length = 1
    while not -((1 << 7 * length - 1) - 1) <= n <= (1 << 7 * length - 1) - 1:
        length += 1
    return (n + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")


def write(payload: bytes) -> bytes:
    """``payload`` as a Matroska file of one 8-bit PCM track."""
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(0x4489, struct.pack(">d", len(payload) * 1000 / RATE)) + element(0x4D80, b"callweave") + element(0x5741, b"callweave"))
    parts, cues, position = [info, TRACK_TABLE], [], len(info) + len(TRACK_TABLE)
    step = FRAME * LACED
    for start in range(0, len(payload), step * BLOCKS):
        at = start * 1000 // RATE
        blocks = []
        for first in range(start, min(start + step * BLOCKS, len(payload)), step):
            frames = [payload[i : i + FRAME] for i in range(first, min(first + step, len(payload)), FRAME)]
            blocks.append(block(frames, first * 1000 // RATE - at))
        parts.append(element(CLUSTER, number(TIMESTAMP, at) + b"".join(blocks)))
        cues.append(element(CUE_POINT, number(CUE_TIME, at) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, position))))
        position += len(parts[-1])
    return HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


@dataclass
class Packets:
    """What a file holds: packets as (cluster, block, lace, track, time in ms, offset, size, keyframe), cues as (time, track, offset of the cluster)."""

    rows: list[tuple[int, int, int, int, float, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _vint_at(data: bytes, i: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """The number at ``i``, where it ends, and whether it says that the size is unknown."""
    if i >= len(data) or not data[i]:
        raise ValueError(f"no variable-length number at byte {i}")
    length = 9 - data[i].bit_length()
    if i + length > len(data):
        raise ValueError(f"cut short at byte {i}")
    n = int.from_bytes(data[i : i + length], "big")
    bare = n & (1 << 7 * length) - 1
    return n if keep_marker else bare, i + length, bare == (1 << 7 * length) - 1


def _lace(data: bytes, i: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block whose lacing begins at ``i``, and where the first frame begins."""
    if not kind:
        return [end - i], i
    n, i = data[i] + 1, i + 1
    if kind == 2:
        return [(end - i) // n] * n, i
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == 1:
            size = 0
            while data[i] == 255:
                size, i = size + 255, i + 1
            size, i = size + data[i], i + 1
        else:
            start = i
            size, i, _ = _vint_at(data, i)
            if k:
                size += sizes[-1] - (1 << 7 * (i - start) - 1) + 1
        sizes.append(size)
    return [*sizes, end - i - sum(sizes)], i


def parse(data: bytes) -> Packets:
    """The packet table of a Matroska file; broken files raise ValueError."""
    out = Packets()
    scale, default_ms, segment = 1_000_000, {}, 0
    cluster_time, n_block = 0, 0
    track: dict[int, int] = {}
    cue: dict[int, int] = {}

    def walk(i: int, end: int, parent: int) -> int:
        nonlocal scale, segment, cluster_time, n_block
        while i < end:
            start = i
            ident, i, _ = _vint_at(data, i, True)
            if parent == CLUSTER and ident in TOP_LEVEL:
                return start  # ends a cluster of unknown size
            size, i, unknown = _vint_at(data, i)
            stop = end if unknown else i + size
            if stop > end:
                raise ValueError(f"element at byte {start} leaves its parent")
            if ident in MASTERS:
                if ident == SEGMENT:
                    segment = i
                elif ident == CLUSTER:
                    out.clusters.append(start)
                    n_block = 0
                elif ident == TRACK:
                    track.clear()
                elif ident == CUE_POINT:
                    cue.clear()
                i = walk(i, stop, ident)
                if ident == TRACK and DEFAULT_DURATION in track:
                    default_ms[track.get(TRACK_NUMBER, 1)] = track[DEFAULT_DURATION] / 1e6
                elif ident == CUE_POINT:
                    out.cues.append((cue[CUE_TIME], cue[CUE_TRACK], segment + cue[CUE_CLUSTER]))
                continue
            if ident in (SIMPLE_BLOCK, BLOCK):
                number_, j, _ = _vint_at(data, i)
                at, flags = struct.unpack_from(">hB", data, j)
                sizes, j = _lace(data, j + 3, stop, flags >> 1 & 3)
                if min(sizes) < 0 or j + sum(sizes) > stop:
                    raise ValueError(f"lacing of the block at byte {start} is broken")
                time = (cluster_time + at) * scale / 1e6
                for k, size in enumerate(sizes):
                    out.rows.append((len(out.clusters) - 1, n_block, k, number_, time + k * default_ms.get(number_, 0), j, size, bool(flags & 0x80)))
                    j += size
                n_block += 1
            elif ident in (TIMESTAMP, TIMESTAMP_SCALE, TRACK_NUMBER, DEFAULT_DURATION, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                value = int.from_bytes(data[i:stop], "big")
                if ident == TIMESTAMP:
                    cluster_time = value
                elif ident == TIMESTAMP_SCALE:
                    scale = value
                elif parent == TRACK:
                    track[ident] = value
                else:
                    cue[ident] = value
            i = stop
        return i

    walk(0, len(data), 0)
    return out


PACKETS = "cluster_no int, block_no int, lace_no int, track int, time_ms double, byte_start long, n_bytes long, keyframe boolean"


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each packet of the Matroska files in ``media_col``: id and the columns of PACKETS.

    Null and empty media have no packets; repeated rows have theirs repeated; broken files raise.
    """
    source = only(df, id=id_col, media=media_col)
    names = ["id", *[x.split()[0] for x in PACKETS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            for i, media in enumerate(batch.column("media")):
                if media.is_valid and (rows := parse(media.as_py()).rows if len(media.as_py()) else []):
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    ident = batch.column("id").take(pa.array([i] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([ident, *columns], names=names)

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {PACKETS}").withColumnRenamed("id", id_col)


def padded(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes of ``text`` with zeros up to a positive multiple of 64, and their own number."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``media``: each whole text as a Matroska file, with its id and ``n_bytes``. Null texts count as empty."""
    source = only(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [padded(x.as_py()) for x in batch.column("text")]
            media = pa.array((write(payload) for payload, _ in made), pa.large_binary()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for _, n in made], pa.int64()), media], names=["id", "n_bytes", "media"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


#: Facts of a file that each of its packets carries.
FACTS = "row long, text_bytes long, media_bytes long, media_sha256 string, clusters int, cues int"
#: Bytes of packets in an Arrow batch.
PART = 1 << 20


def packet_rows(row: int, text_bytes: int, media: bytes) -> Iterator[pa.RecordBatch]:
    """A file's packets with FACTS, PACKETS and their ``data``, in batches of about PART bytes; cues that miss the clusters raise."""
    found = parse(media)
    if [c[2] for c in found.cues] != found.clusters:
        raise ValueError("cues do not point at the clusters")
    facts = (row, text_bytes, len(media), hashlib.sha256(media).hexdigest(), len(found.clusters), len(found.cues))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in f"{FACTS}, {PACKETS}".split(", ")]
    view, first, size = memoryview(media), 0, 0
    for i, packet in enumerate(found.rows, 1):
        size += packet[6]
        if size >= PART or i == len(found.rows):
            some = found.rows[first:i]
            columns = [pa.array([v] * len(some), t) for v, t in zip(facts, kinds, strict=True)] + [pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bytes(view[r[5] : r[5] + r[6]]) for r in some], pa.binary())], names=[*names, "data"])
            first, size = i, 0


class Described:
    """What is told of a file from its packets, in order, with running digests of the payload."""

    def __init__(self, batch: pa.RecordBatch, at: int):
        self.row, self.text_bytes, self.media_bytes, self.media_sha256, self.clusters, self.cues = (batch.column(x.split()[0])[at].as_py() for x in FACTS.split(", "))
        self.sha256, self.tail, self.counts, self.packets, self.blocks = hashlib.sha256(), b"", np.zeros(256, np.int64), 0, 0

    def feed(self, data: np.ndarray, lace: np.ndarray) -> None:
        self.sha256.update(data)
        self.tail = (self.tail + data[-64:].tobytes())[-64:]
        self.counts += np.bincount(data, minlength=256)
        self.packets, self.blocks = self.packets + len(lace), self.blocks + int((lace == 0).sum())

    def told(self) -> tuple:
        values = np.arange(256)
        n, loud = int(self.counts.sum()), int(self.counts[np.abs(values - 128) > 64].sum())
        feature = f"packets={self.packets};blocks={self.blocks};clusters={self.clusters};cues={self.cues};ms={n * 1000 // RATE};sum={int(self.counts @ values)};mode={int(self.counts.argmax())};values={int((self.counts > 0).sum())};loud={loud}"
        return self.row, self.text_bytes, n, self.sha256.hexdigest(), zlib.crc32(self.tail), self.media_bytes, self.media_sha256, feature


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The facts of each file (see ``Described.told``) from batches of its packets; a file's packets follow one another."""
    now: Described | None = None
    for batch in batches:
        row, lace, data = batch.column("row").to_numpy(), batch.column("lace_no").to_numpy(), batch.column("data")
        _, offsets, raw = data.buffers()
        ends = np.frombuffer(offsets, np.int32)[data.offset : data.offset + len(data) + 1]
        flat = np.frombuffer(raw, np.uint8)
        for a, b in zip(edges := np.flatnonzero(np.diff(row, prepend=-1)).tolist(), [*edges[1:], len(row)], strict=True):
            if now is None or now.row != row[a]:
                if now is not None:
                    yield now.told()
                now = Described(batch, a)
            now.feed(flat[ends[a] : ends[b]], lace[a:b])
    if now is not None:
        yield now.told()


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the text's bytes, the payload and digests read back from its stored form, and a feature string.

    Texts are stored as media in the shared folder. Tasks that read them give the packet table, with
    each packet's bytes, and others go along its rows: nothing is shuffled, and no step holds more of
    a long payload than the file that it reads. Null texts count as empty (64 zero bytes); null ids
    and repeated rows give a row each, equal texts equal values; an empty table gives none; other
    columns are ignored.
    """
    media = stored(text_media(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), "n_bytes", "media"), "media", "zstd")
    kind = media.schema["id"].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column("media")):
                for packets in packet_rows(batch.column("row")[i].as_py(), batch.column("n_bytes")[i].as_py(), raw.as_py()):
                    ident = batch.column("id").take(pa.array([i] * len(packets), pa.int64()))
                    yield packets.append_column("id", ident)

    names = ["row", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, object] = {}

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    row = batch.column("row").to_numpy()
                    ids.update((int(row[i]), batch.column("id")[int(i)].as_py()) for i in np.flatnonzero(np.diff(row, prepend=-1)))
                    yield batch

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([ids.pop(x[0]) for x in found], id_type), *columns], names=["id", *names])

        held: list[tuple] = []
        for one in described(seen()):
            held.append(one)
            if len(held) == 1000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    id_type = to_arrow_type(media.schema["id"].dataType)
    packets = media.mapInArrow(parsed, f"{FACTS}, {PACKETS}, data binary, id {kind}")
    kinds = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types, strict=True))
    out = packets.mapInArrow(told, f"id {kind}, {kinds}")
    return out.select(F.col("id").alias(id_col), *names[1:])
