"""A quality classifier by attention over passages (multiple-instance learning).

A text is a bag of passages of PASSAGE_WORDS words. Each passage is described by how often its
kinds of characters follow each other and by how its words repeat, and encoded by a small layer.
Gated attention, learned from the labels of whole documents, weighs the passages; the score is read
from their weighted sum. The model is fitted on a bounded sample of labelled documents with
numpy and sent to all tasks; scoring reads every passage of every text. A long text is read in
blocks, whose attention sums are merged, so memory doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import shingles
from callweave.llm.common import only, unused

PASSAGE_WORDS = 48
#: Bytes of text that are read together; longer texts are read in blocks of about as many.
BLOCK = 1 << 19
#: Passages of a labelled document that are learned from at most, evenly spread over its whole text.
BAG = 64
#: Labelled documents that the model is fitted on at most (those whose ids hash lowest).
SAMPLE = 2500
FOLDS, HELD_OUT = 5, 0
KEEP = 0.3

_KIND = np.full(256, 0, np.int64)
for _k, _chars in enumerate((" ", "\n", "\t\r\x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "#$%&*", "|", "<>{}[]()=/\\_+~^`", "'\"", "-:;", "@"), start=1):
    _KIND[list(_chars.encode())] = _k
_KIND[128:192], _KIND[192:] = 17, 18
KINDS = 19
FEATURES = KINDS * KINDS + 4


def passages(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of consecutive texts, and the number of each one's text.

    A text without words is one passage of zeros. Pairs of characters count where both lie in the
    passage, with the white space behind its words.
    """
    n = len(starts) - 1
    words, doc = shingles.word_hashes(data, starts[:-1]) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    begins, ends = shingles.word_spans(data, starts[:-1]) if len(data) else (doc, doc)
    count = np.bincount(doc, minlength=n)
    place = np.arange(len(words)) - (np.cumsum(count) - count)[doc]
    per_doc = np.maximum(1, -(-count // PASSAGE_WORDS))
    offset = np.cumsum(per_doc) - per_doc
    passage = offset[doc] + place // PASSAGE_WORDS
    total = int(per_doc.sum())
    out = np.zeros((total, FEATURES), np.float32)
    owner = np.repeat(np.arange(n), per_doc)
    if len(words):
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        cut = begins[first]
        kind = _KIND[data]
        of_byte = np.searchsorted(cut, np.arange(len(data) - 1), side="right") - 1
        inside = of_byte >= 0
        inside[cut[cut > 0] - 1] = False  # pairs across passages
        pair = passage[first][of_byte] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
        counts = np.bincount(pair[inside], minlength=total * KINDS * KINDS).reshape(total, -1)
        out[:, : KINDS * KINDS] = counts / np.maximum(1, counts.sum(1, keepdims=True))
        in_passage = np.bincount(passage, minlength=total)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (passage[1:] == passage[:-1])
        order = np.lexsort((words, passage))
        same = np.zeros(len(words), bool)
        same[1:] = (words[order[1:]] == words[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
        share = lambda x: np.bincount(passage, weights=x, minlength=total) / np.maximum(1, in_passage)
        out[:, -4] = share(again)
        out[:, -3] = np.bincount(passage[order], weights=same, minlength=total) / np.maximum(1, in_passage)
        out[:, -2] = share(np.minimum(ends - begins, 40)) / 10
        out[:, -1] = np.minimum(in_passage, PASSAGE_WORDS) / PASSAGE_WORDS
    return out, owner


def blocks(data: np.ndarray, size: int = BLOCK) -> Iterator[np.ndarray]:
    """The bytes of one text in blocks of whole passages, of about ``size`` bytes unless its words are longer."""
    start, step = 0, size
    while len(data) - start > step:
        begins, _ = shingles.word_spans(data[start : start + step], np.zeros(1, np.int64))
        whole = (len(begins) - 1) // PASSAGE_WORDS * PASSAGE_WORDS
        if whole <= 0:
            step *= 2
            continue
        yield data[start : start + begins[whole]]
        start, step = start + int(begins[whole]), size
    yield data[start:]


@dataclass
class Model:
    """Encoder, gated attention and read-out, with the scaling of the features."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """Attention over the passages of ``n`` texts; ``top`` and ``sum`` are what ``merged`` needs of a text's parts."""
        w = self.w
        h = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w["enc"] + w["enc0"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        a = (t * g) @ w["a"]
        top = np.full(n, -np.inf, a.dtype)
        np.maximum.at(top, owner, a)
        e = np.exp(a - top[owner])
        total = np.bincount(owner, weights=e, minlength=n)
        weight = e / total[owner]
        at = np.searchsorted(owner, np.arange(n))
        z = np.add.reduceat(h * weight[:, None].astype(h.dtype), at)
        return {"h": h, "t": t, "g": g, "weight": weight, "top": top, "sum": total, "z": z, "logit": z @ w["c"] + w["c0"]}

    def logits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log odds of consecutive texts; one that is longer than BLOCK is read in parts, whose attention sums are merged."""
        n = len(starts) - 1
        if n != 1 or len(data) <= BLOCK:
            return self.forward(*passages(data, starts), n)["logit"].astype(float)
        top, total, z = -np.inf, 0.0, 0.0
        for part in blocks(data):
            f = self.forward(*passages(part, np.array([0, len(part)])), 1)
            new = max(top, float(f["top"][0]))
            before, own = total * np.exp(top - new), float(f["sum"][0]) * np.exp(float(f["top"][0]) - new)
            z = (z * before + f["z"][0].astype(float) * own) / (before + own)
            top, total = new, before + own
        return np.array([float(z @ self.w["c"] + self.w["c0"])])

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(data, starts), -30, 30)))


def bag(data: np.ndarray) -> np.ndarray:
    """At most BAG passages of one text, every 2^k-th of the whole text."""
    kept, step, seen = np.zeros((0, FEATURES), np.float32), 1, 0
    for part in blocks(data):
        x, _ = passages(part, np.array([0, len(part)]))
        kept = np.concatenate([kept, x[-seen % step :: step]])
        seen += len(x)
        while len(kept) > BAG:
            kept, step = kept[::2], step * 2
    return kept


class Packed(Sequence):
    """Bags of compressed features (about a sixteenth of their bytes, as most are 0); one is unpacked whenever it is read."""

    CODEC = "lz4"

    def __init__(self, parts: list[bytes], lengths: list[int]):
        self.parts, self.lengths = parts, lengths

    @classmethod
    def pack(cls, x: np.ndarray) -> bytes:
        return pa.compress(np.ascontiguousarray(x, np.float32).tobytes(), cls.CODEC, asbytes=True)

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, i: int) -> np.ndarray:
        return np.frombuffer(pa.decompress(self.parts[i], self.lengths[i] * FEATURES * 4, self.CODEC, asbytes=True), np.float32).reshape(-1, FEATURES)


def scaling(bags: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation (1e-3 at least) of the features of all passages, one bag at a time."""
    n, total, square = 0, np.zeros(FEATURES), np.zeros(FEATURES)
    for k in range(len(bags)):
        n, total = n + len(bags[k]), total + bags[k].sum(0, dtype=float)
    mean = total / max(1, n)
    for k in range(len(bags)):
        square += ((bags[k] - mean) ** 2).sum(0)
    return mean.astype(np.float32), np.maximum((square / max(1, n)) ** 0.5, 1e-3).astype(np.float32)


def fit(bags: Sequence[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 24, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
    """Adam on the log loss of whole documents, in bags of passages; the same sample gives the same model."""
    rng = np.random.Generator(np.random.PCG64(seed))
    model = Model(*scaling(bags), {})
    shape = {"enc": (FEATURES, hidden), "enc0": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "a": (gate,), "c": (hidden,), "c0": ()}
    w = model.w = {k: (rng.normal(0, s[0] ** -0.5, s) if s and k[-1] != "0" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    if not len(labels):
        return model
    mean = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    w["c0"] = np.float32(np.log(mean / (1 - mean)))
    m1, m2, step = {k: np.zeros(s) for k, s in shape.items()}, {k: np.zeros(s) for k, s in shape.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for start in range(0, len(order), 64):
            chosen = order[start : start + 64]
            read = [bags[i] for i in chosen]
            x, owner = np.concatenate(read), np.repeat(np.arange(len(chosen)), [len(b) for b in read])
            f = model.forward(x, owner, len(chosen))
            d = (1 / (1 + np.exp(-f["logit"])) - labels[chosen]) / len(chosen)
            dz = d[:, None] * w["c"]
            along = (f["h"] * dz[owner]).sum(1)
            mean_along = np.bincount(owner, weights=f["weight"] * along, minlength=len(chosen))
            da = f["weight"] * (along - mean_along[owner])
            tg = f["t"] * f["g"]
            dtg = da[:, None] * w["a"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["weight"][:, None] * dz[owner] + dt @ w["v"].T + dg @ w["u"].T) * (1 - f["h"] ** 2)
            scaled = np.clip((x - model.mean) / model.scale, -6, 6)
            grads = {"enc": scaled.T @ dh, "enc0": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": tg.T @ da, "c": f["z"].T @ d, "c0": d.sum()}
            step += 1
            for k, grad in grads.items():
                grad = grad + decay * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad**2
                w[k] = (w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str):
    """Whether crc32 of the id's text, modulo FOLDS, is HELD_OUT; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model fitted on at most ``sample`` labelled documents that aren't held out.

    Rows without a label, text or id teach nothing; of an id's labels the largest counts, of its rows
    the one of the least digest, which is chosen before any leaves its task. The features of the sample
    are collected, compressed: at most ``sample`` documents of at most BAG passages, a row of FEATURES
    floats each (233 MB for long texts, 15 as sent), of which the driver unpacks 64 documents at a time.
    """
    known = only(labels, id=id_col, label=label_col).where("label is not null and id is not null").where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = only(df, id=id_col, text=text_col).where("text is not null").join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, starts in shingles.runs(batch.column("text")):
                bags = [bag(data[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
                columns = [batch.column(c).slice(first, len(bags)) for c in ("id", "label")]
                yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.int32()), pa.array([len(b) for b in bags], pa.int32()), pa.array(map(Packed.pack, bags), pa.binary())], names=["id", "label", "length", "bag"])

    kind = rows.schema["id"].dataType.simpleString()
    found = sorted(rows.mapInArrow(run, f"id {kind}, label int, length int, bag binary").collect(), key=lambda r: r["id"])
    return fit(Packed([bytes(r["bag"]) for r in found], [r["length"] for r in found]), np.array([r["label"] for r in found], np.float32))


def with_score(df: DataFrame, model: Model, text_col: str, score_col: str) -> DataFrame:
    """``df`` with the score of each whole text, from 0 to 1; null texts count as empty."""
    from pyspark.sql import types as T

    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores = [own.score(data, starts) for _, data, starts in shingles.runs(batch.column(text_col), BLOCK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*batch.schema.names, score_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())]))


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted`` (1 from a score of KEEP on).

    The score reads the text alone. Null and empty texts have the score of an empty passage; null
    ids and repeated rows are scored like others; without labels all score alike; an empty table
    gives no rows; other columns are ignored.
    """
    model = train(df, labels, id_col, text_col)
    scored = with_score(only(df, id=id_col, text=text_col), model, "text", "score")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_predicted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``model`` scores KEEP or more, with its own columns.

    Null and empty texts have the score of an empty passage; repeated rows share their fate.
    """
    (name,) = unused(df, "score")
    return with_score(df, model, text_col, name).where(F.col(name) >= KEEP).drop(name)
