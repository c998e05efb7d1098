"""Audio files as rows: finding them, cutting raw samples, and recognising speech by a function that the caller brings.

Samples are 16-bit mono at 16,000 a second. All cutting is done by Spark's own functions on binary columns.
Long recordings are rows of chunks: detection reads those that it listens to, and a recogniser goes along
a recording's chunks in order, so no task holds a recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import language, records

# Fixed values.
EXTENSIONS = [".wav", ".mp3", ".m4a", ".mp4", ".ogg", ".flac", ".aac", ".wma", ".webm", ".opus", ".aiff", ".aif"]
RATE, SAMPLE_BYTES, SILENCE_BYTES = 16_000, 2, 8_000


def audio_files(spark: SparkSession, path: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """``path, modificationTime, length, content`` of the audio files below ``path``, by extension in any case, in order of path.

    Content is only read where a plan uses it. A missing folder raises.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(extensions)).orderBy("path")


def seconds_of(pcm: Column) -> Column:
    return F.octet_length(pcm) / F.lit(RATE * SAMPLE_BYTES)


def slice_pcm(pcm: Column, start: Column, seconds: Column) -> Column:
    """The samples of ``seconds`` from ``start``, cut at both ends of the recording; empty beyond it."""
    sample = lambda at: F.greatest(F.floor(at * RATE), F.lit(0)) * SAMPLE_BYTES
    begin = F.least(sample(start), F.octet_length(pcm).cast("long"))
    end = F.least(sample(start + seconds), F.octet_length(pcm).cast("long"))
    return F.substring(pcm, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))


def detection_pcm(pcm: Column) -> Column:
    """The stretches that a language is told by, with a quarter of a second of silence between them."""
    windows = F.transform(language.detection_windows(seconds_of(pcm)), lambda w: slice_pcm(pcm, w["start"], w["length"]))
    parts = F.filter(windows, lambda p: F.octet_length(p) > 0)
    quiet = F.lit(bytes(SILENCE_BYTES))
    joined = F.aggregate(parts, F.lit(None).cast("binary"), lambda got, p: F.when(got.isNull(), p).otherwise(F.concat(got, quiet, p)))
    return F.coalesce(joined, pcm)


#: Bytes of a chunk: half a minute.
CHUNK = 30 * RATE * SAMPLE_BYTES


def chunked(df: DataFrame, id_col: str = "path", pcm_col: str = "pcm", size: int = CHUNK) -> DataFrame:
    """``id, chunk, last, pcm``: each recording's samples in chunks of ``size`` bytes, from 0; an empty or null one has one empty chunk."""
    samples = F.coalesce(F.col(pcm_col), F.lit(b""))
    last = F.greatest(F.ceil(F.octet_length(samples) / size).cast("int") - 1, F.lit(0))
    each = df.select(F.col(id_col).alias("id"), samples.alias("samples"), last.alias("to")).select("*", F.explode(F.sequence(F.lit(0), "to")).alias("chunk"))
    return each.select("id", "chunk", (F.col("chunk") == F.col("to")).alias("last"), F.substring("samples", F.col("chunk") * size + 1, F.lit(size)).alias("pcm"))


def detection_chunks(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """``id, pcm``: what ``detection_pcm`` gives of each recording, from its chunks; only those that it listens to are brought together."""
    lengths = chunks.groupBy(F.col("id").alias("its")).agg(F.sum(F.octet_length("pcm").cast("long")).alias("bytes"))
    windows = language.detection_windows(F.col("bytes") / (RATE * SAMPLE_BYTES))
    sample = lambda at: F.greatest(F.floor(at * RATE), F.lit(0)) * SAMPLE_BYTES
    spans = lengths.select("its", "bytes", F.posexplode(windows).alias("window", "w")).select("its", "window", F.least(sample(F.col("w.start")), "bytes").alias("begin"), F.least(sample(F.col("w.start") + F.col("w.length")), "bytes").alias("end"))
    needed = spans.where("end > begin").select("its", "window", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("end") - 1) / size))).alias("at"))
    met = chunks.join(needed, (F.col("id") == F.col("its")) & (F.col("chunk") == F.col("at")))
    first = F.greatest(F.col("begin") - F.col("chunk") * size, F.lit(0))
    part = F.substring("pcm", (first + 1).cast("int"), (F.least(F.col("end") - F.col("chunk") * size, F.lit(size)) - first).cast("int"))
    parts = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("window", "chunk", part.alias("pcm")))).alias("parts"))  # fifteen seconds at most
    quiet = F.lit(bytes(SILENCE_BYTES))
    start = F.struct(F.lit(None).cast("int").alias("window"), F.lit(b"").alias("pcm"))
    step = lambda s, p: F.struct(p["window"].alias("window"), F.when(s["window"] != p["window"], F.concat(s["pcm"], quiet, p["pcm"])).otherwise(F.concat(s["pcm"], p["pcm"])).alias("pcm"))
    heard = parts.select("id", F.aggregate("parts", start, step)["pcm"].alias("pcm"))
    return lengths.join(heard, F.col("its") == F.col("id"), "left").select(F.col("its").alias("id"), F.coalesce("pcm", F.lit(b"")).alias("pcm"))


#: A piece of speech that a recogniser finished: its JSON (see ``records.recognised_piece``); an error ends a recording.
PIECE = "place int, piece string, error string"


def recognise_chunks(chunks: DataFrame, load: Callable[[], Callable[[], tuple[Callable[[bytes], str | None], Callable[[], str | None]]]]) -> DataFrame:
    """``id, place, piece, error`` of each finished piece, from a recording's chunks in order (see ``chunked``).

    ``load`` runs once in a task and gives a function that begins a recording: it returns ``feed``,
    which takes samples and gives the JSON of a piece once one is finished, and ``finish``, which gives
    what is left. A recording that fails, or lacks a chunk, ends with an error; the others go on.
    """
    dealt = chunks.select("id", "chunk", "last", "pcm").repartition("id").sortWithinPartitions("id", "chunk")
    kind = dealt.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = load()
        now, expected, place, feed, finish = None, 0, 0, None, None
        out: list[tuple] = []

        def said(ident, piece: str | None = None, error: str | None = None) -> None:
            nonlocal place
            if piece is not None or error is not None:
                out.append((ident, place, piece, error))
                place += 1

        def close(missing: bool) -> None:
            nonlocal feed
            if feed is not None and missing:
                said(now, error=f"chunk {expected} is missing")
            feed = None

        for batch in batches:
            for ident, chunk, last, pcm in zip(*(batch.column(c) for c in ("id", "chunk", "last", "pcm")), strict=True):
                ident, chunk = ident.as_py(), chunk.as_py()
                if chunk == 0 or ident != now:
                    close(True)
                    now, expected, place = ident, 0, 0
                    feed, finish = begin() if chunk == 0 else (None, None)
                    if chunk:
                        said(ident, error="chunk 0 is missing")
                if feed is None:
                    continue
                if chunk != expected:
                    close(True)
                    continue
                try:
                    said(ident, feed(pcm.as_py()))
                    if last.as_py():
                        said(ident, finish())
                        feed = None
                except Exception as e:
                    said(ident, error=str(e))
                    feed = None
                expected += 1
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("id").type, pa.int32(), pa.string(), pa.string()), strict=True)], names=["id", "place", "piece", "error"])
            out.clear()
        close(True)
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("id").type, pa.int32(), pa.string(), pa.string()), strict=True)], names=["id", "place", "piece", "error"])

    return dealt.mapInArrow(run, f"id {kind}, {PIECE}")


def transcripts_of(pieces: DataFrame, id_col: str = "file_name") -> DataFrame:
    """A transcript of each recording (``text, segments, words, word_count, avg_confidence, error``) from its pieces; one that failed keeps its error alone."""
    read = pieces.select("id", "place", "error", records.recognised_piece(F.col("piece")).alias("r"))
    heard = F.when(F.col("r").isNotNull(), F.struct("place", "r"))
    whole = read.groupBy("id").agg(F.array_sort(F.collect_list(heard)).alias("heard"), F.max("error").alias("error"))
    ok = lambda value: F.when(F.col("error").isNull(), value)
    word = lambda w: F.struct(w["word"].alias("word"), w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end"), w["conf"].cast("double").alias("conf"))
    words = F.transform(F.flatten(F.transform("heard", lambda h: F.coalesce(h["r"]["words"], F.array()))), word)
    segments = F.transform("heard", lambda h: F.struct(h["r"]["start"].alias("start"), h["r"]["end"].alias("end"), h["r"]["text"].alias("text")))
    text = F.array_join(F.filter(F.transform("heard", lambda h: h["r"]["text"]), lambda t: t != ""), " ")
    told = whole.select("id", ok(text).alias("text"), ok(segments).alias("segments"), ok(words).alias("words"), "error")
    return told.select(F.col("id").alias(id_col), "text", "segments", "words", ok(F.size("words")).alias("word_count"), ok(records.average_confidence(F.lit(None).cast("double"), F.col("words"))).alias("avg_confidence"), "error")


#: What a recogniser says of a recording: its text, and its words with times and confidences (or none).
SAID = "text string, words array<struct<word: string, start: double, end: double, conf: double>>, error string"


def recognise(df: DataFrame, load: Callable[[], Callable[[bytes], str | tuple[str, list[dict] | None]]], id_col: str = "path", pcm_col: str = "pcm") -> DataFrame:
    """``id, text, words, word_count, avg_confidence, error`` of each recording.

    ``load`` runs once in a task and gives the function from samples to text, or to text and words
    (``word``, ``start``, ``end``, ``conf``). Without words the count is that of the text's words and
    the mean confidence null. A recording that fails has its message in ``error``; the others go on.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(pcm_col).alias("pcm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load()
        word = pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("conf", pa.float64())])
        for batch in batches:
            found: list[tuple[str | None, list[dict] | None, str | None]] = []
            for pcm in batch.column("pcm").to_pylist():
                try:
                    said = own(pcm or b"")
                    found.append((said, None, None) if isinstance(said, str) else (said[0], said[1], None))
                except Exception as e:
                    found.append((None, None, str(e)))
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.list_(word), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "text", "words", "error"])

    said = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {SAID}")
    counted = said.select("id", "text", "words", records.raw_word_count(F.lit(None).cast("int"), F.col("words"), F.col("text")).alias("word_count"), records.mean_confidence(F.col("words")).alias("avg_confidence"), "error")
    return counted.withColumnRenamed("id", id_col)


def main_language(df: DataFrame, small: tuple[Callable, Callable], large: tuple[Callable, Callable], hints: tuple[list[str], list[str]], id_col: str = "path", pcm_col: str = "pcm") -> DataFrame:
    """``id`` and ``detected`` (see ``language.detect``) of each recording, told from its detection stretches.

    Both small recognisers listen first, without confidences. Recordings whose call for the special
    language stands on too little are heard again by both large ones, with the confidences of their
    words, and what those say replaces the first result.
    """
    heard = df.select(F.col(id_col).alias("id"), detection_pcm(F.col(pcm_col)).alias("pcm"))

    def told(rows: DataFrame, models: tuple[Callable, Callable], sure: bool) -> DataFrame:
        sides = [recognise(rows, load, "id", "pcm").select("id", F.col("text").alias(f"text_{k}"), F.col("avg_confidence").alias(f"conf_{k}")) for k, load in enumerate(models)]
        both = sides[0].join(sides[1], "id")
        confidences = (F.col("conf_0"), F.col("conf_1")) if sure else (None, None)
        return both.select("id", language.detect(F.col("text_0"), F.col("text_1"), hints, confidences).alias("detected"))

    first = told(heard, small, False)
    again = told(heard.join(first.where("detected.recheck").select("id"), "id", "left_semi"), large, True)
    out = first.join(again.withColumnRenamed("detected", "second"), "id", "left").select("id", F.coalesce("second", "detected").alias("detected"))
    return out.withColumn("language", language.or_default(F.col("detected.code"))).withColumnRenamed("id", id_col)
