"""Conversations from turns: clean every turn, join what is left, judge the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callweave.functions import records
from callweave.functions import text as T
from callweave.functions.lexicon import DEFAULT, Lexicon
from callweave.sources.scratch import fresh
from callweave.sources.tables import TRANSCRIPT


#: Turns of a conversation that are joined first: its ranges of so many turns are joined at the end.
RANGE = 4096


def clean_turns(df: DataFrame, lexicon: Lexicon = DEFAULT, text_col: str = "text") -> DataFrame:
    """``df`` with ``cleaned_text`` ('' if the turn says nothing), ``removed_parts``, ``empty_reason`` and ``turn_words``."""
    (piece,) = fresh(df, "piece")
    out = df.withColumn(piece, clean_text(F.col(text_col), lexicon))
    return out.withColumns({"removed_parts": F.col(piece)["removed"], "cleaned_text": F.col(piece)["text"], "empty_reason": F.col(piece)["reason"], "turn_words": T.count_words(F.col(text_col))}).drop(piece)


def conversations(df: DataFrame, lexicon: Lexicon = DEFAULT, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row for each conversation: cleaned transcript, keywords, flags, review priority and readiness; turns of one place go by their texts.

    Turns are dealt in order, so one long conversation fills many tasks. Each joins ranges of RANGE
    turns at most and counts what was removed; a conversation is then joined from its ranges.
    """
    given = df.select(F.col(id_col).alias("conversation"), F.col(order_col).alias("place"), F.col(text_col).alias("text"))
    dealt = given.repartitionByRange("conversation", "place", "text").sortWithinPartitions("conversation", "place", "text")
    turns = clean_turns(dealt, lexicon).withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    kept = F.when(F.col("cleaned_text") != "", F.struct("at", "cleaned_text"))
    ranges = turns.groupBy("conversation", "task", F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / RANGE).alias("range")).agg(
        F.array_sort(F.collect_list(kept)).alias("kept"),
        F.sum(T.noise_parts(F.col("removed_parts"))).alias("noise"),
        F.max(T.has_personal(F.col("removed_parts"))).alias("personal"),
        F.sum("turn_words").alias("words"),
        F.count("*").alias("turns"),
    )
    spoken = F.array_join(F.transform("kept", lambda x: x["cleaned_text"]), " ")
    joined = ranges.select("*", spoken.alias("spoken")).groupBy("conversation").agg(
        F.array_sort(F.collect_list(F.when(F.col("spoken") != "", F.struct("task", "range", "spoken")))).alias("ranges"),
        F.sum("noise").alias("noise"),
        F.max("personal").alias("personal"),
        F.sum("words").alias("raw_words"),
        F.sum("turns").alias("n_turns"),
    )
    whole = joined.withColumn("cleaned_transcript", F.array_join(F.transform("ranges", lambda x: x["spoken"]), " "))
    whole = whole.withColumn("empty_reason", T.empty_reason(F.col("cleaned_transcript"), lexicon, True)).withColumn("is_empty", F.col("empty_reason") != "useful")
    missing = F.lit(None)
    flags = T.quality_flags(missing.cast("double"), missing.cast("string"), missing.cast("boolean"), F.col("noise"), F.col("personal"), F.col("cleaned_transcript"), F.col("is_empty"), F.col("raw_words"))
    out = whole.withColumns({"clean_words": T.count_words(F.col("cleaned_transcript")), "problem_keywords": T.keywords_in(F.col("cleaned_transcript"), lexicon.keywords), "quality_flags": flags})
    out = out.withColumn("review_priority", T.review_priority(F.col("is_empty"), F.col("cleaned_transcript"), F.col("quality_flags")))
    out = out.withColumns({"cleaning_ratio": T.cleaning_ratio(F.col("raw_words"), F.col("clean_words")), "ready": ~F.col("is_empty") & (F.col("cleaned_transcript") != "") & (F.col("review_priority") != "high")})
    return out.drop("ranges", "noise", "personal").withColumnRenamed("conversation", id_col)


def summary(processed: DataFrame) -> DataFrame:
    """One row of counts over conversations."""
    return processed.agg(
        F.count("*").alias("total"),
        F.count_if("is_empty").alias("empty"),
        F.count_if(~F.col("is_empty")).alias("useful"),
        F.count_if(F.size("quality_flags") > 0).alias("review_needed"),
        F.count_if("ready").alias("ready"),
        *[F.count_if(F.col("review_priority") == p).alias(f"priority_{p}") for p in ("low", "medium", "high")],
    )


def flag_counts(processed: DataFrame) -> DataFrame:
    return processed.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def keyword_windows(tokens: Column | str, keywords: Column | str, before: int = 7, after: int = 18, most: int = 4) -> Column:
    """Stretches of ``tokens`` around ``keywords``: longest keywords first, none overlapping an earlier one, ``most`` at most."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    wanted = F.col(keywords) if isinstance(keywords, str) else keywords
    parts = F.transform(wanted, lambda k, i: F.struct((-F.size(F.split(k, " "))).alias("w"), i.alias("i"), F.split(k, " ").alias("p"), F.substring_index(k, " ", 1).alias("first")))
    hits = F.flatten(
        F.transform(
            F.array_sort(parts),
            lambda k: F.transform(
                F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - F.size(k["p"]), F.lit(0))), lambda i: (F.get(t, i) == k["first"]) & (F.slice(t, i + 1, F.size(k["p"])) == k["p"])),
                lambda i: F.struct(F.greatest(i - before, F.lit(0)).alias("s"), F.least(i + F.size(k["p"]) + after, F.size(t)).alias("e")),
            ),
        )
    )
    none = F.array().cast("array<struct<s:int,e:int>>")
    taken = F.aggregate(hits, none, lambda got, h: F.when((F.size(got) < most) & ~F.exists(got, lambda g: (h["s"] < g["e"]) & (g["s"] < h["e"])), F.array_append(got, F.struct(h["s"].cast("int").alias("s"), h["e"].cast("int").alias("e")))).otherwise(got))
    return F.transform(taken, lambda g: F.array_join(F.slice(t, g["s"] + 1, g["e"] - g["s"]), " "))


def clean_text(text: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """A struct of one piece of speech: ``text`` ('' if it says nothing), ``removed`` (sorted), ``reason`` and ``words``."""

    def judged(c: Column) -> Column:
        named = F.contains(c["text"], F.lit("[name]")) & ~T.has_keyword(c["text"], lexicon.keywords)
        left = F.struct(F.when(named, "").otherwise(c["text"]).alias("text"), F.when(named, F.array_append(c["removed"], F.lit("drop_pii_only_segment"))).otherwise(c["removed"]).alias("removed"))
        counted = lambda x: F.struct(x["text"].alias("text"), x["removed"].alias("removed"), T.count_words(x["text"]).alias("words"))
        with_reason = lambda x: F.struct(x["text"].alias("text"), x["removed"].alias("removed"), x["words"].alias("words"), T.empty_reason(x["text"], lexicon, True, x["words"]).alias("reason"))
        done = lambda x: F.struct(
            F.when(x["reason"] == "useful", x["text"]).otherwise("").alias("text"),
            F.array_sort(F.array_distinct(x["removed"])).alias("removed"),
            x["reason"].alias("reason"),
            F.when(x["reason"] == "useful", x["words"]).otherwise(0).alias("words"),
        )
        return T.let(T.let(T.let(left, counted), with_reason), done)

    def masked(s: Column) -> Column:
        both = lambda m: F.struct(F.lower(m["text"]).alias("text"), F.concat(s["reasons"], m["reasons"]).alias("removed"))
        return T.let(T.masked(s["text"], lexicon.number_words), both)

    return T.let(T.let(T.stripped(T.normalize_text(text), lexicon.patterns), masked), judged)


def semantic_text(cleaned: Column, keywords: Column, kept: Column, lexicon: Lexicon = DEFAULT, parts: int = 4, words: int = 55) -> Column:
    """What a conversation is about, in ``words`` words: its best keywords, then what was said around them.

    All texts are normalised. ``kept`` are the useful pieces in order: they are read until ``parts`` stretches are found. Without
    pieces, or where none has a keyword, the whole ``cleaned`` text is used. '' gives ''.
    """
    around = lambda text, k: T.let(T.words_of(text), lambda t: keyword_windows(t, k))
    none = F.array().cast("array<string>")

    def more(got: Column, piece: Column, k: Column) -> Column:
        def found(s: Column) -> Column:
            hit = F.exists(k, lambda x: F.contains(s, x))
            return F.when(hit, T.let(around(s, k), lambda w: F.when(F.size(w) > 0, F.concat(got, w)).otherwise(F.array_append(got, s)))).otherwise(got)

        return F.when(F.size(got) >= parts, got).otherwise(T.let(T.remove_noise(piece, lexicon, True), found))

    def told(x: Column) -> Column:
        k, whole = x["k"], x["whole"]
        of_pieces = F.when(F.size(k) > 0, F.aggregate(F.coalesce(kept, none), none, lambda got, piece: more(got, piece, k))).otherwise(none)
        found = T.let(of_pieces, lambda p: F.when((F.size(p) == 0) & (F.size(k) > 0), around(whole, k)).otherwise(p))
        found = T.let(found, lambda p: F.when(F.size(p) == 0, F.array(whole)).otherwise(p))
        distinct = F.array_distinct(F.filter(found, lambda p: p != ""))
        body = T.trim_words(T.remove_noise(F.array_join(distinct, " "), lexicon, True), words, True)
        text = F.array_join(F.filter(F.array_append(k, body), lambda p: p != ""), " ")
        return F.when(whole == "", "").otherwise(T.trim_words(T.remove_noise(text, lexicon, True), words, True))

    return T.let(F.struct(T.ranked_keywords(keywords, lexicon).alias("k"), T.remove_noise(cleaned, lexicon, True).alias("whole")), told)


def judged(items: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The listed pieces of ``process``, a row each: ``file_name, place, raw_text, kept, cleaned_text, removed_parts, empty_reason``.

    Pieces are dealt out before they are cleaned, and cleaned once; texts as a whole aren't judged.
    """
    pieces = items.select("file_name", F.posexplode("segments").alias("place", "s")).select("file_name", "place", F.col("s.text").alias("raw_text"))
    cleaned = pieces.withColumn("c", clean_text(F.col("raw_text"), lexicon))
    return cleaned.select("file_name", "place", "raw_text", (F.col("c.reason") == "useful").alias("kept"), F.col("c.text").alias("cleaned_text"), F.col("c.removed").alias("removed_parts"), F.col("c.reason").alias("empty_reason"))


def process(items: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Transcripts as ``tables.read_transcripts`` gives them, cleaned and judged, one row each; nothing is shuffled.

    Pieces are cleaned one by one and joined in order; a transcript without pieces is cleaned whole,
    and what was removed of it isn't listed. Rows with ``error`` have status ``error``, empty texts,
    the flag ``transcription_error`` and high priority. Null and empty texts are empty conversations.
    """
    items = items.select(*[F.col(f"`{f.name}`") for f in StructType.fromDDL(TRANSCRIPT)])
    failed = F.col("error").isNotNull()
    some = F.coalesce(F.size("segments"), F.lit(0)) > 0
    # A transcript without pieces is one, which is not listed.
    said = F.when(some, F.transform("segments", lambda s: s["text"])).otherwise(F.array("text"))
    pieces = F.transform(said, lambda s, i: F.struct(i.alias("index"), s.alias("raw_text"), clean_text(s, lexicon).alias("c")))
    flat = lambda p: F.struct(p["index"].alias("index"), p["raw_text"].alias("raw_text"), p["c"]["text"].alias("cleaned_text"), p["c"]["removed"].alias("removed_parts"), p["c"]["reason"].alias("empty_reason"))
    listed = lambda useful: F.transform(F.filter("_pieces", lambda p: some & ((p["c"]["reason"] == "useful") == F.lit(useful))), flat)
    out = items.select("*", pieces.alias("_pieces"))
    out = out.withColumns(
        {
            "segments_cleaned": listed(True),
            "segments_removed": listed(False),
            "_removed": F.flatten(F.transform(F.filter("_pieces", lambda p: some), lambda p: p["c"]["removed"])),
            "_cleaned": F.array_join(F.transform(F.filter("_pieces", lambda p: p["c"]["reason"] == "useful"), lambda p: p["c"]["text"]), " "),
            # Pieces are joined by blanks, so no word spans two of them.
            "_words": F.aggregate("_pieces", F.lit(0), lambda n, p: n + p["c"]["words"]),
        }
    )
    out = out.withColumns({"_reason": T.empty_reason(F.col("_cleaned"), lexicon, True, F.col("_words")), "_keywords": T.keywords_in(F.col("_cleaned"), lexicon.keywords)})
    language = records.language_code(F.col("language"), F.col("selected_language"))
    sure = records.language_confidence(F.col("language"), F.col("language_detection.confidence"))
    raw_words = records.raw_word_count(F.col("word_count"), F.col("words"), F.col("text"))
    empty, clean_words = F.col("_reason") != "useful", F.col("_words")
    flags = T.quality_flags(F.col("avg_confidence"), sure, F.col("fallback_language_used"), T.noise_parts(F.col("_removed")), T.has_personal(F.col("_removed")), F.col("_cleaned"), empty, F.col("word_count"), clean_words)
    unless_failed = lambda value, otherwise=None: F.when(failed, F.lit(otherwise)).otherwise(value)
    out = out.select(
        "file_name",
        "file_path",
        F.when(failed, "error").otherwise("processed").alias("status"),
        "error",
        language.alias("selected_language"),
        sure.alias("language_confidence"),
        unless_failed(F.coalesce("text", F.lit("")), "").alias("raw_transcript"),
        unless_failed(F.col("_cleaned"), "").alias("cleaned_transcript"),
        unless_failed(semantic_text(F.col("_cleaned"), F.col("_keywords"), F.transform("segments_cleaned", lambda p: p["cleaned_text"]), lexicon), "").alias("semantic_text"),
        (failed | empty).alias("is_empty_call"),
        unless_failed(F.col("_reason"), "transcription_error").alias("empty_reason"),
        unless_failed(raw_words).alias("word_count_raw"),
        unless_failed(clean_words).alias("word_count_cleaned"),
        unless_failed(T.cleaning_ratio(raw_words, clean_words)).alias("cleaning_ratio"),
        unless_failed(records.average_confidence(F.col("avg_confidence"), F.col("words"))).alias("avg_confidence"),
        F.when(~failed, F.col("_keywords")).alias("problem_keywords_found"),
        F.when(~failed, F.array_sort(F.array_distinct("_removed"))).alias("removed_parts"),
        F.when(failed, F.array(F.lit("transcription_error"))).otherwise(flags).alias("quality_flags"),
        "segments_cleaned",
        "segments_removed",
        "transcription_time_seconds",
        "total_time_with_detection_seconds",
    )
    out = out.withColumn("review_priority", T.review_priority(F.col("is_empty_call"), F.col("cleaned_transcript"), F.col("quality_flags")))
    return out.withColumn("ready_for_classification", ~F.col("is_empty_call") & (F.col("cleaned_transcript") != "") & (F.col("review_priority") != "high"))


def process_summary(processed: DataFrame) -> DataFrame:
    """One row of counts over ``process``; null priorities count as high."""
    level = F.when(F.col("review_priority").isin("low", "medium"), F.col("review_priority")).otherwise("high")
    return processed.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_empty_call")).alias("useful"),
        F.count_if("is_empty_call").alias("empty"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.size("quality_flags") > 0).alias("review_needed"),
        F.count_if("ready_for_classification").alias("ready"),
        F.count_if(~F.col("ready_for_classification")).alias("not_ready"),
        *[F.count_if(level == p).alias(f"priority_{p}") for p in ("low", "medium", "high")],
    )
