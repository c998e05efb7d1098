"""Column functions over the fields of transcripts: language, counts, confidences of words, recognised pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions import text as T
from callweave.functions.lexicon import Lexicon, plain

# Confidences below these are low and very low, and how many words are listed.
LOW, VERY_LOW, LISTED = 0.40, 0.20, 30
RECOGNISED = "result array<struct<word: string, start: double, end: double, conf: double>>, text string"


def _is_object(language: Column) -> Column:
    return F.startswith(F.ltrim(language), F.lit("{"))


def language_code(language: Column, selected: Column) -> Column:
    """The code in a JSON object ``language`` (null if it has none), else ``language`` itself, else ``selected``."""
    return F.when(_is_object(language), F.get_json_object(language, "$.code")).otherwise(F.coalesce(language, selected))


def language_confidence(language: Column, detected: Column) -> Column:
    """The confidence in a JSON object ``language`` (null if it has none), else ``detected``."""
    return F.when(_is_object(language), F.get_json_object(language, "$.confidence")).otherwise(detected)


def raw_word_count(word_count: Column, words: Column, text: Column) -> Column:
    """The stored count, else the number of listed words, else of words in the text; null without any."""
    return F.coalesce(word_count, F.when(words.isNotNull(), F.size(words)), F.when(text.isNotNull(), T.count_words(text)))


def mean_confidence(words: Column) -> Column:
    """The mean of the words' confidences; null without any."""
    known = F.filter(F.transform(words, lambda w: w["conf"]), lambda c: c.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, c: s + c) / F.size(known))


def average_confidence(average: Column, words: Column) -> Column:
    return F.round(F.coalesce(average, mean_confidence(words)), 4)


def word_confidences(words: Column, lexicon: Lexicon, listed: int = LISTED) -> Column:
    """Counts of words by confidence, and up to ``listed`` of each kind that a reviewer should see, in order."""
    idle = [plain(w) for w in [*lexicon.number_words, *lexicon.empty_phrases]]
    important = lambda w: F.array_contains(T.texts(lexicon.important_words()), w["word"])
    removable = lambda w: (F.length(w["word"]) >= 4) & ~F.regexp_like(w["word"], F.lit(r"^\d+$")) & ~F.array_contains(T.texts(idle), w["word"]) & ~important(w)
    each = F.transform(words, lambda w: F.struct(T.normalize_text(w["word"]).alias("word"), w["conf"].alias("conf")))
    each = F.coalesce(F.filter(each, lambda w: (w["word"] != "") & w["conf"].isNotNull()), F.array().cast("array<struct<word:string,conf:double>>"))
    rounded = lambda ws: F.slice(F.transform(ws, lambda w: F.struct(w["word"].alias("word"), F.round(w["conf"], 4).alias("conf"))), 1, listed)

    def counted(known: Column) -> Column:
        low, very = F.filter(known, lambda w: w["conf"] < LOW), F.filter(known, lambda w: w["conf"] < VERY_LOW)
        return F.struct(
            F.size(known).alias("total"),
            F.size(low).alias("low"),
            F.size(very).alias("very_low"),
            F.when(F.size(known) > 0, F.round(F.size(low) / F.size(known), 4)).alias("low_ratio"),
            rounded(F.filter(low, important)).alias("low_important"),
            rounded(very).alias("very_low_words"),
            rounded(F.filter(very, removable)).alias("removable"),
        )

    return T.let(each, counted)


def format_confidences(words: Column) -> Column:
    """``word:0.1234; ...`` of (word, conf)."""
    return F.array_join(F.transform(words, lambda w: F.format_string("%s:%.4f", w["word"], w["conf"])), "; ")


def recognised_piece(piece: Column) -> Column:
    """start, end (two decimals) and text of a recogniser's JSON; null where it has neither text nor words."""

    def read(p: Column) -> Column:
        words = p["result"]
        some = F.coalesce(F.size(words), F.lit(0)) > 0
        edge = lambda at, name: F.round(F.coalesce(F.try_element_at(words, F.lit(at))[name], F.lit(0.0)), 2)
        told = F.struct(edge(1, "start").alias("start"), edge(-1, "end").alias("end"), T.clean_string(p["text"]).alias("text"), words.alias("words"))
        return F.when(some | (T.clean_string(p["text"]) != ""), told)

    return T.let(F.from_json(piece, RECOGNISED), read)
