"""Functions and operators on small Russian, Kazakh and English examples."""

import csv
import io
import json
import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave.functions import language, lexicon, records
from callweave.functions import text as T
from callweave.functions.lexicon import DEFAULT, Lexicon, read_lexicon
from callweave.operators import clusters, hierarchy, transcripts, vectors
from callweave.plans import registry
from callweave.sources import audio, batches, documents, tables
from callweave.streaming import ingest
from tests import brute


def one(spark, text, *columns):
    return tuple(spark.createDataFrame([(text,)], "t string").select(*columns).first())


def test_normalizing_and_counting(spark):
    t = F.col("t")
    assert one(spark, "  Счёт №5 (ОТКРЫТ)!\n e-mail a@b.kz ", T.normalize_text(t)) == ("счет 5 открыт e-mail a@b.kz",)
    assert one(spark, None, T.normalize_text(t), T.count_words(t), T.clean_string(t)) == ("", 0, "")
    assert one(spark, "счёт один-два", T.count_words(t)) == (4,)
    assert one(spark, "сегодня карта есть Қайырлы", T.report_tokens(t, DEFAULT.stopwords)) == (["сегодня", "карта", "қайырлы"],)
    assert [one(spark, v, T.cluster_number(F.col("t")))[0] for v in ("3.9", "-2.5", "x", None, "inf")] == [3, -2, -1, -1, -1]


def test_patterns_apply_in_order(spark):
    text, reasons = T.strip_patterns(T.normalize_text(F.col("t")), DEFAULT.patterns)
    assert one(spark, "Здравствуйте, звонок записывается. Карта моя. Спасибо!", text, reasons) == (". карта моя.", ["closing_ru", "greeting_ru", "recording_notice_ru"])


def test_personal_data_is_masked_in_order(spark):
    text, reasons = T.mask_pii(F.col("t"), DEFAULT.number_words)
    assert one(spark, "иин 123456789012 тел +7 701 123 45 67 почта a.b@c.kz", text, reasons) == ("иин [IIN] тел [PHONE] почта [EMAIL]", ["iin_digits", "phone_digits", "email"])
    assert one(spark, "код один два три четыре пять всё", text, reasons) == ("код [NUMBER_SEQ] всё", ["spoken_number_sequence"])
    assert one(spark, "это иванова", text, reasons) == ("это [NAME]", ["single_surname_ru"])
    assert one(spark, "один два три", text, reasons) == ("один два три", [])


def test_reasons_of_empty_turns(spark):
    reason = T.empty_reason(F.col("t"), DEFAULT)
    found = [one(spark, t, reason)[0] for t in (None, "Да", "да один 12", "просто так", "мы тут были вчера", "карта не работает", "мы были там вчера вечером дома")]
    assert found == ["empty_text", "empty_phrase", "only_empty_or_number_words", "too_short_without_problem_signal", "short_noninformative", "useful", "useful"]


def test_default_lists_are_whole(spark):
    """Distinct entries by SURVEY 2.15."""
    sizes = {n: len(set(getattr(DEFAULT, n))) for n in ("generic", "weak", "strong", "canonical", "keywords", "critical", "unimportant", "empty_phrases", "number_words", "stopwords")}
    assert sizes == {"generic": 28, "weak": 16, "strong": 74, "canonical": 14, "keywords": 448, "critical": 51, "unimportant": 47, "empty_phrases": 122, "number_words": 184, "stopwords": 63}
    assert (len(lexicon.KEYWORDS["ru"]), len(lexicon.KEYWORDS["kk"]), len(set(lexicon.RU_HINTS)), len(set(lexicon.KK_HINTS)), len(DEFAULT.patterns)) == (270, 178, 28, 18, 57)
    said = ["Face ID", "502", "возврат денег", "сессия истекла", "подозрительная операция"]
    assert [one(spark, t, T.empty_reason(F.col("t"), DEFAULT))[0] for t in said] == ["useful"] * len(said)
    assert "возврат денег" in one(spark, "хочу возврат денег", T.keywords_in(T.normalize_text(F.col("t")), DEFAULT.keywords))[0]


def test_language_scores(spark):
    f = language.features(F.col("t"), ["да", "карта"], ["сәлем", "қазір"])
    ru, kk = language.score(f, None, False), language.score(f, None, True)
    base = min(math.log1p(3), math.log1p(22)) * 0.72
    assert one(spark, "да моя карта", ru, kk) == (round(base + 0.65 * 2 + 0.45, 4), 0.0)
    score = one(spark, "сәлем қазір барамын", kk)[0]
    assert score == pytest.approx(base + 0.38 * 3 + 0.85 * 2, abs=1e-4)
    assert one(spark, "", ru, kk) == (0.0, 0.0)


def test_conversation_is_cleaned_and_judged(spark):
    turns = [(1, 2, "карта не работает, мой номер 123456789012 и я не могу войти"), (1, 1, "Здравствуйте"), (2, 1, "да"), (2, 2, None)]
    got = {r["conv_id"]: r for r in transcripts.conversations(spark.createDataFrame(turns, "conv_id long, turn long, text string")).collect()}
    assert got[1]["cleaned_transcript"] == "карта не работает мой номер [iin] и я не могу войти"
    assert "pii_removed" in got[1]["quality_flags"] and got[1]["review_priority"] == "medium" and got[1]["ready"]
    assert got[2]["is_empty"] and got[2]["review_priority"] == "high" and not got[2]["ready"]
    totals = transcripts.summary(spark.createDataFrame(turns, "conv_id long, turn long, text string").transform(transcripts.conversations)).first()
    assert (totals["total"], totals["empty"], totals["priority_high"]) == (2, 1, 1)


def test_windows_do_not_overlap(spark):
    tokens = [f"w{i}" if i % 9 else "hit" for i in range(100)]
    df = spark.createDataFrame([(tokens, ["hit"])], "tokens array<string>, wanted array<string>")
    found = df.select(transcripts.keyword_windows("tokens", "wanted").alias("w")).first()["w"]
    spans = [(int(w.split()[1][1:]) - 1, len(w.split())) for w in found]
    assert len(found) == 4 and all(a + n <= b for (a, n), (b, _) in pairwise(spans))


def test_probabilities_and_reports(spark):
    rows = [(i, [math.cos(i / 9), math.sin(i / 9)], i % 2 if i < 9 else -1, "text of row", " ru" if i % 2 else "kk") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, vec array<float>, cluster_id int, text string, lang string")
    scored = clusters.probabilities(df, "id")
    for c in (0, 1):
        own = np.array([r[1] for r in rows if r[2] == c], np.float32).astype(float)
        mean = own.mean(0)
        cos = own @ mean / np.linalg.norm(own, axis=1) / np.linalg.norm(mean)
        want = 0.5 + 0.5 * (cos - cos.min()) / (cos.max() - cos.min())
        got = [r["probability"] for r in scored.where(F.col("cluster_id") == c).orderBy("id").collect()]
        assert np.allclose(got, want, atol=1e-4)
    assert scored.where("cluster_id = -1").first()["probability"] == 0
    report = {r["cluster_id"]: r for r in clusters.report(scored, "id", "text", "lang", []).collect()}
    assert report[1]["languages"] == "ru" and report[0]["cluster_size"] == 5 and report[-1]["cluster_status"] == "noise" and report[0]["top_terms"] == "text"


def test_clustering_finds_blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (np.eye(3)[i % 3] * 9 + rng.normal(0, 0.3, 3)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    for out in (clusters.kmeans(df, 3), clusters.ward(df, 3)):
        assert sorted(r["n"] for r in out.groupBy("cluster_id").agg(F.count_distinct((F.col("id") % 3)).alias("n")).collect()) == [1, 1, 1]
    reduced, explained = clusters.reduce_pca(df, 2)
    x = np.array([r[1] for r in rows])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert explained == pytest.approx(values[:2].sum() / values.sum(), abs=1e-6)
    assert np.var(np.array([r["reduced"] for r in reduced.collect()]), axis=0, ddof=1) == pytest.approx(values[:2], rel=1e-6)


def test_sources_and_streams(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"results": [{"file_name": "a", "segments": [{"start": 0, "end": 1, "text": "карта не работает"}, {"text": "да"}]}, {"file_name": "b", "error": "x"}]}))
    read = tables.read_transcripts(spark, str(tmp_path / "t.json"))
    turns = tables.segments(read)
    assert read.count() == 2 and [tuple(r) for r in turns.orderBy("turn").collect()] == [("a", 0, "карта не работает"), ("a", 1, "да")]
    turns.write.parquet(str(tmp_path / "turns"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns"))
    ingest.append_cleaned(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r["cleaned_text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"карта не работает", ""}
    tables.write_csv(turns.withColumn("x", F.array(F.lit(1), F.lit(2))), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["x"] == "1, 2"
    (tmp_path / "lex.json").write_text(json.dumps({"keywords": ["abc"], "patterns": [["x", "y"]]}))
    assert read_lexicon(spark, str(tmp_path / "lex.json")) == Lexicon(keywords=["abc"], patterns=[("x", "y")])
    assert tables.newest(turns, "turn", 1).first()["turn"] == 1


@pytest.mark.parametrize(
    ("raw", "text", "reason", "removed"),
    [
        ("Здравствуйте, спасибо", "", "empty_text", ["closing_ru", "greeting_ru"]),
        ("Здравствуйте, меня зовут Айгуль, карта заблокирована", "карта заблокирована", "useful", ["greeting_ru", "operator_intro_ru"]),
        ("не приходит код дата рождения первое мая", "не приходит код", "useful", ["birth_date_ru"]),
        ("иин 850101300123", "", "too_short_without_problem_signal", ["iin_digits"]),
        ("один два три четыре", "", "too_short_without_problem_signal", ["spoken_number_sequence"]),
        (None, "", "empty_text", []),
    ],
)
def test_pieces_of_speech(spark, raw, text, reason, removed):
    got = one(spark, raw, transcripts.clean_text(F.col("t")).alias("c"))[0]
    assert (got["text"], got["reason"], got["removed"]) == (text, reason, removed)


def test_keywords_and_semantic_texts(spark):
    said = "карта заблокирована не могу войти"
    found = T.keywords_in(F.col("t"), DEFAULT.keywords)
    assert one(spark, said, found, T.ranked_keywords(found, DEFAULT)) == (["войти", "карта", "карта заблокирована", "не могу", "не могу войти"], ["не могу войти", "карта заблокирована", "не могу", "войти"])
    none = F.array().cast("array<string>")
    assert one(spark, said, transcripts.semantic_text(F.col("t"), found, none)) == ("не могу войти карта заблокирована не могу войти карта заблокирована не могу войти",)
    wanted = F.array(F.lit("не приходит"), F.lit("смс"))
    assert one(spark, "смс не приходит", transcripts.semantic_text(F.col("t"), wanted, none)) == ("не приходит смс код смс не приходит",)
    assert one(spark, "", transcripts.semantic_text(F.col("t"), wanted, F.array(F.lit("")))) == ("",)
    assert one(spark, "номер обращения в банк", T.remove_noise(F.col("t"), DEFAULT)) == ("обращения в",)


def test_transcripts_are_processed(spark, tmp_path):
    said = "карта заблокирована не могу войти"
    items = [
        {"file_name": "a", "language": {"code": "ru", "confidence": "high"}, "text": said, "word_count": 5, "segments": [{"text": said}, {"text": "да"}]},
        {"file_name": "b", "error": "broken"},
        {"file_name": "c", "language": "kk", "language_detection": {"confidence": "low"}, "text": f"Здравствуйте {said}", "words": [{"word": "x", "conf": 0.5}, {"word": "y", "conf": 0.25}]},
        {"file_name": "d", "selected_language": "ru"},
    ]
    (tmp_path / "many.json").write_text(json.dumps({"results": items}))
    (tmp_path / "one.json").write_text(json.dumps(items[0]))
    read = tables.read_transcripts(spark, str(tmp_path / "many.json"))
    processed = transcripts.process(read)
    got = {r["file_name"]: r for r in processed.collect()}
    a, b, c, d = (got[x] for x in "abcd")
    assert (a["quality_flags"], a["review_priority"], a["ready_for_classification"], a["selected_language"]) == (["very_short_but_useful"], "medium", True, "ru")
    assert a["cleaned_transcript"] == said and [p["index"] for p in a["segments_removed"]] == [1]
    assert (b["status"], b["empty_reason"], b["quality_flags"], b["review_priority"], b["is_empty_call"], b["word_count_raw"]) == ("error", "transcription_error", ["transcription_error"], "high", True, None)
    assert (c["selected_language"], c["language_confidence"], c["word_count_raw"], c["avg_confidence"], c["removed_parts"], c["cleaned_transcript"]) == ("kk", "low", 2, 0.375, [], said)
    assert (d["selected_language"], d["is_empty_call"], d["empty_reason"], d["word_count_raw"]) == ("ru", True, "empty_text", None)
    totals = transcripts.process_summary(processed).first()
    assert (totals["total"], totals["useful"], totals["errors"], totals["ready"], totals["priority_high"]) == (4, 2, 1, 1, 3)
    assert tables.read_transcripts(spark, str(tmp_path / "one.json"), "single").count() == 1
    for name, mode in (("one", "many"), ("many", "single")):
        with pytest.raises(ValueError):
            tables.read_transcripts(spark, str(tmp_path / f"{name}.json"), mode)
    tables.append_results(processed.where("file_name = 'a'"), str(tmp_path / "results"))
    tables.append_results(processed.where("file_name = 'c'"), str(tmp_path / "results"))
    assert [r["file_name"] for r in tables.read_results(spark, str(tmp_path / "results"), 1).collect()] == ["c"]
    assert [r["file_name"] for r in tables.read_results(spark, str(tmp_path / "results")).collect()] == ["a", "c"]
    tables.write_review(processed, str(tmp_path / "review"))
    assert {r["quality_flags"] for r in tables.read_csv_records(spark, str(tmp_path / "review"), tables.REVIEW_COLUMNS).collect()} >= {"transcription_error", "very_short_but_useful"}
    tables.write_envelope(processed.orderBy("file_name"), transcripts.process_summary(processed), str(tmp_path / "out.json"), "many.json", {"notes": "é"})
    said = json.loads((tmp_path / "out.json").read_text("utf-8"))
    assert (said["source_file"], said["notes"], said["summary"]["total"]) == ("many.json", "é", 4) and [r["file_name"] for r in said["results"]] == sorted(r["file_name"] for r in processed.collect())
    assert "avg_confidence" in said["results"][0]
    with pytest.raises(FileExistsError):
        tables.write_envelope(processed, transcripts.process_summary(processed), str(tmp_path / "out.json"), "many.json")


def test_tables_keep_what_they_are_given(spark, tmp_path):
    odd = spark.createDataFrame([(1, 'a "quoted", text\nof two lines'), (2, "plain")], "id int, text string")
    tables.write_csv(odd, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in tables.read_csv_records(spark, str(tmp_path / "csv"), ["id", "text"]).collect()) == [("1", 'a "quoted", text\nof two lines'), ("2", "plain")]
    (tmp_path / "empty.csv").write_text("")
    for name in ("empty.csv", "absent.csv"):
        assert tables.read_csv_records(spark, str(tmp_path / name), ["id", "text"]).count() == 0
    path = str(tmp_path / "results")
    assert tables.read_results(spark, path).count() == 0 and tables.ensure_schema(spark, path, tables.RESULT_COLUMNS) is None
    odd.write.parquet(path)
    failed = tables.error_rows(spark.createDataFrame([("a.wav", "broken")], "file_name string, error string"))
    assert failed.columns == [*tables.RESULT_COLUMNS, "error"]
    tables.append_results(failed, path)
    tables.append_results(failed.withColumn("file_name", F.lit("b.wav")).unionByName(failed.withColumn("file_name", F.lit("c.wav"))), path)
    assert [r["file_name"] for r in tables.read_results(spark, path).collect()] == ["a.wav", "b.wav", "c.wav"]
    row = tables.read_results(spark, path, 1).first()
    assert (row["file_name"], row["quality_flags"], row["review_priority"], row["is_empty_call"], row["word_count_raw"]) == ("c.wav", "processing_error", "high", "true", "")
    aside = list(tmp_path.glob("results_*.bak"))
    assert len(aside) == 1 and spark.read.parquet(str(aside[0])).count() == 2
    assert tables.response_rows(failed).columns == tables.RESULT_COLUMNS
    assert tables.clear(spark, path, str(tmp_path / "csv"), str(tmp_path / "nothing")) == 2 and not (tmp_path / "results").exists()


def test_texts_are_normalised_once(spark):
    """No chain of replacements stands within a function that runs for each keyword, however often Catalyst inlines it."""
    df = spark.createDataFrame([("Карта, не работает!",)], "t string").withColumn("norm", T.normalize_text(F.col("t")))
    for column in (T.has_keyword(F.col("norm"), DEFAULT.keywords), T.keywords_in(F.col("norm"), DEFAULT.keywords), T.ranked_keywords(T.keywords_in(F.col("norm"), DEFAULT.keywords), DEFAULT)):
        plan = df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(T.KEPT) <= 2  # ranked_keywords normalises the keywords themselves too


def test_listed_pieces_are_cleaned_once(spark, tmp_path):
    """They are those of ``process``, from one reading of the rows and one cleaning of each piece."""
    said = [["карта заблокирована не могу войти", "да", "иин 850101300123"], [], None, ["", "Спасибо! Карта не работает"]]
    items = [{"file_name": str(i), "text": "карта", "error": "broken" if i == 3 else None, "segments": None if x is None else [{"text": t} for t in x]} for i, x in enumerate(said)]
    (tmp_path / "many.json").write_text(json.dumps({"results": items}))
    read = tables.read_transcripts(spark, str(tmp_path / "many.json"))
    got = transcripts.judged(read)
    flat = lambda r, p, kept: (r["file_name"], p["index"], p["raw_text"], kept, p["cleaned_text"], tuple(p["removed_parts"]), p["empty_reason"])
    want = {flat(r, p, kept) for r in transcripts.process(read).collect() for column, kept in (("segments_cleaned", True), ("segments_removed", False)) for p in r[column]}
    assert {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in got.collect()} == want and len(want) == 5 == got.count()
    plan = registry.judged_pieces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("phrase_of") == 1 == plan.count("n_chars") and "Union" not in plan


def test_words_of_a_transcript_are_counted_in_its_pieces(spark):
    """Not again in the whole text, for each flag and the ratio anew; characters are looked up in listed classes."""
    plan = registry.process_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(lower(coalesce(_cleaned" not in plan and "[^a-z" not in plan
    rows = transcripts.process(registry.transcript_items(spark, "/root/testdata/sf0.001"), registry.LEXICON).where("status = 'processed'")
    assert rows.where(F.col("word_count_cleaned") != T.count_words(F.col("cleaned_transcript"))).isEmpty()
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x10400)]))
    slow = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower("t"), F.lit("ё"), F.lit("е")), r"[^a-zа-яәғқңөұүһі0-9\s\[\]_@.+\-]", " "), r"\s+", " "))
    counted = F.regexp_count(F.lower("t"), F.lit(T.WORD))
    assert one(spark, every, T.normalize_text(F.col("t")) == slow, T.count_words(F.col("t")) == counted) == (True, True)


def test_patterns_are_tried_where_their_words_are(spark):
    assert T.needed(r"\bзвонок\s+(?:будет\s+)?записыва(?:е|и)тся\b") == "записыва" and T.needed("a|b") == "" and T.needed(r"\bab?[cd]\b") == "a"
    assert T.any_of(["ab", "abc", "b"]) == "(?:ab(?:c)?|b)"
    text, reasons = T.strip_patterns(F.col("t"), [(r"\bодин\b", "one"), (r"\bone\b", "two")])
    assert one(spark, "ОДИН One раз", text, reasons) == ("раз", ["one", "two"])


def test_confidences_of_words(spark):
    words = [("карта", 0.1), ("двадцать", 0.1), ("шелест", 0.15), ("да", 0.3), ("", 0.1), ("окно", None), ("окно", 0.9)]
    df = spark.createDataFrame([(words,), (None,)], "words array<struct<word:string,conf:double>>")
    full, none = (r["s"] for r in df.select(records.word_confidences(F.col("words"), DEFAULT).alias("s")).collect())
    assert (full["total"], full["low"], full["very_low"], full["low_ratio"]) == (5, 4, 3, 0.8)
    assert [w["word"] for w in full["low_important"]] == ["карта"] and [w["word"] for w in full["removable"]] == ["шелест"]
    assert (none["total"], none["low_ratio"], none["very_low_words"]) == (0, None, [])
    piece = json.dumps({"result": [{"word": "да", "start": 1.234, "end": 2.0, "conf": 1}, {"word": "нет", "start": 2, "end": 3.456, "conf": 0.5}], "text": " да нет "})
    got = one(spark, piece, records.recognised_piece(F.col("t")))[0]
    assert (got["start"], got["end"], got["text"]) == (1.23, 3.46, "да нет")
    assert one(spark, '{"text": " "}', records.recognised_piece(F.col("t"))) == (None,)


def test_audio(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    pcm = np.arange(16_000 * 60, dtype=np.int64).astype(np.int16).tobytes()
    (tmp_path / "sub" / "A.WAV").write_bytes(pcm)
    (tmp_path / "notes.txt").write_text("x")
    files = audio.audio_files(spark, str(tmp_path)).withColumnRenamed("content", "pcm")
    got = files.select(audio.seconds_of(F.col("pcm")).alias("s"), audio.detection_pcm(F.col("pcm")).alias("d"), audio.slice_pcm(F.col("pcm"), F.lit(59.5), F.lit(2.0)).alias("end"), audio.slice_pcm(F.col("pcm"), F.lit(61.0), F.lit(2.0)).alias("none")).collect()
    assert len(got) == 1 and got[0]["s"] == 60
    quiet = bytes(8000)
    assert bytes(got[0]["d"]) == quiet.join(pcm[a : a + 153_600] for a in (480_000, 960_000, 1_440_000))
    assert bytes(got[0]["end"]) == pcm[-16_000:] and bytes(got[0]["none"]) == b""

    def load():
        def words(samples: bytes) -> str:
            if not samples:
                raise ValueError("no samples")
            return f"{len(samples)} bytes"

        return words

    rows = spark.createDataFrame([("a", b"1234"), ("b", None)], "path string, pcm binary")
    said = {r["path"]: r for r in audio.recognise(rows, load).collect()}
    assert (said["a"]["text"], said["a"]["words"], said["a"]["word_count"], said["a"]["avg_confidence"], said["a"]["error"]) == ("4 bytes", None, 2, None, None)
    assert (said["b"]["text"], said["b"]["error"]) == (None, "no samples")


def speaker(by_length, conf=None):
    """A recogniser that knows recordings by their length."""

    def load():
        def say(samples: bytes):
            text = by_length.get(len(samples), "")
            return text if conf is None else (text, [{"word": w, "start": 0.0, "end": 1.0, "conf": conf} for w in text.split()])

        return say

    return load


def test_doubtful_languages_are_heard_again(spark):
    rows = spark.createDataFrame([("ru", bytes(8_000)), ("kk", bytes(16_000)), ("doubt", bytes(32_000)), ("none", bytes(64_000))], "path string, pcm binary")
    hints = (["да", "карта"], ["сәлем", "қазір"])
    small = (speaker({40_000: "да моя карта"}), speaker({64_000: "сәлем қазір барамын өте жақсы", 112_000: "қала"}))  # three stretches and two silences
    large = (speaker({112_000: "да карта моя"}, 1.0), speaker({112_000: "к"}, 0.5))
    got = {r["path"]: r for r in audio.main_language(rows, small, large, hints).collect()}
    assert {k: r["language"] for k, r in got.items()} == {"ru": "ru", "kk": "kk", "doubt": "ru", "none": "ru"}
    assert got["none"]["detected"]["code"] == "unknown" and got["doubt"]["detected"]["default_score"] == round(math.log1p(3) + 0.65 * 2 + 0.45, 4)


def test_language_of_two_recognisers(spark):
    hints = (["да", "карта"], ["сәлем", "қазір"])
    df = spark.createDataFrame([("да моя карта", ""), ("", "сәлем қазір барамын"), ("", "")], "ru string, kk string")
    got = [r["d"] for r in df.select(language.detect(F.col("ru"), F.col("kk"), hints).alias("d")).collect()]
    assert [g["code"] for g in got] == ["ru", "kk", "unknown"] and [g["recheck"] for g in got] == [False, False, False]
    assert one(spark, "unknown", language.or_default(F.col("t"))) == ("ru",)


def adjusted_rand(a, b):
    table = np.array([[np.sum((a == x) & (b == y)) for y in np.unique(b)] for x in np.unique(a)])
    pairs = lambda n: (n * (n - 1) / 2).sum()
    rows, columns, all_pairs = pairs(table.sum(1)), pairs(table.sum(0)), len(a) * (len(a) - 1) / 2
    expected = rows * columns / all_pairs
    most = (rows + columns) / 2
    return (pairs(table) - expected) / (most - expected) if most != expected else 1.0


def test_ward_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(5):
        c, w, k = rng.normal(size=(40, 3)), rng.integers(1, 5, 40).astype(float), int(rng.integers(1, 8))
        got, centre, weight, label = brute.ward_labels(c, w, k), c.copy(), w.copy(), np.arange(40)
        live = list(range(40))
        while len(live) > k:
            _, a, b = min((((centre[a] - centre[b]) ** 2).sum() * weight[a] * weight[b] / (weight[a] + weight[b]), a, b) for i, a in enumerate(live) for b in live[i + 1 :])
            centre[a] = (centre[a] * weight[a] + centre[b] * weight[b]) / (weight[a] + weight[b])
            weight[a] += weight[b]
            label[label == b] = a
            live.remove(b)
        assert adjusted_rand(got, label) == 1


@pytest.mark.parametrize("n, last, block, edges", [(300, 20, 64, 50), (5000, 1000, 2048, 2000)])
def test_hierarchies_equal_those_in_memory(spark, monkeypatch, n, last, block, edges):
    monkeypatch.setattr(hierarchy, "LAST", last)
    monkeypatch.setattr(hierarchy, "BLOCK", block)
    monkeypatch.setattr(hierarchy, "EDGES", edges)
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(12, 6)) * 3
    x = np.round(centre[rng.integers(0, 12, n)] + rng.normal(size=(n, 6)), 6)
    x[: n // 20] = x[n // 20 : 2 * (n // 20)]  # repeats
    x[-n // 30 :] = x[-1]  # a hot vector
    df = spark.createDataFrame([*enumerate(x.tolist()), (n, None)], "id long, vec array<double>").repartition(3)
    distinct, at, weight = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    same = lambda a, b: len(set(zip(a, b))) == len(set(a)) == len(set(b))
    got = [r["cluster_id"] for r in clusters.ward(df, 7).orderBy("id").collect()]
    assert got[n] is None and len(set(got[:n])) == 7 and same(got[:n], brute.ward_labels(distinct, weight, 7)[at.ravel()].tolist())
    sizes = [got.count(i) for i in range(7)]
    assert sizes == sorted(sizes, reverse=True)
    found = clusters.hdbscan(df, least_size=5).orderBy("id").collect()
    label, member = brute.density_clusters(distinct, weight.astype(float), 5, 4)
    assert same([r["cluster_id"] for r in found[:n]], label[at.ravel()].tolist()) and found[n]["cluster_id"] == -1
    assert np.allclose([r["probability"] for r in found[:n]], member[at.ravel()], atol=1e-4)
    assert [r["cluster_id"] == -1 for r in found[:n]] == (label[at.ravel()] == -1).tolist()


def test_rows_are_copied_for_few_blocks(spark):
    """600,000 rows used to be copied 74 times on either side."""
    assert [hierarchy.blocks_of(n) for n in (0, 1, 8193, 50_000, 200_000, 600_000)] == [1, 1, 2, 7, 8, 19]
    rows = spark.range(200_000).selectExpr("id", "array(id * 1.0D) as c")
    seen = hierarchy.in_blocks(rows, rows, lambda q, t: pa.table({"n": [len(q["id"]) + 0], "m": [len(t["id"])]}), "n long, m long", 200_000, 200_000)
    assert seen.agg(F.sum("n"), F.sum("m"), F.sum(F.col("n") * F.col("m"))).first()[:] == (8 * 200_000, 8 * 200_000, 200_000**2)


def test_hierarchies_of_odd_tables(spark):
    schema = "id long, vec array<double>, c string, w string, root string, node string, part string"
    rows = [(i, v, *"cwrnp") for i, v in enumerate([[1.0, 2.0], [1.0, 2.0], None, [1.0, 2.0]])]
    for df, want in ((spark.createDataFrame(rows, schema), 4), (spark.createDataFrame(rows[2:3], schema), 1), (spark.createDataFrame([], schema), 0)):
        for out in (clusters.ward(df, 3), clusters.hdbscan(df), clusters.kmeans(df, 3)):
            got = out.collect()
            assert len(got) == want and all(r["c"] == "c" and r["root"] == "r" for r in got)
            assert {r["cluster_id"] for r in got if r["vec"]} <= {0, -1}


def test_starts_of_kmeans_move_together(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (60, 3)) for c in np.eye(3) * 6] + [rng.normal(9, 0.4, (20, 3))])
    df = spark.createDataFrame([*enumerate(x.tolist())], "id long, vec array<double>").repartition(3)
    got = np.array([r["cluster_id"] for r in clusters.kmeans(df, 4).orderBy("id").collect()])
    assert adjusted_rand(got, np.repeat([0, 1, 2, 3], [60, 60, 60, 20])) == 1 and (got[180:] == 3).all()
    counted = clusters._means(df.select("vec"), {0: x[:4], 1: x[60:62]})
    near = ((x[:, None] - x[None, :4]) ** 2).sum(2)
    assert np.allclose(counted[2][0], near.min(1).sum()) and (counted[1][0] == np.bincount(near.argmin(1), minlength=4)).all()


def test_centres_settled_on_a_part_of_the_rows_rest_on_all(spark, monkeypatch):
    monkeypatch.setattr(clusters, "FIRST_CENTRES", 40)
    x = np.random.default_rng(4).normal(0, 1, (1500, 2))
    df = spark.createDataFrame([*enumerate(x.tolist())], "id long, vec array<double>").repartition(3)
    got = np.array([r["cluster_id"] for r in clusters.kmeans(df, 3, runs=3).orderBy("id").collect()])
    means = np.array([x[got == j].mean(0) for j in range(3)])
    assert (clusters.nearest_centre(x, means)[0] == got).mean() > 0.98  # each row's cluster is the nearest by the means of all rows
    cost = clusters.nearest_centre(x, means)[1].sum()
    full = [clusters.settled(x, clusters.first_centres(x, 3, s), 300, 1e-9) for s in range(10)]
    assert cost < 1.01 * min(clusters.nearest_centre(x, c)[1].sum() for c in full)


def test_small_tables_are_clustered_exactly(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(5, 0.3, (30, 2)), rng.uniform(-10, 15, (6, 2))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate([*points, points[0]])], "id long, vec array<double>")
    weight = np.ones(len(points))
    weight[0] = 2
    label, member = brute.density_clusters(points, weight, 4, 4)
    found = {r["id"]: r for r in clusters.hdbscan(df).collect()}
    assert adjusted_rand(np.array([found[i]["cluster_id"] for i in range(76)]), label) == 1 and found[76]["cluster_id"] == found[0]["cluster_id"]
    assert np.allclose([found[i]["probability"] for i in range(76)], member, atol=1e-4)
    exact = np.array([r["cluster_id"] for r in clusters.ward(df, 4).orderBy("id").collect()])
    assert adjusted_rand(exact[:76], brute.ward_labels(points, weight, 4)) == 1


def test_recordings_in_chunks(spark):
    rng = np.random.default_rng(0)
    pcm = {f"r{i}": rng.integers(0, 256, n, dtype=np.uint8).tobytes() for i, n in enumerate((0, 2, 7000, 64_000, 960_000, 2_000_000))}
    df = spark.createDataFrame([*pcm.items(), ("none", None)], "path string, pcm binary").repartition(3)
    chunks = audio.chunked(df, size=50_000)
    assert {r["id"]: r["n"] for r in chunks.groupBy("id").agg(F.count("*").alias("n")).collect()} == {"none": 1} | {k: max(1, -(-len(v) // 50_000)) for k, v in pcm.items()}
    want = {r["path"]: bytes(r["d"] or b"") for r in df.select("path", audio.detection_pcm(F.col("pcm")).alias("d")).collect()}
    assert {r["id"]: bytes(r["pcm"]) for r in audio.detection_chunks(chunks, 50_000).collect()} == want

    def load():
        def begin():
            seen = {"bytes": 0, "sum": 0}

            def feed(samples):
                if len(samples) == 7000:
                    raise ValueError("noise")
                seen["bytes"] += len(samples)
                seen["sum"] = (seen["sum"] * 31 + sum(samples)) % 1_000_003  # depends on order
                return json.dumps({"text": f"at {seen['bytes']}", "result": [{"word": "at", "start": 1, "end": 2, "conf": 0.5}]}) if seen["bytes"] % 100_000 == 0 and samples else None

            return feed, lambda: json.dumps({"text": f"sum {seen['sum']}"})

        return begin

    def alone(raw):
        feed, finish = load()()
        said = [feed(raw[i : i + 50_000]) for i in range(0, max(len(raw), 1), 50_000)] + [finish()]
        return " ".join(json.loads(x)["text"] for x in said if x)

    pieces = audio.recognise_chunks(chunks, load)
    got = {r["file_name"]: r for r in audio.transcripts_of(pieces).collect()}
    assert got["r2"]["error"] == "noise" and got["r2"]["text"] is None
    for k in ("r0", "r1", "r3", "r4", "r5"):
        assert got[k]["text"] == alone(pcm[k]) and got[k]["error"] is None
    assert got["r5"]["word_count"] == 20 and got["r5"]["avg_confidence"] == 0.5 and len(got["r5"]["segments"]) == 21
    broken = {r["file_name"]: r["error"] for r in audio.transcripts_of(audio.recognise_chunks(chunks.where("not (id = 'r4' and chunk = 3) and not (id = 'r5' and chunk = 0)"), load)).collect()}
    assert broken["r4"] == "chunk 3 is missing" and broken["r5"] == "chunk 0 is missing" and broken["r3"] is None


def test_vectors_learned_from_the_texts(spark):
    rng = np.random.default_rng(0)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("карта", "кредит", "вход")]
    texts = [" ".join(rng.choice(topics[i % 3], 8)) + " банк" for i in range(90)] + [None, "", "банк"]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "id long, text string, hashes string").repartition(4)
    got = {r["id"]: np.array(r["vec"]) for r in vectors.embed_learned(df, "text", 5, passes=20).collect()}
    assert all(np.isclose(np.linalg.norm(got[i]), 1) for i in range(90)) and not got[90].any() and not got[91].any()
    hashed = [r[0] for r in df.orderBy("id").select(vectors.hashed_tokens(F.col("text"))).collect()]
    rarity = np.array([math.log((len(texts) + 1) / (sum(j in h for h in hashed) + 1)) for j in range(vectors.TOKENS)])
    row, token, value = vectors.weights(pa.array(hashed, pa.list_(pa.int32())), rarity)
    dense = np.zeros((len(texts), vectors.TOKENS))
    dense[row, token] = value
    strong = np.linalg.svd(dense, full_matrices=False)[2][:5]
    want = dense @ strong.T
    unit = want[:90] / np.linalg.norm(want[:90], axis=1, keepdims=True)
    mine = np.array([got[i] for i in range(90)])
    assert np.allclose(mine @ mine.T, unit @ unit.T, atol=0.02)  # the same space, whatever its axes
    assert vectors.embed_learned(df.where("false"), "text", 5).count() == 0 and "hashes" in vectors.embed_learned(df, "text", 5).columns


def test_batches_come_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *names: tables.error_rows(spark.createDataFrame([(n, "x") for n in names], "file_name string, error string"))
    assert tables.append_results(rows("a", "b"), path, "run/1") and not tables.append_results(rows("z"), path, "run/1") and tables.append_results(rows("c"), path, "run/2")
    (tmp_path / "t" / "data-left-by-a-failed-writer").mkdir()
    names = lambda limit=0: [r["file_name"] for r in tables.read_results(spark, path, limit).collect()]
    assert names() == ["a", "b", "c"] and names(2) == ["c", "b"]
    # Two writers of one key that both found none: the second's manifest is refused and its data deleted.
    real, checked = batches._at, []

    def blind(session, at):
        fs, p = real(session, at)
        if at.endswith("run%2F2.json") and not checked:
            checked.append(at)
            return type("NoneThere", (), {"exists": lambda self, _: False, "delete": lambda self, *x: fs.delete(*x)})(), p
        return fs, p

    batches._at = blind
    try:
        assert not batches.append(rows("y"), path, "run/2")
    finally:
        batches._at = real
    assert names() == ["a", "b", "c"] and len(list((tmp_path / "t").glob("data-*"))) == 3
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"file_name": "s", "text": "карта не работает"}))
    stream = lambda: spark.readStream.schema(tables.TRANSCRIPT).json(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # the second run knows nothing of the first, as after a lost checkpoint
        ingest.append_processed(stream(), path, str(tmp_path / checkpoint), "stream").awaitTermination()
    assert names() == ["a", "b", "c", "s"]


def test_documents_of_many_parts(spark, tmp_path):
    df = spark.createDataFrame([(i, f'a "{i}", é\nb' if i % 2 else None, [f"x{i}", "y"]) for i in range(40)], "id long, text string, tags array<string>").repartitionByRange(7, "id").sortWithinPartitions("id")
    documents.write_csv_document(df, str(tmp_path / "t.csv"))
    raw = (tmp_path / "t.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,text,tags\n")
    read = list(csv.DictReader(io.StringIO(raw.decode("utf-8-sig"))))
    assert [(int(r["id"]), r["text"], r["tags"]) for r in read] == [(i, f'a "{i}", é\nb' if i % 2 else "", f"x{i}, y") for i in range(40)]
    documents.write_json_document(df, str(tmp_path / "t.json"), {"n": 40})
    said = json.loads((tmp_path / "t.json").read_text("utf-8"))
    assert said["n"] == 40 and [r["id"] for r in said["results"]] == list(range(40)) and said["results"][0]["text"] is None
    documents.write_json_document(df.where("false"), str(tmp_path / "t.json"), overwrite=True)
    assert json.loads((tmp_path / "t.json").read_text()) == {"results": []} and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t.csv", "t.json"]


def test_clustered_tables_have_types(spark, tmp_path):
    rows = spark.createDataFrame([("a", "3.0", "0.5", "x"), ("b", "", "nan", "2")], "file_name string, cluster_id string, cluster_probability string, cluster_size string")
    whole = rows.select(*[F.col(c) if c in rows.columns else F.lit("t").alias(c) for c in [*tables.RESULT_COLUMNS, *tables.CLUSTERED]])
    documents.write_csv_document(whole, str(tmp_path / "c.csv"))
    got = tables.read_clustered(spark, str(tmp_path / "c.csv"))
    assert dict(got.dtypes)["cluster_id"] == "int" and dict(got.dtypes)["cluster_probability"] == "double"
    assert sorted((r["file_name"], r["cluster_id"], r["cluster_probability"], r["cluster_size"]) for r in got.collect()) == [("a", 3, 0.5, None), ("b", -1, None, 2)]


def test_one_long_conversation_is_joined_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "RANGE", 50)
    said = [f"карта номер {i} не работает" if i % 3 else "спасибо" for i in range(2000)]
    rows = [("long", i, t) for i, t in enumerate(said)] + [("short", 2, "да"), ("short", 1, "не приходит код"), ("none", 1, None)]
    got = {r["_conversation"]: r for r in transcripts.conversations(spark.createDataFrame(rows, "_conversation string, turn int, text string").repartition(6), id_col="_conversation").collect()}
    assert got["long"]["cleaned_transcript"] == " ".join(t for t in said if t != "спасибо") and got["long"]["n_turns"] == 2000
    assert got["short"]["cleaned_transcript"] == "не приходит код" and got["none"]["is_empty"]


def test_user_columns_survive(spark):
    df = spark.createDataFrame([("карта не работает", *"nsmtp")], "text string, _norm string, _stripped string, _masked string, _text string, piece string")
    row = transcripts.clean_turns(df).first()
    assert (row["_norm"], row["_text"], row["piece"], row["cleaned_text"]) == ("n", "t", "p", "карта не работает")


def test_windows_of_long_texts(spark):
    tokens = [f"w{i}" for i in range(20_000)]
    tokens[5000:5002], tokens[19_990] = ["не", "могу"], "карта"
    df = spark.createDataFrame([(tokens, ["карта", "не могу"])], "t array<string>, k array<string>")
    (got,) = df.select(transcripts.keyword_windows("t", "k")).first()
    assert got == [" ".join(tokens[4993:5020]), " ".join(tokens[19_983:])]


def test_vectors_of_a_given_model(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abcd")], "id long, text string")
    got = {r["id"]: r["vec"] for r in clusters.embed_by(df, "text", lambda: lambda texts: [[len(t) * 3.0, len(t) * 4.0] for t in texts]).collect()}
    assert got[2] == [0, 0] and np.allclose(got[1], [0.6, 0.8]) and np.allclose(got[3], [0.6, 0.8])
    rows = spark.createDataFrame([([" b", "a", "b", "", None],), (None,)], "v array<string>")
    assert [r[0] for r in rows.select(T.ordered_distinct(F.col("v"))).collect()] == [["b", "a"], []]


def test_clustering_run(spark, tmp_path):
    rows = [(f"f{i}", ["карта заблокирована банк", "перевод не уходит деньги"][i % 2] if i < 20 else "", "") for i in range(21)]
    tables.write_csv(spark.createDataFrame(rows, "file_name string, semantic_text string, cleaned_transcript string"), str(tmp_path / "in"))
    got = clusters.run_clustering(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["file_name", "semantic_text", "cleaned_transcript"], ["semantic_text", "cleaned_transcript"], algorithm="kmeans", k=2, dims=2)
    assert (got["total"], got["clustered"], got["noise"], got["clusters"]) == (21, 20, 1, 2)
    assert all(got[f"{x}_seconds"] >= 0 for x in ("csv_read", "text_preparation", "clustering", "cluster_metadata", "csv_save", "total")) and got["seconds_per_row"] > 0
    out = tables.read_csv_records(spark, str(tmp_path / "out"), ["file_name", "cluster_id", "cluster_size", "cluster_status"])
    assert out.count() == 21 and out.where("cluster_status = 'noise'").count() == 1
    numbered = out.withColumn("cluster_id", F.col("cluster_id").cast("int"))
    assert [(r["cluster_id"], r["cluster_size"]) for r in clusters.sizes_in_order(numbered).collect()] == [("-1", 1), ("0", 10), ("1", 10)]
    reported = clusters.report(numbered.withColumns({"probability": F.lit(1.0), "text": F.lit("a b"), "lang": F.lit("ru")}), "file_name", "text", "lang", [])
    assert tuple(clusters.report_counts(numbered, reported).first()) == (21, 2, 1, 3)


def test_density_clusters():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(5, 0.3, (30, 2)), rng.uniform(-10, 15, (6, 2))])
    label, member = brute.density_clusters(points, np.ones(len(points)), 4, 4)
    assert set(label[:40]) == {0} and set(label[40:70]) == {1} and (label[70:] == -1).sum() >= 5
    assert member[label == -1].max() == 0 and member[label == 0].max() == 1


@pytest.mark.parametrize("algorithm", ["kmeans", " Ward ", "hdbscan"])
def test_texts_are_clustered(spark, algorithm):
    rows = [(i, ["карта заблокирована банк", "перевод не уходит деньги", "лимит превышен сегодня"][i % 3] + f" w{i % 2}", None) for i in range(30)] + [(30, " ", None), (31, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, semantic_text string")
    options: dict = {}
    got = {r["id"]: r for r in clusters.cluster_texts(df, "id", ["semantic_text", "text", "absent"], algorithm, k=3, dims=4, **options).collect()}
    assert len(got) == 32 and got[30]["cluster_id"] == got[31]["cluster_id"] == -1 and got[30]["cluster_probability"] == 0
    if algorithm == "kmeans":
        assert len({(i % 3, got[i]["cluster_id"]) for i in range(30)}) == 3
    empty = clusters.cluster_texts(df.where("id >= 30"), "id", ["text"], algorithm)
    assert {(r["cluster_id"], r["cluster_size"], r["cluster_status"]) for r in empty.collect()} == {(-1, 2, "noise")}
    with pytest.raises(ValueError):
        clusters.cluster_texts(df, "id", ["text"], "other")
