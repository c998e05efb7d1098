"""Named queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import language, lexicon, records
from callweave.functions import text as T
from callweave.operators import clusters, transcripts
from callweave.sources import scratch, tables
from callweave.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

#: A lexicon for the invented texts of the tables.
LEXICON = lexicon.Lexicon(
    patterns=[(r"\bof\s+the\b", "phrase_of"), (r"\bthe\s+the\b", "asr_double"), (r"\band\b", "filler_and"), (r"\bing\b", "asr_piece")],
    keywords=["the ti", "is the", "ation", "nth", "ingth", "er the", "in"],
    canonical={"in": "in the"},
    strong=["is the"],
    weak=["nth"],
    empty_phrases=["", "the", "is", "ok", "yes"],
    number_words=["one", "two", "three", "for"],
    stopwords=["that", "this", "with", "from"],
    generic=["of the", "the"],
    noise=[r"\bin\s+the\b"],
)
DEFAULT_HINTS, SPECIAL_HINTS, LETTERS, SPECIAL = ["the", "and", "der", "les"], ["que", "los", "para"], "[a-zñáéíóúü]+", "ñáéíóú"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def joined(column) -> F.Column:
    return F.array_join(column, "|")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words and problem signals by language."""
    docs = documents(spark, sf_dir).withColumn("norm", T.normalize_text(F.col("text")))
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(T.count_words(F.col("text"))).alias("n_words"), F.count_if(T.has_keyword(F.col("norm"), LEXICON.keywords)).alias("n_signals"))


def normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


def count_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.count_words(F.col("text")).cast("long").alias("n_words"))


def pattern_strip(spark, sf_dir):
    stripped, reasons = T.strip_patterns(T.normalize_text(F.col("text")), LEXICON.patterns)
    return documents(spark, sf_dir).select("doc_id", stripped.alias("stripped"), joined(reasons).alias("reasons"))


def pii_mask(spark, sf_dir):
    """All documents with every mask and reason, runs of number words too."""
    masked, reasons = T.mask_pii(F.col("norm"), LEXICON.number_words)
    return normalize_text(spark, sf_dir).select("doc_id", masked.alias("masked"), joined(reasons).alias("reasons"))


def number_run_mask(spark, sf_dir):
    """All documents with runs of number words masked, and nothing else."""
    return normalize_text(spark, sf_dir).select("doc_id", T.collapse(T.mask_number_runs(F.col("norm"), LEXICON.number_words)).alias("masked"))


#: Texts in Russian and Kazakh for the default lexicon, which the tables have none of.
SPOKEN = [
    "Здравствуйте, моя карта заблокирована, не могу войти", "Это Иванова Петрова, счёт №5", "Айгүлдің емес, Серіктің қызы: Асанның әкесінің аты Болат Серікұлы", "код один два три четыре пять всё",
    "двадцать пять тысяч тенге перевёл", "один два три", "Не приходит СМС, номер +7 701 123 45 67", "почта a.b@c.kz и ИИН 850101300123", "карта 1234 5678-9012 3456 не работает", "да", "спасибо большое",
    "ну да один", "Face ID не открывается, ошибка 502", "несие төлей алмай жүрмін, ақшам жоқ", "машина причина Ковалевская и причинa", "", "мың екі жүз теңге төледім", "звонили мошенники, украли деньги",
]


#: More of what is said in calls: what the default patterns strip, in Russian and Kazakh.
SAID = [
    "уведомляем о записи разговора", "этот разговор будет записывается", "звонок записывается", "әңгіменің жазылуы туралы ескертеміз", "қоңырау жазылады", "доктор быка сэр быка", "бербок шоу дэвидтен", "видео пробирка",
    "банка рыбы камня", "включайте бизнес на полную", "горячее предложение комиссию берем на себя", "добрый вечер девушка", "подскажите пожалуйста", "вот чем могу помочь", "меня зовут Айгуль", "слушаю вас",
    "сәлеметсіз бе тыңдап тұрмын", "қосымша сұрақтарыңыз бар ма", "всего доброго до свидания", "сау болыңыз рақмет", "рахмет", "давайте проверим ваше имя и отчество", "ваша полная фамилия имя отчество Иванов",
    "ваша дата рождения первое мая", "кодовое слово берег", "в таком случае ваш вопрос", "туған жылыңыз", "құпия сөзіңіз тау", "хочу узнать про рабочее время отделения", "пришло сообщение о блокировке", "иван петров",
]


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with calls for their texts: each line becomes three phrases of SPOKEN and SAID, chosen by its length, blanks and place."""
    phrases = T.texts([*SPOKEN, *SAID])
    phrase = lambda n: F.element_at(phrases, (n % F.size(phrases) + 1).cast("int"))

    def call(line, i):
        n, blanks = F.length(line), F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
        return F.concat_ws(" ", phrase(n), phrase(n * 7 + blanks * 3 + 1), phrase(blanks * 5 + i))

    return documents(spark, sf_dir).withColumn("text", F.array_join(F.transform(F.split("text", "\n"), call), "\n"))


def spoken_texts(spark, sf_dir):
    """Masks, keywords and reasons of calls by the default lexicon, all 448 keywords."""
    rows = spoken(spark, sf_dir).withColumn("norm", T.normalize_text(F.col("text")))
    masked, reasons = T.mask_pii(F.col("norm"), lexicon.DEFAULT.number_words)
    rows = rows.select("doc_id", "text", "norm", masked.alias("masked"), joined(reasons).alias("reasons"), T.keywords_in(F.col("norm"), lexicon.DEFAULT.keywords).alias("found"))
    ranked = T.ranked_keywords(F.col("found"), lexicon.DEFAULT)
    return rows.select("doc_id", "norm", "masked", "reasons", joined(F.col("found")).alias("keywords"), joined(ranked).alias("ranked"), T.empty_reason(F.col("norm"), lexicon.DEFAULT, True).alias("reason"))


def default_patterns(spark, sf_dir):
    """Calls without what the 57 default patterns strip, and the reasons."""
    stripped = T.stripped(T.normalize_text(F.col("text")), lexicon.DEFAULT.patterns)
    return spoken(spark, sf_dir).select("doc_id", stripped.alias("s")).select("doc_id", F.col("s.text").alias("stripped"), joined(F.col("s.reasons")).alias("reasons"))


def problem_keywords(spark, sf_dir):
    return normalize_text(spark, sf_dir).select("doc_id", joined(T.keywords_in(F.col("norm"), LEXICON.keywords)).alias("keywords"))


def keyword_counts(spark, sf_dir):
    return normalize_text(spark, sf_dir).select(F.explode(T.keywords_in(F.col("norm"), LEXICON.keywords)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


def semantic_keywords(spark, sf_dir):
    return normalize_text(spark, sf_dir).select("doc_id", joined(T.ranked_keywords(T.keywords_in(F.col("norm"), LEXICON.keywords), LEXICON)).alias("keywords"))


def keyword_windows(spark, sf_dir):
    docs = normalize_text(spark, sf_dir).select("doc_id", T.words_of(F.col("norm")).alias("tokens"), F.array(F.lit("is"), F.lit("of the")).alias("wanted"))
    return docs.select("doc_id", joined(transcripts.keyword_windows("tokens", "wanted")).alias("windows"))


def empty_classification(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.empty_reason(F.col("text"), LEXICON).alias("reason"))


def text_for_clustering(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.first_text(F.lit(" "), F.nullif("source", F.lit("src0")), F.col("lang")).alias("chosen"), T.short_text(F.col("text"), 40).alias("short"))


def conversations(spark, sf_dir):
    out = transcripts.conversations(tables.spread(read(spark, sf_dir, "conversations")), LEXICON)
    return out.withColumns({c: joined(F.col(c)) for c in ("problem_keywords", "quality_flags")})


def conversation_summary(spark, sf_dir):
    return transcripts.summary(transcripts.conversations(tables.spread(read(spark, sf_dir, "conversations")), LEXICON))


def flag_counts(spark, sf_dir):
    return transcripts.flag_counts(transcripts.conversations(tables.spread(read(spark, sf_dir, "conversations")), LEXICON))


def language_scores(spark, sf_dir):
    f = language.features(F.col("text"), DEFAULT_HINTS, SPECIAL_HINTS, LETTERS, SPECIAL)
    scored = documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in f.items()])
    f = {n: F.col(n) for n in f}
    scored = scored.withColumns({"default_score": language.score(f, None, False), "special_score": language.score(f, None, True)})
    chosen = language.choose(F.col("default_score"), F.col("special_score"), F.col("evidence"), ("en", "es"))
    scored = scored.withColumns(chosen)
    return scored.withColumn("confidence", language.confidence_of(F.col("default_score"), F.col("special_score"), F.col("code"), F.col("guardrail")))


def detection_windows(spark, sf_dir):
    each = read(spark, sf_dir, "events").select("event_id", F.posexplode(language.detection_windows(F.col("value"))).alias("part", "w"))
    return each.select("event_id", F.col("part").cast("long").alias("part"), F.round("w.start", 6).alias("start"), F.round("w.length", 6).alias("length"))


def csv_values(spark, sf_dir):
    value = F.when(F.col("event_id") % 4 == 0, " TRUE ").when(F.col("event_id") % 4 == 1, "NaN").when(F.col("event_id") % 4 == 2, F.concat(F.col("value").cast("decimal(12,2)").cast("string"))).otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", T.parse_csv_value(value).alias("parsed"), T.cluster_number(value).cast("long").alias("number"))


def newest_events(spark, sf_dir):
    return tables.newest(read(spark, sf_dir, "events"), "event_id", 50).select("event_id", "event_type", "value")


def window_counts(spark, sf_dir):
    return ingest.windowed_counts(read(spark, sf_dir, "events"))


def embeddings(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster_id"))


def cluster_sizes(spark, sf_dir):
    return clusters.with_sizes(embeddings(spark, sf_dir)).select("vec_id", "cluster_id", "cluster_size", "cluster_status")


def cluster_counts(spark, sf_dir):
    return clusters.run_counts(embeddings(spark, sf_dir))


def cluster_centroids(spark, sf_dir):
    return clusters.centroids(embeddings(spark, sf_dir)).select("cluster_id", F.col("dim").cast("long").alias("dim"), F.round("mean", 9).alias("mean"))


def cluster_probability(spark, sf_dir):
    return clusters.probabilities(embeddings(spark, sf_dir), "vec_id").select("vec_id", "probability")


def clustered_documents(spark, sf_dir):
    return documents(spark, sf_dir).withColumn("cluster_id", F.substring("source", 4, 9).try_cast("int")).withColumn("probability", F.col("doc_id") % 7 / 10)


def top_terms(spark, sf_dir):
    return clusters.top_terms(clustered_documents(spark, sf_dir), "cluster_id", "text", "doc_id", LEXICON.stopwords)


def cluster_report(spark, sf_dir):
    spaced = clustered_documents(spark, sf_dir).withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" "), "lang")).otherwise(F.col("lang")))
    out = clusters.report(spaced, "doc_id", "text", "lang", LEXICON.stopwords, examples=2)
    return out.select("cluster_id", "cluster_size", "avg_probability", "languages", "example_1", "example_2")


def top_keywords(spark, sf_dir):
    found = F.array_join(T.keywords_in(T.normalize_text(F.col("text")), LEXICON.keywords), ", ")
    return clusters.top_terms(clustered_documents(spark, sf_dir).withColumn("found", found), "cluster_id", "found", "doc_id", [], keywords=True)


def noise_removal(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.remove_noise(F.col("text"), LEXICON).alias("left_over"))


def word_confidences(spark, sf_dir):
    words = F.transform(T.words_of(T.normalize_text(F.col("text"))), lambda w: F.struct(w.alias("word"), (F.pmod(F.length(w) * 37, F.lit(100)) / 100.0).alias("conf")))
    stats = documents(spark, sf_dir).select("doc_id", records.word_confidences(words, LEXICON).alias("s"))
    return stats.select("doc_id", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("total", "low", "very_low")], "s.low_ratio", records.format_confidences(F.col("s.very_low_words")).alias("very_low_words"))


def transcript_items(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents as transcripts: lines are pieces, labels of low quality doubt the language, words have confidences by their lengths; some have failed."""
    docs = (documents(spark, sf_dir) if docs is None else docs).join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    pieces = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), x.alias("text")))
    null = lambda kind: F.lit(None).cast(kind)
    words = F.transform(T.words_of(T.normalize_text(F.col("text"))), lambda w: F.struct(w.alias("word"), null("double").alias("start"), null("double").alias("end"), (F.length(w) * 37 % 64 / 64.0).alias("conf")))
    return docs.select(
        F.col("doc_id").cast("string").alias("file_name"),
        F.col("source").alias("file_path"),
        F.when(F.col("text").isNull(), "no text").when(F.col("doc_id") % 11 == 0, "broken file").alias("error"),
        "text",
        F.col("lang").alias("language"),
        null("string").alias("selected_language"),
        F.struct(F.when(F.col("quality") == 0, "low").alias("confidence")).alias("language_detection"),
        pieces.alias("segments"),
        F.when(F.col("lang") != "de", words).alias("words"),
        F.when(F.col("lang") == "fr", F.length("text")).alias("word_count"),
        F.when(F.col("doc_id") % 3 == 0, 0.875).when(F.col("doc_id") % 3 == 1, 0.625).alias("avg_confidence"),
        (F.col("doc_id") % 5 == 0).alias("fallback_language_used"),
        null("double").alias("transcription_time_seconds"),
        null("double").alias("total_time_with_detection_seconds"),
    )


def processed_transcripts(spark, sf_dir):
    return tables.as_text(transcripts.process(transcript_items(spark, sf_dir), LEXICON), tables.RESULT_COLUMNS)


def processed_calls(spark, sf_dir):
    """Calls processed by the default lexicon: all its patterns, keywords and lists."""
    return tables.as_text(transcripts.process(transcript_items(spark, sf_dir, spoken(spark, sf_dir)), lexicon.DEFAULT), tables.RESULT_COLUMNS)


def cleaned_transcripts(spark, sf_dir):
    """The result columns but for the semantic text: a smaller query beside ``processed_transcripts``."""
    return processed_transcripts(spark, sf_dir).drop("semantic_text")


def review_rows(spark, sf_dir):
    """What reviewers read of each transcript, ratio and confidence as numbers."""
    done = transcripts.process(transcript_items(spark, sf_dir), LEXICON)
    numbers = ("cleaning_ratio", "avg_confidence")
    return tables.as_text(done, [c for c in tables.REVIEW_COLUMNS if c not in (*numbers, "semantic_text")], numbers)


def response_rows(spark, sf_dir):
    """What a caller gets of each transcript, lists joined."""
    rows = tables.response_rows(transcripts.process(transcript_items(spark, sf_dir), LEXICON))
    return rows.withColumns({c: joined(F.col(c)) for c in ("quality_flags", "problem_keywords_found")}).drop("semantic_text")


def judged_pieces(spark, sf_dir):
    """Every piece of every transcript: whether it was kept, what is left of it and what was removed."""
    done = transcripts.judged(transcript_items(spark, sf_dir), LEXICON)
    return done.select("file_name", F.col("place").cast("long").alias("place"), "kept", "cleaned_text", joined(F.col("removed_parts")).alias("removed"), "empty_reason")


def ordered_lines(spark, sf_dir):
    """The distinct lines of each document, in order."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.ordered_distinct(F.split("text", "\n")), "\n").alias("lines"))


def trimmed_texts(spark, sf_dir):
    """The first twelve words of each normalised text."""
    return documents(spark, sf_dir).select("doc_id", T.trim_words(F.col("text"), 12).alias("first_words"))


def confidence_lists(spark, sf_dir):
    """The words of each document that reviewers should see: important ones heard badly, and others that may go."""
    words = F.transform(T.words_of(T.normalize_text(F.col("text"))), lambda w: F.struct(w.alias("word"), (F.pmod(F.length(w) * 37, F.lit(100)) / 100.0).alias("conf")))
    stats = documents(spark, sf_dir).select("doc_id", records.word_confidences(words, LEXICON).alias("s"))
    return stats.select("doc_id", *[records.format_confidences(F.col(f"s.{c}")).alias(c) for c in ("low_important", "removable")])


def failed_files(spark, sf_dir):
    """The rows that stand for documents of one source, taken as files that failed."""
    rows = tables.error_rows(documents(spark, sf_dir).select(F.concat(F.lit("f"), "doc_id").alias("name"), F.concat(F.lit("broken "), F.coalesce("source", F.lit("?"))).alias("why")), "name", "why")
    return rows.withColumns({c: joined(F.col(c)) for c in ("quality_flags", "problem_keywords_found")})


def stored_csv(spark, sf_dir):
    """Documents written as CSV and read back as records: quotes and line ends survive, values are parsed."""
    path = scratch.shared_path(spark, "csv")
    tables.write_csv(documents(spark, sf_dir).select("doc_id", "lang", "source", "text", F.split("source", "c").alias("parts")), path)
    return tables.read_csv_records(spark, path, ["doc_id", "lang", "source", "text", "parts"])


def report_totals(spark, sf_dir):
    """Rows, clusters, noise and report rows of the clustered documents."""
    rows = clustered_documents(spark, sf_dir)
    return clusters.report_counts(rows, clusters.report(rows, "doc_id", "text", "lang", LEXICON.stopwords, examples=2))


def sizes_by_number(spark, sf_dir):
    return clusters.sizes_in_order(embeddings(spark, sf_dir))


def process_summary(spark, sf_dir):
    return transcripts.process_summary(transcripts.process(transcript_items(spark, sf_dir), LEXICON))


def text_clusters(spark, sf_dir):
    """Conversations clustered by what their turns say."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    return clusters.cluster_texts(turns, "conv_id", ["semantic_text", "text"], "kmeans").select("conv_id", "cluster_id", "cluster_probability", "cluster_size", "cluster_status")


def hdbscan(spark, sf_dir):
    return clusters.hdbscan(embeddings(spark, sf_dir).drop("cluster_id")).select("vec_id", "cluster_id", "probability")


def pca_projection(spark, sf_dir):
    reduced, _ = clusters.reduce_pca(embeddings(spark, sf_dir), 10)
    return reduced.select("vec_id", F.transform("reduced", lambda x: F.round(x, 6)).alias("reduced"))


def kmeans(spark, sf_dir):
    return clusters.kmeans(embeddings(spark, sf_dir).drop("cluster_id")).select("vec_id", "cluster_id")


def ward(spark, sf_dir):
    return clusters.ward(embeddings(spark, sf_dir).drop("cluster_id")).select("vec_id", "cluster_id")


QUERIES: list[Query] = [
    flagship, normalize_text, count_words, pattern_strip, pii_mask, number_run_mask, spoken_texts, problem_keywords, keyword_counts, semantic_keywords, keyword_windows, empty_classification, text_for_clustering, conversations, conversation_summary, flag_counts,
    language_scores, detection_windows, csv_values, newest_events, window_counts, cluster_sizes, cluster_counts, cluster_centroids, cluster_probability, top_terms, cluster_report, pca_projection, kmeans, ward,
    top_keywords, noise_removal, word_confidences, processed_transcripts, cleaned_transcripts, process_summary, text_clusters, hdbscan,
    default_patterns, processed_calls, review_rows, response_rows, judged_pieces, ordered_lines, report_totals, sizes_by_number, trimmed_texts, confidence_lists, failed_files, stored_csv,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


def _norm(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower(coalesce({column}, '')), 'ё', 'е'), '[^a-zа-яәғқңөұүһі0-9\\s\\[\\]_@.+\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _words(column: str) -> str:
    return f"len(regexp_extract_all(lower(coalesce({column}, '')), '{T.WORD}'))"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _signal(column: str, keywords: list[str] = LEXICON.keywords) -> str:
    return "(" + " OR ".join(f"contains({column}, '{lexicon.plain(k)}')" for k in keywords) + ")"


def _found(column: str, keywords: list[str] = LEXICON.keywords) -> str:
    keys = "[" + ", ".join(f"{{'p': '{lexicon.plain(k)}', 'k': '{k}'}}" for k in dict.fromkeys(keywords)) + "]"
    return f"list_sort(list_transform(list_filter({keys}, lambda k: contains({column}, k.p)), lambda k: k.k))"


#: RE2 knows word boundaries of ASCII only: what stands beside a Cyrillic word is matched instead, twice, as neighbours share it.
_BEFORE, _AFTER = "(^|[^0-9a-zа-яёәғқңөұүһі_])", "($|[^0-9a-zа-яёәғқңөұүһі_])"
_NAMES = [f"{_BEFORE}{pattern[2:-2]}{_AFTER}" for pattern, _, _ in T.PII[4:]]


def _masked(source: str, keys: str, column: str, number_words: list[str], name: str) -> str:
    """CTEs that mask the normalised ``column`` of ``source``; the last, ``name``, has ``keys`` (first: the row's own), masked and mask_reasons."""
    key, steps, text = keys.split(", ")[0], [], column
    for i, (pattern, mark, _) in enumerate(T.PII):
        own = pattern if i < 4 else _NAMES[i - 4]
        into = mark if i < 4 else f"\\1{mark}\\2"
        before = text
        if i == 1:  # the separator behind a card's number belongs to it where a word follows, a Cyrillic one too
            before = f"regexp_replace({text}, '\\b(?:[0-9][ -]?){{15}}[0-9][ -]([а-яёәғқңөұүһі])', '{mark}\\1', 'g')"
        new = f"regexp_replace({before}, '{own}', '{into}', 'g')"
        new = new if i < 4 else f"regexp_replace({new}, '{own}', '{into}', 'g')"
        steps.append(f"{name}{i} AS (SELECT *, {new} AS p{i}, regexp_matches({text}, '{own}') AS q{i} FROM {f'{name}{i - 1}' if i else source})")
        text = f"p{i}"
    reasons = ", ".join(f"CASE WHEN q{i} THEN '{r}' END" for i, (_, _, r) in enumerate(T.PII))
    return ", ".join(steps) + f""",
{name}_t AS (SELECT {key}, unnest(tok) AS w, unnest(range(0, len(tok))) AS pos FROM (SELECT {key}, list_filter(string_split(regexp_replace({text}, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS tok FROM {name}5)),
{name}_m AS (SELECT *, list_contains({_list(number_words)}, w) AS num FROM {name}_t),
{name}_g AS (SELECT *, pos - row_number() OVER (PARTITION BY {key}, num ORDER BY pos) AS island FROM {name}_m),
{name}_r AS (SELECT {key}, num AND count(*) >= 4 AS run, min(pos) AS start, string_agg(w, ' ' ORDER BY pos) AS words FROM {name}_g GROUP BY {key}, num, island),
{name}_j AS (SELECT {key}, string_agg(CASE WHEN run THEN '[NUMBER_SEQ]' ELSE words END, ' ' ORDER BY start) AS whole, bool_or(run) AS spoken FROM {name}_r GROUP BY {key}),
{name} AS (SELECT {name}5.*, coalesce(whole, '') AS masked, list_filter([{reasons}, CASE WHEN spoken THEN 'spoken_number_sequence' END], lambda x: x IS NOT NULL) AS mask_reasons FROM {name}5 LEFT JOIN {name}_j USING ({key}))"""


def _bounded(pattern: str) -> tuple[str, str]:
    """A pattern for RE2 with the characters beside a word instead of word boundaries, and what replaces its matches: ``~`` and those characters.

    RE2 knows the boundaries of ASCII words, whose patterns stay as they are.
    """
    if pattern.isascii():
        return pattern, "~"
    lead, trail = pattern.startswith("\\b"), pattern.endswith("\\b")
    body = pattern[2 * lead : len(pattern) - 2 * trail].replace("\\b", "(?:$|[^0-9a-zа-яёәғқңөұүһі_])")
    return (_BEFORE if lead else "") + body + (_AFTER if trail else ""), "\\1" * lead + "~" + ("\\2" if lead else "\\1") * trail


def _without(text: str, pattern: str) -> str:
    """``text`` with a blank for each match. Blanks are doubled meanwhile, as neighbours share the character between them; no normalised text holds ``~``."""
    own, into = _bounded(pattern)
    if into == "~":
        return f"regexp_replace({text}, '{own}', ' ', 'g')"
    own = own.replace(" ", "  ")
    return f"replace(replace(regexp_replace(regexp_replace(replace({text}, ' ', '  '), '{own}', '{into}', 'g'), '{own}', '{into}', 'g'), '  ', ' '), '~', ' ')"


def _stripped(source: str, column: str, name: str, words: lexicon.Lexicon = LEXICON) -> str:
    """CTEs that strip the patterns of a lexicon from ``column``; the last, ``name``, adds stripped and strip_reasons."""
    text, steps = column, []
    for i, (pattern, _) in enumerate(words.patterns):
        steps.append(f"{name}{i} AS MATERIALIZED (SELECT * EXCLUDE ({'w' if i else column}), {_without(text, pattern)} AS w, regexp_matches({text}, '{_bounded(pattern)[0]}') AS r{i} FROM {f'{name}{i - 1}' if i else source})")
        text = "w"
    reasons = ", ".join(f"CASE WHEN r{i} THEN '{r}' END" for i, (_, r) in enumerate(words.patterns))
    return ", ".join(steps) + f", {name} AS (SELECT * EXCLUDE ({', '.join(f'r{i}' for i in range(len(steps)))}, w), {_collapsed('w')} AS stripped, list_sort(list_distinct(list_filter([{reasons}], lambda x: x IS NOT NULL))) AS strip_reasons FROM {name}{len(steps) - 1})"


def _collapsed(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _noise(text: str, words: lexicon.Lexicon = LEXICON) -> str:
    for pattern in words.noise:
        text = _without(text, pattern)
    phrases = sorted({lexicon.plain(g) for g in words.generic}, key=lambda g: (-len(g), g))
    return _collapsed(_without(text, f"\\b(?:{'|'.join(phrases)})\\b"))


def _pieces(source: str, words: lexicon.Lexicon = LEXICON) -> str:
    """CTEs that clean the ``text`` of ``source`` (key: k) piece by piece; the last, ``pieces``, has its columns, kept, removed and its reason."""
    return f"""normal AS (SELECT *, {_norm('text')} AS norm FROM {source}),
{_stripped('normal', 'norm', 'bare', words)}, {_masked('bare', 'k', 'stripped', words.number_words, 'hidden')},
left_over AS (SELECT *, CASE WHEN contains(masked, '[NAME]') AND NOT {_signal('lower(masked)', words.keywords)} THEN '' ELSE lower(masked) END AS said FROM hidden),
weighed AS (SELECT *, {_reason('said', words)} AS why FROM left_over),
pieces AS (SELECT *, CASE WHEN why = 'useful' THEN said ELSE '' END AS kept,
  list_sort(list_distinct(list_concat(strip_reasons, mask_reasons, CASE WHEN said = '' AND masked <> '' THEN ['drop_pii_only_segment'] ELSE [] END))) AS removed FROM weighed)"""


_PERSONAL = [r for _, _, r in T.PII] + ["name_ru", "spoken_number_sequence", "drop_pii_only_segment"]


def _judged(source: str, low_language: str = "false", ratio: str = "false", low_average: str = "false", fallback: str = "false", words: lexicon.Lexicon = LEXICON) -> str:
    """CTEs over ``source`` (cleaned, removed, raw_words): ``judged`` adds reason, clean_words, keywords, flags, priority and ready."""
    return f"""reasoned AS (SELECT *, {_reason('cleaned', words)} AS reason, {_words('cleaned')} AS clean_words, {_found('cleaned', words.keywords)} AS keywords FROM {source}),
flagged AS (SELECT *, reason <> 'useful' AS empty, list_sort(list_filter([
  CASE WHEN {low_average} THEN 'low_avg_confidence' END, CASE WHEN {fallback} THEN 'fallback_language_used' END,
  CASE WHEN {low_language} THEN 'low_language_confidence' END,
  CASE WHEN len(list_filter(removed, lambda r: starts_with(r, 'asr_'))) >= 2 THEN 'many_asr_noise_fragments' END,
  CASE WHEN len(list_filter(removed, lambda r: list_contains({_list(_PERSONAL)}, r))) > 0 THEN 'pii_removed' END,
  CASE WHEN contains(cleaned, '[number_seq]') THEN 'contains_number_sequence' END,
  CASE WHEN reason = 'useful' AND {ratio} THEN 'high_cleaning_ratio' END,
  CASE WHEN reason = 'useful' AND clean_words <= 5 THEN 'very_short_but_useful' END], lambda x: x IS NOT NULL)) AS flags FROM reasoned),
levelled AS (SELECT *, CASE WHEN empty OR cleaned = '' OR list_has_any(flags, {_list(T.HIGH)}) THEN 'high' WHEN list_has_any(flags, {_list(T.MEDIUM)}) THEN 'medium' ELSE 'low' END AS priority FROM flagged),
judged AS (SELECT *, NOT empty AND cleaned <> '' AND priority <> 'high' AS ready FROM levelled)"""


def _conversations() -> str:
    return f"""WITH turns AS (SELECT row_number() OVER () AS k, * FROM conversations), {_pieces('turns')},
whole AS (SELECT conv_id, coalesce(string_agg(kept, ' ' ORDER BY turn, text NULLS FIRST) FILTER (kept <> ''), '') AS cleaned, flatten(list(removed)) AS removed, sum({_words('text')})::BIGINT AS raw_words, count(*) AS n_turns FROM pieces GROUP BY conv_id),
{_judged('whole', ratio='raw_words > 0 AND round(clean_words / raw_words, 4) < 0.55::DOUBLE')}"""


def _transcripts(words: lexicon.Lexicon = LEXICON, documents: str = "documents") -> str:
    return f"""WITH items AS (SELECT row_number() OVER () AS item, d.*, quality, CASE WHEN text IS NULL THEN 'no text' WHEN doc_id % 11 = 0 THEN 'broken file' END AS failure FROM {documents} d LEFT JOIN labels USING (doc_id)),
facts AS (SELECT *, CASE WHEN lang = 'fr' THEN length(text) END AS word_count, CASE WHEN lang <> 'de' THEN list_transform(list_filter(string_split({_norm('text')}, ' '), lambda x: x <> ''), lambda x: (length(x) * 37 % 64) / 64.0::DOUBLE) END AS confidences,
  CASE doc_id % 3 WHEN 0 THEN 0.875::DOUBLE WHEN 1 THEN 0.625::DOUBLE END AS average FROM items),
lines AS (SELECT item * 1000000 + place AS k, * FROM (SELECT item, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS place FROM items WHERE text IS NOT NULL)), {_pieces('lines', words)},
joined AS (SELECT item, string_agg(kept, ' ' ORDER BY k) FILTER (kept <> '') AS cleaned, flatten(list(removed ORDER BY k)) AS removed FROM pieces GROUP BY item),
whole AS (SELECT facts.*, coalesce(cleaned, '') AS cleaned, coalesce(removed, []) AS removed, coalesce(word_count, len(confidences), {_words('text')}) AS raw_words,
  round(coalesce(average, CASE WHEN len(confidences) > 0 THEN list_sum(confidences) / len(confidences) END), 4) AS avg_confidence FROM facts LEFT JOIN joined USING (item)),
{_judged('whole', 'quality = 0', 'word_count > 0 AND round(clean_words / word_count, 4) < 0.55::DOUBLE', 'average < 0.75', 'doc_id % 5 = 0', words)}"""


def _around(tokens: str, keywords: str, before: int = 7, after: int = 18, most: int = 4) -> str:
    """The stretches of a list of tokens around keywords: longest first, none overlapping an earlier one."""
    parts = f"list_sort(list_transform(range(1, len({keywords}) + 1), lambda i: {{'w': -len(string_split({keywords}[i], ' ')), 'i': i, 'p': string_split({keywords}[i], ' ')}}))"
    hits = f"flatten(list_transform({parts}, lambda x: list_transform(list_filter(range(1, len({tokens}) - len(x.p) + 2), lambda j: {tokens}[j:j + len(x.p) - 1] = x.p), lambda j: [{{'s': greatest(j - {before + 1}, 0), 'e': least(j - 1 + len(x.p) + {after}, len({tokens}))}}])))"
    taken = f"list_reduce({hits}, lambda got, h: CASE WHEN len(got) < {most} AND len(list_filter(got, lambda g: h[1].s < g.e AND g.s < h[1].e)) = 0 THEN list_concat(got, h) ELSE got END, []::STRUCT(s BIGINT, e BIGINT)[])"
    return f"list_transform({taken}, lambda g: array_to_string({tokens}[g.s + 1:g.e], ' '))"


def _semantic(words: lexicon.Lexicon = LEXICON) -> str:
    """CTEs over ``judged`` and ``pieces``; the last, ``semantic``, has item and semantic_text."""
    pairs = ", ".join(f"('{k}', '{words.canonical.get(lexicon.plain(k), lexicon.plain(k))}')" for k in dict.fromkeys(words.keywords))
    size = "len(string_split(named, ' '))"
    markers = f"len(list_filter({_list(words.markers)}, lambda m: contains(named, m)))"
    tokens = lambda text: f"list_filter(string_split({text}, ' '), lambda x: x <> '')"
    first = lambda text: f"array_to_string(string_split({text}, ' ')[1:55], ' ')"
    return f"""names(listed, named) AS (VALUES {pairs}),
scored AS (SELECT DISTINCT item, named, CASE WHEN list_contains({_list(words.strong)}, named) THEN 100 ELSE 0 END + CASE WHEN {size} >= 3 THEN 40 WHEN {size} = 2 THEN 20 ELSE 0 END + CASE WHEN {markers} > 0 THEN 30 ELSE 0 END + least(length(named), 30) AS score
  FROM (SELECT item, unnest(keywords) AS listed FROM judged) JOIN names USING (listed) WHERE length(named) >= 3 AND NOT list_contains({_list(words.weak + words.generic)}, named)),
best AS (SELECT item, list(named ORDER BY place) FILTER (place <= 6) AS wanted FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, named) AS place FROM scored) GROUP BY item),
keyed AS (SELECT item, coalesce(wanted, []::VARCHAR[]) AS wanted, {_noise('cleaned', words)} AS whole FROM judged LEFT JOIN best USING (item)),
heard AS (SELECT p.item, p.k AS pos, wanted, {_noise('p.kept', words)} AS said FROM pieces p JOIN keyed USING (item) WHERE p.kept <> ''),
split AS (SELECT *, {tokens('said')} AS t FROM heard WHERE len(list_filter(wanted, lambda x: contains(said, x))) > 0),
near AS (SELECT *, {_around('t', 'wanted')} AS found FROM split),
each AS (SELECT item, pos, CASE WHEN len(found) > 0 THEN found ELSE [said] END AS found FROM near),
counted AS (SELECT *, coalesce(sum(len(found)) OVER (PARTITION BY item ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM each),
parts AS (SELECT item, flatten(list(found ORDER BY pos)) AS found FROM counted WHERE before < 4 GROUP BY item),
wholes AS (SELECT keyed.*, coalesce(found, []::VARCHAR[]) AS found, {tokens('whole')} AS t FROM keyed LEFT JOIN parts USING (item)),
filled AS (SELECT item, whole, wanted, CASE WHEN len(found) = 0 AND len(wanted) > 0 THEN {_around('t', 'wanted')} ELSE found END AS found FROM wholes),
ended AS (SELECT item, whole, wanted, CASE WHEN len(found) = 0 THEN [whole] ELSE found END AS found FROM filled),
bodies AS (SELECT item, whole, wanted, {_noise("array_to_string(list_filter(found, lambda x, i: x <> '' AND list_position(found, x) = i), ' ')", words)} AS body FROM ended),
texts AS (SELECT item, whole, array_to_string(list_filter(list_append(wanted, {first('body')}), lambda x: x <> ''), ' ') AS body FROM bodies),
clean AS (SELECT item, whole, {_noise('body', words)} AS body FROM texts),
semantic AS (SELECT item, CASE WHEN whole = '' THEN '' ELSE {first('body')} END AS semantic_text FROM clean)"""


def _text_or(value: str, otherwise: str = "''") -> str:
    return f"CASE WHEN failure IS NOT NULL THEN {otherwise} ELSE {value} END"


#: The columns of results, as texts, over ``judged``.
_RESULT = {
    "file_name": "doc_id::VARCHAR", "status": _text_or("'processed'", "'error'"), "selected_language": "coalesce(lang, '')", "language_confidence": "CASE WHEN quality = 0 THEN 'low' ELSE '' END",
    "word_count_raw": _text_or("raw_words::VARCHAR"), "word_count_cleaned": _text_or("clean_words::VARCHAR"), "is_empty_call": "(failure IS NOT NULL OR empty)::VARCHAR", "empty_reason": _text_or("reason", "'transcription_error'"),
    "review_priority": _text_or("priority", "'high'"), "ready_for_classification": "(failure IS NULL AND ready)::VARCHAR", "quality_flags": _text_or("array_to_string(flags, ', ')", "'transcription_error'"),
    "problem_keywords_found": _text_or("array_to_string(keywords, ', ')"), "raw_transcript": _text_or("coalesce(text, '')"), "cleaned_transcript": _text_or("cleaned"),
}
_RESULTS = ", ".join(f"{value} AS {name}" for name, value in _RESULT.items())


def _spoken() -> str:
    """A table like documents, with what ``spoken`` makes of each text."""
    n, blanks = "length(line)", "(length(line) - length(replace(line, ' ', '')))"
    phrase = lambda number: f"phrases[({number}) % len(phrases) + 1]"
    call = f"{phrase(n)} || ' ' || {phrase(f'{n} * 7 + {blanks} * 3 + 1')} || ' ' || {phrase(f'{blanks} * 5 + i - 1')}"
    return f"(SELECT doc_id, lang, source, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i: {call}), chr(10)) AS text FROM documents, (SELECT {_list([*SPOKEN, *SAID])} AS phrases))"


def _strip() -> str:
    text, steps = "n0", []
    for i, (pattern, _) in enumerate(LEXICON.patterns):
        steps.append(f"s{i + 1} AS (SELECT *, regexp_replace({text}, '{pattern}', ' ', 'g') AS n{i + 1}, regexp_matches({text}, '{pattern}') AS r{i + 1} FROM s{i})")
        text = f"n{i + 1}"
    reasons = ", ".join(f"CASE WHEN r{i + 1} THEN '{r}' END" for i, (_, r) in enumerate(LEXICON.patterns))
    return f"WITH s0 AS (SELECT doc_id, {_norm('text')} AS n0 FROM documents), {', '.join(steps)} SELECT doc_id, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS stripped, array_to_string(list_sort(list_filter([{reasons}], lambda x: x IS NOT NULL)), '|') AS reasons FROM s{len(steps)}"


def _reason(norm: str, words: lexicon.Lexicon = LEXICON) -> str:
    idle = f"len(list_filter(string_split({norm}, ' '), lambda w: NOT (list_contains({_list(words.empty_phrases + words.number_words)}, w) OR regexp_full_match(w, '[0-9]+')))) = 0"
    return f"CASE WHEN {norm} = '' THEN 'empty_text' WHEN list_contains({_list(words.empty_phrases)}, {norm}) THEN 'empty_phrase' WHEN {_signal(norm, words.keywords)} THEN 'useful' WHEN {idle} THEN 'only_empty_or_number_words' WHEN {_words(norm)} <= 3 THEN 'too_short_without_problem_signal' WHEN {_words(norm)} <= 5 THEN 'short_noninformative' ELSE 'useful' END"


def _spoken_texts() -> str:
    d = lexicon.DEFAULT
    pairs = ", ".join(f"('{lexicon.plain(k)}', '{k}', '{d.canonical.get(lexicon.plain(k), lexicon.plain(k))}')" for k in dict.fromkeys(d.keywords))
    words = "len(string_split(named, ' '))"
    return f"""WITH normal AS (SELECT doc_id, text, {_norm('text')} AS norm FROM {_spoken()}),
{_masked('normal', 'doc_id', 'norm', d.number_words, 'hidden')}, keys(plain, listed, named) AS (VALUES {pairs}),
hits AS (SELECT doc_id, listed, named FROM normal JOIN keys ON contains(norm, plain)),
found AS (SELECT doc_id, string_agg(DISTINCT listed, '|' ORDER BY listed) AS keywords FROM hits GROUP BY doc_id),
scored AS (SELECT DISTINCT doc_id, named, CASE WHEN list_contains({_list(d.strong)}, named) THEN 100 ELSE 0 END + CASE WHEN {words} >= 3 THEN 40 WHEN {words} = 2 THEN 20 ELSE 0 END
  + CASE WHEN len(list_filter({_list(d.markers)}, lambda m: contains(named, m))) > 0 THEN 30 ELSE 0 END + least(length(named), 30) AS score
  FROM hits WHERE length(named) >= 3 AND NOT list_contains({_list(d.weak + d.generic)}, named)),
places AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, named) AS place FROM scored),
best AS (SELECT doc_id, string_agg(named, '|' ORDER BY place) AS ranked FROM places WHERE place <= 6 GROUP BY doc_id)
SELECT doc_id, norm, masked, array_to_string(mask_reasons, '|') AS reasons, coalesce(keywords, '') AS keywords, coalesce(ranked, '') AS ranked, {_reason('norm', d)} AS reason FROM hidden LEFT JOIN found USING (doc_id) LEFT JOIN best USING (doc_id)"""


_RANK = ", ".join(f"('{k}', '{LEXICON.canonical.get(k, k)}')" for k in LEXICON.keywords)
_DOCS = "(SELECT *, try_cast(substr(source, 4, 9) AS INTEGER) AS cluster_id, (doc_id % 7) / 10 AS probability FROM documents)"
_EMB = "(SELECT vec_id, embedding AS vec, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster_id FROM embeddings)"


def oracle_sql() -> dict[str, str]:
    return {
        "flagship": f"SELECT lang, count(*) AS n_docs, sum({_words('text')})::BIGINT AS n_words, count(*) FILTER ({_signal(_norm('text'))}) AS n_signals FROM documents GROUP BY lang",
        "normalize_text": f"SELECT doc_id, {_norm('text')} AS norm FROM documents",
        "count_words": f"SELECT doc_id, {_words('text')}::BIGINT AS n_words FROM documents",
        "pattern_strip": _strip(),
        "pii_mask": f"WITH normal AS (SELECT doc_id, {_norm('text')} AS norm FROM documents), {_masked('normal', 'doc_id', 'norm', LEXICON.number_words, 'hidden')} SELECT doc_id, masked, array_to_string(mask_reasons, '|') AS reasons FROM hidden",
        "number_run_mask": f"""WITH t AS (SELECT doc_id, unnest(tok) AS w, unnest(range(0, len(tok))) AS pos FROM (SELECT doc_id, list_filter(string_split({_norm('text')}, ' '), lambda x: x <> '') AS tok FROM documents)),
g AS (SELECT *, num, pos - row_number() OVER (PARTITION BY doc_id, num ORDER BY pos) AS island FROM (SELECT *, list_contains({_list(LEXICON.number_words)}, w) AS num FROM t)),
r AS (SELECT doc_id, num AND count(*) >= 4 AS run, min(pos) AS start, string_agg(w, ' ' ORDER BY pos) AS words FROM g GROUP BY doc_id, num, island),
j AS (SELECT doc_id, string_agg(CASE WHEN run THEN '[NUMBER_SEQ]' ELSE words END, ' ' ORDER BY start) AS masked FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(masked, '') AS masked FROM documents LEFT JOIN j USING (doc_id)""",
        "spoken_texts": _spoken_texts(),
        "default_patterns": f"WITH normal AS (SELECT doc_id, {_norm('text')} AS norm FROM {_spoken()}), {_stripped('normal', 'norm', 'bare', lexicon.DEFAULT)} SELECT doc_id, stripped, array_to_string(strip_reasons, '|') AS reasons FROM bare",
        "processed_transcripts": f"{_transcripts()}, {_semantic()} SELECT {_RESULTS}, {_text_or('semantic_text')} AS semantic_text FROM judged JOIN semantic USING (item)",
        "processed_calls": f"{_transcripts(lexicon.DEFAULT, _spoken())}, {_semantic(lexicon.DEFAULT)} SELECT {_RESULTS}, {_text_or('semantic_text')} AS semantic_text FROM judged JOIN semantic USING (item)",
        "review_rows": f"""{_transcripts()} SELECT {", ".join(f"{v} AS {c}" for c, v in _RESULT.items() if c in tables.REVIEW_COLUMNS)}, {_text_or("array_to_string(list_sort(list_distinct(removed)), ', ')")} AS removed_parts,
  {_text_or("CASE WHEN raw_words > 0 THEN round(clean_words / raw_words, 4) END", "NULL")} AS cleaning_ratio, {_text_or("avg_confidence", "NULL")} AS avg_confidence FROM judged""",
        "response_rows": f"""{_transcripts()} SELECT doc_id::VARCHAR AS file_name, {_RESULT['status']} AS status, lang AS selected_language, CASE WHEN quality = 0 THEN 'low' END AS language_confidence, {_text_or('raw_words', 'NULL')} AS word_count_raw, {_text_or('clean_words', 'NULL')} AS word_count_cleaned,
  failure IS NOT NULL OR empty AS is_empty_call, {_RESULT['empty_reason']} AS empty_reason, {_RESULT['review_priority']} AS review_priority, failure IS NULL AND ready AS ready_for_classification, {_text_or("array_to_string(flags, '|')", "'transcription_error'")} AS quality_flags,
  {_text_or("array_to_string(keywords, '|')")} AS problem_keywords_found, {_RESULT['raw_transcript']} AS raw_transcript, {_RESULT['cleaned_transcript']} AS cleaned_transcript FROM judged""",
        "judged_pieces": f"{_transcripts()} SELECT doc_id::VARCHAR AS file_name, place, why = 'useful' AS kept, p.kept AS cleaned_text, array_to_string(p.removed, '|') AS removed, why AS empty_reason FROM pieces p JOIN items USING (item)",
        "ordered_lines": "WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)) AS lines FROM t",
        "trimmed_texts": f"SELECT doc_id, array_to_string(string_split({_norm('text')}, ' ')[1:12], ' ') AS first_words FROM documents",
        "confidence_lists": f"""WITH w AS (SELECT doc_id, list_filter(string_split({_norm('text')}, ' '), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_filter(words, lambda x: (length(x) * 37) % 100 < 40 AND list_contains({_list(LEXICON.important_words())}, x))[1:30] AS important,
  list_filter(words, lambda x: (length(x) * 37) % 100 < 20 AND length(x) >= 4 AND NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains({_list([*LEXICON.number_words, *LEXICON.empty_phrases, *LEXICON.important_words()])}, x))[1:30] AS idle FROM w)
SELECT doc_id, {", ".join(f"array_to_string(list_transform({c}, lambda x: x || ':' || printf('%.4f', ((length(x) * 37) % 100) / 100.0::DOUBLE)), '; ') AS {n}" for c, n in (("important", "low_important"), ("idle", "removable")))} FROM s""",
        "failed_files": f"""SELECT 'f' || doc_id AS file_name, 'error' AS status, true AS is_empty_call, 'processing_error' AS empty_reason, 'high' AS review_priority, false AS ready_for_classification, 'processing_error' AS quality_flags, '' AS problem_keywords_found,
  NULL::INTEGER AS word_count_raw, NULL::INTEGER AS word_count_cleaned, {", ".join(f"'' AS {c}" for c in ("selected_language", "language_confidence", "raw_transcript", "cleaned_transcript", "semantic_text"))}, 'broken ' || coalesce(source, '?') AS error FROM documents""",
        "stored_csv": "WITH t AS (SELECT doc_id::VARCHAR AS doc_id, trim(coalesce(lang, ''), ' ') AS lang, trim(coalesce(source, ''), ' ') AS source, trim(coalesce(text, ''), ' ') AS text, array_to_string(string_split(source, 'c'), ', ') AS parts FROM documents) SELECT doc_id, lang, source, parts, CASE WHEN lower(text) IN ('true', 'false') THEN lower(text) WHEN lower(text) IN ('nan', 'none', 'null') THEN '' ELSE text END AS text FROM t",
        "report_totals": f"SELECT count(*) AS rows, count(DISTINCT c) FILTER (c <> -1) AS clusters, count(*) FILTER (c = -1) AS noise, count(DISTINCT coalesce(c, -1)) AS report_rows FROM (SELECT cluster_id AS c FROM {_DOCS})",
        "sizes_by_number": f"SELECT cluster_id::VARCHAR AS cluster_id, count(*) AS cluster_size FROM {_EMB} GROUP BY 1",
        "keyword_windows": f"""WITH d AS (SELECT doc_id, list_filter(string_split({_norm('text')}, ' '), lambda x: x <> '') AS t FROM documents),
h AS (SELECT doc_id, t, list_concat(
  list_transform(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the'), lambda i: [{{'s': greatest(i - 8, 0), 'e': least(i + 19, len(t))}}]),
  list_transform(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'is'), lambda i: [{{'s': greatest(i - 8, 0), 'e': least(i + 18, len(t))}}])) AS hits FROM d),
w AS (SELECT doc_id, t, list_reduce(hits, lambda got, h: CASE WHEN len(got) < 4 AND len(list_filter(got, lambda g: h[1].s < g.e AND g.s < h[1].e)) = 0 THEN list_concat(got, h) ELSE got END, []::STRUCT(s BIGINT, e BIGINT)[]) AS taken FROM h)
SELECT doc_id, array_to_string(list_transform(taken, lambda g: array_to_string(t[g.s + 1:g.e], ' ')), '|') AS windows FROM w""",
        "conversations": f"""{_conversations()} SELECT conv_id, raw_words, n_turns, cleaned AS cleaned_transcript, reason AS empty_reason, empty AS is_empty, clean_words, array_to_string(keywords, '|') AS problem_keywords, array_to_string(flags, '|') AS quality_flags,
  priority AS review_priority, CASE WHEN raw_words > 0 THEN round(clean_words / raw_words, 4) END AS cleaning_ratio, ready FROM judged""",
        "conversation_summary": f"""{_conversations()} SELECT count(*) AS total, count(*) FILTER (empty) AS empty, count(*) FILTER (NOT empty) AS useful, count(*) FILTER (len(flags) > 0) AS review_needed, count(*) FILTER (ready) AS ready,
  {', '.join(f"count(*) FILTER (priority = '{p}') AS priority_{p}" for p in ('low', 'medium', 'high'))} FROM judged""",
        "flag_counts": f"{_conversations()} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM judged) GROUP BY flag",
        "cleaned_transcripts": f"{_transcripts()} SELECT {_RESULTS} FROM judged",
        "process_summary": f"""{_transcripts()} SELECT count(*) AS total, count(*) FILTER (failure IS NULL AND NOT empty) AS useful, count(*) FILTER (failure IS NOT NULL OR empty) AS empty, count(*) FILTER (failure IS NOT NULL) AS errors,
  count(*) FILTER (failure IS NOT NULL OR len(flags) > 0) AS review_needed, count(*) FILTER (failure IS NULL AND ready) AS ready, count(*) FILTER (failure IS NOT NULL OR NOT ready) AS not_ready,
  {', '.join(f"count(*) FILTER (CASE WHEN failure IS NOT NULL THEN 'high' ELSE priority END = '{p}') AS priority_{p}" for p in ('low', 'medium', 'high'))} FROM judged""",
        "problem_keywords": f"WITH d AS (SELECT doc_id, {_norm('text')} AS norm FROM documents) SELECT doc_id, array_to_string({_found('norm')}, '|') AS keywords FROM d",
        "keyword_counts": f"WITH d AS (SELECT {_norm('text')} AS norm FROM documents) SELECT keyword, count(*) AS n FROM (SELECT unnest({_found('norm')}) AS keyword FROM d) GROUP BY keyword",
        "semantic_keywords": f"""WITH d AS (SELECT doc_id, {_norm('text')} AS norm FROM documents), k(word, named) AS (VALUES {_RANK}),
hits AS (SELECT DISTINCT doc_id, named, CASE WHEN named IN ({", ".join(f"'{s}'" for s in LEXICON.strong)}) THEN 100 ELSE 0 END + CASE WHEN len(string_split(named, ' ')) >= 3 THEN 40 WHEN len(string_split(named, ' ')) = 2 THEN 20 ELSE 0 END + least(length(named), 30) AS score
  FROM d JOIN k ON contains(norm, word) WHERE length(named) >= 3 AND named NOT IN ({", ".join(f"'{s}'" for s in LEXICON.weak)})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, named) AS r FROM hits)
SELECT doc_id, coalesce(string_agg(named, '|' ORDER BY r) FILTER (r <= 6), '') AS keywords FROM d LEFT JOIN ranked USING (doc_id) GROUP BY doc_id""",
        "empty_classification": f"WITH c AS (SELECT conv_id, turn, {_norm('text')} AS norm FROM conversations) SELECT conv_id, turn, {_reason('norm')} AS reason FROM c",
        "text_for_clustering": "SELECT doc_id, coalesce(nullif(trim(nullif(source, 'src0')), ''), nullif(trim(lang), ''), '') AS chosen, CASE WHEN length(trim(text, ' ')) > 40 THEN rtrim(substr(trim(text, ' '), 1, 40), ' ') || '...' ELSE coalesce(trim(text, ' '), '') END AS short FROM documents",
        "language_scores": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{LETTERS}') AS tok, length(regexp_replace(lower(coalesce(text, '')), '[^{SPECIAL}]', '', 'g')) AS special_chars FROM documents),
f AS (SELECT doc_id, len(tok) AS word_count, special_chars, len(list_intersect(list_distinct(tok), {_list(DEFAULT_HINTS)})) AS default_hits, len(list_intersect(list_distinct(tok), {_list(SPECIAL_HINTS)})) AS special_hits FROM t),
e AS (SELECT *, (least(special_chars, 6) + 2 * special_hits)::DOUBLE AS evidence, least(ln(1 + word_count), ln(1 + 22)) * 0.72::DOUBLE AS base FROM f),
s AS (SELECT *, CASE WHEN word_count = 0 THEN 0.0 ELSE round(greatest(0, base + 0.65::DOUBLE * default_hits + CASE WHEN special_chars = 0 THEN 0.45::DOUBLE ELSE 0 END - least(0.12::DOUBLE * special_chars, 0.8::DOUBLE)), 4) END AS default_score,
  CASE WHEN word_count = 0 THEN 0.0 ELSE round(greatest(0, base + 0.38::DOUBLE * least(special_chars, 6) + 0.85::DOUBLE * special_hits - CASE WHEN evidence = 0 THEN 1.35::DOUBLE WHEN evidence < 2 THEN 0.55::DOUBLE ELSE 0 END), 4) END AS special_score FROM e),
c AS (SELECT *, CASE WHEN default_score = 0 AND special_score = 0 THEN 'unknown' WHEN default_score >= special_score THEN 'en' ELSE 'es' END AS raw,
  special_score > default_score AND evidence < 2 AND (special_score < 1.35::DOUBLE * default_score OR special_score - default_score < 0.55::DOUBLE) AS guardrail FROM s),
m AS (SELECT *, CASE WHEN guardrail THEN 'en' ELSE raw END AS code, CASE WHEN greatest(default_score, special_score) > 0 THEN (greatest(default_score, special_score) - least(default_score, special_score)) / greatest(default_score, special_score) ELSE 0 END AS margin FROM c)
SELECT doc_id, word_count, special_chars, default_hits, special_hits, evidence, default_score, special_score, raw, code, guardrail,
  CASE WHEN code = 'unknown' THEN 'low' WHEN guardrail THEN CASE WHEN margin >= 0.08::DOUBLE THEN 'medium' ELSE 'low' END WHEN margin >= 0.22::DOUBLE THEN 'high' WHEN margin >= 0.10::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM m""",
        "detection_windows": "WITH w AS (SELECT event_id, value, least(greatest(value * 0.08::DOUBLE, 2.5), 5.0, value) AS length FROM events) SELECT event_id, part::BIGINT AS part, round(greatest(0, least(value * [0.25::DOUBLE, 0.5, 0.75][part + 1], value - length)), 6) AS start, round(length, 6) AS length FROM w, range(0, 3) t(part)",
        "csv_values": "WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'NaN' WHEN 2 THEN value::DECIMAL(12,2)::VARCHAR ELSE event_type END AS v FROM events) SELECT event_id, CASE WHEN lower(trim(v)) IN ('true', 'false') THEN lower(trim(v)) WHEN lower(trim(v)) IN ('nan', 'none', 'null') THEN '' ELSE trim(v) END AS parsed, CASE WHEN event_id % 4 = 2 THEN trunc(v::DOUBLE)::BIGINT WHEN event_id % 4 = 1 THEN -1 ELSE -1 END AS number FROM v",
        "newest_events": "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 50",
        "window_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "cluster_sizes": f"SELECT vec_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size, CASE WHEN cluster_id = -1 THEN 'noise' ELSE 'clustered' END AS cluster_status FROM {_EMB}",
        "cluster_counts": f"SELECT count(*) AS total, count(*) FILTER (cluster_id <> -1) AS clustered, count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS clusters, count(*) FILTER (cluster_id = -1) AS noise FROM {_EMB}",
        "cluster_centroids": f"SELECT cluster_id, dim, round(avg(x), 9) AS mean FROM (SELECT cluster_id, unnest(range(0, len(vec))) AS dim, unnest(vec)::DOUBLE AS x FROM {_EMB}) GROUP BY ALL",
        "cluster_probability": f"""WITH e AS (SELECT vec_id, cluster_id, unnest(range(0, len(vec))) AS dim, unnest(vec)::DOUBLE AS x FROM {_EMB}), c AS (SELECT cluster_id, dim, avg(x) AS m FROM e GROUP BY ALL),
p AS (SELECT vec_id, cluster_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cos FROM e JOIN c USING (cluster_id, dim) GROUP BY ALL),
b AS (SELECT *, min(cos) OVER w AS low, max(cos) OVER w AS high, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY cluster_id))
SELECT vec_id, round_even(CASE WHEN cluster_id = -1 THEN 0 WHEN n = 1 THEN 1 ELSE 0.5 + 0.5 * CASE WHEN high > low THEN (cos - low) / (high - low) ELSE 1 END END, 4) AS probability FROM b""",
        "top_terms": f"""WITH t AS (SELECT cluster_id, doc_id, unnest(range(0, len(tok))) AS pos, unnest(tok) AS term FROM (SELECT cluster_id, doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{T.TOKEN}'), lambda w: length(w) >= 4 AND NOT list_contains({_list(LEXICON.stopwords)}, w)) AS tok FROM {_DOCS})),
c AS (SELECT cluster_id, term, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS first FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS rank FROM c)
SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) AS top_terms FROM r WHERE rank <= 12 GROUP BY cluster_id""",
        "top_keywords": f"""WITH t AS (SELECT cluster_id, doc_id, unnest(range(0, len(tok))) AS pos, unnest(tok) AS term FROM (SELECT cluster_id, doc_id, {_found(_norm('text'))} AS tok FROM {_DOCS})),
c AS (SELECT cluster_id, term, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS first FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS rank FROM c)
SELECT cluster_id, string_agg(term, ', ' ORDER BY rank) AS top_terms FROM r WHERE rank <= 12 GROUP BY cluster_id""",
        "noise_removal": f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({_norm('text')}, '\\bin\\s+the\\b', ' ', 'g'), '\\b(of the|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS left_over FROM documents",
        "word_confidences": f"""WITH w AS (SELECT doc_id, list_filter(string_split({_norm('text')}, ' '), lambda x: x <> '') AS words FROM documents),
c AS (SELECT doc_id, words, list_filter(words, lambda x: (length(x) * 37) % 100 < 40) AS low, list_filter(words, lambda x: (length(x) * 37) % 100 < 20) AS very FROM w)
SELECT doc_id, len(words) AS total, len(low) AS low, len(very) AS very_low, CASE WHEN len(words) > 0 THEN round(len(low)::DOUBLE / len(words), 4) END AS low_ratio,
  array_to_string(list_transform(very[1:30], lambda x: x || ':' || printf('%.4f', ((length(x) * 37) % 100) / 100.0::DOUBLE)), '; ') AS very_low_words FROM c""",
        "cluster_report": f"""WITH d AS {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY probability DESC, doc_id) AS k, CASE WHEN length(trim(text, ' ')) > 320 THEN rtrim(substr(trim(text, ' '), 1, 320), ' ') || '...' ELSE coalesce(trim(text, ' '), '') END AS short FROM d)
SELECT cluster_id, count(*) AS cluster_size, round(avg(probability), 4) AS avg_probability, array_to_string(list_sort(list_transform(list(DISTINCT CASE WHEN doc_id % 5 = 0 THEN ' ' || lang ELSE lang END) FILTER (trim(lang) <> ''), lambda x: trim(x))), ', ') AS languages, coalesce(max(short) FILTER (k = 1), '') AS example_1, coalesce(max(short) FILTER (k = 2), '') AS example_2 FROM r GROUP BY cluster_id""",
    }
