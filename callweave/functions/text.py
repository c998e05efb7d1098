"""Column functions over texts: normalising, counting, cleaning values. No function of this package runs Python on rows."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions.lexicon import plain


def others(kept: str) -> str:
    """A class of all characters other than ``kept``, listed: Java matches a negated class at a fifth of the speed."""
    places = sorted(map(ord, set(kept)))
    gaps = [(a + 1, b - 1) for a, b in zip([-1, *places], [*places, 0x110000], strict=True) if b - a > 1]
    low = "".join(rf"\x{c:02x}" for a, b in gaps for c in range(a, min(b, 255) + 1))
    high = "".join(rf"\x{{{max(a, 256):x}}}-\x{{{b:x}}}" for a, b in gaps if b > 255)
    return f"[{low}{high}]"


# What normalising replaces (all but these letters and signs), and the letters that make words.
KEPT = others("abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяәғқңөұүһі0123456789 \t\n\x0b\f\r[]_@.+-")
WORD = r"[a-zа-яәғқңөұүһі0-9\[\]_]+"
#: WORD for Java, which looks for the commonest letters first if they are nested so.
NESTED_WORD = r"[a-z[0-9\[\]_[а-яәғқңөұүһі]]]+"
TOKEN = r"[a-zа-яёәғқңөұүһі0-9_]+"


def let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def literal(value, kind: str) -> Column:
    """A constant of lists and dictionaries as one expression, however long it is: the optimiser folds it into a literal."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def texts(values: list[str]) -> Column:
    return literal(values, "array<string>")


def is_any(text: Column, words: list[str]) -> Column:
    """Whether the whole text is one of ``words``."""
    return F.rlike(text, F.lit(rf"\A(?:{any_of(words)})\z")) if words else F.lit(False)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case, ``ё`` as ``е``, characters outside KEPT as spaces, white space collapsed; null gives ''."""
    return collapse(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е")), KEPT, " "))


def count_words(text: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(NESTED_WORD))


def words_of(normalized: Column) -> Column:
    """Tokens of a normalised text; none for ''."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def ordered_distinct(values: Column) -> Column:
    """The texts of an array that aren't blank, trimmed, each once, in order; null gives none."""
    told = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    return F.coalesce(F.array_distinct(told), F.array().cast("array<string>"))


def clean_string(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit(""))


def first_text(*values: Column) -> Column:
    """The first of ``values`` that isn't blank, trimmed; else ''."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(""))


def trim_words(text: Column, n: int = 55, normalized: bool = False) -> Column:
    return F.substring_index(text if normalized else normalize_text(text), " ", n)


def short_text(text: Column, limit: int = 320) -> Column:
    whole = clean_string(text)
    return F.when(F.length(whole) > limit, F.concat(F.rtrim(F.substring(whole, 1, limit)), F.lit("..."))).otherwise(whole)


def report_tokens(text: Column, stopwords: list[str]) -> Column:
    """Lower-cased tokens of four characters or more that aren't stopwords, in order, repeats kept."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)
    return F.filter(tokens, lambda w: (F.length(w) >= 4) & ~w.isin(stopwords))


def split_keywords(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_csv_value(value: Column) -> Column:
    """A stored value as text: trimmed, booleans in lower case, nan, none and null as ''."""
    text = clean_string(value)
    low = F.lower(text)
    return F.when(low.isin("true", "false"), low).when(low.isin("nan", "none", "null"), "").otherwise(text)


def cluster_number(value: Column) -> Column:
    """An id from text: truncated towards zero; what is no number, or no 32-bit one, is -1."""
    return F.coalesce(value.try_cast("double").try_cast("int"), F.lit(-1))


def cleaning_ratio(raw_words: Column, clean_words: Column) -> Column:
    return F.when(raw_words > 0, F.round(clean_words / raw_words, 4))


def any_of(words: list[str]) -> str:
    """A pattern for the longest of ``words`` at a place, as a tree of their beginnings: a regular expression tries few of them there."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def of(at: dict) -> str:
        branches = [re.escape(c) + of(below) for c, below in sorted(at.items()) if c]
        inner = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
        return "" if not branches else f"(?:{inner})?" if "" in at else inner

    return of(tree)


def needed(pattern: str) -> str:
    """The longest run of letters that every match of ``pattern`` holds; '' if none can be told."""
    bare = re.sub(r"\[[^\]]*\]", "\0", re.sub(r"\\.", "\0", pattern))
    while (inner := re.sub(r"\([^()]*\)", "\0", bare)) != bare:
        bare = inner
    if "|" in bare or "(" in bare:
        return ""
    bare = re.sub(r"\w(?=[*?{])", "\0", bare)
    return max(re.findall(r"[^\W\d_]+", bare), key=len, default="")


def _replaced(state: Column, pattern: str, mark: str, earlier: str | None, guard=None) -> Column:
    """``state`` after one more pattern; patterns are literals, so that each is compiled once.

    The text is read once: the reason of the pattern before (``earlier``) is added now if it changed
    the text. The pattern runs only where ``guard`` holds: that must be cheap, and true wherever it matches.
    """

    def step(s: Column) -> Column:
        replaced = F.regexp_replace(s["text"], f"(?iuU){pattern}", mark)
        if guard is not None:
            replaced = F.when(guard(s["text"]), replaced).otherwise(s["text"])
        elif word := needed(pattern).lower():
            replaced = F.when(F.contains(s["text"], F.lit(word)) | ~s["low"], replaced).otherwise(s["text"])
        return F.struct(replaced.alias("text"), s["text"].alias("before"), _reasons(s, earlier).alias("reasons"), s["low"].alias("low"))

    return let(state, step)


def _reasons(s: Column, reason: str | None) -> Column:
    return F.when(s["text"] != s["before"], F.array_append(s["reasons"], F.lit(reason))).otherwise(s["reasons"]) if reason else s["reasons"]


def _start(text: Column) -> Column:
    """The text, no reasons yet, and whether it is in lower case (a word of a pattern can then be looked for as it is)."""
    return let(F.coalesce(text, F.lit("")), lambda t: F.struct(t.alias("text"), t.alias("before"), F.array().cast("array<string>").alias("reasons"), (F.lower(t) == t).alias("low")))


def stripped(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """``strip_patterns`` as one struct (text, reasons).

    One fold over the patterns, whatever their number. A text that holds none of the words that they
    need is left as it is; else a pattern is compiled and run where the word that it needs is there.
    """
    words = [needed(p).lower() for p, _ in patterns]
    steps = literal([{"pattern": f"(?iuU){p}", "word": w, "reason": r} for (p, r), w in zip(patterns, words, strict=True)], "array<struct<pattern:string,word:string,reason:string>>")
    none = F.array().cast("array<string>")

    def step(s: Column, p: Column) -> Column:
        def judged(t: Column) -> Column:
            reasons = F.when(t != s["text"], F.array_append(s["reasons"], p["reason"])).otherwise(s["reasons"])
            return F.struct(t.alias("text"), reasons.alias("reasons"), s["low"].alias("low"))

        return F.when(F.contains(s["text"], p["word"]) | ~s["low"], let(F.regexp_replace(s["text"], p["pattern"], F.lit(" ")), judged)).otherwise(s)

    def run(t: Column) -> Column:
        start = F.struct(t.alias("text"), none.alias("reasons"), (F.lower(t) == t).alias("low"))
        met = F.lit(True) if "" in words else F.rlike(t, F.lit(any_of(words))) | (F.lower(t) != t)
        done = F.when(met, F.aggregate(steps, start, step)).otherwise(start)
        return let(done, lambda s: F.struct(collapse(s["text"]).alias("text"), F.array_sort(F.array_distinct(s["reasons"])).alias("reasons")))

    whole = F.coalesce(text, F.lit(""))
    return let(whole, run) if patterns else let(whole, lambda t: F.struct(collapse(t).alias("text"), none.alias("reasons")))


def strip_patterns(text: Column, patterns: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Ordered replacement of ``patterns`` by spaces: the text, and the reasons that applied, sorted and distinct.

    Later patterns see the text that earlier ones left; white space is collapsed at the end.
    """
    done = stripped(text, patterns)
    return done["text"], done["reasons"]


PII = [  # Fixed values, in order.
    (r"\b\d{12}\b", "[IIN]", "iin_digits"),
    (r"\b(?:\d[ -]?){16}\b", "[CARD]", "card_digits"),
    (r"(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}", "[PHONE]", "phone_digits"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]", "email"),
    (r"\b[а-яё]{4,}(?:ова|ева|ина|ская|цкая)\b", "[NAME]", "single_surname_ru"),
    (r"\b[а-яәғқңөұүһі]+нің\s+[а-яәғқңөұүһі]+\s+[а-яәғқңөұүһі]+(?:қызы|ұлы)\b", "[NAME]", "name_kk"),
]
#: What a normalised text must hold for each of PII to match at all.
PII_GUARDS = [
    lambda t: F.rlike(t, F.lit(r"\d{12}")),
    lambda t: F.rlike(t, F.lit(r"(?:\d[ -]?){16}")),
    lambda t: F.rlike(t, F.lit(r"(?:\+7|8)[\s\-]?\(?\d{3}")),
    lambda t: F.contains(t, F.lit("@")),
    lambda t: F.rlike(F.lower(t), F.lit("(?:ова|ева|ина|ская|цкая)")),
    lambda t: F.contains(F.lower(t), F.lit("нің")),
]


def mask_number_runs(text: Column, number_words: list[str], least: int = 4) -> Column:
    """Runs of ``least`` number words or more as one ``[NUMBER_SEQ]``."""
    words = any_of(number_words)
    return F.regexp_replace(text, rf"(?<!\S){words}(?!\S)(?:\s+{words}(?!\S)){{{least - 1},}}", "[NUMBER_SEQ]")


#: What a text must hold for any of PII_GUARDS.
PII_SIGNS = r"[0-9@\u0400-\u04ff]"


def masked(text: Column, number_words: list[str]) -> Column:
    """``mask_pii`` as one struct (text, reasons)."""

    def by_patterns(s: Column) -> Column:
        state, reason = s, None
        for (pattern, mark, following), guard in zip(PII, PII_GUARDS, strict=True):
            state, reason = _replaced(state, pattern, mark, reason, guard), following
        return let(state, lambda x: F.struct(x["text"].alias("text"), x["text"].alias("before"), _reasons(x, reason).alias("reasons"), x["low"].alias("low")))

    state = let(_start(text), lambda s: F.when(F.rlike(s["text"], F.lit(PII_SIGNS)), by_patterns(s)).otherwise(s))
    runs = let(state, lambda s: F.struct(s["text"].alias("before"), mask_number_runs(s["text"], number_words).alias("after"), s["reasons"].alias("reasons")))
    spoken = lambda s: F.when(s["after"] != s["before"], F.array_append(s["reasons"], F.lit("spoken_number_sequence"))).otherwise(s["reasons"])
    return let(runs, lambda s: F.struct(collapse(s["after"]).alias("text"), spoken(s).alias("reasons")))


def mask_pii(text: Column, number_words: list[str]) -> tuple[Column, Column]:
    """The text with personal data masked, in the order of PII, and the reasons in that order."""
    done = masked(text, number_words)
    return done["text"], done["reasons"]


def has_keyword(normalized: Column, keywords: list[str]) -> Column:
    """Whether any keyword occurs in the text, within words too; the text is computed once."""
    return F.rlike(normalized, F.lit(any_of([plain(k) for k in keywords]))) if keywords else F.lit(False)


def keywords_in(normalized: Column, keywords: list[str]) -> Column:
    """The keywords that occur, as they are listed, sorted and distinct; the text is computed and read once.

    At each place the longest keyword is taken; all others that begin there are beginnings of it, so
    the keywords that occur in what was taken are those that occur in the text.
    """
    if not keywords:
        return F.array().cast("array<string>")
    listed: dict[str, set[str]] = {}
    for k in keywords:
        listed.setdefault(plain(k), set()).add(k)
    held = {p: sorted({k for i in range(len(p)) for j in range(i + 1, len(p) + 1) for k in listed.get(p[i:j], ())}) for p in listed}
    table = literal(held, "map<string,array<string>>")
    first = re.escape("".join(sorted({p[0] for p in listed if p}))).replace("-", r"\-")
    taken = F.array_distinct(F.regexp_extract_all(normalized, F.lit(f"(?=[{first}])(?=({any_of(list(listed))}))"), 1))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(taken, lambda k: F.element_at(table, k)))))


def empty_reason(text: Column, lexicon, normalized: bool = False, words: Column | None = None) -> Column:
    """Why a text says nothing: ``useful`` if it does say something, else the first reason that holds.

    ``normalized``: the text is normalised already. ``words``: how many it has, if that is known; else they are
    counted, where a reason rests on them.
    """

    def judged(x: Column) -> Column:
        t, signal = x["t"], x["signal"]
        few = lambda n: F.when(n <= 3, "too_short_without_problem_signal").when(n <= 5, "short_noninformative").otherwise("useful")
        idle = F.forall(words_of(t), lambda w: is_any(w, [*lexicon.empty_phrases, *lexicon.number_words]) | F.regexp_like(w, F.lit(r"^\d+$")))
        return (
            F.when(t == "", "empty_text")
            .when(is_any(t, lexicon.empty_phrases), "empty_phrase")
            .when(signal, "useful")
            .when(idle, "only_empty_or_number_words")
            .otherwise(let(count_words(t), few) if words is None else few(words))
        )

    heard = lambda t: F.struct(t.alias("t"), has_keyword(t, lexicon.keywords).alias("signal"))
    return let(let(text if normalized else normalize_text(text), heard), judged)


def ranked_keywords(found: Column, lexicon, most: int = 6) -> Column:
    """Up to ``most`` telling keywords, best first.

    A strong keyword counts 100, three words 40 and two 20, a marker of trouble 30, and each
    character 1 up to 30; generic and weak ones and those of fewer than three characters are dropped.
    """
    canonical = literal(lexicon.canonical, "map<string,string>") if lexicon.canonical else None
    named = F.transform(found, lambda k: normalize_text(k))
    named = F.transform(named, lambda k: F.coalesce(F.try_element_at(canonical, k), k)) if canonical is not None else named
    told = F.filter(named, lambda k: (F.length(k) >= 3) & ~is_any(k, [*lexicon.weak, *lexicon.generic]))
    score = lambda k: (
        F.when(is_any(k, lexicon.strong), 100).otherwise(0)
        + F.when(F.size(F.split(k, " ")) >= 3, 40).when(F.size(F.split(k, " ")) == 2, 20).otherwise(0)
        + F.when(F.exists(texts(lexicon.markers), lambda m: F.contains(k, m)), 30).otherwise(0)
        + F.least(F.length(k), F.lit(30))
    )
    ranked = F.array_sort(F.transform(told, lambda k: F.struct((-score(k)).alias("s"), k.alias("k"))))
    return F.slice(F.array_distinct(F.transform(ranked, lambda x: x["k"])), 1, most)


def remove_noise(text: Column, lexicon, normalized: bool = False) -> Column:
    """The normalised text without noise patterns and generic phrases, the longest first."""
    out = text if normalized else normalize_text(text)
    for pattern in lexicon.noise:
        out = F.regexp_replace(out, f"(?iuU){pattern}", " ")
    phrases = sorted({plain(g) for g in lexicon.generic}, key=lambda g: (-len(g), g))
    if phrases:
        out = F.regexp_replace(out, rf"(?U)\b(?:{'|'.join(phrases)})\b", " ")
    return collapse(out)


def noise_parts(reasons: Column) -> Column:
    """How many of the stripped parts are a recogniser's noise."""
    return F.size(F.filter(reasons, lambda r: F.startswith(r, F.lit("asr_"))))


def has_personal(reasons: Column) -> Column:
    """Whether personal data were masked or dropped."""
    return F.exists(reasons, lambda r: r.isin([r for _, _, r in PII] + ["name_ru", "spoken_number_sequence", "drop_pii_only_segment"]))


def quality_flags(average_confidence: Column, language_confidence: Column, fallback: Column, noise: Column, personal: Column, cleaned: Column, empty: Column, raw_words: Column, words: Column | None = None) -> Column:
    """Sorted flags of a cleaned conversation; ``noise`` and ``personal`` as of ``noise_parts`` and ``has_personal`` for all that was removed.

    ``words``: how many ``cleaned`` has, if that is known; else they are counted.
    """
    low_confidence, high_ratio = 0.75, 0.55  # fixed values
    words = count_words(cleaned) if words is None else words
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(average_confidence < low_confidence, "low_avg_confidence"),
                F.when(language_confidence == "low", "low_language_confidence"),
                F.when(F.coalesce(fallback, F.lit(False)), "fallback_language_used"),
                F.when(noise >= 2, "many_asr_noise_fragments"),
                F.when(personal, "pii_removed"),
                F.when(F.contains(F.lower(cleaned), F.lit("[number_seq]")), "contains_number_sequence"),
                F.when(~empty & (raw_words > 0) & (F.round(words / raw_words, 4) < high_ratio), "high_cleaning_ratio"),
                F.when(~empty & (words <= 5), "very_short_but_useful"),
            )
        )
    )


# The flags of each priority.
HIGH = ["transcription_error", "low_avg_confidence", "low_language_confidence", "fallback_language_used", "many_asr_noise_fragments", "high_cleaning_ratio"]
MEDIUM = ["has_very_low_confidence_words", "has_low_confidence_noise_candidates", "contains_number_sequence", "pii_removed", "very_short_but_useful"]


def review_priority(empty: Column, cleaned: Column, flags: Column) -> Column:
    """high for empty conversations and flags of HIGH, medium for flags of MEDIUM, else low."""
    some = lambda names: F.arrays_overlap(flags, F.array(*[F.lit(x) for x in names]))
    return F.when(empty | (cleaned == "") | some(HIGH), "high").when(some(MEDIUM), "medium").otherwise("low")
