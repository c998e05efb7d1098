"""Evidence for one of two languages in a transcript: a default one and one with special letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions.text import let

# Fixed values.
LETTERS, SPECIAL = r"[а-яёәғқңөұүһі]+", "әғқңөұүһі"
DEFAULT_CONFIDENCE, FULL_WORDS = 0.72, 22
DEFAULT_BONUS, NO_EVIDENCE, WEAK_EVIDENCE = 0.45, 1.35, 0.55
LEAST_EVIDENCE, STRONG_EVIDENCE, MULTIPLIER, ADVANTAGE = 2.0, 4.0, 1.35, 0.55


def features(text: Column, default_hints: list[str], special_hints: list[str], letters: str = LETTERS, special: str = SPECIAL) -> dict[str, Column]:
    """Counts of words, special letters and distinct hint words, and the evidence for the special language."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tokens = F.regexp_extract_all(low, F.lit(letters), 0)
    hits = lambda hints: F.size(F.array_intersect(tokens, F.array(*[F.lit(h) for h in hints])))
    chars = F.length(F.regexp_replace(low, f"[^{special}]", ""))
    return {
        "word_count": F.size(tokens),
        "special_chars": chars,
        "default_hits": hits(default_hints),
        "special_hits": hits(special_hints),
        "evidence": (F.least(chars, F.lit(6)) + 2 * hits(special_hints)).cast("double"),
    }


def score(f: dict[str, Column], confidence: Column | None, special: bool) -> Column:
    """The score of one language, 0 or more, four decimals."""
    sure = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE)) if confidence is not None else F.lit(DEFAULT_CONFIDENCE)))
    base = F.least(F.log1p(f["word_count"]), F.log1p(F.lit(FULL_WORDS))) * sure
    if special:
        raw = base + 0.38 * F.least(f["special_chars"], F.lit(6)) + 0.85 * f["special_hits"]
        raw = raw - F.when(f["evidence"] == 0, NO_EVIDENCE).when(f["evidence"] < LEAST_EVIDENCE, WEAK_EVIDENCE).otherwise(0.0)
    else:
        raw = base + 0.65 * f["default_hits"] + F.when(f["special_chars"] == 0, DEFAULT_BONUS).otherwise(0.0) - F.least(0.12 * f["special_chars"], F.lit(0.8))
    return F.when(f["word_count"] == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), raw), 4))


def choose(default: Column, special: Column, evidence: Column, names: tuple[str, str] = ("ru", "kk")) -> dict[str, Column]:
    """``raw`` and ``code`` of the language, and whether the guardrail turned a weak special one down."""
    none = (default == 0) & (special == 0)
    weak = (special > default) & (evidence < LEAST_EVIDENCE) & ((special < MULTIPLIER * default) | (special - default < ADVANTAGE))
    raw = F.when(none, "unknown").when(default >= special, names[0]).otherwise(names[1])
    return {"raw": raw, "code": F.when(weak & ~none, names[0]).otherwise(raw), "guardrail": weak & ~none}


def confidence_of(default: Column, special: Column, code: Column, guardrail: Column) -> Column:
    """low, medium or high by how far the better score leads."""
    best, second = F.greatest(default, special), F.least(default, special)
    margin = F.when(best > 0, (best - second) / best).otherwise(0.0)
    return F.when((code == "unknown") | (best <= 0), "low").when(guardrail, F.when(margin >= 0.08, "medium").otherwise("low")).when(margin >= 0.22, "high").when(margin >= 0.10, "medium").otherwise("low")


def detection_windows(seconds: Column) -> Column:
    """Starts and length of the stretches of audio to listen to: 8 % of it, 2.5 to 5 seconds, at 25, 50 and 75 %."""
    size = F.least(F.least(F.greatest(seconds * 0.08, F.lit(2.5)), F.lit(5.0)), seconds)
    return F.transform(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), lambda at: F.struct(F.greatest(F.lit(0.0), F.least(seconds * at, seconds - size)).alias("start"), size.alias("length")))


def needs_recheck(code: Column, raw: Column, evidence: Column, confidence: Column, special: str = "kk") -> Column:
    """Whether a call for the special language stands on too little to be taken from a first, short look."""
    return ((code == special) | (raw == special)) & ((evidence < STRONG_EVIDENCE) | confidence.isin("low", "medium"))


def detect(default: Column, special: Column, hints: tuple[list[str], list[str]], confidences: tuple[Column | None, Column | None] = (None, None), names: tuple[str, str] = ("ru", "kk")) -> Column:
    """A struct of the language told by two recognisers' texts of one recording: scores, ``code``, ``raw``, ``guardrail``, ``confidence``, ``recheck``.

    Each text is scored for its own language; the evidence is that of the special one. Where nothing
    was recognised the code is ``unknown``; ``or_default`` makes that the default language.
    """
    f, g = features(default, *hints), features(special, *hints)
    scores = F.struct(score(f, confidences[0], False).alias("default_score"), score(g, confidences[1], True).alias("special_score"), g["evidence"].alias("evidence"))

    def chosen(s: Column) -> Column:
        c = choose(s["default_score"], s["special_score"], s["evidence"], names)
        fields = [s[n].alias(n) for n in ("default_score", "special_score", "evidence")]
        return F.struct(*fields, *[c[n].alias(n) for n in ("code", "raw", "guardrail")])

    def judged(s: Column) -> Column:
        sure = confidence_of(s["default_score"], s["special_score"], s["code"], s["guardrail"])
        fields = [s[n].alias(n) for n in ("default_score", "special_score", "evidence", "code", "raw", "guardrail")]
        return F.struct(*fields, sure.alias("confidence"), needs_recheck(s["code"], s["raw"], s["evidence"], sure, names[1]).alias("recheck"))

    return let(let(scores, chosen), judged)


def or_default(code: Column, name: str = "ru") -> Column:
    return F.when(code == "unknown", name).otherwise(code)
