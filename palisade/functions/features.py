"""Engineered features and scam typing as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import rules, tone
from palisade.functions.measures import measured
from palisade.functions.patterns import Family, family_counts
from palisade.functions.phrases import Scores
from palisade.functions.text import share
from palisade.functions.urls import lookalike_host, url_flags, url_host, with_links

PHRASE_SCORES = {"scam": dict.fromkeys(rules.PHRASES, 1), "legit": rules.LEGIT_PHRASES}
#: Short lists that signals read besides the phrase scores.
LISTS = {"urgency": dict.fromkeys(rules.CUES, 1), "named": dict.fromkeys(rules.IMPERSONATED, 1), "named_action": dict.fromkeys(rules.IMPERSONATION_ACTIONS, 1), "secret": {"do not share": 1}}


def counted(name: str) -> Column:
    """A count of :func:`with_parts`."""
    return F.col(f"measures.{name}")


_EDGES = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"


def bare_word(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), _EDGES, "")


def syllable_count(bare: Column) -> Column:
    """Of a lower-case word without outer punctuation: 1 up to three letters; else runs of a, e, i, o, u without a final
    e that follows one of them, 1 at least."""
    runs = F.regexp_count(F.regexp_replace(bare, "([aeiou])e$", "$1"), F.lit("[aeiou]+"))
    return F.when(F.char_length(bare) <= 3, F.lit(1)).otherwise(F.greatest(runs, F.lit(1)))


def readability_score() -> Column:
    """Flesch reading ease between 0 and 100; an empty piece after the last stop counts as a sentence."""
    n, sentences = counted("words"), F.greatest(counted("sentences"), F.lit(1))
    ease = F.lit(206.835) - F.lit(1.015) * (n / sentences) - F.lit(84.6) * (counted("syllables") / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.greatest(ease, F.lit(0.0)), F.lit(100.0)))


def sender_impersonation_score(hosts: Column) -> Column:
    named = (counted("score_named") > 0) & (counted("score_named_action") > 0)
    return F.least(named.cast("int") + F.exists(hosts, lambda h: lookalike_host(h)).cast("int") * 2, F.lit(3))


def type_families(types: dict[str, tuple[str, ...]] = rules.SCAM_TYPES) -> dict[str, Family]:
    return {f"type_{name}": Family(patterns) for name, patterns in types.items()}


def type_scores(low: Column, types: dict[str, tuple[str, ...]] = rules.SCAM_TYPES) -> dict[str, Column]:
    """How many patterns of each type occur; a null text's scores are null."""
    found = family_counts(low, type_families(types))
    return {name: found[f"type_{name}"] for name in types}


def scam_type(scores: dict[str, Column], default: str = rules.DEFAULT_TYPE) -> Column:
    """The type with most matching patterns; ties go to the type declared first, no match to the default."""
    options = [F.struct(s.alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("name")) for k, (name, s) in enumerate(scores.items())]
    none = F.struct(F.lit(0).alias("score"), F.lit(1).alias("rank"), F.lit(default).alias("name"))  # before all types without a match
    return F.array_max(F.array(*options, none))["name"]  # read once, so that no pattern is matched twice


def opener_hits(low: Column, patterns: tuple[str, ...]) -> Column:
    return family_counts(low, {"n": Family(patterns)})["n"]


OTP = r"\b[0-9]{3}[-\s][0-9]{3}\b|\b[0-9]{6}\b"


def otp_signal(text: Column) -> Column:
    return F.when(text.isNotNull(), (counted("score_secret") > 0) & text.rlike(OTP))


#: All families of patterns that signals are made of.
MARKS = tone.families() | type_families() | {"romance": Family(rules.ROMANCE), "outreach": Family(rules.ROMANCE[: rules.OUTREACH]), "soft_invest": Family(rules.SOFT_INVEST)}


def with_parts(df: DataFrame, text_col: str = "text", scores: Scores = PHRASE_SCORES) -> DataFrame:
    """Adds what the features are made of, each once: ``low``, links and their hosts, and ``measures``, all that is counted in the text by one pass of
    :func:`measured`."""
    rows = df.withColumns({"low": F.lower(text_col), "measures": measured(F.col(text_col), {**scores, **LISTS}, MARKS)})
    return with_links(rows, text_col, F.col("measures.link_words")).withColumn("hosts", F.transform("urls", url_host))


def engineered(text_col: str = "text") -> dict[str, Column]:
    """All engineered features, from the columns of :func:`with_parts`."""
    return {
        "avg_word_length": share(counted("chars").cast("double"), counted("words")),
        "capitalized_word_count": counted("capitals"),
        "scam_phrase_score": counted("score_scam"),
        "legit_phrase_score": counted("score_legit"),
        "sender_impersonation_score": sender_impersonation_score(F.col("hosts")),
        "punctuation_density": share(counted("punctuation"), F.char_length(text_col)),
        "question_mark_count": counted("questions"),
        "currency_symbol_count": counted("currency"),
        "readability_score": readability_score(),
        "unique_word_ratio": share(counted("different"), counted("words")),
        **url_flags(F.col("explicit"), F.col("bare"), F.col(text_col)),
    }
