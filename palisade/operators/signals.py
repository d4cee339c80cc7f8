"""All that the verdict policy and the models read of a text, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import features, rules, text, urls
from palisade.functions.phrases import Scores

TONES = ("tone_urgency", "tone_fear", "tone_reward", "tone_threat")
URL_FLAGS = ("url_suspicious_tld", "url_suspicious_keyword", "url_has_ip")
#: Numeric features of the models, in order; proximity comes from vectors.
NUMERIC = (
    "text_length", "word_count", "has_url", "url_count", "exclamation_count", "uppercase_ratio", "digit_ratio", "urgency_score", *TONES, *URL_FLAGS, "scam_phrase_score", "sender_impersonation_score",
    "avg_word_length", "capitalized_word_count", "punctuation_density", "question_mark_count", "currency_symbol_count", "readability_score", "unique_word_ratio", "proximity_scam_score", "legit_phrase_score",
)
DIGITS = {"avg_word_length": 4, "punctuation_density": 4, "readability_score": 2, "unique_word_ratio": 4}


def engineered() -> dict[str, Column]:
    return {k: text.rounded(c, DIGITS[k]) if k in DIGITS else c for k, c in features.engineered().items()}


def with_signals(rows: DataFrame, keep: tuple[str, ...] | None = None, scores: Scores = features.PHRASE_SCORES) -> DataFrame:
    """The columns ``keep`` (all, by default) and every signal of ``text``. What features are made of is made once."""
    links, n, count = F.size("urls"), F.char_length("text"), features.counted
    kept = rows.columns if keep is None else keep
    basic = {
        "text_length": n,
        "exclamation_count": count("exclamations"),
        "uppercase_ratio": text.rounded(text.share(count("upper"), n), 4),
        "digit_ratio": text.rounded(text.share(count("digits"), n), 4),
        "urgency_score": count("score_urgency").cast("int"),
    }
    made = basic | {"word_count": count("words"), "has_url": (links > 0).cast("int"), "url_count": links} | engineered() | {k: count(k) for k in TONES}
    return features.with_parts(rows, scores=scores).select(
        *kept, "urls", links.alias("n_urls"),
        *[c.alias(k) for k, c in made.items()],
        urls.trusted_hosts(F.col("hosts")).alias("trusted"),
        features.scam_type({k: count(f"type_{k}") for k in rules.SCAM_TYPES}).alias("scam_type"),
        *[count(k).alias(k) for k in ("romance", "outreach", "soft_invest")],
        features.otp_signal(F.col("text")).alias("otp"),
    )
