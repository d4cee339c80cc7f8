"""Text normalisation and basic statistics as Spark columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import rules

MIN_CHARS, MAX_CHARS = 20, 5000
UPPER, DIGIT = r"\p{Lu}", r"\p{Nd}"


def normalize_nfkc(text: Column) -> Column:
    """Unicode NFKC; null becomes empty. Python sees only rows with a character beyond ASCII."""

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else "")

    clean = F.coalesce(text, F.lit(""))
    return F.when(clean.rlike(r"[^\x00-\x7F]"), folded(clean)).otherwise(clean)


def emoji_to_token(text: Column, emoji: dict[str, str] = rules.EMOJI) -> Column:
    for sign, word in emoji.items():
        text = F.replace(text, F.lit(sign), F.lit(f" {word} "))
    return text


def strip_html_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def mark_short_urls(text: Column, hosts: tuple[str, ...] = rules.SHORTENERS) -> Column:
    return F.regexp_replace(text, short_url_pattern(hosts), " SHORTURL ")


def short_url_pattern(hosts: tuple[str, ...] = rules.SHORTENERS) -> str:
    return r"(?i)https?://(?:" + "|".join(h.replace(".", "[.]") for h in hosts) + r")/\S*"


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preprocess_text(text: Column, nfkc: bool = True) -> Column:
    """NFKC, emoji, tags, short links and blanks, in this order."""
    clean = normalize_nfkc(text) if nfkc else F.coalesce(text, F.lit(""))
    return collapse_whitespace(mark_short_urls(strip_html_tags(emoji_to_token(clean))))


def leet_normalize(text: Column) -> Column:
    return F.translate(F.lower(text), *rules.LEET)


def normalised(df: DataFrame, text_col: str = "text", nfkc: bool = True) -> DataFrame:
    """Adds ``clean`` (lower case of the preprocessed text) and ``leet``: what serving reads."""
    rows = df.withColumn("__prepared", preprocess_text(F.col(text_col), nfkc=nfkc))
    return rows.withColumns({"clean": F.lower("__prepared"), "leet": leet_normalize(F.col("__prepared"))}).drop("__prepared")


def non_ascii_share(text: Column) -> Column:
    n = F.char_length(text)
    return F.when(n > 0, F.lit(1.0) - F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / n).otherwise(0.0)


def count_contained(text: Column, cues: tuple[str, ...] | dict[str, int]) -> Column:
    """Sum of weights of the listed phrases that occur, each once. ``text`` is lower case. For long lists see
    :mod:`palisade.functions.phrases`."""
    weights = cues if isinstance(cues, dict) else dict.fromkeys(cues, 1)
    if not weights:
        return F.lit(0)
    total = F.lit(0)
    for cue, weight in weights.items():
        total = total + F.contains(text, F.lit(cue)).cast("int") * weight
    return F.coalesce(total, F.lit(0))


def count_matching(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur at least once. ``text`` is lower case."""
    total = F.lit(0)
    for p in patterns:
        total = total + text.rlike(p).cast("int")
    return total


def any_of(patterns: tuple[str, ...]) -> str:
    """A pattern that occurs where any of the patterns does. Those between word borders share them, so most places of a text
    are left at once."""
    inside = [p[5:-3] if p.startswith(r"\b(?:") and p.endswith(r")\b") and _closed(p[5:-3]) else None for p in patterns]
    shared = "|".join(f"(?:{x})" for x in inside if x is not None)
    return "|".join([*([rf"\b(?:{shared})\b"] if shared else []), *[f"(?:{p})" for p, x in zip(patterns, inside, strict=True) if x is None]])


def _closed(pattern: str) -> bool:
    """Whether no bracket closes one that was opened before the pattern."""
    depth = 0
    for c in re.sub(r"\\.|\[[^\]]*\]", "", pattern):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return False
    return True


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def share(count: Column, n: Column) -> Column:
    return F.when(n > 0, count / n).otherwise(0.0)


def rounded(x: Column, digits: int) -> Column:
    """``x`` times a power of ten rounded to a whole number, then divided again, as DuckDB rounds. Spark's ``round`` looks at
    the shortest decimal instead, so the two part at ties: 0.06495 x 10,000 is below 649.5."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def basic_features(text: Column, cues: tuple[str, ...] = rules.CUES, digits: int | None = 4) -> dict[str, Column]:
    """The stored statistics of a message; ``digits`` None leaves ratios unrounded. Upper-case letters and digits are
    those of all scripts."""
    n = F.char_length(text)
    fix = (lambda c: rounded(c, digits)) if digits is not None else (lambda c: c)
    urls = F.regexp_count(text, F.lit(r"https?://[^ \t\r\n]+"))
    return {
        "text_length": n,
        "word_count": F.size(tokens(text)),
        "has_url": (urls > 0).cast("int"),
        "url_count": urls,
        "exclamation_count": F.regexp_count(text, F.lit("!")),
        "uppercase_ratio": fix(share(F.regexp_count(text, F.lit(UPPER)), n)),
        "digit_ratio": fix(share(F.regexp_count(text, F.lit(DIGIT)), n)),
        "urgency_score": count_contained(F.lower(text), cues),
    }
