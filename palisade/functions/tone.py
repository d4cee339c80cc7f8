"""Tone counts that a negator shortly before a match voids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.functions.patterns import Family, family_counts
from palisade.functions.text import count_contained

def families(of: dict[str, tuple[str, ...]] = rules.TONE, negators: tuple[str, ...] = rules.NEGATORS) -> dict[str, Family]:
    return {f"tone_{name}": Family(patterns, negators) for name, patterns in of.items()}


def tone(text_col: str, family: tuple[str, ...], negators: tuple[str, ...] = rules.NEGATORS) -> Column:
    """Matches of a family's patterns with no negator shortly before; ``text_col`` names a lower-case column."""
    return family_counts(F.col(text_col), {"n": Family(family, negators)})["n"]


def tones(text_col: str, of: dict[str, tuple[str, ...]] = rules.TONE) -> dict[str, Column]:
    found = family_counts(F.col(text_col), families(of))
    return {f"tone_{name}": found[f"tone_{name}"] for name in of}


def tones_legacy(text: Column, of: dict[str, tuple[str, ...]] = rules.TONE_LEGACY) -> dict[str, Column]:
    """Older counts: listed words contained, without negation. ``text`` is lower case."""
    return {f"tone_{name}": count_contained(text, words) for name, words in of.items()}
