"""Phrase scores in one pass over each text, whatever the number of phrases.

The phrases of all scores are compiled into one automaton (Aho-Corasick) on the driver and run over batches of texts in
the tasks, so the time follows the text, not the rules. Rules are a dict of scores (phrase -> weight) or a table of
(score, phrase, weight); the table may hold up to ``MOST_BYTES`` of phrases, which is what a task holds and a broadcast sends.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scores = Mapping[str, Mapping[str, int]]
#: Text of a rule table that is compiled into an automaton: about twenty times as much in memory.
MOST_BYTES = 16_000_000


def automaton(scores: Scores) -> ahocorasick.Automaton:
    """Of all phrases; a phrase's value is its weight in each score that lists it. Empty phrases are left out."""
    values: dict[str, list[tuple[int, int]]] = {}
    for k, phrases in enumerate(scores.values()):
        for phrase, weight in phrases.items():
            if phrase:
                values.setdefault(phrase, []).append((k, weight))
    found = ahocorasick.Automaton()
    for i, (phrase, of) in enumerate(values.items()):
        found.add_word(phrase, (i, tuple(of)))
    if values:
        found.make_automaton()
    return found


def totals(found: ahocorasick.Automaton, n: int, text: str | None) -> list[int]:
    """The weights of the phrases that occur, each once, summed by score."""
    out = [0] * n
    if text and len(found):
        for _, of in dict(value for _, value in found.iter(text)).items():
            for k, weight in of:
                out[k] += weight
    return out


def phrase_scores(text: Column, scores: Scores) -> Column:
    """A struct with a long for each score. A null text has zeros."""
    names, compiled = list(scores), automaton(scores)

    @F.pandas_udf(", ".join(f"`{name}` long" for name in names))
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([totals(compiled, len(names), t) for t in texts], columns=names, dtype="int64")

    return scored(text)


def rules_of(table: DataFrame) -> dict[str, dict[str, int]]:
    """The scores of a rule table of (score, phrase, weight); a phrase that a score lists twice has the sum of its weights."""
    rows = table.where("score is not null and phrase is not null").groupBy("score", "phrase").agg(F.sum("weight").cast("int").alias("weight"))
    size = rows.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of phrases; an automaton takes {MOST_BYTES} at most: split the table and add up the scores")
    out: dict[str, dict[str, int]] = {}
    for r in rows.orderBy("score", "phrase").collect():
        out.setdefault(r["score"], {})[r["phrase"]] = r["weight"]
    return out


def with_phrase_scores(df: DataFrame, table: DataFrame, text_col: str = "low") -> DataFrame:
    """Adds a column for each score of a rule table, named after it."""
    scores = rules_of(table)
    return df if not scores else df.withColumn("__scores", phrase_scores(F.col(text_col), scores)).select(*df.columns, "__scores.*")
