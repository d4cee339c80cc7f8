"""What features count in a text, in one pass of a task over a batch of texts: phrases, patterns, words and signs.

Words stand between blanks; a bare word is in lower case and without outer ASCII punctuation. Texts are laid end to end as arrays
of signs, and the counts are made for all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.patterns import Family, Finder
from palisade.functions.phrases import Scores, automaton, totals

#: Characters of texts that are counted together, about.
TOGETHER = 100_000
#: Counts of words and signs: words, characters and syllables of the bare words, different bare words, words in capitals, sentences
#: (an empty one after the last stop counts), and signs.
COUNTS = ("words", "chars", "syllables", "different", "capitals", "sentences", "punctuation", "exclamations", "questions", "currency", "upper", "digits")
_PUNCTUATION = frozenset(chr(b) for b in range(33, 127) if not chr(b).isalnum())
BLANK, SIGN, UPPER, DIGIT, SMALL, BIG, VOWEL, KNOWN = (1 << k for k in range(8))


def _kind(c: str) -> int:
    of = category(c)
    yes = (c in " \t\n\x0b\f\r", c in _PUNCTUATION, of == "Lu", of == "Nd", c.upper() != c, c.lower() != c, c in "aeiou", True)
    return sum(bit for bit, held in zip((BLANK, SIGN, UPPER, DIGIT, SMALL, BIG, VOWEL, KNOWN), yes, strict=True) if held)


class Laid:
    """Texts end to end, a line break after each: signs and their kinds, where texts and words begin and end."""

    def __init__(self, texts: list[str], kinds: np.ndarray):
        self.text = "\n".join([*texts, ""])
        self.signs = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        self.kind = kinds[self.signs]
        if len(new := np.unique(self.signs[self.kind == 0])):
            kinds[new] = [_kind(chr(c)) for c in new.tolist()]
            self.kind = kinds[self.signs]
        self.bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
        edge = np.diff((self.kind & BLANK).view(np.int8), prepend=1)
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.of_words = np.searchsorted(self.starts, self.bounds)

    def count(self, held: np.ndarray) -> np.ndarray:
        """By text."""
        return np.diff(np.searchsorted(np.flatnonzero(held), self.bounds))

    def by_text(self, of_word: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(of_word, dtype=np.int64)])[self.of_words])

    def within(self, held: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many places of each stretch hold."""
        upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(held, dtype=np.int32)])
        return upto[ends] - upto[starts]


    def linked(self) -> list[str]:
        """Of each text the words that links can be in, those with a dot before their end or a scheme: no link holds a blank."""
        colon = np.zeros(len(self.signs), bool)
        colon[:-2] = (self.signs[:-2] == 58) & (self.signs[1:-1] == 47) & (self.signs[2:] == 47)
        found = np.flatnonzero((self.within(self.signs == 46, self.starts, self.ends - 1) > 0) | (self.within(colon, self.starts, self.ends) > 0))
        words = [self.text[a:b] for a, b in zip(self.starts[found].tolist(), self.ends[found].tolist(), strict=True)]
        edges = np.searchsorted(found, self.of_words).tolist()
        return [" ".join(words[a:b]) for a, b in zip(edges, edges[1:])]


def link_words(text: Column) -> Column:
    """The words of a text that links can be in; null for a null text."""

    @F.arrow_udf("string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = np.zeros(0x110000, np.uint8)
        for batch in batches:
            words = [w for texts in stretches(batch.fill_null("").to_pylist()) for w in Laid(texts, kinds).linked()]
            yield _put(pa.array(words, pa.string()), np.asarray(batch.is_null()), None)

    return found(text)


def counts(t: Laid, low: Laid) -> np.ndarray:
    """Of texts and the same in lower case: by text, in the order of COUNTS."""
    big = t.within(t.kind & BIG > 0, t.starts, t.ends) > 0
    capitals = big & (t.within(t.kind & SMALL > 0, t.starts, t.ends) == 0) & (t.ends - t.starts > 1)
    # of a word in lower case, from its first to its last sign that is no punctuation
    inner = low.kind & (BLANK | SIGN) == 0
    at = np.flatnonzero(inner)
    upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(inner, dtype=np.int32)])
    some = upto[low.ends] > upto[low.starts]
    first, last = at[upto[low.starts[some]]], at[upto[low.ends[some]] - 1] + 1
    vowel = low.kind & VOWEL > 0
    runs = np.ones(len(some), np.int64)
    runs[some] = np.where(last - first > 3, np.maximum(1, low.within(vowel & ~np.concatenate([[False], vowel[:-1]]), first, last)), 1)
    chars = np.zeros(len(some), np.int64)
    chars[some] = last - first
    bare = low.signs.copy()
    shell = np.zeros(len(bare) + 1, np.int8)
    shell[first] = 1
    shell[last] -= 1
    bare[np.cumsum(shell[:-1], dtype=np.int8) == 0] = 32
    bare = bare.tobytes().decode("utf-32-le")
    none = low.by_text(~some) > 0
    different = [len({*filter(None, bare[a:b].split(" "))}) + e for a, b, e in zip(low.bounds[:-1].tolist(), low.bounds[1:].tolist(), none.tolist(), strict=True)]
    stop = (t.signs == 33) | (t.signs == 46) | (t.signs == 63)
    made = [
        np.diff(t.of_words), low.by_text(chars), low.by_text(runs), different, t.by_text(capitals), t.count(stop & ~np.concatenate([[False], stop[:-1]])) + 1, t.count(t.kind & SIGN > 0),
        t.count(t.signs == 33), t.count(t.signs == 63), sum(t.count(t.signs == ord(c)) for c in "$€£¥"), t.count(t.kind & UPPER > 0), t.count(t.kind & DIGIT > 0),
    ]
    return np.stack(made, axis=1)


def stretches(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def measured(text: Column, scores: Scores, families: Mapping[str, Family]) -> Column:
    """A struct of the counts (null for a null text), a long for each score and an int for each family of the text in lower case,
    and the text's ``link_words``."""
    held, compiled, names = {name: Family(*f) for name, f in families.items()}, automaton(scores), [*scores]
    kinds = {**dict.fromkeys(COUNTS, pa.int32()), **{f"score_{n}": pa.int64() for n in names}, **dict.fromkeys(held, pa.int32())}
    schema = ", ".join(f"`{name}` {'long' if kind == pa.int64() else 'int'}" for name, kind in kinds.items()) + ", link_words string"

    @F.arrow_udf(schema)
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder, signs = Finder(held), np.zeros(0x110000, np.uint8)
        for batch in batches:
            rows, links = [], []
            for texts in stretches(batch.fill_null("").to_pylist()):
                lows = [t.lower() for t in texts]
                laid = Laid(texts, signs)
                rows += [[*c, *totals(compiled, len(names), low), *finder.counts(low)] for c, low in zip(counts(laid, Laid(lows, signs)).tolist(), lows, strict=True)]
                links += laid.linked()
            null = np.asarray(batch.is_null())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            without = dict(zip([*COUNTS, *held], [None] * len(COUNTS) + finder.counts(None), strict=True))
            arrays = [_put(pa.array(c, kind), null, without.get(name, 0)) for c, (name, kind) in zip(columns, kinds.items(), strict=True)]
            yield pa.StructArray.from_arrays([*arrays, _put(pa.array(links, pa.string()), null, None)], names=[*kinds, "link_words"])

    return made(text)


def _put(values: pa.Array, null: np.ndarray, value) -> pa.Array:
    """The values, with another one for null texts."""
    return pc.if_else(pa.array(null), pa.scalar(value, values.type), values) if null.any() else values
