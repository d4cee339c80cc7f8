"""Pattern counts in one pass over each text, whatever the number of patterns.

Most patterns can begin only with one of a few literal pieces ("urgent", "claim your prize"). The pieces of all patterns are
compiled into one automaton (Aho-Corasick), and a pattern is tried only where one of its pieces begins. A pattern without such
pieces looks through the texts that hold one of its inner pieces (" hours"). Patterns are read with ASCII classes and word
borders, for lower-case text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from re import _constants as op
from re import _parser as parser
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters before a match that are looked at, and words among them.
REACH, WORDS = 40, 6
_MARK, _BLANKS = "\x01", re.compile("[ \t\r\n]+")


class Family(NamedTuple):
    """Patterns that are counted together: how many occur, or, with negators, all matches with no negator among the WORDS words
    in the REACH characters before."""

    patterns: tuple[str, ...]
    negators: tuple[str, ...] | None = None


def needles(pattern: str) -> set[str]:
    """Literal pieces of which every match holds one; empty if none are known."""

    def of(items) -> set[str]:
        found, run = [], ""
        for kind, arg in [*items, (None, None)]:
            if kind is op.LITERAL:
                run += chr(arg)
                continue
            found, run = [*found, {run}] if run else found, ""
            if kind is op.SUBPATTERN:
                found.append(of(arg[3]))
            elif kind is op.BRANCH:
                ways = [of(way) for way in arg[1]]
                found.append(set().union(*ways) if all(ways) else set())
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
                found.append(of(arg[2]))
        return max(filter(None, found), key=lambda pieces: min(map(len, pieces)), default=set())

    return set() if re.compile(pattern).flags & re.IGNORECASE else of(parser.parse(pattern))


#: Beginnings of a pattern that are told apart at most.
MOST_BEGINNINGS = 200


def beginnings(pattern: str) -> set[str]:
    """Literal beginnings of which every match has one; empty if none are known."""

    def of(items, so_far: set[str]) -> tuple[set[str], bool]:
        """What matches of the items begin with after ``so_far``, and whether that is all of them."""
        for kind, arg in items:
            if kind is op.AT:
                continue
            if kind is op.LITERAL:
                new, whole = {s + chr(arg) for s in so_far}, True
            elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
                new, whole = {s + chr(c) for s in so_far for _, c in arg}, True
            elif kind is op.SUBPATTERN and not arg[1] and not arg[2]:
                new, whole = of(arg[3], so_far)
            elif kind is op.BRANCH:
                ways = [of(way, so_far) for way in arg[1]]
                new, whole = set().union(*[w for w, _ in ways]), all(w for _, w in ways)
            elif kind is op.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
                new, whole = of(arg[2], so_far)
                new = new | so_far
            elif kind is op.MAX_REPEAT and arg[0] > 0:
                new, whole = of(arg[2], so_far)[0], False
            else:
                return so_far, False
            if len(new) > MOST_BEGINNINGS:
                return so_far, False
            so_far = new
            if not whole:
                return so_far, False
        return so_far, True

    found = set() if re.compile(pattern).flags & re.IGNORECASE else of(parser.parse(pattern), {""})[0]
    return found if min(map(len, found), default=0) > 1 else set()


def void(before: str, negators: frozenset[str]) -> bool:
    """Whether a negator is among the last WORDS words of what stands before a match."""
    return not negators.isdisjoint([w for w in _BLANKS.split(before) if w][-WORDS:])


def unnegated(pattern: re.Pattern, negators: frozenset[str], text: str) -> int:
    marked, n = pattern.subn(lambda m: _MARK + m.group(), text)
    if not n:
        return 0
    count, tail = 0, ""
    for part in marked.split(_MARK)[:-1]:
        tail = (tail + part)[-REACH:]
        count += not void(tail, negators)
    return count


class Finder:
    def __init__(self, families: Mapping[str, Family]):
        self.families = [(frozenset(f.negators) if f.negators is not None else None) for f in families.values()]
        each = [(k, p) for k, f in enumerate(families.values()) for p in f.patterns]
        self.rules = [(k, re.compile(p, re.ASCII)) for k, p in each]
        pieces: dict[str, tuple[list[int], list[int]]] = {}
        self.always = []
        for i, (_, p) in enumerate(each):
            first = beginnings(p)
            found = first or needles(p)
            for piece in found:
                pieces.setdefault(piece, ([], []))[not first].append(i)
            if not found:
                self.always.append(i)
        self.pieces = ahocorasick.Automaton()
        for piece, (begins, inside) in pieces.items():
            self.pieces.add_word(piece, (len(piece) - 1, tuple(begins), tuple(inside)))
        if pieces:
            self.pieces.make_automaton()

    def counts(self, text: str | None) -> list[int | None]:
        """By family; of a null text 0 with negators and null without."""
        if text is None:
            return [None if negators is None else 0 for negators in self.families]
        out, near, starts = [0] * len(self.families), set(self.always), {}
        marked = _MARK in text
        if len(self.pieces):
            for end, (before, begins, inside) in self.pieces.iter(text):
                near.update(inside)
                for i in begins:
                    starts.setdefault(i, set()).add(end - before)
        for i, at in starts.items():
            k, pattern = self.rules[i]
            negators = self.families[k]
            if negators is None:
                out[k] += any(pattern.match(text, a) for a in at)
            elif marked:
                out[k] += unnegated(pattern, negators, text)
            else:
                out[k] += self.begun(pattern, negators, text, sorted(at))
        for i in near:
            k, pattern = self.rules[i]
            negators = self.families[k]
            out[k] += bool(pattern.search(text)) if negators is None else unnegated(pattern, negators, text)
        return out

    @staticmethod
    def begun(pattern: re.Pattern, negators: frozenset[str], text: str, starts: list[int]) -> int:
        """As :func:`unnegated`, of a pattern whose matches begin at some of ``starts``."""
        count, free = 0, 0
        for a in starts:
            if a >= free and (m := pattern.match(text, a)):
                free = m.end()
                count += not void(text[max(0, a - REACH) : a], negators)
        return count


def family_counts(low: Column, families: Mapping[str, Family]) -> Column:
    """A struct with an int for each family."""
    held = {name: Family(*f) for name, f in families.items()}

    @F.arrow_udf(", ".join(f"`{name}` int" for name in held))
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(held)
        for texts in batches:
            rows = [finder.counts(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int32()) for k in range(len(held))], names=list(held))

    return counted(low)
