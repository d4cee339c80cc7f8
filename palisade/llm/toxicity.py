"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. The lexical transducer rewrites their words to insults, threats (sequences of words),
targets, negators and verbs of report, with weights. Two composed transducers then run over the clause, one from each
end: negation (abuse soon after a negator, or before one that ends the clause), reported speech (after or before a verb
of report) and target (somebody is named before or after). Each arc has a weight, and the weights along a path are
multiplied; what leaves the last transducer are abuse labels with marks. A single line break ends no clause.
The path weights of matched clauses, by mark, are the features of a small logistic model.

Insult words, also as beginnings of words, threats (sequences with a target) and the model are learned from a bounded
sample of labelled rows. When the model is fitted each row is measured twice, with the words of the whole sample and with
those learned on the half that it is not in; the words of the whole sample then serve. A short starter lexicon holds
without labels.

Defined cases: null text counts as empty and scores the base rate; without labels of both kinds the starter lexicon
and fixed weights score; an empty table gives an empty result; repeated rows give repeated rows, and train as often; a
row whose label is null does not train; terms of equal evidence are taken in order of name; texts of any length are
read whole; columns besides id and text are ignored by :func:`score_toxicity` and kept by :func:`reject_toxic`.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import cut, small_batches

#: Rows of each label in the sample, terms in the lexicon.
FIT_ROWS, LEXICON = 6_000, 2_000
#: A term needs so many toxic rows. Its evidence, the log odds less SURE standard errors, must reach LEAST_ODDS and
#: LEAST_SHARE of the strongest term's: words that near copies of a few toxic rows share stay below that.
LEAST_ROWS, LEAST_ODDS, LEAST_SHARE, SURE = 3, 1.1, 0.5, 2.33
PREFIX = (4, 8)
#: Words in a learned threat.
PHRASE = (2, 4)

#: Where the lexicon starts; what a corpus uses besides is learned.
INSULTS = tuple("idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile filth vermin parasite coward freak disgrace garbage scumbag dimwit".split())
THREATS = tuple(f"{verb} {whom}" for verb in ("kill", "hurt", "destroy", "beat", "crush", "stab", "shoot", "strangle", "burn", "bury") for whom in ("you", "him", "her", "them")) + ("you will pay", "watch your back", "hope you die", "we know where you live")
TARGETS = frozenset("you your yours yourself u ur he him his she her they them their these those people everyone".split())
NEGATORS = frozenset("not never no isn't aren't wasn't don't doesn't nobody neither nor without".split())
REPORTS = frozenset("said says say called calls wrote writes quoted claimed claims reported according".split())
_CLAUSE = re.compile(r"[.!?;]+|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def lexical(words: Iterable[str], weight_of, threat_at=None) -> Iterator[tuple[str, float]]:
    """First transducer: word -> (class, weight); ``threat_at(words, i)`` is the weight of a threat that begins there."""
    words = list(words)
    for i, w in enumerate(words):
        weight = weight_of(w)
        threat = threat_at(words, i) if threat_at else 0.0
        if threat > 0:
            yield "threat", threat
        if weight > 0:
            yield "insult", weight
        elif w in NEGATORS:
            yield "negator", 0.0
        elif w in REPORTS:
            yield "report", 0.0
        elif w in TARGETS:
            yield "target", 0.0
        elif not threat:
            yield "other", 0.0


class Transducer:
    """Weighted arcs (state, label) -> (label, weight, state). A label without an arc passes unchanged with weight 1, and
    the state becomes ``otherwise(state)``."""

    def __init__(self, arcs: dict[tuple, tuple[str, float, object]], otherwise, start=0):
        self.arcs, self.otherwise, self.start = arcs, otherwise, start

    def step(self, state, label: str) -> tuple[str, float, object]:
        return self.arcs.get((state, label)) or (label, 1.0, self.otherwise(state))

    def run(self, tape: Iterable[tuple[str, float]]) -> Iterator[tuple[str, float]]:
        state = self.start
        for label, weight in tape:
            out, factor, state = self.step(state, label)
            yield out, weight * factor


def compose(*machines: Transducer) -> Transducer:
    """One transducer that does what the machines do one after the other: its states are their states together, and an
    arc's weight is the product of theirs. Arcs are made for every label that can come in or leave one of them."""
    labels = {"insult", "threat", "negator", "report", "target", "other"}
    while more := {out for m in machines for (_, label), (out, _, _) in m.arcs.items() if label in labels} - labels:
        labels |= more
    start = tuple(m.start for m in machines)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        states = todo.pop()
        for label in labels:
            out, weight, after = label, 1.0, []
            for m, state in zip(machines, states, strict=True):
                out, factor, state = m.step(state, out)
                weight *= factor
                after.append(state)
            arcs[states, label] = (out, weight, tuple(after))
            if tuple(after) not in seen:
                seen.add(tuple(after))
                todo.append(tuple(after))
    return Transducer(arcs, lambda states: tuple(m.otherwise(s) for m, s in zip(machines, states, strict=True)), start)


#: Factors of the arcs that mark abuse.
NEGATED, REPORTED, AIMED = 0.25, 0.4, 1.5
_MARKS = ("negated", "reported", "aimed")
_ABUSE = [f"{kind}{marks}" for kind in ("insult", "threat") for marks in ("", "+aimed", "+negated", "+reported", "+negated+aimed", "+negated+reported", "+reported+aimed", "+negated+reported+aimed")]


def _marked(label: str, mark: str) -> str:
    kind, *marks = label.split("+")
    return "+".join([kind, *(m for m in _MARKS if m in {*marks, mark})])


def _marking(mark: str, factor: float, states: Iterable[int], after) -> dict:
    """Arcs that put a mark on abuse that has not got it yet."""
    return {(s, label): (_marked(label, mark), factor, after(s)) for s in states for label in _ABUSE if mark not in label}


def negation(reach: int = 3) -> Transducer:
    """State: words left in the reach of a negator."""
    fewer = lambda s: max(0, s - 1)
    arcs = {(s, "negator"): ("negator", 1.0, reach) for s in range(reach + 1)}
    return Transducer(arcs | _marking("negated", NEGATED, range(1, reach + 1), fewer), fewer)


def late_negation(reach: int = 4) -> Transducer:
    """From the end of a clause: only a negator that is its last word counts. State: as above, -1 at the end."""
    fewer = lambda s: max(0, s - 1)
    return Transducer({(-1, "negator"): ("negator", 1.0, reach)} | _marking("negated", NEGATED, range(1, reach + 1), fewer), fewer, -1)


def reported() -> Transducer:
    """State: whether a verb of report stands on that side."""
    return Transducer({(0, "report"): ("report", 1.0, 1)} | _marking("reported", REPORTED, (1,), lambda s: s), lambda s: s)


def targeted() -> Transducer:
    """State: whether somebody is named on that side."""
    return Transducer({(0, "target"): ("target", 1.0, 1)} | _marking("aimed", AIMED, (1,), lambda s: s), lambda s: s)


FORWARD, BACKWARD = compose(negation(), reported(), targeted()), compose(late_negation(), reported(), targeted())


def clause_labels(tape: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """The clause after both composed transducers, in its order."""
    return list(BACKWARD.run(reversed(list(FORWARD.run(tape)))))[::-1]


def slot(label: str) -> int | None:
    """The feature that a label counts for; None for what is no abuse."""
    kind, *marks = label.split("+")
    if kind not in ("insult", "threat"):
        return None
    if "negated" in marks:
        return 2
    if "reported" in marks:
        return 3
    return (4 if kind == "threat" else 0) + ("aimed" in marks)


SLOTS = 6
#: Where the model starts, and what it falls back to: base, then log weights of each slot.
PRIOR = np.array([-4.0, 3.0, 3.5, 0.5, 1.0, 4.0, 4.0])


class Grammar:
    def __init__(self, terms: dict[str, float]):
        """terms: word, or beginning of a word and "*", or words of a threat with blanks between, -> weight."""
        self.terms = terms
        self.threats: dict[str, list[tuple[list[str], float]]] = {}
        for t, w in ({t: 1.0 for t in THREATS} | {t: w for t, w in terms.items() if " " in t}).items():
            self.threats.setdefault(t.split()[0], []).append((t.split(), w))
        self.words = {t: w for t, w in terms.items() if not t.endswith("*") and " " not in t}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.sizes = sorted({len(s) for s in self.stems})
        self._finder = None

    def __getstate__(self):
        return {"terms": self.terms}

    def __setstate__(self, state):
        self.__init__(state["terms"])

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in self.sizes:
            if n > len(word):
                break
            found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def threat_at(self, words: list[str], i: int) -> float:
        return max((w for t, w in self.threats.get(words[i], ()) if words[i : i + len(t)] == t), default=0.0)

    def finder(self):
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            marks = {max((w for w in t if w not in TARGETS), key=len, default=t[0]) for ts in self.threats.values() for t, _ in ts}
            for t in {*self.words, *self.stems, *marks}:
                self._finder.add_word(t, len(t))
            self._finder.make_automaton()
        return self._finder

    def features(self, text: str | None) -> np.ndarray:
        """log(1 + path weights) of each slot over the matched clauses of the whole text."""
        sums = np.zeros(SLOTS)
        low = text.lower() if isinstance(text, str) else ""
        starts = [end + 1 - n for end, n in self.finder().iter(low)] if low else []
        starts = [s for s in starts if not s or not low[s - 1].isalpha()]
        if not starts:
            return sums
        bounds = [0, *(m.end() for m in _CLAUSE.finditer(low)), len(low) + 1]
        for k in sorted({bisect_right(bounds, s) - 1 for s in starts}):
            clause = low[bounds[k] : bounds[k + 1]]
            for label, weight in clause_labels(list(lexical(_WORD.findall(clause), self.weight, self.threat_at))):
                k = slot(label)
                if k is not None:
                    sums[k] += weight
        return np.log1p(sums)


class ToxicityModel:
    def __init__(self, grammar: Grammar, weights: np.ndarray):
        self.grammar, self.weights = grammar, weights

    def score(self, texts: Iterable[str | None]) -> list[float]:
        rows = np.array([self.grammar.features(t) for t in texts]).reshape(-1, SLOTS)
        return (1 / (1 + np.exp(-(self.weights[0] + rows @ self.weights[1:])))).tolist()


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: np.ndarray, strength: float = 0.1) -> np.ndarray:
    """Weighted logistic regression by Newton steps, drawn towards ``prior``."""
    a, b = np.column_stack([np.ones(len(x)), x]), prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (w * (p - y)) + strength * (b - prior)
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + strength * np.eye(len(b)), grad)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _terms(text: str | None) -> set[str]:
    found = set()
    for w in set(_WORD.findall(text.lower())) if isinstance(text, str) else ():
        if len(w) >= 3:
            found.add(w)
        found.update(w[:n] + "*" for n in range(PREFIX[0], min(PREFIX[1], len(w)) + 1))
    return found | _phrases(text)


def _phrases(text: str | None) -> set[str]:
    """Sequences of words in a clause, with a target and another word in them."""
    found = set()
    for clause in _CLAUSE.split(text.lower()) if isinstance(text, str) else ():
        words = _WORD.findall(clause)
        for i, w in enumerate(words):
            if w in TARGETS:
                for n in range(PHRASE[0], PHRASE[1] + 1):
                    for a in range(max(0, i - n + 1), min(i, len(words) - n) + 1):
                        part = words[a : a + n]
                        if not TARGETS.issuperset(part):
                            found.add(" ".join(part))
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, training: Column, *, id_col: str, text_col: str, label_col: str, seed: int = 5) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """Rows (text, y, rate): about FIT_ROWS of each label by hash. Their ids are few, so they are broadcast."""
    known = labels.where(training & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    rates = {y: min(1.0, FIT_ROWS / n) for y, n in counts.items()}
    rate = F.when(F.col("y") == 1, F.lit(rates.get(1, 0.0))).otherwise(F.lit(rates.get(0, 0.0)))
    draw = F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    picked = known.where(draw < rate)
    texts = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("text"))
    return texts.join(F.broadcast(picked), "__id").select("text", "y"), counts, rates


def fit_toxicity(docs: DataFrame, labels: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    starter = {t: 1.0 for t in INSULTS}
    sample, counts, rates = labelled_sample(docs, labels, training, id_col=id_col, text_col=text_col, label_col=label_col)
    if not counts.get(0) or not counts.get(1):
        return ToxicityModel(Grammar(starter), PRIOR)
    sample = cut(sample.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for text, y, half in zip(pdf["text"], pdf["y"], pdf["half"], strict=True):
                for t in _terms(text):
                    seen.setdefault(t, [0, 0, 0, 0])[2 * half + y] += 1
            yield pd.DataFrame([(t, *n) for t, n in seen.items()], columns=["term", "a0", "a1", "b0", "b1"])

    rows_of = {(r["half"], r["y"]): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    terms = sample.mapInPandas(split, "term string, a0 long, a1 long, b0 long, b1 long")
    terms = cut(terms.groupBy("term").agg(*(F.sum(k).alias(k) for k in ("a0", "a1", "b0", "b1"))).where(f"a1 + b1 >= {LEAST_ROWS}"))
    whole = _learned(terms, "a0 + b0", "a1 + b1", *(sum(rows_of.get((h, y), 0) for h in (0, 1)) for y in (0, 1)), starter)
    halves = [_learned(terms, f"{k}0", f"{k}1", rows_of.get((h, 0), 0), rows_of.get((h, 1), 0), starter) for h, k in enumerate("ab")]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for grammars in (halves[::-1], [whole, whole]):
                yield pd.DataFrame({"y": pdf["y"], "x": [grammars[h].features(t).tolist() for t, h in zip(pdf["text"], pdf["half"], strict=True)]})

    rows = sample.mapInPandas(measure, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in rows], float)
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), SLOTS)
    w = np.where(y == 1, 1 / rates[1], 1 / rates[0])
    return ToxicityModel(whole, fit_logistic(x, y, w / w.mean(), PRIOR))


def _learned(terms: DataFrame, n0: str, n1: str, rows0: int, rows1: int, starter: dict[str, float]) -> Grammar:
    """The grammar of the terms whose evidence suffices, from their counts in rows of both labels."""
    odds = f"ln((n1 + 0.5) / ({rows1} + 1.0)) - ln((n0 + 0.5) / ({rows0} + 1.0))"
    known = terms.select("term", F.expr(n0).alias("n0"), F.expr(n1).alias("n1")).where(f"n1 >= {LEAST_ROWS}").withColumn("odds", F.expr(odds))
    known = known.withColumn("low", F.expr(f"odds - {SURE} * sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))")).where(f"low >= {LEAST_ODDS}")
    is_phrase = F.instr("term", " ") > 0
    found, threats = (known.where(kind).orderBy(F.desc("low"), "term").limit(LEXICON).collect() for kind in (~is_phrase, is_phrase))
    bar = LEAST_SHARE * max((r["low"] for r in found[:1] + threats[:1]), default=0.0)
    insults = Grammar(starter | {r["term"]: r["low"] / 3 for r in found if r["low"] >= bar})
    # What an insult in it explains is no threat.
    learned = {r["term"]: r["low"] / 3 for r in threats if r["low"] >= bar and not any(map(insults.weight, r["term"].split()))}
    return Grammar(insults.terms | learned)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "score": held.value.score(pdf["text"])})

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def reject_toxic(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below ``threshold``."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(texts), dtype=float)

    return docs.where(score(F.col(text_col)) < threshold)
