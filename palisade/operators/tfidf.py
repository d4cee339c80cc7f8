"""TF-IDF of texts: a vocabulary from totals that tasks sum, then each text's weights in one pass, as arrays or rows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What SQL takes as words.
WORD = r"[\p{L}\p{N}_]{2,}"
#: Common English words that are left out of word terms.
STOP = tuple(
    """the of and to in a is that it for on was be with as this by are at from or an not have has had but they you he she we his her their its our my your me him them us who whom which what when where why how
    all any both each few more most other some such no nor only own same so than too very can will just should now do does did doing am were been being having if because until while about against between into through
    during before after above below up down out off over under again further then once here there also may might must would could shall""".split()
)


_STOP = frozenset(STOP)
#: Word terms that a task sums before it hands them on.
HELD = 300_000


@dataclass(frozen=True)
class Cut:
    """Terms of a kind, and the column that tasks cut them from: lower case, words between blanks."""

    kind: str
    text: Column


def word_terms(text: Column) -> Cut:
    """Words of two letters, digits or underscores and more in any script, without stop words, and pairs of neighbours
    among what is left."""
    return Cut("word", F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def char_terms(text: Column) -> Cut:
    """Character n-grams inside words (all between blanks, with signs) that are padded with a blank on both sides."""
    return Cut("char", F.regexp_replace(F.lower(text), r"\s+", " "))


def pieces(word: str, low: int = 3, high: int = 5) -> list[str]:
    """Pieces of ``low`` to ``high`` characters of a padded word; shorter words give none."""
    p = f" {word} "
    return [p[i : i + n] for n in range(low, high + 1) for i in range(len(p) - n + 1)]


#: Bits of a sign in a key; five signs fit in 60. Characters of texts that are counted together.
BITS, TOGETHER = 12, 2_000_000


class Alphabet:
    """Numbers of the signs of some texts, blank first, and with them keys of pieces: the same for equal pieces only."""

    def __init__(self, signs: np.ndarray):
        self.signs = np.concatenate([[0, 32], np.setdiff1d(signs, [32])]).astype(np.uint32)
        self.fits = len(self.signs) <= 1 << BITS
        self.number = np.zeros(0x110000, np.int64)
        self.number[self.signs[1:]] = np.arange(1, len(self.signs))  # 0: a sign that the alphabet lacks

    def keys(self, text: str) -> np.ndarray:
        """Of all pieces of 3 to 5 signs of a text's padded words: windows with no blank inside."""
        at = self.number[_signs(f" {text} ")]
        inside = at[1:-1] > 1
        known = at > 0
        out, key, free = [], at[:-1] << BITS | at[1:], known[:-1] & known[1:]
        for n in range(3, 6):
            if len(at) < n:
                break
            key, free = key[:-1] << BITS | at[n - 1 :], free[:-1] & known[n - 1 :] & inside[n - 3 :]
            out.append(key[free])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def pieces(self, keys: np.ndarray) -> list[str]:
        """Of sorted keys."""
        out = []
        for n in range(3, 6):
            some = keys[(keys >= 1 << BITS * (n - 1)) & (keys < 1 << BITS * n)]
            signs = self.signs[np.stack([some >> BITS * (n - 1 - j) & (1 << BITS) - 1 for j in range(n)], axis=1)]
            text = signs.astype("<u4").tobytes().decode("utf-32-le")
            out += [text[i : i + n] for i in range(0, len(text), n)]
        return out


def _signs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(starts, append=len(keys))


def char_totals(texts: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """(terms, counts, counts of texts) of character pieces, for some texts at a time."""
    ends = np.cumsum([len(t) for t in texts]) // TOGETHER
    for part in (np.flatnonzero(ends == e) for e in np.unique(ends)):
        some = [texts[i] for i in part.tolist()]
        alphabet = Alphabet(np.flatnonzero(np.bincount(_signs("".join(some)), minlength=1)))
        if alphabet.fits:
            found = [_each(alphabet.keys(t)) for t in some]
            keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(keys, kind="stable")
            each, df = _each(keys)
            yield alphabet.pieces(each), (np.add.reduceat(counts[order], np.cumsum(df) - df) if len(each) else df).tolist(), df.tolist()
        else:
            terms, tf, df = Terms("char"), Counter(), Counter()
            for t in some:
                got = terms.counts(t)
                df.update(got.keys())
                for term, n in got.items():
                    tf[term] += n
            yield list(tf), list(tf.values()), [df[t] for t in tf]


class Terms:
    """Cuts texts of one kind into terms, as places of a vocabulary if there is one."""

    def __init__(self, kind: str, places: dict[str, int] | None = None):
        self.kind, self.places, self.alphabet = kind, places, None
        if kind == "char" and places:
            alphabet = Alphabet(np.unique(_signs("".join(places))))
            if alphabet.fits:
                keys = np.array([int(sum(int(x) << BITS * (len(t) - 1 - j) for j, x in enumerate(alphabet.number[_signs(t)]))) for t in places], np.int64)
                order = np.argsort(keys)
                self.alphabet, self.keys, self.at = alphabet, keys[order], np.array(list(places.values()), np.int32)[order]

    def units(self, text: str) -> list[str]:
        if self.kind == "char":
            return [p for w in text.split(" ") if w for p in pieces(w)]
        words = [w for w in text.split(" ") if len(w) > 1 and w not in _STOP]
        return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]

    def counts(self, text: str) -> dict:
        """Counts of a text's terms."""
        found = Counter(self.units(text))
        return found if self.places is None else {self.places[t]: n for t, n in found.items() if t in self.places}

    def arrays(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted places of a text's terms and their counts."""
        if self.alphabet is None:
            found = self.counts(text)
            at = np.array(sorted(found), np.int32)
            return at, np.array([found[i] for i in at.tolist()], np.int64)
        keys = self.alphabet.keys(text)
        near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        n = np.bincount(self.at[near[self.keys[near] == keys]], minlength=1)
        at = np.flatnonzero(n)
        return at.astype(np.int32), n[at]


def fit_vocabulary(docs: DataFrame, cut: Cut, n_docs: int, size: int) -> list[tuple[str, float]]:
    """(term, idf) of the ``size`` most frequent terms, in order of name; ties go to the lesser term. Tasks sum what they read,
    so totals are shuffled and no text's terms are."""

    kind = cut.kind

    def some(terms: list[str], tf: list[int], df: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(tf, pa.int64()), pa.array(df, pa.int64())], ["term", "tf", "df"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, tf, df = Terms(kind), Counter(), Counter()
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t is not None]
            if kind == "char":
                yield from (some(*x) for x in char_totals(texts))
                continue
            for text in texts:
                found = terms.units(text)
                tf.update(found)
                df.update(set(found))
                if len(tf) > HELD:
                    yield some(list(tf), list(tf.values()), [df[t] for t in tf])
                    tf.clear()
                    df.clear()
        yield some(list(tf), list(tf.values()), [df[t] for t in tf])

    counted = docs.select(cut.text.alias("t")).mapInArrow(totals, "term string, tf long, df long")
    kept = counted.groupBy("term").agg(F.sum("tf").alias("total"), F.sum("df").alias("df")).orderBy(F.desc("total"), "term").limit(size)
    return sorted((r["term"], math.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0) for r in kept.collect())  # its size is a parameter


def weights(cut: Cut, vocabulary: list[tuple[str, float]]) -> Column:
    """(place, weight) of a text's terms by place, as two arrays: sublinear term frequency x idf, unit length. A null text has none."""
    kind, places, idf = cut.kind, {t: i for i, (t, _) in enumerate(vocabulary)}, np.array([w for _, w in vocabulary], np.float64)
    schema = pa.struct([("place", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64()))])

    @F.arrow_udf("place array<int>, weight array<double>")
    def weighed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = Terms(kind, places)
        for texts in batches:
            at, w = [], []
            for text in texts.to_pylist():
                p, n = terms.arrays(text or "")
                x = (np.log(n) + 1.0) * idf[p]
                at.append(p)
                w.append(x / np.sqrt((x * x).sum()) if len(p) else x)
            yield pa.StructArray.from_arrays([pa.array(at, schema[0].type), pa.array(w, schema[1].type)], fields=list(schema))

    return weighed(cut.text)


def counted(cut: Cut, vocabulary: list[tuple[str, float]]) -> Column:
    """Places and counts of a text's terms as few bytes, from which :func:`weighed` makes what :func:`weights` makes of the text."""
    kind, places = cut.kind, {t: i for i, (t, _) in enumerate(vocabulary)}

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = Terms(kind, places)
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                p, n = terms.arrays(text or "")
                out.append(len(p).to_bytes(4, "little") + pa.compress(np.concatenate([np.diff(p, prepend=0), n]).astype(np.int32).tobytes(), codec="zstd", asbytes=True))
            yield pa.array(out, pa.binary())

    return packed(cut.text)


def weighed(counts: Column, vocabulary: list[tuple[str, float]]) -> Column:
    """(place, weight) as :func:`weights` has them, from :func:`counted`."""
    idf = np.array([w for _, w in vocabulary], np.float64)
    schema = pa.struct([("place", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64()))])

    @F.arrow_udf("place array<int>, weight array<double>")
    def opened(packed: pa.Array) -> pa.Array:
        sizes, at, w = [0], [], []
        for data in packed.to_pylist():
            size = int.from_bytes(data[:4], "little")
            both = np.frombuffer(pa.decompress(data[4:], size * 8, "zstd"), np.int32)
            p, n = np.cumsum(both[:size], dtype=np.int32), both[size:]
            x = (np.log(n) + 1.0) * idf[p]
            sizes.append(size)
            at.append(p)
            w.append(x / np.sqrt((x * x).sum()) if size else x)
        ends = pa.array(np.cumsum(sizes), pa.int32())
        made = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, kind), *some]))) for some, kind in ((at, np.int32), (w, np.float64))]
        return pa.StructArray.from_arrays(made, fields=list(schema))

    return opened(counts)


def weigh(docs: DataFrame, cut: Cut, vocabulary: list[tuple[str, float]], id_col: str = "doc_id") -> DataFrame:
    """(id, term, weight) of all texts under a vocabulary."""
    names = F.broadcast(docs.sparkSession.createDataFrame([(i, t) for i, (t, _) in enumerate(vocabulary)], "place int, term string"))
    rows = docs.select(id_col, weights(cut, vocabulary).alias("w")).select(id_col, F.explode(F.arrays_zip("w.place", "w.weight")).alias("w"))
    return rows.select(id_col, F.col("w.place").alias("place"), F.col("w.weight").alias("weight")).join(names, "place").select(id_col, "term", "weight")


def tfidf(docs: DataFrame, cut: Cut, size: int, id_col: str = "doc_id") -> DataFrame:
    return weigh(docs, cut, fit_vocabulary(docs, cut, docs.count(), size), id_col)


def scale_numeric(df: DataFrame, columns: list[str], keep: tuple[str | Column, ...] = ("message_id",)) -> DataFrame:
    """``keep`` and z-scores by population deviation; a constant column is only centred. The statistics are one row."""
    stats = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = [((F.col(c) - F.lit(stats[f"{c}_m"])) / F.lit(stats[f"{c}_s"] or 1.0)).alias(c) for c in columns]
    return df.select(*keep, *z)
