"""Phrase collocations by prefix-free parsing.

Words whose hash falls on a trigger start chunks; a chunk runs to the next trigger and on over it, by as many words as the
longest phrase needs, so that every phrase stands whole in the chunk that its first word belongs to. Triggers depend on
words alone, so repeated passages parse into the same chunks: the distinct chunks of a language are the dictionary, their
frequencies the parse. Phrases are counted once in each distinct chunk, times its frequency; those that start in the overlap
belong to the next chunk and are left to it.

The dictionary lies in blocks, by a hash of the chunk. Each block sends its distinct word pairs as hashes with weights to
buckets, which return those that reach the least count; hashes that fall together only let more through. Pairs of an overlap
are asked for with no weight, since phrases run into it. A phrase can be frequent only if all its pairs are, so blocks then give exact counts, by text, for the words and for phrases of such pairs.
Hot chunks and phrases are summed before every shuffle; nothing is broadcast or held by the driver.

Defined cases: a null text is empty; a null language is ``und`` (and falls together with a language of that name); pieces
without words give nothing; repeated rows count each; ties have an order to the last byte; texts of any length are read
whole; an empty table, or one without frequent phrases, gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import hash_spans, kept, mix64, packed, small_batches, stretches, unpacked, utf8

#: One word in so many starts a chunk.
TRIGGER = 16
#: Text of a block of the dictionary, and of the pairs that fall in a bucket.
BLOCK_BYTES = 4_000_000
LEAST, MOST_WORDS, TOP = 30, 4, 2000
_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, piece ends as line feeds, tabs as blanks.
TABLE = bytes(0x0A if b in _BREAKS else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BITS = np.uint64(40)


class Words:
    """Words of normalised bytes: places, pieces, and whether each starts a chunk."""

    def __init__(self, data: bytes):
        self.data = b"\n" + data + b"\n"
        flat = np.frombuffer(self.data, np.uint8)
        word = (flat != 0x0A) & (flat != 0x20)
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.starts, self.ends = edge[::2], edge[1::2]
        self.piece = np.cumsum(flat == 0x0A)[self.starts]
        self.hash = hash_spans(flat, self.starts, self.ends)
        self.trigger = self.hash % np.uint64(TRIGGER) == 0


def chunks(texts: list[bytes], overlap: int) -> Iterator[tuple[int, bytes]]:
    """(index of the text, chunk) for all chunks of the texts, in order."""
    w = Words(b"\n".join(texts).translate(TABLE))
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), w.starts - 1, "right")
    if not len(text):
        return
    first = np.flatnonzero(w.trigger | np.concatenate([[True], text[1:] != text[:-1]]))
    last = np.append(first[1:], len(text)) - 1
    end = np.minimum(np.searchsorted(w.piece, w.piece[last], "right"), last + 1 + overlap) - 1
    for k, lo, hi in zip(text[first].tolist(), w.starts[first].tolist(), w.ends[end].tolist(), strict=True):
        yield k, w.data[lo:hi]


def parsed(docs: DataFrame, overlap: int) -> DataFrame:
    """(lang, chunk, n) for the chunks of all texts, summed within stretches of texts."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, langs = [utf8(t) for t in pdf["text"]], pdf["lang"].tolist()
            for lo, hi in stretches(pdf["text"].tolist()):
                seen: dict[tuple[str, bytes], int] = {}
                for k, chunk in chunks(texts[lo:hi], overlap):
                    key = langs[lo + k], chunk
                    seen[key] = seen.get(key, 0) + 1
                yield pd.DataFrame({"lang": [k[0] for k in seen], "chunk": [k[1] for k in seen], "n": list(seen.values())})

    return docs.mapInPandas(parse, "lang string, chunk binary, n long")


class Block:
    """The chunks of one language in a block of the dictionary; words are numbered."""

    def __init__(self, lang: str, chunk: pd.Series, n: pd.Series):
        summed: dict[bytes, int] = {}
        for c, k in zip(chunk, n, strict=True):
            summed[c] = summed.get(c, 0) + k
        w = Words(b"\n".join(summed))
        of = np.searchsorted(np.cumsum([len(c) + 1 for c in summed]), w.starts - 1, "right")
        numbers: dict[bytes, int] = {}
        self.ids = np.array([numbers.setdefault(x, len(numbers)) for x in w.data.split()], np.int64)
        self.words = list(numbers)
        self.weight = np.array(list(summed.values()), np.int64)[of]
        # the first trigger after a chunk's first word begins the overlap
        head = np.concatenate([[True], of[1:] != of[:-1]])
        marks = np.cumsum(w.trigger & ~head)
        self.own = marks == (marks - (w.trigger & ~head))[np.flatnonzero(head)][of - of[0]] if len(of) else head[:0]
        piece = w.piece
        self.room = np.searchsorted(piece, piece, "right") - np.arange(len(piece))  # words to the end of the piece
        a, b = self.pairs()
        salt = mix64(np.array([np.frombuffer(utf8(lang), np.uint8).astype(np.uint64) @ np.arange(1, len(utf8(lang)) + 1, dtype=np.uint64)]))
        self.pair_hash = mix64(mix64(w.hash[a] + salt) + w.hash[b])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first and the second words of pairs within pieces, overlaps included."""
        at = np.flatnonzero(self.room >= 2)
        return at, at + 1

    def counts(self, places: np.ndarray, size: int) -> Iterator[tuple[bytes, int]]:
        """Phrases of ``size`` words that start at the places, with their weights."""
        key, v = self.ids[places], len(self.words)
        for k in range(1, size):
            key = np.unique(key, return_inverse=True)[1] * v + self.ids[places + k]
        _, where, back = np.unique(key, return_index=True, return_inverse=True)
        total = np.zeros(len(where), np.int64)
        np.add.at(total, back, self.weight[places])
        for i, n in zip(places[where].tolist(), total.tolist(), strict=True):
            yield b" ".join([self.words[x] for x in self.ids[i : i + size].tolist()]), n


def blocks_of(pdf: pd.DataFrame) -> Iterator[tuple[str, Block]]:
    for lang, g in pdf.groupby("lang", sort=True):
        yield lang, Block(lang, g["chunk"], g["n"])


def phrase_counts(docs: DataFrame, *, least: int = LEAST, most_words: int = MOST_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, words, phrase, f): exact counts of all words and phrases of up to ``most_words`` words that occur ``least``
    times within pieces, and of all words together as the phrase of 0 words. ``docs`` has lang and text, without nulls."""
    small_batches(docs.sparkSession)
    n = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    rows = parsed(docs, most_words - 1).withColumn("block", F.pmod(F.xxhash64("lang", "chunk"), F.lit(n)))

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, weights = [], []
        for _, b in blocks_of(pdf):
            at = b.pairs()[0]  # pairs of the overlap count elsewhere, but the answer is wanted here too: phrases run into it
            hashes.append(b.pair_hash)
            weights.append(np.where(b.own[at], b.weight[at], 0))
        h, w = np.concatenate(hashes), np.concatenate(weights)
        bucket, low = h % np.uint64(n), h >> (np.uint64(64) - _BITS)
        order = np.lexsort((low, bucket))
        bucket, low, w = bucket[order], low[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1])])) if len(h) else np.zeros(0, np.int64)
        w = np.minimum(np.add.reduceat(w, first), least).astype(np.uint64) if len(h) else w.astype(np.uint64)
        bucket, low = bucket[first], low[first]
        edge = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(h) else np.zeros(1, np.int64)
        return pd.DataFrame({
            "bucket": bucket[edge[:-1]].astype(np.int64), "block": int(pdf["block"].iloc[0]),
            "data": [packed(low[a:b], w[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)],
        })

    def frequent(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [unpacked(d) for d in pdf["data"]]
        low, w = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        values, back = np.unique(low, return_inverse=True)
        total = np.zeros(len(values), np.uint64)
        np.add.at(total, back, w)
        good = (total >= least)[back]
        ends = np.cumsum([len(g[0]) for g in got])
        data = [packed(g[0][good[e - len(g[0]) : e]]) for g, e in zip(got, ends.tolist(), strict=True)]
        return pd.DataFrame({"bucket": pdf["bucket"], "block": pdf["block"], "data": data})

    def count(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        known = [(unpacked(d)[0], k) for k, d in zip(told["bucket"], told["data"], strict=True)]
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[mix64(low + (np.uint64(k) << _BITS)) for low, k in known]]))
        out: list[tuple[str, int, bytes, int]] = []
        for lang, b in blocks_of(pdf) if len(pdf) else ():
            own = np.flatnonzero(b.own)
            out.append((lang, 0, b"", int(b.weight[own].sum())))
            out += [(lang, 1, p, k) for p, k in b.counts(own, 1)]
            good = np.zeros(len(b.ids) + most_words, bool)
            mine = mix64((b.pair_hash >> (np.uint64(64) - _BITS)) + (b.pair_hash % np.uint64(n) << _BITS))
            at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
            good[b.pairs()[0]] = keys[at] == mine if len(keys) else False
            for size in range(2, most_words + 1):
                own = own[(b.room[own] >= size) & good[own + size - 2]]
                out += [(lang, size, p, k) for p, k in b.counts(own, size)]
        return pd.DataFrame(out, columns=["lang", "words", "phrase", "f"])

    sent = rows.groupBy("block").applyInPandas(send, "bucket long, block long, data binary")
    told = sent.groupBy("bucket").applyInPandas(frequent, "bucket long, block long, data binary")
    found = rows.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(count, "lang string, words int, phrase binary, f long")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(f"words = 0 or f >= {int(least)}").withColumn("phrase", F.col("phrase").cast("string"))


def collocations(docs: DataFrame, *, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, inside: int = 80, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score). A phrase goes if a longer one that holds
    it has ``inside`` percent of its count."""
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    counts = kept(phrase_counts(texts, least=least, most_words=most_words, block_bytes=block_bytes))
    f = counts.where("words > 0").select("lang", "phrase", "f")
    words = counts.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = words.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail")
    )
    both = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    parts = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = words.where("size(w) > 2").select("lang", F.explode(parts).alias("part"), "a").groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("most"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.expr(f"most is null or cast(most as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {int(inside)}"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
