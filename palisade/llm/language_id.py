"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built. A text is parsed greedily into
the longest phrases that the sample holds; phrases x log2(sample length) bits are what the text costs in that
language, and the cheapest language wins. All languages and many blocks of text are stepped together through dense
transition tables, in which a step that ends a phrase carries a flag. A language's table has about 2 x sample length x
alphabet cells; where a large alphabet would make it exceed CELLS, the sample is cut shorter.

Texts are case-folded, runs of signs other than letters (Unicode category L) are one blank, and parsed in blocks of
BLOCK letters, each from the start state, so a very long text is read whole in as many steps as a short one.

Defined cases: null texts and texts without a letter (also number-like signs such as a half or a Roman numeral sign)
give "und" with score 0; without labelled training rows every text is "und"; an empty table gives an empty result;
repeated rows give repeated rows and train once; ties go to the first language in order of name; columns besides id,
text and lang are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import small_batches

#: Sample for each language: about SAMPLE_DOCS rows by hash, SAMPLE_CHARS characters from a place in each that the hash
#: draws, FIT_CHARS in all, and table cells.
SAMPLE_DOCS, SAMPLE_CHARS, FIT_CHARS, CELLS = 160, 1_000, 40_000, 1 << 24
BLOCK = 1_024
#: Letters of a batch that are parsed together.
BATCH = 1_000_000
_FLAG = np.int32(1 << 30)
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """Lower-case letters and single blanks."""
    plain = _NOT_LETTERS.sub(" ", text).strip()
    if not plain.isascii() and not plain.replace(" ", "").isalpha():  # numeric signs that are no digits
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split())
    return plain.lower()


def suffix_automaton(text: str) -> tuple[list[dict[str, int]], int]:
    """Transitions of each state; state 0 is the start."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                new = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[cur] = new
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = new
                    p = link[p]
        last = cur
    return nxt, len(text)


def fitting(sample: str) -> str:
    """As much of a sample as CELLS allow."""
    while 2 * len(sample) * (len(set(sample)) + 1) > CELLS:
        sample = sample[: len(sample) * 3 // 4]
    return sample


class CrossParser:
    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.alphabets, tables, self.bases, self.widths, self.bits, base = [], [], [], [], [], 0
        for lang in self.langs:
            sample = fitting(samples[lang])
            letters = np.unique(np.frombuffer(sample.encode("utf-32-le", "surrogatepass"), np.uint32))
            code = {chr(c): k for k, c in enumerate(letters.tolist(), 1)}  # 0: not in the sample
            nxt, n = suffix_automaton(sample)
            width = len(letters) + 1
            row = np.array([0, *(nxt[0][chr(c)] for c in letters.tolist())], np.int32) | _FLAG  # a phrase ends; the letter opens the next one
            table = np.repeat(row[None], len(nxt), 0)
            for state, arrows in enumerate(nxt):
                for c, to in arrows.items():
                    table[state, code[c]] = to
            tables.append(table.ravel())
            self.alphabets.append(letters)
            self.bases.append(base)
            self.widths.append(width)
            self.bits.append(np.log2(max(n, 2)))
            base += table.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """The letters' numbers in each language's alphabet."""
        found, at = np.unique(points, return_inverse=True)
        out = np.zeros((len(self.langs), len(found)), np.int64)
        for row, letters in zip(out, self.alphabets, strict=True):
            k = np.minimum(np.searchsorted(letters, found), max(len(letters) - 1, 0))
            row[:] = np.where(letters[k] == found, k + 1, 0) if len(letters) else 0
        return out[:, at]

    def costs(self, texts: list[str]) -> np.ndarray:
        """Bits of each folded text in each language."""
        joined = "".join(texts)
        codes = self.codes(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
        sizes = np.array([len(t) for t in texts], np.int64)
        n_blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, n_blocks) + within * BLOCK
        size = np.minimum(BLOCK, sizes[owner] - within * BLOCK)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        state = np.zeros((len(self.langs), len(owner)), np.int64)
        base, width = np.array(self.bases, np.int64)[:, None], np.array(self.widths, np.int64)[:, None]
        phrases = np.ones(state.shape, np.int64)
        active = len(owner) - np.searchsorted(size[::-1], np.arange(BLOCK), "right")
        for i in range(int(size[0]) if len(size) else 0):
            k = active[i]
            got = self.table[base + state[:, :k] * width + codes[:, start[:k] + i]]
            phrases[:, :k] += got >> 30
            state[:, :k] = got & (_FLAG - 1)
        out = np.zeros((len(self.langs), len(texts)))
        for row, counts in zip(out, phrases, strict=True):
            np.add.at(row, owner, counts)
        return (out * np.array(self.bits)[:, None]).T

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        todo = [(k, f) for k, t in enumerate(texts) if isinstance(t, str) and (f := folded(t))] if self.langs else []
        at = 0
        while at < len(todo):
            end, letters = at, 0
            while end < len(todo) and (end == at or letters + len(todo[end][1]) <= 4 * BATCH // max(len(self.langs), 4)):
                letters += len(todo[end][1])
                end += 1
            cost = self.costs([f for _, f in todo[at:end]])
            best = cost.argmin(1)
            odds = np.exp2(-np.minimum(cost - cost.min(1, keepdims=True), 500.0) / 4)  # phrases are not independent
            sure = 1 / odds.sum(1)
            for (k, _), b, s in zip(todo[at:end], best.tolist(), sure.tolist(), strict=True):
                langs[k], scores[k] = self.langs[b], s
            at = end
        return langs, scores


def labelled_sample(docs: DataFrame, training: Column, *, id_col: str, text_col: str, lang_col: str, seed: int = 7) -> dict[str, str]:
    """A bounded sample of training text by language: rows are taken by hash at a rate set from the counts."""
    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = docs.where(training & F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()
    if not counts:
        return {}
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r[lang_col], min(1.0, SAMPLE_DOCS / r["count"]))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    picked = rows.where(draw < F.element_at(rate, F.col(lang_col)))
    sample: dict[str, list[str]] = {}
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed + 1)), F.greatest(F.char_length(text_col) - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    texts = picked.select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), place.cast("int"), F.lit(SAMPLE_CHARS)).alias("t"), F.xxhash64(id_col, F.lit(seed)).alias("h"))
    for r in texts.distinct().collect():
        sample.setdefault(r["lang"], []).append((r["h"], r["t"]))
    out = {}
    for lang, found in sample.items():
        seen = dict.fromkeys(folded(t) for _, t in sorted(found))
        text = " ".join(x for x in seen if x)[:FIT_CHARS]
        if text:
            out[lang] = text
    return out


def predict_language(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score) for each row of ``docs``; labels are read only from rows where ``training`` is true."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    parser = docs.sparkSession.sparkContext.broadcast(CrossParser(labelled_sample(docs, training, id_col=id_col, text_col=text_col, lang_col=lang_col)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            langs, scores = parser.value.predict(pdf["text"].tolist())
            yield pd.DataFrame({"id": pdf["id"], "lang_pred": langs, "score": scores})

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
