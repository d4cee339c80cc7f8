"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The words of every document run through the automaton, which keeps the longest match that ends at each word. Where
it reaches ``window`` words, a window of some item ends; the state then tells which items hold it. Items are taken in
blocks of bounded size, one automaton for each, built in tasks; a pass holds a few, so the items may outgrow memory.

Defined cases: null texts have no words; items without words, without text or without id are left out; an item
shorter than the window is one window of its own length; repeated items count once by id; repeated documents give
repeated rows; windows that lie on each other count their words once; documents of any length are read whole; an empty
table of documents gives an empty result, one of items no hits; columns besides id and text are ignored by
:func:`contamination` and kept by :func:`decontaminate`, except for a length column, which is set anew.
"""

from __future__ import annotations

import pickle
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import WORD_TABLE, cut, kept, small_batches, unused, utf8, words_of

WINDOW = 10
#: Bytes of item text in one automaton.
BLOCK_BYTES = 1_000_000
#: Automata that a task holds at a time; more are run in later passes over a checkpoint.
RESIDENT = 4


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        owners: dict[int, set[str]] = {}
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for name, codes in coded:
            at = 0
            for c in codes:
                at = self._extend(at, c)
                owners.setdefault(at, set()).add(name)
        self.least = min((min(len(c), window) for _, c in coded), default=window)
        # items whose windows end in a state, from long strings to short ones
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.len[v] >= window and self.len[self.link[v]] >= window:
                owners.setdefault(self.link[v], set()).update(owners.get(v, ()))
        self.full: list[int] = [-1] * len(self.len)  # the state of the last ``window`` words of a longer match
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.len)
        ends: dict[int, set[tuple[int, str]]] = {}
        for name, codes in coded:
            if len(codes) < window:
                v = 0
                for c in codes:
                    v = self.next[v][c]
                ends.setdefault(v, set()).add((len(codes), name))
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            up = self.link[v]
            self.short[v] = self.short[up] + tuple(sorted(ends.get(v, ())))
            self.full[v] = -1 if self.len[v] < window else v if self.len[up] < window else self.full[up]
        self.owners = {v: tuple(sorted(owners[v])) for v in set(self.full) - {-1}}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (start, end exclusive), merged and in order, and the items hit."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if len(words) < self.least or not self.vocab:
            return spans, items
        codes = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        known = np.concatenate([[False], codes >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo >= self.least:
                self._run(codes[lo:hi].tolist(), lo, spans, items)
        return spans, items

    def _run(self, codes: list[int], at: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        nxt, link, length, full, short, window = self.next, self.link, self.len, self.full, self.short, self.window
        v = n = 0
        for i, c in enumerate(codes, at + 1):
            while c not in nxt[v]:
                v = link[v]
                n = length[v]
            v, n = nxt[v][c], n + 1
            size = 0
            if n >= window:
                size = window
                items.update(self.owners[full[v]])
            for k, name in short[v]:
                if k <= n:
                    items.add(name)
                    size = max(size, k)
            if size:
                start = i - size
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))


def built(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame | None, int]:
    """(block, data): pickled automata of about BLOCK_BYTES of item text each, built in tasks; and how many there are."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("id"), benchmark[text_col].alias("text")).where("id is not null and text is not null")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = Automaton([(i, words_of(t)) for i, t in zip(pdf["id"], pdf["text"], strict=True)], window)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "data": [pickle.dumps(made)]})

    if not n:
        return None, 0
    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    return kept(dealt.groupBy("block").applyInPandas(build, "block long, data binary")), n


def with_hits(docs: DataFrame, benchmark: DataFrame, out_col: str, *, clean: bool = False, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Adds a struct of n_words, spans (flat starts and ends in words, merged), items (ids whose windows occur) and,
    with ``clean``, the text without the spans. The automata of one pass are broadcast: RESIDENT at most."""
    small_batches(docs.sparkSession)
    automata, n = built(benchmark, window, item_col, item_text_col)
    rows, group, starts = docs, [], range(0, n, RESIDENT) or [0]
    for k in starts:
        if k:
            rows = cut(rows)
            for old in group:
                old.unpersist()
        held = automata.where((F.col("block") >= k) & (F.col("block") < k + RESIDENT)).collect() if n else []
        group = [docs.sparkSession.sparkContext.broadcast(pickle.loads(r["data"])) for r in held]
        before = F.col(out_col) if k else F.lit(None).cast(_HITS)
        rows = rows.withColumn(out_col, _hits(group, clean and k == starts[-1])(F.col(text_col), before))
    return rows


_HITS = "struct<n_words: long, spans: array<long>, items: array<string>, clean: string>"


def _hits(group: list, clean: bool):
    @F.pandas_udf(_HITS)
    def found(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        n_words, spans, items, out = [], [], [], []
        for text, old, names in zip(texts, before["spans"], before["items"], strict=True):
            words = words_of(text)
            got = [] if old is None else np.asarray(old, np.int64).reshape(-1, 2).tolist()
            hit = set() if names is None else set(names)
            for automaton in group:
                ranges, ids = automaton.value.matches(words)
                got += ranges
                hit |= ids
            n_words.append(len(words))
            spans.append(_merged(got))
            items.append(sorted(hit))
            out.append(None if not clean or not isinstance(text, str) else remove_spans(text, spans[-1]) if spans[-1] else text)
        return pd.DataFrame({"n_words": n_words, "spans": spans, "items": items, "clean": pd.Series(out, dtype=object)})

    return found


def _merged(spans: list) -> list[int]:
    """Flat starts and ends of the union of word ranges."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


_N_HIT = "aggregate(transform({0}.spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (s, x) -> s + x)"


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row."""
    rows = with_hits(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), benchmark, "hits", window=window)
    return rows.select(
        F.col("id").alias(id_col),
        F.col("hits.n_words").alias("n_words"),
        F.expr(_N_HIT.format("hits")).alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.size("hits.spans") > 0).alias("contaminated"),
    )


def remove_spans(text: str, flat: list[int]) -> str:
    """The text without the words of the given ranges and the separators inside each range."""
    data = utf8(text)
    mask = np.frombuffer(data.translate(WORD_TABLE), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in zip(flat[::2], flat[1::2], strict=True):
        out.append(data[at : starts[a]])
        at = ends[b - 1]
    return (b"".join(out) + data[at:]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, max_coverage: float = 0.5, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same columns: hit words are cut out of a text; rows with over ``max_coverage`` of their words hit go."""
    hits = unused("hits", docs.columns)
    rows = with_hits(docs, benchmark, hits, clean=True, window=window, text_col=text_col)
    rows = rows.where(F.expr(_N_HIT.format(hits)) <= F.col(f"{hits}.n_words") * F.lit(max_coverage))
    out = rows.withColumn(text_col, F.col(f"{hits}.clean"))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(docs.columns)
