"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie as ragged numpy arrays (one flat symbol array, one array of sequence numbers). In every
round each sequence merges its lowest-rank adjacent pair, all sequences at once, until no pair has a rank; what
survives is counted. The vocabulary file's library is used by the tests only.

Defined cases: null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result; repeated rows
give repeated rows; a word of any length is merged whole; special strings inside a text count one token each, as the
library's default does; columns besides id and text are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from palisade.llm.common import small_batches

#: Distinct pre-tokens kept per Python worker; beyond it the memory of counts starts anew.
CACHE_WORDS = 400_000
_NONE = np.int32(2**31 - 1)


class RankMerger:
    """Counts the tokens of a lower-casing byte-level BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), np.array(made, np.int64)
        self._check_order(np.array(left), np.array(right))
        split = [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(_as_the_library(split), regex.V1)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or "(?!)")
        self.cache: dict[str, int] = {}

    def _check_order(self, left: np.ndarray, right: np.ndarray) -> None:
        """Merging every occurrence of the lowest-rank pair at once is exact only if no merge uses a symbol that a
        later merge makes; where that fails, one occurrence is merged in a round."""
        last_made = np.full(int(max(self.made.max(), left.max(), right.max())) + 1, -1)
        np.maximum.at(last_made, self.made, np.arange(len(self.made)))
        at = np.arange(len(left))
        self.ordered = bool(((last_made[left] < at) & (last_made[right] < at)).all())

    def _rank(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        key = sym[:-1] << 32 | sym[1:]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word; all words are non-empty."""
        sizes = np.array([len(w) for w in words], np.int64)
        counts = np.zeros(len(words), np.int64)
        if not len(words):
            return counts
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym, seq = self.inner[flat], np.repeat(np.arange(len(words)), sizes)
        last = np.cumsum(sizes) - 1
        sym[last] = self.final[flat[last]]
        while len(sym):
            rank = np.append(self._rank(sym, seq), _NONE)
            start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(sym)))
            done = low == _NONE
            counts[seq[start[done]]] = length[done]
            hit = np.flatnonzero((rank == np.repeat(low, length)) & (rank != _NONE))
            if self.ordered:
                # occurrences may overlap only in runs of one symbol: every second of a run is taken
                new_run = np.append(True, np.diff(hit) != 1) if len(hit) else np.zeros(0, bool)
                run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run_at) % 2 == 0]
            else:  # only the leftmost of each sequence
                hit = hit[np.append(True, seq[hit][1:] != seq[hit][:-1])] if len(hit) else hit
            sym[hit] = self.made[rank[hit]]
            keep = ~np.repeat(done, length)
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        return counts

    def _learn(self, chunks: set[str]) -> None:
        """Counts of white-space free chunks: all their pre-tokens are merged together."""
        todo = list(chunks)
        for at in range(0, len(todo), 50_000):
            part, words, owner = todo[at : at + 50_000], [], []
            for k, chunk in enumerate(part):
                for piece in self.pattern.findall(chunk):
                    words.append(piece.encode("utf-8", "surrogatepass"))
                    owner.append(k)
            got = np.bincount(owner, self.merge(words), len(part)) if words else np.zeros(len(part))
            self.cache.update(zip(part, got.astype(int).tolist(), strict=True))

    def chunks(self, text: str) -> list[str]:
        """Normalised text in pieces that no pre-token crosses."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.translate(_LATER).lower() if _ODD.search(text) else text.lower()
        return _SPACE.split(text) if _CONTROL.search(text) else text.split()

    def count(self, texts: list[str]) -> list[int]:
        rows, new, out = [], set(), []
        for text in texts:
            parts = self.special.split(text) if "<" in text else [text]
            found = [x for part in parts for x in self.chunks(part)]
            rows.append((len(parts) - 1, found))
            new.update(set(found).difference(self.cache))
            if len(new) > CACHE_WORDS // 8:
                out += self._counted(rows, new)
                rows, new = [], set()
        return out + self._counted(rows, new)

    def _counted(self, rows: list[tuple[int, list[str]]], new: set[str]) -> list[int]:
        known = self.cache
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = {x for _, found in rows for x in found}
        self._learn(new)
        return [specials + sum(map(known.__getitem__, found)) for specials, found in rows]

#: Lower case where str.lower() looks at neighbours or knows no such letter yet.
_LATER = {0x03A3: 0x03C3, 0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
_LATER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_ODD = re.compile("[" + "".join(map(chr, _LATER)) + "]")
#: Ranges of letters, then of numbers, that the library's tables do not have yet.
_UNKNOWN = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A-11B0A 11DB0-11DDB 11DF1-11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
    "11DE0-11DE9 1246F-1246F 12475-1247F 12550-12686 16FF4-16FF6"
)


def _as_the_library(pattern: str) -> str:
    """The pre-tokeniser's pattern with what the library takes for letters and numbers."""
    unknown = "[" + "".join(f"\\U{int(a, 16):08X}-\\U{int(b, 16):08X}" for a, b in (r.split("-") for r in _UNKNOWN.split())) + "]"
    other = r"[^\s\p{L}\p{N}]"
    parts = [part.replace(r"[\p{L}]", rf"[\p{{L}}--{unknown}]").replace(r"[\p{N}]", rf"[\p{{N}}--{unknown}]") for part in pattern.split(other)]
    return f"[{other}||{unknown}]".join(parts)


#: White space of the pre-tokeniser's pattern; str.split() would also split at four control characters.
_SPACE = regex.compile(r"[\t-\r \x85\p{Z}]+")
_CONTROL = re.compile("[\x1c-\x1f]")


def _byte_chars() -> list[str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


_LOADED: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    if path not in _LOADED:
        _LOADED[path] = RankMerger(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, vocab_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row; ``vocab_path`` is a file that every executor has."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = merger(vocab_path)
        for pdf in batches:
            texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
            counts = model.count(texts)
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts], "n_tokens": counts, "over_limit": [c > limit for c in counts]})

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
