"""Secret scan: fixed patterns, and values in credential context whose guessing would be costly.

A value that follows a credential word ("passphrase is ...", "auth: ...") is cut into words, dates, repeats, keyboard
walks and brute-force spans so that the guesses needed are fewest (dynamic programming over cut points); it is a
secret when even that cheapest way takes ``min_cost`` powers of ten. A value is the whole run of signs, however long.
The patterns' own spans are always kept; a guessed value that reaches beyond one has its span besides. Values of letters
alone (also with hyphens and apostrophes between them) are prose: they are secrets only from PROSE letters on, and never
after "is", "was" or "bearer" and a blank, but for headers ("Authorization: Bearer ..."). Signs beyond ASCII count too,
in values that have a digit or another sign as well.

Defined cases: null text counts as empty (no spans); an empty table gives an empty result; repeated rows give repeated
rows; texts of any length are scanned whole; spans that begin together stand in order of kind; of equal costs any
segmentation gives the same span; columns besides id and text are ignored by :func:`secret_spans` and kept by
:func:`redact`, except for a length column, which is set anew.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import small_batches

#: Order of kinds that begin at the same place.
KINDS = ("assign", "access", "hex", "guess")
#: Powers of ten of guesses from which a value in credential context is a secret.
MIN_COST = 10.0
#: Letters of a value of letters alone from which it is no prose.
PROSE = 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal: the same as [0-9a-f]+ of 16 or more
_CUES = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login", "pin")
_CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth(?:orization)?|bearer|login|pin)(?:["']?\x20*(?:[:=]+|->|=>)\x20*["'`]?bearer\x20+|["']?\x20*(?:[:=]+|->|=>)\x20*|\x20+(?:is|was)\x20+|(?<=bearer)\x20+(?!["'`]?[a-z]+(?:['-][a-z]+)*[^\sa-z0-9]*(?:\s|\Z)))["'`]?([^\x00-\x20\x7f-\xa0\u2000-\u200b\u2028\u2029\u3000]{8,})""",
    re.I | re.A,
)

_LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")

_WORDS = """the be to of and in that have it for not on with he as you do at this but his by from they we say her she
or an will my one all would there their what so up out if about who get which go me when make can like time no just him
know take people into year your good some could them see other than then now look only come its over think also back
after use two how our work first well way even new want because any these give day most us password pass admin user
login welcome master dragon monkey letmein shadow sunshine princess football baseball secret love hello summer winter
spring autumn monday friday test guest root default changeme example""".split()
_RANK = {w: math.log10(k + 2) for k, w in enumerate(_WORDS)}
_LONGEST = max(map(len, _WORDS))
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)?\d\d)")


_AT = {c: (y, x) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}


def _direction(a: str, b: str) -> tuple[int, int] | int | None:
    """The way from a key to a neighbour, or up or down the alphabet or digits; None for other steps."""
    if a in _AT and b in _AT:
        (y, x), (v, u) = _AT[a], _AT[b]
        if a != b and abs(v - y) <= 1 and abs(u - x) <= 1:
            return v - y, u - x
    step = ord(b) - ord(a)
    return step if abs(step) == 1 and a.isalnum() and b.isalnum() else None


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def guess_cost(value: str, limit: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation; 0 for an empty value. Exact below ``limit``; dearer values
    may give any cost from ``limit`` on, and are left as soon as every way is that dear."""
    n, low = len(value), value.lower()
    best = [0.0] + [math.inf] * n
    reach = 0  # the furthest end of a way below the limit
    bounded = limit < math.inf
    sizes = max(1, min(n // 2, int(limit))) if bounded else n // 2  # a sign costs 1 at least
    near = int(8 * limit) if bounded else n
    since = [0] * (max(sizes, 1) + 1)  # where the stretch of each period began that goes on here
    for i in range(n):
        if i > reach:
            return limit
        for size in range(1, sizes + 1) if bounded and i else ():
            if i - 1 + size >= n or value[i - 1] != value[i - 1 + size]:
                since[size] = i
        here = best[i]
        if here >= limit:
            continue
        step = 0.3 if i else 0.0  # a guesser also tries how segments follow each other

        def offer(j: int, cost: float, at: float = here + step) -> None:
            nonlocal reach
            if at + cost < best[j]:
                best[j] = at + cost
                if j > reach and best[j] < limit:
                    reach = j

        offer(i + 1, _brute(value[i]), here)
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            rank = _RANK.get(low[i:j])
            if rank is not None:
                offer(j, rank + (0 if value[i:j] == low[i:j] else 0.3 if value[i + 1 : j] == low[i + 1 : j] else 0.05 * (j - i) + 0.3))
        date = _DATE.match(value, i)
        if date:
            offer(date.end(), math.log10(365 * 120) if date.end() - i > 4 else math.log10(120))
        # Far into a stretch some repeat is under way: to carry it on is cheaper than to begin another.
        j = i + 1
        while i - since[1] <= near and j < n and value[j] == value[i]:
            j += 1
            if j - i >= 3:
                offer(j, _brute(value[i]) + math.log10(j - i))
        for size in range(2, min((n - i) // 2, sizes) + 1):
            if i - since[size] > near:
                continue
            block, j = value[i : i + size], i + size
            while value.startswith(block, j):
                j += size
                offer(j, sum(map(_brute, block)) + math.log10((j - i) // size))
        j, turns, way = i + 1, 0, None
        while j < n and (now := _direction(low[j - 1], low[j])) is not None:
            turns, way, j = turns + (now != way), now, j + 1
            if j - i >= 3:
                offer(j, math.log10(47) + math.log10(j - i) + 0.6 * min(turns, (j - i) // 2 + 1))
            if 0.6 * min(turns, (j - i) // 2 + 1) >= limit:
                break
    return best[n]


def scan(text: str, min_cost: float = MIN_COST) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    found = []
    low = text.lower()
    if any(c in low for c in _CUES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        held = [(s, e) for s, e, _ in found]
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip("\"'`.,;:!?)]}>’”»。，、！？")
            start, end = m.start(1), m.start(1) + len(value)
            quote = text[start - 1] if text[start - 1] in "\"'`" else None
            said = text[m.start() : start].rstrip("\"'`")
            if _LETTERS.fullmatch(value) and (len(value) < PROSE or said.lower().endswith(("is ", "was "))) and not said[:-1].rstrip().lower().endswith("bearer"):
                continue
            inside = any(s <= start < e and (end <= e or quote and text[e] == quote) for s, e in held)
            if len(value) >= 8 and not inside and guess_cost(value, min_cost) >= min_cost:
                found.append((start, end, "guess"))
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_spans(docs: DataFrame, *, min_cost: float = MIN_COST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_guess) for each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                spans = scan(text, min_cost) if isinstance(text, str) else []
                n = {k: sum(x[2] == k for x in spans) for k in KINDS} if spans else dict.fromkeys(KINDS, 0)
                base = hashlib.sha256(_joined([x for x in spans if x[2] != "guess"]).encode()).hexdigest()
                rows.append((n["assign"], n["access"], n["hex"], base, _joined(spans), n["guess"]))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)


def cover(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at, end = [], 0, -1
    for start, stop, kind in spans:
        if start >= end:
            out += [text[at:start], f"[{kind} removed]"]
        end = max(end, stop)
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, *, min_cost: float = MIN_COST, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced by marks; null texts stay null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([cover(x, scan(x, min_cost)) if isinstance(x, str) else None for x in texts], dtype=object)

    out = docs.withColumn(text_col, masked(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(docs.columns)
