"""Vector codes: each of several parts of a vector is written as the nearest entry of that part's codebook (ball k-means).

A codebook is improved by rounds of integer k-means. A part lies in the ball of the entry that it had before, at distance d
from its centre. An entry further than 2 d from that centre can't be as near, by the triangle inequality; so the entries
around a centre, ordered by distance, cut its ball into rings, and a part is compared with the entries of its ring alone:
none in the stable core. All comparisons are of integers (4 d^2 with squared distances), so codes are those of a full search.
The codes of earlier rounds are made anew from the codebooks in each pass, which costs little by the same rule: no table is
written, and a lost executor loses nothing. Codebooks (parts x entries vectors) are the only thing that the driver holds.

Defined cases: rows whose vector is null or holds a null or non-finite component are left out; so are vectors of another
length than that of the least id (nulls last). A length that the parts don't divide is filled up with zeros. Fewer vectors
than entries give as many entries. Rows without id are coded like others; repeated rows count as often as they stand and are
repeated in the result; ties go to the lower entry; entries without parts stay. Integers of any size are compared exactly,
errors beyond 64 bits are given as 2^63 - 1. An empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import kept

#: Components up to this size are compared in 64 bits, larger ones as Python integers.
SMALL = 1 << 24
LARGEST = (1 << 63) - 1
#: Sums of labels up to so many rows (of about 40 bytes) are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000

Books = list[np.ndarray]  # of each part: entries x components


def to_integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where all are small, else as Python integers."""
    wide = values.astype(np.float64) * scale
    if not len(wide) or np.abs(wide).max() < SMALL:
        return np.floor(wide).astype(np.int64)
    return np.array([math.floor(x * scale) if abs(x) < 2**50 else int(x) * scale for x in values.astype(np.float64).tolist()], object)


def squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1) if x.shape[-1] else np.zeros(x.shape[:-1], np.int64)


class Balls:
    """The entries of a codebook, and of each the others from near to far."""

    def __init__(self, book: np.ndarray):
        self.book = book
        between = squares(book[:, None] - book[None])
        self.near = np.argsort(between, axis=1, kind="stable")
        self.edges = np.take_along_axis(between, self.near, 1)

    def guess(self, x: np.ndarray) -> np.ndarray:
        """Any entries to begin with: those nearest by floating point."""
        if x.dtype == object or self.book.dtype == object:
            return np.zeros(len(x), np.int64)
        book = self.book.astype(np.float64)
        return np.argmin((book * book).sum(1) - 2 * (x.astype(np.float64) @ book.T), axis=1)

    def assign(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entries (ties to the lower) and squared distances, from the entries that the rows had before."""
        best, index = squares(x - self.book[before]), before.copy()
        order = np.argsort(before, kind="stable")
        starts = np.searchsorted(before[order], np.arange(len(self.book) + 1))
        ring = np.empty(len(x), np.int64)  # entries that lie within twice the distance
        reach = 4 * best
        for j, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            ball = order[lo:hi]
            if not len(ball) or len(self.book) == 1:
                ring[ball] = 1
                continue
            neighbours = int(np.searchsorted(self.edges[j], reach[ball].max(), "right"))  # of the whole ball, by its radius
            ring[ball] = np.searchsorted(self.edges[j, :neighbours], reach[ball], "right")
        rows = np.flatnonzero(ring > 0)
        for k in range(int(ring.max()) if len(ring) else 0):
            rows = rows[ring[rows] > k]
            entry = self.near[before[rows], k]
            d = squares(x[rows] - self.book[entry])
            better = ((d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))).astype(bool)
            at = rows[better]
            best[at], index[at] = d[better], entry[better]
        return index, best


def coded(x: np.ndarray, history: list[list[Balls]]) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances of all parts (rows x parts) under the last of the codebooks."""
    n, parts = x.shape[:2]
    codes, errors = np.zeros((n, parts), np.int64), np.zeros((n, parts), x.dtype)
    for p in range(parts):
        at = history[0][p].guess(x[:, p])
        for balls in history:
            at, d = balls[p].assign(x[:, p], at)
        codes[:, p], errors[:, p] = at, d
    return codes, errors


def sums_by_entry(x: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
    """(part, entry, count, component sums) of the parts of a batch."""
    for p in range(x.shape[1]):
        order = np.argsort(codes[:, p], kind="stable")
        entries, starts, counts = np.unique(codes[order, p], return_index=True, return_counts=True)
        sums = np.add.reduceat(x[order, p], starts, axis=0) if len(order) else []
        for e, c, s in zip(entries.tolist(), counts.tolist(), sums, strict=True):
            yield p, e, c, s.tolist()


def _added(rows: Iterable[tuple[int, int, int, Iterable[int]]], width: int) -> Iterator[pa.RecordBatch]:
    """Counts and sums of each (part, entry), the sums as text since they may pass 64 bits."""
    totals: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for p, e, n, sums in rows:
        have = totals.get((p, e), (0, [0] * width))
        totals[p, e] = have[0] + n, [a + b for a, b in zip(have[1], sums, strict=True)]
    if totals:
        made = [{"part": p, "entry": e, "n": n, "sums": list(map(str, s))} for (p, e), (n, s) in totals.items()]
        yield pa.RecordBatch.from_pylist(made, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]))


def _parts(column: pa.Array, parts: int, width: int, scale: int) -> np.ndarray:
    flat = to_integers(column.flatten().to_numpy(zero_copy_only=False), scale)
    rows = flat.reshape(len(column), len(flat) // max(1, len(column)))
    if rows.shape[1] < parts * width:
        rows = np.concatenate([rows, np.zeros((len(rows), parts * width - rows.shape[1]), rows.dtype)], axis=1)
    return rows.reshape(len(rows), parts, width)


def fit(vectors: DataFrame, *, parts: int, entries: int, rounds: int, scale: int) -> list[Books]:
    """The codebooks before each round and after the last, from (id, vector) rows of finite vectors of one length."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    width = -(-len(first[0][0]) // parts)
    seeds = _parts(pa.array([r[0] for r in first], pa.list_(pa.float64())), parts, width, scale)
    history = [[seeds[:, p] for p in range(parts)]]
    for _ in range(rounds):
        history.append(_next_books(vectors, history, parts, width, scale))
    return history


def _next_books(vectors: DataFrame, history: list[Books], parts: int, width: int, scale: int) -> Books:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [[Balls(b) for b in books] for books in history]
        of = lambda x: sums_by_entry(x, coded(x, balls)[0])
        yield from _added((row for batch in batches for row in of(_parts(batch.column("vector"), parts, width, scale))), width)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added(((r["part"], r["entry"], r["n"], map(int, r["sums"])) for batch in batches for r in batch.to_pylist()), width)

    schema = "part int, entry int, n long, sums array<string>"
    found = vectors.select("vector").mapInArrow(partial, schema).repartition("part", "entry").mapInArrow(total, schema).collect()
    books = [b.tolist() for b in history[-1]]
    for r in found:
        books[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    big = any(abs(c) >= SMALL for book in books for row in book for c in row)
    return [np.array(b, object if big else np.int64).reshape(len(b), width) for b in books]


def fingerprint(books: Books) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for row in book.tolist() for c in row).encode()).hexdigest()


def encode(df: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books]:
    """((id, label, codes, error) of every finite vector, the last codebooks); codes: an entry of each part."""
    rows = df.select(df[id_col].alias("id"), df[label_col].alias("label"), df[vector_col].cast("array<double>").alias("vector"))
    finite = rows.where("vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    least = finite.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    schema = f"id {df.schema[id_col].dataType.simpleString()}, label {df.schema[label_col].dataType.simpleString()}, codes array<int>, error long"
    if least is None:
        return df.sparkSession.createDataFrame([], schema), []
    vectors = finite.where(F.size("vector") == least[0])
    history = fit(vectors, parts=parts, entries=entries, rounds=rounds, scale=scale)
    width = history[0][0].shape[1]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [[Balls(b) for b in books] for books in history]
        for batch in batches:
            codes, errors = coded(_parts(batch.column("vector"), parts, width, scale), balls)
            total = [min(sum(e), LARGEST) for e in errors.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(total, pa.int64())], ["id", "label", "codes", "error"]
            )

    return vectors.mapInArrow(final, schema), history[-1]


def vector_codes(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **how: int) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every finite vector; code: two hex digits for each part."""
    found, books = encode(df, id_col=id_col, vector_col=vector_col, label_col=label_col, **how)
    hexed: Callable = lambda codes: F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    rows = kept(found.select("id", "label", hexed(F.col("codes")).alias("code"), "error"))
    total = F.least(F.sum(F.col("error").cast("decimal(20, 0)")), F.lit(LARGEST)).cast("long")
    sums = rows.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256")
    )
