"""Packed token output: best-fit-decreasing packing with a segment tree over capacities.

Documents are tokenised, closed with an end id and, if longer than a sequence, cut losslessly. Pieces are dealt at
random over buckets (more for more documents); in each bucket they are placed longest first into the open sequence
with the least room that fits, found by a descent in a segment tree. Each sequence is one row of a packed id matrix:
its ids as little-endian integers padded to ``capacity``, the cumulative segment lengths (as attention kernels take
them) and the places where positions start again from 0.

Defined cases: null text counts as empty (the end id alone); repeated rows are packed each; an empty table gives an
empty result; ties go to the lower document id and piece; columns besides id and text are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import small_batches
from palisade.llm.token_ids import piece_bounds, token_ids

CAPACITY, END_ID, PAD_ID = 1024, 2, 0
BUCKET = 1024


class CapacityTree:
    """Open sequences by room left; finds the least room of at least a size in log2(capacity) steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room >= size, taken out; None if there is none."""
        node = self.leaves + size
        while not self.count[node]:
            while node & 1:  # a right child: go up until there is a sibling to the right
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences."""
    tree, n = CapacityTree(capacity), 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        found = tree.take(size)
        if found is None:
            found, n = (capacity, n), n + 1
        room, seq = found
        where[k], offset[k] = seq, capacity - room
        tree.put(room - size, seq)
    return where, offset, n


def packed_ids(docs: DataFrame, tokenizer: tuple[str, str, str], *, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = PAD_ID, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids (binary), cu_seqlens, position_resets, doc_ids, pieces."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end, dtype = struct.pack("<I", end_id), f"<u{id_bytes}"
    buckets = -(-max(docs.count(), 1) // BUCKET)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, at = token_ids(*tokenizer), 0
        for pdf in batches:
            rows = []
            for at, (name, text) in enumerate(zip(pdf["id"].tolist(), pdf["text"], strict=True), at + 1):
                ids = np.frombuffer(model.encode(text if isinstance(text, str) else "") + end, "<u4")
                if int(ids.max()) >> (8 * id_bytes):
                    raise ValueError(f"an id needs more than {id_bytes} bytes")
                small = ids.astype(dtype)
                rows += [(name, k, n, small[s : s + n].tobytes(), at) for k, (s, n) in enumerate(piece_bounds(len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["id", "piece", "length", "ids", "salt"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece", "ids"], kind="stable")
        where, offset, n = best_fit(pdf["length"].to_numpy(), capacity)
        order = np.lexsort((offset, where))
        edge = np.searchsorted(where[order], np.arange(n + 1))
        ids, names, numbers, sizes = (pdf[c].to_numpy()[order] for c in ("ids", "id", "piece", "length"))
        pad, rows = np.array([pad_id], dtype).tobytes(), []
        for k, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
            ends = np.cumsum(sizes[a:b]).tolist()
            rows.append(((int(pdf["bucket"].iloc[0]) << 32) + k, ends[-1], b"".join(ids[a:b]) + pad * (capacity - ends[-1]), [0, *ends], [0, *ends[:-1]], names[a:b].tolist(), numbers[a:b].tolist()))
        return pd.DataFrame(rows, columns=["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "pieces"])

    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInPandas(cut, f"id {kind}, piece int, length long, ids binary, salt long")
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "salt"), F.lit(buckets)))  # the salt parts repeated rows
    schema = f"sequence_id long, n_tokens long, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, pieces array<int>"
    return dealt.groupBy("bucket").applyInPandas(fill, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed matrix as Parquet files; a reader stacks the ids of a row group into one matrix without a copy."""
    packed.write.mode("overwrite").parquet(path)
