"""Best-fit packing by bin completion.

Documents become token pieces of at most ``capacity`` ids. Pieces are dealt at random over buckets of a few thousand
(more buckets for more documents), and each bucket is packed by branch and bound: a bin is opened around the largest
piece left, its undominated fillings (of any number of pieces) are tried fullest first, and a branch ends when its
waste exceeds what the best packing known so far allows. The first packing known is best-fit decreasing. The search
stops when it is proven best, or after a number of steps in proportion to the pieces. Three quarters of the steps go to
bin completion of some bins of the best packing at a time (the emptiest, other wasteful ones, any others), which gathers
room in few bins until one falls away.

Defined cases: null text counts as empty (one piece, the end id alone); repeated rows, also without id, are packed
each and dealt apart; very long texts are cut losslessly; equal lengths are placed in order of id, piece and ids; an
empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import bisect
import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import small_batches
from palisade.llm.token_ids import piece_bounds, token_ids

CAPACITY, END_ID = 1024, 2
#: Documents in a bucket, and steps of the search: for each piece of a bucket, and for a bucket of any size.
BUCKET, STEPS, LEAST_STEPS = 4096, 150, 50_000


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths; each length, longest first, goes to the fullest bin that it fits."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for size in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([size])
            left, k = capacity - size, len(bins) - 1
        else:
            left, k = room.pop(at)
            bins[k].append(size)
            left -= size
        bisect.insort(room, (left, k))
    return bins


def _subset_sums(counts: list[int], sizes: list[int], top: int) -> list[int]:
    """For each prefix of the rising sizes, a number whose bit s says that some of its pieces have length s in all."""
    mask, now, out = (1 << (top + 1)) - 1, 1, [1]
    for size in sizes:
        left, k = min(counts[size], top // size), 1
        while left > 0:  # 1, 2, 4, .. copies make any number of copies
            now |= (now << (size * min(k, left))) & mask
            left -= k
            k *= 2
        out.append(now)
    return out


def _dominated(filling: tuple[int, ...], waste: int, free: int) -> bool:
    """Whether a free piece fits in the place of some pieces of the filling, or of none: a bin with that piece leaves
    smaller pieces for later. Bits of ``free`` are the sizes of the pieces outside the filling."""
    single, several = 0, 0
    for s in filling:
        several |= (single << s) | (several << s)
        single |= 1 << s
    reach = several
    for w in range(1, waste + 1):
        reach |= (several | single | 1) << w
    return bool(reach & free)


def fillings(counts: list[int], room: int, most_waste: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of a room, of any number of pieces, fullest first, and of one fullness those with long
    pieces first. They may be very many, so they are found one by one; each step takes 1 from ``budget``, the only stop."""
    sizes = [s for s in range(1, room + 1) if counts[s]]
    budget[0] -= 2 + room // 32
    if not sizes:
        if room <= most_waste:
            yield ()
        return
    present = partners = 0  # bits of the sizes, and of what is left of the room beside each
    for s in sizes:
        present |= 1 << s
        partners |= 1 << (room - s)

    def undominated(filling: tuple[int, ...], waste: int) -> bool:
        budget[0] -= 1 + waste // 8
        free = present
        for s in set(filling):
            if counts[s] == filling.count(s):
                free &= ~(1 << s)
        return not _dominated(filling, waste, free)

    sums: list[int] = []
    for waste in range(min(most_waste, room - 1) + 1):
        budget[0] -= 1
        if budget[0] <= 0:
            return
        target = room - waste
        if counts[target] and undominated((target,), waste):
            yield (target,)
            if not waste:
                return  # it dominates all others
        pairs = present & (partners >> waste)
        while pairs:
            long = pairs.bit_length() - 1
            pairs ^= 1 << long
            if 2 * long < target:
                break
            if counts[long] > (2 * long == target) and undominated((long, target - long), waste):
                yield long, target - long
        if target < 3 * sizes[0]:
            continue
        if not sums:
            budget[0] -= len(sizes) // 2
            sums = _subset_sums(counts, sizes, room)
        if sums[-1] >> target & 1:
            for more in _exact(counts, sizes, sums, target, budget):
                if undominated(more, waste):
                    yield more


def _exact(counts: list[int], sizes: list[int], sums: list[int], target: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """Three pieces or more of exactly that length in all: depth first, longest piece first."""
    chosen: list[int] = []
    at, left = [bisect.bisect_right(sizes, target - 2 * sizes[0]) - 1], [target]
    while at and budget[0] > 0:
        budget[0] -= 1
        if len(chosen) == len(at):  # back from below
            chosen.pop()
        k, rest = at[-1], left[-1]
        if k >= 0 and chosen and chosen[-1] == sizes[k] and chosen.count(sizes[k]) == counts[sizes[k]]:
            k -= 1
        if k < 0 or not sums[k + 1] >> rest & 1:
            at.pop()
            left.pop()
            continue
        size = sizes[k]
        at[-1] = k - 1
        if rest == size:
            if len(chosen) > 1:
                yield (*chosen, size)
        elif rest > size:
            chosen.append(size)
            at.append(bisect.bisect_right(sizes, min(size, rest - size)) - 1)
            left.append(rest - size)


def fewest(lengths: list[int], capacity: int) -> int:
    """A bound from below: for each small size, pieces above the rest of a bin stand alone, pieces over half a bin
    take a bin each, and what the middle pieces exceed their room by needs more bins."""
    counts = np.bincount(np.array(lengths, np.int64), minlength=capacity + 1)[: capacity + 1]
    n, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half, small = capacity // 2, np.arange(1, capacity // 2 + 1)
    alone, wide = n[capacity] - n[capacity - small], n[capacity - small] - n[half]
    spare = wide * capacity - (total[capacity - small] - total[half])
    middle = total[half] - total[small - 1]
    return int(max(-(-total[capacity] // capacity), (alone + wide + np.maximum(0, -(-(middle - spare) // capacity))).max()))


def branch(lengths: list[int], capacity: int, bins: int, budget: list[int]) -> list[list[int]] | None:
    """A packing in at most ``bins`` bins by depth-first bin completion: each bin holds the largest piece left and an
    undominated filling, and a branch ends where the bins' waste exceeds what that many bins allow. None if there is
    none; also when the budget ends (it is then below 1)."""
    counts = np.bincount(np.array(lengths, np.int64), minlength=capacity + 1).tolist()
    order = sorted(set(lengths), reverse=True)
    allowed, placed = bins * capacity - sum(lengths), 0
    stack: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]], int]] = []  # bin, waste before it, others, place in order
    waste = at = 0
    options = None
    while True:
        if options is None:
            if placed == len(lengths):
                return [list(b) for b, *_ in stack]
            while not counts[order[at]]:
                at += 1
            top = order[at]
            counts[top] -= 1  # while its fillings are looked for
            options = fillings(counts, capacity - top, allowed - waste, budget) if waste <= allowed else iter(())
        else:
            counts[top] -= 1
        chosen = next(options, None)
        counts[top] += 1
        if chosen is not None and budget[0] > 0:
            full = (top, *chosen)
            stack.append((full, waste, options, at))
            for s in full:
                counts[s] -= 1
            placed += len(full)
            waste += capacity - sum(full)
            options = None
            continue
        if budget[0] <= 0 or not stack:
            return None
        old, waste, options, at = stack.pop()
        for s in old:
            counts[s] += 1
        placed -= len(old)
        top = order[at]


def complete(lengths: list[int], capacity: int, steps: int = STEPS) -> list[list[int]]:
    """Bins of lengths, as few as the search finds: best-fit, then branch and bound for fewer, then, where the steps
    end before that does, bin completion of some bins of the best packing at a time."""
    if not lengths:
        return []
    best = best_fit_decreasing(lengths, capacity)
    least = fewest(lengths, capacity)
    budget = [steps * len(lengths) + LEAST_STEPS]
    while len(best) > least and budget[0] > 0:
        part = [budget[0] // 4]
        spent = part[0]
        better = branch(lengths, capacity, len(best) - 1, part)
        budget[0] -= spent - part[0]
        if better is None:
            if part[0] > 0:
                return best  # proven
            break
        best = better
    rng, full = random.Random(len(lengths)), [sum(b) for b in best]
    while len(best) > least and budget[0] > 0:
        wasteful = [k for k, x in enumerate(full) if x < capacity]
        n = rng.randint(3, 12)
        some = {full.index(min(full)), *rng.sample(wasteful, min(len(wasteful), n)), *rng.sample(range(len(best)), min(len(best), n))}
        some = sorted(some, reverse=True)
        parts = [s for k in some for s in best[k]]
        local = [min(budget[0], 1_500)]
        spent = local[0]
        new = branch(parts, capacity, len(some) - 1, local) if sum(parts) <= (len(some) - 1) * capacity else None
        if new is None and local[0] > 0:
            new = branch(parts, capacity, len(some), local)
        budget[0] -= spent - local[0] + 100 + len(best) // 4
        # Fewer bins, or as many with the room gathered in fewer of them.
        if new is not None and (len(new) < len(some) or sum(sum(b) ** 2 for b in new) >= sum(full[k] ** 2 for k in some)):
            for k in some:
                best.pop(k)
                full.pop(k)
            best += new
            full += map(sum, new)
    return best


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece."""
    full = lengths == capacity
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    where[full] = np.arange(full.sum())
    rest = np.flatnonzero(~full)
    waiting: dict[int, list[int]] = {}
    for k in rest[::-1].tolist():
        waiting.setdefault(int(lengths[k]), []).append(k)
    for number, sizes in enumerate(complete(lengths[rest].tolist(), capacity), int(full.sum())):
        at = 0
        for s in sizes:
            k = waiting[s].pop()
            where[k], offset[k] = number, at
            at += s
    return where, offset


def pieces(docs: DataFrame, tokenizer: tuple[str, str, str], *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, salt) of every document; the salt tells repeated rows of a task apart."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, at = token_ids(*tokenizer), 0
        for pdf in batches:
            rows = []
            for at, (name, text) in enumerate(zip(pdf["id"].tolist(), pdf["text"], strict=True), at + 1):
                ids = model.encode(text if isinstance(text, str) else "") + end
                rows += [(name, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), at) for k, (s, n) in enumerate(piece_bounds(len(ids) // 4, capacity))]
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "salt"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, salt long").withColumnRenamed("id", id_col)


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`pieces` with sequence_id and offset."""
    found = pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col)
    buckets = -(-max(docs.count(), 1) // BUCKET)
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32", "salt"), F.lit(buckets)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_col, "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        where, offset = place(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=where + (int(pdf["bucket"].iloc[0]) << 32), offset=offset).drop(columns=["bucket", "salt"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("bucket").applyInPandas(run, schema)
