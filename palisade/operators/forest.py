"""Decision trees and random forests over sparse vectors, grown level by level.

Spark's own trees hold an int for every feature of every row, and a dense table of all features for every node that a task
looks at; with thousands of sparse features that is far more than the vectors themselves. Here rows are kept as blocks of the
bins of their entries, only entries away from a feature's zero bin are counted, and counts of nodes meet by node.

A tree is the one that Spark's ``DecisionTreeClassifier`` finds: same candidate thresholds (up to 10,000 rows; beyond that both
take a sample of about max(10,000, maxBins squared) rows), Gini gain, order of ties, leaves and pruning. A forest draws for each
row and tree how often it counts (Poisson, mean 1) from a hash of the row's id, and for each node its features from a hash of
tree and node, so a forest does not depend on how rows lie in partitions.

Defined cases: labels are 0, 1, ... (0 if null); an entry that a vector lacks is 0; a constant feature is never split; rows that
come twice count twice; an empty table gives one leaf without a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from palisade.operators.serving import Stored, _param

#: Rows of a block; entries that a task counts before it passes them on, and about as many meet in a task; cells that are looked
#: at together; drawn features of the nodes of a pass; groups of features whose thresholds are found together.
BLOCK, HELD, CELLS, DRAWN, GROUPS = 2_048, 3_000_000, 4_000_000, 8_000_000, 32
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])
_EPSILON = 2.220446049250313e-16


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _entries(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the entries of vectors, by row."""
    kind = column.field("type").to_numpy(zero_copy_only=False)
    values = column.field("values")
    n = np.diff(values.offsets.to_numpy())
    at, flat = np.repeat(np.arange(len(column)), n), values.flatten().to_numpy(zero_copy_only=False)
    if (kind == 1).all():
        return at, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), flat
    if (kind == 0).all():
        return at, column.field("indices").flatten().to_numpy(zero_copy_only=False).astype(np.int64), flat
    parts = [(i, _entries(column.slice(i, 1))) for i in range(len(column))]
    return np.repeat([i for i, _ in parts], [len(p[1]) for _, p in parts]), np.concatenate([p[1] for _, p in parts]), np.concatenate([p[2] for _, p in parts])


def _vectors(column: pa.Array) -> pa.StructArray:
    return column.storage if isinstance(column, pa.ExtensionArray) else column


# --- candidate thresholds
def thresholds_of(values: np.ndarray, weighted: float, count: int, most: int) -> list[float]:
    """Of a feature, from its values other than 0 in a sample, the sample's expected size, the rows in all, and the thresholds
    wanted at most: as Spark finds them."""
    distinct, counts = np.unique(values, return_counts=True)
    counts = counts.astype(np.float64)
    if weighted - counts.sum() > _EPSILON * count * 100:
        place = int(np.searchsorted(distinct, 0.0))
        distinct, counts = np.insert(distinct, place, 0.0), np.insert(counts, place, weighted - counts.sum())
    middle = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middle) <= most:
        return middle.tolist()
    stride, out = weighted / (most + 1), []
    target, so_far = stride, float(counts[0])
    for k, c in enumerate(counts[1:].tolist()):
        before, so_far = so_far, so_far + c
        if abs(before - target) < abs(so_far - target):
            out.append(k)
            target += stride
    return middle[out].tolist()


def thresholds(rows: DataFrame, n: int, size: int, bins: int, seed: int) -> list[np.ndarray]:
    """Of every feature, found in tasks by groups of features."""
    wanted, most = max(bins * bins, 10_000), min(bins, n) - 1
    share = wanted / n if wanted < n else 1.0
    sample = rows.sample(False, share, seed) if share < 1 else rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, f, v = _entries(_vectors(batch.column(0)))
            f, v = f[v != 0], v[v != 0]
            order = np.argsort(f % GROUPS, kind="stable")
            f, v = f[order].astype(np.int32), v[order]
            edge = np.searchsorted(f % GROUPS, np.arange(GROUPS + 1))
            pairs = [(g, a, b) for g, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([f[a:b].tobytes() for _, a, b in pairs], pa.binary()), pa.array([v[a:b].tobytes() for _, a, b in pairs], pa.binary())], ["g", "f", "v"])

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        f, v = np.frombuffer(b"".join(pdf["f"]), np.int32), np.frombuffer(b"".join(pdf["v"]), np.float64)
        order = np.argsort(f, kind="stable")
        f, v = f[order], v[order]
        start = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        return pd.DataFrame([(int(f[a]), thresholds_of(v[a:b], share * n, n, most)) for a, b in zip(start, np.append(start[1:], len(f)), strict=True)], columns=["f", "t"])

    out = [np.zeros(0)] * size
    for r in sample.select("features").mapInArrow(cut, "g int, f binary, v binary").groupBy("g").applyInPandas(find, "f int, t array<double>").collect():
        out[r["f"]] = np.array(r["t"], np.float64)
    return out


class Bins:
    """Thresholds of all features, and the bin of an entry: how many thresholds are below it."""

    def __init__(self, cuts: list[np.ndarray]):
        self.start = np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int64)
        self.cuts = np.concatenate([*cuts, np.zeros(0)])
        self.splits = np.diff(self.start)
        self.size, self.most = len(cuts), int(max(self.splits, default=0)) + 1
        self.kind = np.uint8 if self.most <= 256 else np.uint16 if self.most <= 65_536 else np.uint32
        every = np.arange(self.size)
        self.zero = self.of(every, np.zeros(self.size)).astype(self.kind)

    def of(self, f: np.ndarray, v: np.ndarray) -> np.ndarray:
        low, high = self.start[f].copy(), self.start[f + 1].copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high) // 2, 0)
            below = open_ & (self.cuts[middle] < v)
            low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
        return low - self.start[f]


# --- blocks of rows
class Block(NamedTuple):
    labels: np.ndarray
    names: np.ndarray
    rows: np.ndarray
    features: np.ndarray
    bins: np.ndarray


def binned(rows: DataFrame, bins, classes: int) -> DataFrame:
    """(labels, names, per, row, bin): blocks of rows as the entries away from their zero bins, by feature."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b, table = bins.value, pa.Table.from_batches(held).combine_chunks()
        got = [_entries(_vectors(c)) for c in table.column(0).chunks]
        sizes = np.cumsum([0, *[len(c) for c in table.column(0).chunks]])
        at, f, v = (np.concatenate(x) for x in zip(*[(r + s, f, v) for (r, f, v), s in zip(got, sizes, strict=False)], strict=True))
        bin_ = b.of(f, v).astype(b.kind)
        away = np.flatnonzero(bin_ != b.zero[f])
        away = away[np.argsort(f[away], kind="stable")]
        names = table.column(2).to_numpy().astype(np.int64)
        repeat = pd.Series(names).groupby(names).cumcount().to_numpy()  # of a name within the block
        labels = np.clip(table.column(1).to_numpy(), 0, classes - 1).astype(np.uint16)
        packed = (labels, _mix(names.astype(np.uint64) + _mix(repeat.astype(np.uint64) + np.uint64(1))), np.bincount(f[away], minlength=b.size).astype(np.uint16), at[away].astype(np.uint16), bin_[away])
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], list(Block._fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, BLOCK - n)
                held, n, at = [*held, some], n + some.num_rows, at + some.num_rows
                if n == BLOCK:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    return rows.mapInArrow(run, ", ".join(f"{c} binary" for c in Block._fields))


def _opened(batch: pa.RecordBatch, bins: Bins) -> Iterator[Block]:
    for labels, names, per, row, bin_ in zip(*(batch.column(c).to_pylist() for c in Block._fields), strict=True):
        features = np.repeat(np.arange(bins.size), np.frombuffer(per, np.uint16))
        yield Block(np.frombuffer(labels, np.uint16).astype(np.int64), np.frombuffer(names, np.uint64), np.frombuffer(row, np.uint16).astype(np.int64), features, np.frombuffer(bin_, bins.kind))


# --- growing
class Grown:
    """A tree while it grows: of each node its feature (-1: none yet, or a leaf), bin, children, gain and counts by class."""

    def __init__(self, counts: np.ndarray):
        self.feature, self.bin, self.left, self.right, self.gain, self.counts, self.depth = [-1], [0], [-1], [-1], [0.0], [counts], [0]

    def split(self, node: int, feature: int, bin_: int, gain: float, left: np.ndarray) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node], self.gain[node] = feature, bin_, at, at + 1, gain
        for counts in (left, self.counts[node] - left):
            for column, x in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.gain, 0.0), (self.counts, counts), (self.depth, self.depth[node] + 1)):
                column.append(x)
        return at, at + 1


def gini(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Over the last axis, class by class, as Spark adds it up; 0 without rows."""
    out = np.ones(total.shape)
    for c in range(counts.shape[-1]):
        share = counts[..., c] / np.maximum(total, 1e-300)
        out -= share * share
    return np.where(total > 0, out, 0.0)


class Pass(NamedTuple):
    """What the tasks of a pass read: trees as arrays, the slots of the nodes to be split, their features and their totals."""

    trees: dict[int, tuple[np.ndarray, ...]]
    drawn: np.ndarray | None
    totals: np.ndarray
    chunk: np.ndarray
    least: int


def _bag(names: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    if not bootstrap:
        return np.ones(len(names), np.int64)
    u = (_mix(names ^ _mix(np.array([(seed & 0xFFFFFFFF) << 24 | tree + 1], np.uint64))) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_POISSON, u, "right")


def _drawn(seed: int, tree: int, node: int, size: int, m: int) -> np.ndarray:
    return np.sort(np.random.default_rng([seed & 0xFFFFFFFF, tree, node]).choice(size, m, replace=False))


def _slots(tree: tuple[np.ndarray, ...], dense: np.ndarray, live: np.ndarray) -> np.ndarray:
    """The slot that each of the rows has come to, or -1."""
    feature, bin_, left, right, slot = tree
    node, moving = np.zeros(len(live), np.int64), np.arange(len(live))
    while len(moving := moving[feature[node[moving]] >= 0]):
        at = node[moving]
        node[moving] = np.where(dense[feature[at], live[moving]] <= bin_[at], left[at], right[at])
    return slot[node]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def _found(blocks: DataFrame, bins, state, classes: int, seed: int, bootstrap: bool) -> list:
    """The best split of every slot: (slot, feature, bin, gain, counts on the left). Slots without one are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, s = bins.value, state.value
        m = b.size if s.drawn is None else s.drawn.shape[1]
        keys, counts, n, kept = [], [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            k, c = _summed(np.concatenate(keys), np.concatenate(counts))
            of = s.chunk[k // (m * b.most * classes)]
            edge = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist()
            for x, y in zip(edge, [*edge[1:], len(k)], strict=True):
                made = [pa.array([int(of[x])], pa.int32()), pa.array([y - x], pa.int32())]
                for data in (np.diff(k[x:y], prepend=0), c[x:y].astype(np.uint32)):
                    made.append(pa.array([pa.compress(data.tobytes(), codec="zstd", asbytes=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(made, ["chunk", "n", "k", "c"])

        for batch in batches:
            for block in _opened(batch, b):
                dense = np.repeat(b.zero[:, None], len(block.labels), axis=1)
                dense[block.features, block.rows] = block.bins
                for t, tree in s.trees.items():
                    bag = _bag(block.names, t, seed, bootstrap)
                    live = np.flatnonzero(bag)
                    slot = _slots(tree, dense, live)
                    live, slot = live[slot >= 0], slot[slot >= 0]
                    if s.drawn is None:
                        of_row = np.full(len(block.labels), -1)
                        of_row[live] = slot
                        at = of_row[block.rows]
                        i = np.flatnonzero(at >= 0)
                        row, cell = block.rows[i], (at[i] * m + block.features[i]) * b.most + block.bins[i]
                    else:
                        f = s.drawn[slot]
                        v = dense[f, live[:, None]]
                        i, j = np.nonzero(v != b.zero[f])
                        row, cell = live[i], (slot[i] * m + j) * b.most + v[i, j]
                    keys.append(cell * classes + block.labels[row])
                    counts.append(bag[row])
                    n += len(row)
                    if n > HELD + 2 * kept:
                        k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                        keys, counts, n, kept = [k], [c], len(k), len(k)
                        if kept > HELD:
                            yield from out()
                            keys, counts, n, kept = [], [], 0, 0
        if n:
            yield from out()

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        b, s = bins.value, state.value
        m = b.size if s.drawn is None else s.drawn.shape[1]
        sizes = pdf["n"].tolist()
        keys = np.concatenate([np.cumsum(np.frombuffer(pa.decompress(x, n * 8, "zstd"), np.int64)) for x, n in zip(pdf["k"], sizes, strict=True)])
        counts = np.concatenate([np.frombuffer(pa.decompress(x, n * 4, "zstd"), np.uint32) for x, n in zip(pdf["c"], sizes, strict=True)]).astype(np.float64)
        wide, rows = m * b.most * classes, []
        slots = np.flatnonzero(s.chunk == pdf["chunk"].iloc[0])
        step = max(1, CELLS // wide)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        for a in range(int(slots[0]), int(slots[-1]) + 1, step):
            g = min(step, int(slots[-1]) + 1 - a)
            x, y = np.searchsorted(keys, [a * wide, (a + g) * wide])
            cells = np.bincount(keys[x:y] - a * wide, counts[x:y], g * wide).reshape(g, m, b.most, classes)
            feats = np.broadcast_to(np.arange(b.size), (g, m)) if s.drawn is None else s.drawn[a : a + g].astype(np.int64)
            total = s.totals[a : a + g].astype(np.float64)
            i, j = np.indices((g, m))
            cells[i, j, b.zero[feats]] = total[:, None, :] - cells.sum(axis=2)
            left = cells.cumsum(axis=2)[:, :, :-1, :]
            right = total[:, None, None, :] - left
            n_left, n_right = left.sum(axis=-1), right.sum(axis=-1)
            n = np.maximum(n_left + n_right, 1e-300)
            impure = gini(total, total.sum(axis=-1))[:, None, None]
            gain = impure - n_left / n * gini(left, n_left) - n_right / n * gini(right, n_right)
            splits = b.splits[feats][:, :, None]
            gain[(np.arange(b.most - 1) >= splits) | (n_left < s.least) | (n_right < s.least)] = -1.0
            flat = gain.reshape(g, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(g, -1)[np.arange(g), flat] > 0).tolist():
                p, q = divmod(int(flat[k]), b.most - 1)
                rows.append((a + k, int(feats[k, p]), q, float(gain[k, p, q]), left[k, p, q].tolist()))
        return pd.DataFrame(rows, columns=["slot", "feature", "bin", "gain", "counts"])

    counted = blocks.mapInArrow(count, "chunk int, n int, k binary, c binary")
    return counted.groupBy("chunk").applyInPandas(best, "slot long, feature int, bin int, gain double, counts array<double>").collect()


def _pruned(tree: Grown, node: int) -> dict:
    """Nested nodes; two leaves of one prediction become a leaf."""
    here = {"counts": tree.counts[node], "best": int(np.argmax(tree.counts[node])), "feature": -1}
    if tree.feature[node] < 0:
        return here
    left, right = _pruned(tree, tree.left[node]), _pruned(tree, tree.right[node])
    if left["feature"] < 0 and right["feature"] < 0 and left["best"] == right["best"]:
        return here
    return here | {"feature": tree.feature[node], "bin": tree.bin[node], "gain": tree.gain[node], "left": left, "right": right}


class ForestClassifier(Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """A forest (or, of one tree without a bootstrap, a decision tree) over ``features`` and ``label``, with Spark's parameters."""

    numTrees = _param("numTrees", "trees", TypeConverters.toInt)
    maxDepth = _param("maxDepth", "levels below the root at most", TypeConverters.toInt)
    minInstancesPerNode = _param("minInstancesPerNode", "rows that a child needs", TypeConverters.toInt)
    featureSubsetStrategy = _param("featureSubsetStrategy", "features of a node: all, sqrt, log2 or auto", TypeConverters.toString)
    maxBins = _param("maxBins", "bins of a feature at most", TypeConverters.toInt)
    bootstrap = _param("bootstrap", "whether trees draw their rows", TypeConverters.toBoolean)
    seed = _param("seed", "of all draws", TypeConverters.toInt)
    idCol = _param("idCol", "column whose hash draws the rows", TypeConverters.toString)

    def __init__(self, **given):
        super().__init__()
        self._setDefault(numTrees=20, maxDepth=5, minInstancesPerNode=1, featureSubsetStrategy="auto", maxBins=32, bootstrap=True, seed=42, idCol="message_id")
        self._set(**given)

    def _subset(self, size: int, trees: int) -> int | None:
        how = self.getOrDefault("featureSubsetStrategy")
        m = {"all": size, "auto": size if trees == 1 else math.ceil(math.sqrt(size)), "sqrt": math.ceil(math.sqrt(size)), "log2": max(1, math.ceil(math.log(size) / math.log(2)))}[how]
        return None if m >= size else m

    def _fit(self, dataset: DataFrame) -> ForestModel:
        return fit_all(dataset, [self])[0]

    def _binned(self, dataset: DataFrame) -> Binned | None:
        spark, get = dataset.sparkSession, self.getOrDefault
        name = F.xxhash64(get("idCol")) if get("idCol") in dataset.columns else F.monotonically_increasing_id()
        rows = dataset.select("features", F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"), name.alias("name"))

        def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b for b in batches if b.num_rows):
                v = _vectors(batch.column(0))
                size = v.field("size")[0].as_py() or len(v.field("values")[0])  # a dense vector has no size of its own
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (batch.num_rows, pc.max(batch.column(1)).as_py(), size)], ["n", "most", "size"])

        seen = rows.mapInArrow(shape, "n long, most long, size long").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.max("size").alias("size")).first()
        if not seen["n"]:
            return None
        size, classes = seen["size"], max(2, seen["most"] + 1)
        cuts = thresholds(rows, seen["n"], size, get("maxBins"), get("seed"))
        bins = spark.sparkContext.broadcast(Bins(cuts))
        return Binned(binned(rows, bins, classes).persist(StorageLevel.MEMORY_AND_DISK), bins, cuts, classes)

    def _fitted(self, made: Binned | None) -> ForestModel:
        trees = self.getOrDefault("numTrees")
        if made is None:
            return self._copyValues(ForestModel()._with(0, 2, [[(-1, 0.0, -1, -1, 0.0, [0.0, 0.0])]] * trees))
        size = len(made.cuts)
        grown = self._grow(made.blocks, made.bins, made.classes, self._subset(size, trees))
        return self._copyValues(ForestModel()._with(size, made.classes, [_flat(_pruned(t, 0), made.cuts) for t in grown]))

    def _grow(self, blocks: DataFrame, bins, classes: int, m: int | None) -> list[Grown]:
        spark, get = blocks.sparkSession, self.getOrDefault
        seed, trees, bootstrap, depth = get("seed"), get("numTrees"), get("bootstrap"), get("maxDepth")
        size, cells = bins.value.size, bins.value.most * classes

        def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((trees, classes), np.int64)
            for batch in batches:
                for labels, names in zip(batch.column("labels").to_pylist(), batch.column("names").to_pylist(), strict=True):
                    y, h = np.frombuffer(labels, np.uint16).astype(np.int64), np.frombuffer(names, np.uint64)
                    for t in range(trees):
                        total[t] += np.bincount(y, _bag(h, t, seed, bootstrap), classes).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(trees), classes)), pa.array(np.tile(np.arange(classes), trees)), pa.array(total.ravel())], ["t", "c", "n"])

        start = np.zeros((trees, classes))
        for r in blocks.mapInArrow(roots, "t long, c long, n long").groupBy("t", "c").agg(F.sum("n").alias("n")).collect():
            start[r["t"], r["c"]] = r["n"]
        grown = [Grown(x) for x in start]
        open_ = [(t, 0) for t in range(trees)] if depth > 0 and bins.value.most > 1 else []
        while open_:
            new = []
            most = max(1, DRAWN // (m or 1)) if m else max(1, (1 << 62) // (size * cells))
            for some in (open_[a : a + most] for a in range(0, len(open_), most)):
                for slot, feature, bin_, gain, left in self._pass(blocks, bins, grown, some, classes, m):
                    t, node = some[slot]
                    for child in grown[t].split(node, feature, bin_, gain, np.array(left)):
                        counts = grown[t].counts[child]
                        if grown[t].depth[child] < depth and abs(float(gini(counts, counts.sum()))) >= _EPSILON:
                            new.append((t, child))
            open_ = sorted(new)
        return grown

    def _pass(self, blocks: DataFrame, bins, grown: list[Grown], some: list[tuple[int, int]], classes: int, m: int | None) -> list[tuple]:
        get, b = self.getOrDefault, bins.value
        totals = np.array([grown[t].counts[node] for t, node in some])
        per_row = b.size if m is None else m  # a chunk has so many rows' entries, or one node
        chunk = np.cumsum(totals.sum(axis=1) * per_row).astype(np.int64) // (4 * HELD)
        trees, kind = {}, np.min_scalar_type(b.size)
        for t in dict.fromkeys(t for t, _ in some):
            g = grown[t]
            trees[t] = (np.array(g.feature, np.int32), np.array(g.bin, np.int32), np.array(g.left, np.int32), np.array(g.right, np.int32), np.full(len(g.feature), -1, np.int64))
        for slot, (t, node) in enumerate(some):
            trees[t][4][node] = slot
        drawn = None if m is None else np.stack([_drawn(get("seed"), t, node, b.size, m) for t, node in some]).astype(kind)
        state = blocks.sparkSession.sparkContext.broadcast(Pass(trees, drawn, totals, chunk, get("minInstancesPerNode")))
        try:
            return [tuple(r) for r in _found(blocks, bins, state, classes, get("seed"), get("bootstrap"))]
        finally:
            state.destroy()


class Binned(NamedTuple):
    blocks: DataFrame
    bins: Broadcast
    cuts: list[np.ndarray]
    classes: int


def fit_all(dataset: DataFrame, forests: list[ForestClassifier]) -> list[ForestModel]:
    """The forests' models; forests with the same bins share their blocks, one kind of bins at a time."""
    key = lambda f: tuple(f.getOrDefault(p) for p in ("maxBins", "seed", "idCol"))
    out: list[ForestModel | None] = [None] * len(forests)
    for k in dict.fromkeys(map(key, forests)):
        some = [i for i, f in enumerate(forests) if key(f) == k]
        made = forests[some[0]]._binned(dataset)
        try:
            for i in some:
                out[i] = forests[i]._fitted(made)
        finally:
            if made is not None:
                made.blocks.unpersist()
                made.bins.unpersist()
    return out


def _flat(root: dict, cuts: list[np.ndarray]) -> list[tuple]:
    """Nodes in rows: feature (-1 of a leaf), threshold, places of the children, gain, counts by class."""
    out = []

    def add(node: dict) -> int:
        at = len(out)
        out.append(None)
        counts = [float(x) for x in node["counts"]]
        if node["feature"] < 0:
            out[at] = (-1, 0.0, -1, -1, 0.0, counts)
        else:
            left, right = add(node["left"]), add(node["right"])
            out[at] = (node["feature"], float(cuts[node["feature"]][node["bin"]]), left, right, node["gain"], counts)
        return at

    add(root)
    return out


class ForestModel(Model, Stored):
    """Adds ``probability`` (mean of the leaves' shares) and ``prediction`` (the greatest; ties to the lesser class)."""

    TABLES = ("shape", "nodes")

    def __init__(self):
        super().__init__()
        self._with(0, 2, [])

    def _with(self, size: int, classes: int, trees: list[list[tuple]]) -> ForestModel:
        self.size, self.classes, self.trees = size, classes, trees
        return self

    def tables(self):
        rows = [(t, i, *node) for t, tree in enumerate(self.trees) for i, node in enumerate(tree)]
        return {"shape": ("size int, classes int, trees int", [(self.size, self.classes, len(self.trees))]), "nodes": ("tree int, place int, feature int, threshold double, left int, right int, gain double, counts array<double>", rows)}

    def restore(self, tables):
        size, classes, n = tables["shape"][0]
        trees = [[] for _ in range(n)]
        for r in sorted(tables["nodes"], key=lambda r: (r["tree"], r["place"])):
            trees[r["tree"]].append(tuple(r)[2:])
        self._with(size, classes, trees)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Gains times rows by feature, each tree's adding up to 1, then all."""
        total = np.zeros(self.size)
        for tree in self.trees:
            one = np.zeros(self.size)
            for feature, _, _, _, gain, counts in tree:
                if feature >= 0:
                    one[feature] += gain * sum(counts)
            total += one / one.sum() if one.sum() else one
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes = self.classes
        used = sorted({node[0] for tree in self.trees for node in tree if node[0] >= 0})
        place = {f: i for i, f in enumerate(used)}
        columns = []
        for tree in self.trees:
            f, t, left, right, _, counts = (np.array(x) for x in zip(*tree, strict=True))
            counts = counts.reshape(len(tree), classes)
            total = counts.sum(axis=1, keepdims=True)
            columns.append((np.array([place.get(x, -1) for x in f.tolist()]), t, left, right, counts / np.where(total > 0, total, 1.0)))
        trees = dataset.sparkSession.sparkContext.broadcast((np.array(used, np.int64), columns))

        @F.arrow_udf("array<double>")
        def voted(vectors: pa.Array) -> pa.Array:
            used, columns = trees.value
            out = np.zeros((len(vectors), classes))
            for a in range(0, len(vectors), 512):
                part = _vectors(vectors.slice(a, 512))
                row, f, v = _entries(part)
                x = np.zeros((len(part), len(used) + 1))
                at = np.minimum(np.searchsorted(used, f), max(0, len(used) - 1))
                hit = used[at] == f if len(used) else np.zeros(len(f), bool)
                x[row[hit], at[hit]] = v[hit]
                for feature, t, left, right, share in columns:
                    node, moving = np.zeros(len(part), np.int64), np.arange(len(part))
                    while len(moving := moving[feature[node[moving]] >= 0]):
                        n = node[moving]
                        node[moving] = np.where(x[moving, feature[n]] <= t[n], left[n], right[n])
                    out[a : a + 512] += share[node]
            total = out.sum(axis=1, keepdims=True)
            return pa.array(list(out / np.where(total > 0, total, 1.0)), pa.list_(pa.float64()))

        return dataset.withColumn("__p", voted("features")).withColumns({"probability": array_to_vector("__p"), "prediction": (F.array_position("__p", F.array_max("__p")) - 1).cast("double")}).drop("__p")
