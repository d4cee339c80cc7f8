"""N-gram Jaccard self-join by chosen paths.

Each text is the set of hashes of its shingles (five words; shorter texts are one shingle). Texts with equal sets are
one node. Every node picks some of its shingles by a hash that all nodes share, REPEATS / (threshold x set size) of them
each on average, so two nodes at the threshold pick REPEATS shared ones on average: each shared pick is a bucket that
holds both. In a bucket of more than SPLIT nodes the nodes pick afresh, with the bucket's own salt and from the shingles
off its path, again REPEATS shared ones on average, and the bucket is replaced by its sub-buckets; so on until buckets
are small or a split does not halve the work. A pair is missed with a probability of at most x = exp(-REPEATS (1 - x))
at any depth (:func:`miss_rate`, 0.252 %); runs with new salts are repeated until that of all runs is within ``recall``.
A bucket whose members are all in one other is left out. Small buckets are compared by brute force; what is still large
(near copies, which no shingle splits) is cut into blocks, and every pair of blocks is compared in a task of its own, so
no bucket is capped and none must fit in one task. Texts and sets are joined by shuffles at every size; only the ids of the nodes of large buckets, up to FILTER of them, are broadcast. Pairs are never written out: a task counts links and returns each
node's count and its least neighbour.

Defined cases: texts without words (null, empty, signs only) have no links; repeated rows and equal texts link with
each other; a similarity of exactly the threshold links; a class is named by its least id; rows without id keep a null class and no links; an empty table gives an empty result; long texts are
taken whole; columns besides id and text are ignored by :func:`similarity_classes` and kept by
:func:`keep_one_of_each`. Sets are compared by 32-bit hashes of shingles: two different shingles of a pair agree with
probability 2**-32.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import cut, hash_words, kept, mix64, packed, small_batches, stretches, unpacked, unused, utf8
from palisade.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
#: Expected shared picks of a pair at the threshold.
REPEATS = 6.0
#: Share of the pairs at the threshold that are found, by calculation; one run gives 0.9974.
RECALL = 0.997
#: Nodes in a bucket from which it is split; nodes, and shingles, in a block of what is left.
SPLIT, BLOCK, BLOCK_SHINGLES = 1_024, 1_024, 1_000_000
#: Nodes up to which their ids are broadcast as a filter of the texts (8 bytes each).
FILTER = 1_000_000
_STEP = np.uint64(0x100000001B3)
_LEVEL = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words, offsets = hash_words([utf8(t) if isinstance(t, str) else b"" for t in texts])
    rolled = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        rolled = rolled * _STEP + words[k : k + len(rolled)]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            short = b - a
            for w in words[a:b].tolist():
                short = (short * int(_STEP) + w) % 2**64
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty set."""
    if not len(shingles):
        return None
    a, b = mix64(shingles ^ _LEVEL).sum(dtype=np.uint64), mix64(shingles * _STEP).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def packed_set(shingles: np.ndarray) -> bytes:
    """The set as steps between sorted 32-bit hashes."""
    return packed(np.diff(np.unique(shingles >> np.uint64(32)), prepend=np.uint64(0)))


def opened_set(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data)[0], dtype=np.uint64).astype("<u4")


def miss_rate() -> float:
    """Probability at most that a run misses a pair at the threshold: it shares no pick, or each is a bucket whose
    split misses it in turn, each by a salt of its own."""
    x = 0.0
    for _ in range(200):
        x = math.exp(-REPEATS * (1 - x))
    return x


def runs_for(recall: float) -> int:
    """Runs with salts of their own after which a pair at the threshold is found with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss_rate())))


def _drawn(shingles: np.ndarray, key: int) -> np.ndarray:
    return mix64(shingles ^ mix64(np.array([key % 2**64], np.uint64) ^ _LEVEL))


def picks_below(shingles: np.ndarray, path: list[int], threshold: float) -> list[int]:
    """Keys of the sub-buckets of the bucket that ``path`` (the run, and a key a level) leads to."""
    least = threshold * len(shingles) - (len(path) - 1)  # shared ones off the path, if the pair's other set is smaller
    if least > 0:
        for key, chosen in zip(path[:-1], path[1:], strict=True):
            shingles = shingles[_drawn(shingles, key) != np.uint64(chosen % 2**64)]
    drawn = _drawn(shingles, path[-1])
    if least > REPEATS:
        drawn = drawn[drawn < np.uint64(int(REPEATS / least * 2**64))]
    return drawn.astype(np.int64).tolist()


def picks(shingles: np.ndarray, threshold: float, run: int = 0) -> list[int]:
    """Bucket keys of a run: the sampled shingles' hashes."""
    return picks_below(shingles, [run], threshold)


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of pairs at or above the threshold: within ``a`` (i < j), or between ``a`` and ``b``."""
    sets = a if b is None else a + b
    sizes = np.array([len(s) for s in sets], np.int64)
    token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    same = np.concatenate([[False], token[1:] == token[:-1]])
    shared = same | np.append(same[1:], False)
    column = np.cumsum(~same[shared]) - 1
    width = int(column[-1]) + 1 if len(column) else 0
    common = np.zeros((len(sets), len(sets)), np.float64)
    step = max(1, 4_000_000 // max(len(sets), 1))  # columns at a time
    rows = owner[shared]
    for at in range(0, width, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        grid = np.zeros((len(sets), min(step, width - at)), np.float32)
        grid[rows[lo:hi], column[lo:hi] - at] = 1
        common += grid @ grid.T
    near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    near = np.triu(near, 1)
    if b is not None:
        near[: len(a), : len(a)] = False
        near[len(a) :, :] = False
    i, j = np.nonzero(near)
    return i, j


def _first_shared(keys: list[np.ndarray], i: np.ndarray, j: np.ndarray, bucket: int) -> np.ndarray:
    """Whether ``bucket`` is the least bucket that both nodes of a pair are in: so each pair counts once."""
    width = max(len(k) for k in keys)
    grid = np.zeros((len(keys), width), np.int64)
    for row, k in zip(grid, keys, strict=True):
        row[: len(k)] = k
        row[len(k) :] = k[-1]
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 50_000):
        x, y = grid[i[at : at + 50_000]], grid[j[at : at + 50_000]]
        both = (x[:, :, None] == y[:, None, :]).any(2)
        out[at : at + 50_000] = np.where(both, x, np.iinfo(np.int64).max).min(1) == bucket
    return out


def _compare(group: pd.DataFrame, threshold: float) -> pd.DataFrame | None:
    """Links of one bucket, or of one pair of blocks of it: node, links, texts, and a node of its local component."""
    if group["node"].duplicated().any():  # rows that are repeated with their id
        group = group.drop_duplicates("node")
    if len(group) < 2:
        return None
    left, right = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])
    if left != right:
        group = group.sort_values("block", kind="stable")
    sets = [opened_set(s) for s in group["shingles"]]
    cut_at = int((group["block"] == left).sum())
    if left == right:
        i, j = linked(sets, None, threshold)
    elif 0 < cut_at < len(sets):
        i, j = linked(sets[:cut_at], sets[cut_at:], threshold)
    else:
        return None
    if len(i):
        once = _first_shared([np.asarray(k, np.int64) for k in group["leaves"]], i, j, int(group["leaf"].iloc[0]))
        i, j = i[once], j[once]
    if not len(i):
        return None
    n, copies = len(sets), group["copies"].to_numpy()
    links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
    texts = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    root = np.arange(n)
    while True:  # least labels within the task
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    hit = texts > 0
    nodes = group["node"].to_numpy()
    return pd.DataFrame({"node": nodes[hit], "links": links[hit].astype(np.int64), "texts": texts[hit], "root": nodes[root[hit]]})


def _compare_stream(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Groups lie together in sorted partitions; one that goes on in the next batch is carried over."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        key = pdf[["leaf", "lo", "hi"]].to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        bounds = [0, *edge.tolist()]
        rest = pdf.iloc[bounds[-1] :]
        got = [r for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > 1 and (r := _compare(pdf.iloc[a:b], threshold)) is not None]
        if got:
            yield pd.concat(got, ignore_index=True)
    if rest is not None and (last := _compare(rest, threshold)) is not None:
        yield last


def _scan(docs: DataFrame, id_col: str, text_col: str, field: str | None = None, value=None) -> DataFrame:
    """(id, node), and a field with what ``value`` makes of each text's shingles."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "node", *([field.split()[0]] if field else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, to in stretches(pdf["text"].tolist()):
                part = pdf.iloc[at:to]
                sets = shingle_sets(part["text"].tolist())
                rows = [(i, node_of(s), *([value(s)] if field else [])) for i, s in zip(part["id"].tolist(), sets, strict=True)]
                yield pd.DataFrame(rows, columns=names)

    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return source.mapInPandas(run, f"id {kind}, node binary" + (f", {field}" if field else ""))


def similarity_links(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, node), nodes (node, rep, copies) and links (node, links, texts, root)."""
    small_batches(docs.sparkSession)
    rows = kept(_scan(docs, id_col, text_col))
    nodes = kept(rows.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    chosen = nodes.select("node", "rep", "copies")
    runs = range(runs_for(recall))
    found = _scan(docs, id_col, text_col, "paths array<array<long>>", lambda s: [[len(s)], *([r, key] for r in runs for key in picks(s, threshold, r))])
    picked = found.join(chosen.withColumnRenamed("rep", "id"), ["node", "id"]).dropDuplicates(["node"])
    picked = picked.select("node", F.col("paths")[0][0].alias("size"), F.explode(F.slice("paths", 2, F.greatest(F.size("paths") - 1, F.lit(1)))).alias("path"))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    leaves = kept(_leaves(picked, texts, chosen.select("node", F.col("rep").alias("id")), threshold))
    shared = leaves.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("leaf", "members", "weight"))).alias("found"))
    needed = shared.join(_needless(shared), "node", "left")
    needed = needed.withColumn("leaves", F.col("found.leaf")).withColumn("found", F.filter("found", lambda x: F.col("needless").isNull() | ~F.array_contains(F.col("needless"), x["leaf"])))
    wanted = chosen.join(needed.where(F.size("found") > 0), "node").select("node", F.col("rep").alias("id"), "copies", "found", "leaves")
    sets = _scan(docs, id_col, text_col, "shingles binary", packed_set)
    member = sets.join(wanted.hint("merge"), ["node", "id"]).withColumn("f", F.explode("found"))
    blocks = F.ceil(F.greatest(F.col("f.members") / F.lit(BLOCK), F.least(F.col("f.weight") / F.lit(BLOCK_SHINGLES), F.col("f.members")))).cast("int")
    member = member.select("node", "copies", "shingles", "leaves", F.col("f.leaf").alias("leaf"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    dealt = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "copies", "shingles", "leaves", "leaf", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = dealt.repartition("leaf", "lo", "hi").sortWithinPartitions("leaf", "lo", "hi", "node")
    links = dealt.mapInPandas(lambda it: _compare_stream(it, threshold), "node binary, links long, texts long, root binary")
    return rows, nodes, cut(links)


def _leaves(picked: DataFrame, texts: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """(node, leaf, members, weight) of every bucket with two nodes or more, large ones split where that halves the work."""
    done = []
    while True:
        named = picked.withColumn("leaf", F.element_at("path", -1))
        sizes = named.groupBy("leaf").agg(F.count("*").alias("members"), F.sum("size").alias("weight")).where("members > 1")
        held = kept(named.join(sizes, "leaf").select("node", "size", "path", "leaf", "members", "weight"))
        large = held.where(F.col("members") > SPLIT)
        if large.isEmpty():
            done.append(held)
            break
        below = kept(_below(large, texts, ids, threshold))
        counts = below.groupBy(F.element_at("path", -2).alias("leaf"), F.element_at("path", -1).alias("sub")).count()
        work = counts.groupBy("leaf").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("work"))
        wholes = large.groupBy("leaf").agg(F.first("members").cast("double").alias("m"))
        split = kept(wholes.join(work, "leaf", "left").where(F.coalesce("work", F.lit(0.0)) <= F.col("m") * F.col("m") / 2).select("leaf"))
        done.append(held.join(split, "leaf", "left_anti"))
        picked = below.join(split, F.element_at("path", -2) == F.col("leaf"), "left_semi")
    return reduce(DataFrame.unionByName, [d.select("node", "leaf", "members", "weight") for d in done])


def _below(large: DataFrame, texts: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """(node, size, path) for the fresh picks of the nodes of large buckets."""
    wanted = kept(large.groupBy("node").agg(F.collect_list("path").alias("paths")).join(ids, "node"))
    if wanted.count() <= FILTER:  # then only their texts are shuffled; beyond, all are
        texts = texts.join(F.broadcast(wanted.select("id").distinct()), "id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, to in stretches(pdf["text"].tolist()):
                part = pdf.iloc[at:to]
                rows = []
                for node, paths, s in zip(part["node"], part["paths"], shingle_sets(part["text"].tolist()), strict=True):
                    if node_of(s) == node:  # another text may have the same id
                        rows += [(node, len(s), [*path, key]) for path in map(np.ndarray.tolist, paths) for key in picks_below(s, path, threshold)]
                yield pd.DataFrame(rows, columns=["node", "size", "path"])

    return texts.join(wanted.hint("merge"), "id").select("node", "paths", "text").mapInPandas(run, "node binary, size long, path array<long>").distinct()


def _needless(shared: DataFrame) -> DataFrame:
    """(node, needless): the node's buckets whose members are all in one lesser bucket, where each pair is compared."""
    each = shared.select("node", F.explode("found").alias("f"), F.col("found.leaf").alias("all"))
    both = each.select(F.col("f.leaf").alias("leaf"), F.col("f.members").alias("members"), F.explode(F.filter("all", lambda x: x < F.col("f.leaf"))).alias("other"))
    inside = both.groupBy("leaf", "other", "members").count().where(F.col("count") == F.col("members"))
    gone = inside.select("leaf").distinct()
    return each.select("node", F.col("f.leaf").alias("leaf")).join(gone, "leaf").groupBy("node").agg(F.collect_list("leaf").alias("needless"))


def similarity_classes(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_links, n_texts) for each row: the least id of its class, the other rows that are linked with
    it, and the other texts among them."""
    rows, nodes, links = similarity_links(docs, threshold=threshold, id_col=id_col, text_col=text_col)
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = nodes.join(counts, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = cut(known)
    least = known.groupBy("label").agg(F.min("rep").alias("class_id"))
    found = cut(known.join(least, "label").select("node", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("texts")))
    out = rows.join(found, "node", "left")
    has = F.col("id").isNotNull() & F.col("class_id").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(has, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(has, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(has, F.col("texts")).otherwise(F.lit(0)).cast("long").alias("n_texts"),
    )


def keep_one_of_each(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose id is the least of its class. Rows repeated with one id all stay."""
    classes = similarity_classes(docs, threshold=threshold, id_col=id_col, text_col=text_col)
    name = unused("gone", docs.columns)
    gone = classes.where(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
