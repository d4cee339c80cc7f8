"""A stored index of vectors for approximate neighbours by cosine.

A coarse quantiser, whose size grows with the square root of the rows, puts each vector in a list; what is left of it beside
the list's centre is written as codes of several parts. Lists lie in folders, so a query reads those that it probes. Within a
probed list all codes are scored by table look-ups; those above a bar are scored by their stored vectors, exactly. A query's bar
is the score that a set share of a stored sample reaches, so lists need not be compared with each other first.

The quantisers are fitted on a sample of at most ``sample`` vectors (those of the least hashes); every vector is indexed. How
many lists are probed and what share is scored exactly follow from the recall that is wanted, measured on the sample. A list
of many rows is cut into chunks, and the queries of a list are dealt over them, so a hot list is spread over tasks.

Defined cases: null vectors and those with null or non-finite components or without length are neither indexed nor asked
for; rows of equal content and repeated ids stand each; ties go to the lesser id; an empty table gives an empty index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS, ENTRIES = 16, 256
#: Vectors that the quantisers are fitted on, at most; rows of a chunk; lists of a folder.
SAMPLE, CHUNK_ROWS, SHELF = 65_536, 50_000, 16
#: Vectors of the sample that bars are taken from.
BAR_ROWS = 8_192
#: Queries that a task compares with that sample at once.
ASKED = 256


def unit_rows(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, v): vectors of unit length."""
    v = F.col(col).cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return rows.withColumn("n", norm).where("n > 0").select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def k_means(x: np.ndarray, k: int, rounds: int = 6, seed: int = 42) -> np.ndarray:
    """Centres of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        at = nearest_entry(x, centres)
        order = np.argsort(at, kind="stable")
        used, start, count = np.unique(at[order], return_index=True, return_counts=True)
        centres[used] = np.add.reduceat(x[order], start, axis=0) / count[:, None]
    return centres


def nearest_entry(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    half = (entries * entries).sum(axis=1) / 2
    blocks = np.array_split(x, 1 + len(x) * len(entries) // 8_000_000)
    return np.concatenate([np.argmin(half - b @ entries.T, axis=1) for b in blocks]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Index:
    """What a searcher holds; the lists stay in their folders."""

    path: str
    centres: np.ndarray
    books: list[np.ndarray]
    sizes: dict[int, int]
    probes: int
    share: float
    rows: int
    bar_lists: np.ndarray
    bar_codes: np.ndarray

    def codes(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest = x - self.centres[at]
        return np.stack([nearest_entry(r, b) for r, b in zip(np.array_split(rest, len(self.books), axis=1), self.books, strict=True)], axis=1).astype(np.uint8)

    def scores(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate similarities of queries (rows) to the coded vectors of a list."""
        out = np.repeat((q @ self.centres[at])[:, None], len(codes), axis=1)
        for p, (part, book) in enumerate(zip(np.array_split(q, len(self.books), axis=1), self.books, strict=True)):
            out += (part @ book.T)[:, codes[:, p]]
        return out

    def sampled(self, q: np.ndarray) -> np.ndarray:
        """Approximate similarities of queries to the stored sample."""
        out = (q @ self.centres.T)[:, self.bar_lists]
        for p, (part, book) in enumerate(zip(np.array_split(q, len(self.books), axis=1), self.books, strict=True)):
            out += (part @ book.T)[:, self.bar_codes[:, p]]
        return out

    def bars(self, q: np.ndarray) -> np.ndarray:
        s = self.sampled(q)
        n = s.shape[1]
        rank = min(n, max(1, int(np.ceil(self.share * n))))
        return np.partition(s, n - rank, axis=1)[:, n - rank] if rank < n else np.full(len(q), -np.inf)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The lists nearest to each query, nearest first."""
        near = q @ self.centres.T
        return np.argsort(-near, axis=1, kind="stable")[:, : self.probes]


def _fit(sample: np.ndarray, n: int, parts: int, recall: float, k: int) -> Index:
    lists = int(min(4 * np.sqrt(n), max(1, len(sample) // 16))) or 1
    centres = k_means(sample, lists)
    at = nearest_entry(sample, centres)
    rest = sample - centres[at]
    books = [k_means(r, ENTRIES) for r in np.array_split(rest, min(parts, sample.shape[1]), axis=1)]
    index = Index("", centres, books, {}, lists, 1.0, n, np.zeros(0, np.int64), np.zeros((0, len(books)), np.uint8))
    index.bar_lists, index.bar_codes = at[:BAR_ROWS], index.codes(sample[:BAR_ROWS], at[:BAR_ROWS])
    asked = np.arange(0, len(sample), max(1, len(sample) // 64))
    exact = sample[asked] @ sample.T
    k = min(k, len(sample))
    wanted = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    order = np.argsort(-(sample[asked] @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    reach = np.sort(np.take_along_axis(place, at[wanted], axis=1).ravel())  # the place of each true neighbour's list
    half = 1 - (1 - recall) / 4  # of what may be missed, a part for the lists and a part for the bar
    index.probes = int(reach[min(len(reach) - 1, int(np.ceil(half * len(reach))))]) + 1
    # the share of the sample that scores as high as each true neighbour does
    codes, shares = index.codes(sample, at), []
    bars = np.sort(index.sampled(sample[asked]), axis=1)
    for row, (i, true) in enumerate(zip(asked.tolist(), wanted, strict=True)):
        own = np.array([index.scores(sample[i : i + 1], at[t], codes[t : t + 1])[0, 0] for t in true.tolist()])
        shares += (1 - np.searchsorted(bars[row], own - 1e-12) / bars.shape[1]).tolist()
    index.share = max(float(np.sort(shares)[min(len(shares) - 1, int(np.ceil(half * len(shares))))]), 2 * k / bars.shape[1])
    index.share = min(1.0, 2 * index.share)  # the sample is small
    return index


def build(vectors: DataFrame, path: str, *, id_col: str = "vec_id", col: str = "embedding", parts: int = PARTS, sample: int = SAMPLE, recall: float = 0.95, k: int = 10) -> Index | None:
    """Fits, codes and writes the index of all vectors; None if there are none."""
    rows = unit_rows(vectors, id_col, col)
    dims = rows.orderBy("id").select(F.size("v")).first()
    if dims is None:
        return None
    rows = rows.where(F.size("v") == dims[0])
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("v"), "id").limit(sample).select("v").collect()
    index = _fit(np.array([r["v"] for r in drawn]), n, parts, recall, k)
    index.path = path

    def lists(frames):
        for pdf in frames:
            x = np.stack(pdf["v"].to_list()) if len(pdf) else np.zeros((0, dims[0]))
            at = nearest_entry(x, index.centres)
            yield pd.DataFrame({"shelf": at // SHELF, "list": at, "id": pdf["id"], "code": [c.tobytes() for c in index.codes(x, at)], "v": list(x.astype(np.float32))})

    kind = rows.schema["id"].dataType.simpleString()
    coded = rows.mapInPandas(lists, f"shelf long, list long, id {kind}, code binary, v array<float>")
    coded.repartition("shelf").sortWithinPartitions("shelf", "list").write.partitionBy("shelf").parquet(f"{path}/lists")
    spark = vectors.sparkSession
    index.sizes = {r["list"]: r["count"] for r in spark.read.parquet(f"{path}/lists").groupBy("list").count().collect()}
    head = {"sizes": sorted(index.sizes.items()), "probes": index.probes, "share": index.share, "rows": n}
    arrays = [("head", 0, json.dumps(head), None)] + [("centre", i, None, c.tolist()) for i, c in enumerate(index.centres)]
    arrays += [(f"book{p}", i, None, e.tolist()) for p, b in enumerate(index.books) for i, e in enumerate(b)]
    arrays += [("bar", i, None, [float(c), *map(float, code)]) for i, (c, code) in enumerate(zip(index.bar_lists, index.bar_codes, strict=True))]
    spark.createDataFrame(arrays, "kind string, place int, head string, v array<double>").coalesce(1).write.parquet(f"{path}/quantisers")
    return index


def load(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/quantisers").collect()
    head = json.loads(next(r["head"] for r in rows if r["kind"] == "head"))
    table = lambda kind: np.array([r["v"] for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["place"])])
    books = [table(f"book{p}") for p in range(len({r["kind"] for r in rows}) - 3)]
    bars = table("bar").astype(np.int64)
    return Index(path, table("centre"), books, {int(a): b for a, b in head["sizes"]}, head["probes"], head["share"], head["rows"], bars[:, 0], bars[:, 1:].astype(np.uint8))


def asked_lists(index: Index, pdf: pd.DataFrame, chunks: dict[int, int]) -> Iterator[pd.DataFrame]:
    """(list, chunk, id, v, bar) of queries (id, v), for ASKED of them at a time: each is compared with the whole stored sample."""
    for start in range(0, len(pdf), ASKED):
        some = pdf.iloc[start : start + ASKED]
        q = np.stack(some["v"].to_list())
        asked_of = zip(some["id"], some["v"], index.bars(q).tolist(), index.probed(q).tolist(), strict=True)
        rows = [(c, j, i, v, bar) for i, v, bar, cells in asked_of for c in cells for j in range(chunks.get(c, 0))]
        yield pd.DataFrame(rows, columns=["list", "chunk", "id", "v", "bar"])


def search(queries: DataFrame, index: Index, k: int = 10, *, id_col: str = "vec_id", col: str = "embedding", probes: int | None = None) -> DataFrame:
    """(id, ref_id, similarity, rank, looked): the k best of the probed lists; ``looked``: vectors compared exactly for a query."""
    spark = queries.sparkSession
    if probes is not None:
        index = replace(index, probes=probes)
    asked = unit_rows(queries, id_col, col).where(F.size("v") == index.centres.shape[1])
    chunks = {c: -(-n // CHUNK_ROWS) for c, n in index.sizes.items()}
    kind = asked.schema["id"].dataType.simpleString()

    def spread(frames):
        for pdf in frames:
            yield from asked_lists(index, pdf, chunks)

    probing = asked.mapInPandas(spread, f"list long, chunk int, id {kind}, v array<double>, bar double")
    held = spark.read.parquet(f"{index.path}/lists")
    if index.probes < len(index.centres):
        shelves = [r["shelf"] for r in probing.select(F.floor(F.col("list") / SHELF).alias("shelf")).distinct().collect()]  # no more than there are folders
        held = held.where(F.col("shelf").isin(shelves))
    n_chunks = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in chunks.items() for x in pair]), F.col("list")), F.lit(1)) if any(n > 1 for n in chunks.values()) else F.lit(1)
    held = held.select("list", F.pmod(F.xxhash64("id"), n_chunks).cast("int").alias("chunk"), "id", "code", "v")

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            r = r.sort_values("id", kind="stable")
            codes = np.frombuffer(b"".join(r["code"]), np.uint8).reshape(len(r), -1)
            x, ids = np.stack(r["v"].to_list()).astype(np.float64), r["id"].to_numpy()
            bars, at = q["bar"].to_numpy(), int(q["list"].iloc[0])
            for part in np.array_split(np.arange(len(q)), 1 + len(q) * len(r) // 4_000_000):
                v = np.stack(q["v"].iloc[part].to_list())
                above = index.scores(v, at, codes) >= bars[part][:, None] - 1e-12
                for i, qid in enumerate(q["id"].iloc[part].tolist()):
                    look = np.flatnonzero(above[i])
                    s = np.round(x[look] @ v[i], 12)
                    top = np.argsort(-s, kind="stable")[:k]
                    out += [(qid, int(ids[look[t]]), float(s[t]), len(look) if j == 0 else 0) for j, t in enumerate(top)]
        return pd.DataFrame(out, columns=["id", "ref_id", "similarity", "looked"])

    found = probing.groupBy("list", "chunk").cogroup(held.groupBy("list", "chunk")).applyInPandas(best, f"id {kind}, ref_id {kind}, similarity double, looked long")
    one = F.struct((-F.col("similarity")).alias("s"), F.col("ref_id"))
    top = found.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(one)), 1, k).alias("top"), F.sum("looked").alias("looked"))  # k a list
    return top.select(F.col("id").alias(id_col), F.posexplode("top").alias("pos", "n"), "looked").select(
        id_col, F.col("n.ref_id").alias("ref_id"), (-F.col("n.s")).alias("similarity"), (F.col("pos") + 1).alias("rank"), "looked"
    )
