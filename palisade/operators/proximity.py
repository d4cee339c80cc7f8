"""Exact nearest neighbours by cosine, in blocks; :mod:`palisade.operators.vector_index` has approximate ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Reference and query vectors that one task compares.
BLOCK, CHUNK = 10_000, 2_000


def l2_normalize(df: DataFrame, col: str = "embedding") -> DataFrame:
    norm = F.sqrt(F.aggregate(F.col(col), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn(col, F.transform(col, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)))


def _unit(values: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.zeros((0, 1))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _nearest(queries: DataFrame, references: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(id, ref_id, similarity, rank) from (cell, part, id, v) on both sides: the vectors of a cell and part meet in a task,
    which gives k candidates for each query; the k best of those few are kept."""
    kind = queries.schema["id"].dataType.simpleString()

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"id": q["id"][:0], "ref_id": q["id"][:0], "similarity": np.zeros(0)})
        r = r.sort_values("id", kind="stable")
        ids, mine = r["id"].to_numpy(), q["id"].to_numpy()
        sims = np.round(_unit(q["v"]) @ _unit(r["v"]).T, 12)
        if exclude_self:
            sims[mine[:, None] == ids[None, :]] = -2
        m = min(k, len(ids))
        least = np.partition(sims, len(ids) - m, axis=1)[:, len(ids) - m]  # ties at the edge: the lesser id first
        rows, cols = np.nonzero(sims >= least[:, None])
        out = pd.DataFrame({"id": mine[rows], "ref_id": ids[cols], "similarity": sims[rows, cols], "row": rows})
        out = out.sort_values(["row", "similarity", "ref_id"], ascending=[True, False, True], kind="stable").groupby("row", sort=False).head(m)
        return out.loc[out["similarity"] > -2, ["id", "ref_id", "similarity"]]

    found = queries.groupBy("cell", "part", "chunk").cogroup(references.groupBy("cell", "part", "chunk")).applyInPandas(best, f"id {kind}, ref_id {kind}, similarity double")
    ordered = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("similarity")).alias("s"), F.col("ref_id")))), 1, k)  # k a part
    top = found.groupBy("id").agg(ordered.alias("top")).select("id", F.posexplode("top").alias("pos", "n"))
    return top.select("id", F.col("n.ref_id").alias("ref_id"), (-F.col("n.s")).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def _meet(queries: DataFrame, references: DataFrame, cells: dict[int, int] | None, n_queries: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt over parts of cells (of references) and chunks (of queries); each side is repeated for the other's."""
    chunks = max(1, -(-n_queries // CHUNK))
    parts = F.lit(max(1, -(-max(cells.values(), default=1) // BLOCK)))
    q = queries.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    r = references.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
    return q, r


def class_knn(queries: DataFrame, references: DataFrame, k: int = 10, *, id_col: str = "vec_id", col: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(id, ref_id, similarity, rank) of the k most similar references; ties go to the lesser id. Blocks of references
    and chunks of queries meet in tasks; nothing passes through the driver."""
    q, r = (df.select(F.lit(0).alias("cell"), F.col(id_col).alias("id"), F.col(col).alias("v")) for df in (queries, references))
    return _nearest(*_meet(q, r, {0: r.count()}, q.count()), k, exclude_self).withColumnRenamed("id", id_col)


def proximity_scores(queries: DataFrame, scam: DataFrame, legit: DataFrame, k: int = 10, *, id_col: str = "vec_id", scale: float = 1.0) -> DataFrame:
    """(id, scam, legit, delta): means over the neighbours that exist in each class."""
    near = [class_knn(queries, refs, k, id_col=id_col).groupBy(id_col).agg((F.avg("similarity") * scale).alias(name)) for refs, name in ((scam, "scam"), (legit, "legit"))]
    both = queries.select(id_col).join(near[0], id_col, "left").join(near[1], id_col, "left")
    return both.select(id_col, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("scam", "legit"))).withColumn("delta", F.col("scam") - F.col("legit"))


def similar_messages(queries: DataFrame, references: DataFrame, texts: DataFrame, k: int = 3, *, id_col: str = "vec_id", text_col: str = "text") -> DataFrame:
    near = class_knn(queries, references, k, id_col=id_col)
    joined = near.join(texts.select(F.col(id_col).alias("ref_id"), F.substring(text_col, 1, 150).alias("snippet")), "ref_id")
    return joined.select(id_col, "ref_id", F.round("similarity", 4).alias("similarity"), "rank", "snippet")
