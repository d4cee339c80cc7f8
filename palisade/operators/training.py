"""Splits, Spark ML estimators, calibration and selection."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.text import rounded
from palisade.operators.forest import ForestClassifier, fit_all


def stratified_split(df: DataFrame, test_share: float = 0.2, *, id_col: str = "message_id", label: str = "label", seed: int = 42) -> DataFrame:
    """Adds ``is_test``: of each label, the share with the least hashes, the same rows in every run.

    The cut-off is the hash's quantile of each label, so no label is sorted in one task.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("long")
    rows = df.withColumn("__h", h)
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    cuts = {}
    for y, n in counts.items():
        k = round(n * test_share)
        cuts[y] = _kth_least(rows.where(F.col(label).eqNullSafe(F.lit(y))).select("__h"), k)
    test = F.lit(False)
    for y, c in cuts.items():
        if c is not None:
            test = test | (F.col(label).eqNullSafe(F.lit(y)) & (F.col("__h") <= c))
    return rows.withColumn("is_test", test).drop("__h")


def _kth_least(values: DataFrame, k: int) -> int | None:
    """The k-th least value, by narrowing buckets of the 32-bit range: counts of 4,096 buckets meet at the driver."""
    if k < 1:
        return None
    low, width = 0, 1 << 32
    while width > 1:
        step = max(1, width // 4096)
        inside = values.where((F.col("__h") >= low) & (F.col("__h") < low + width))
        seen = 0
        for r in inside.groupBy(F.floor((F.col("__h") - low) / step).alias("b")).count().orderBy("b").collect():
            if seen + r["count"] >= k:
                low, width, k = low + r["b"] * step, step, k - seen
                break
            seen += r["count"]
        else:
            return low + width
    return low


def fold_column(df: DataFrame, k: int = 5, *, id_col: str = "message_id", label: str = "label") -> DataFrame:
    """Adds ``fold`` 0..k-1, even within each label."""
    part = Window.partitionBy(label, F.pmod(F.xxhash64(id_col), F.lit(64))).orderBy(F.crc32(F.col(id_col).cast("string")), id_col)
    return df.withColumn("fold", F.pmod(F.row_number().over(part), F.lit(k)).cast("int"))


def assemble_features(rows: DataFrame, columns: list[str], blocks: list[tuple[str, int]], *, out: str = "features") -> DataFrame:
    """One sparse vector for each row: the blocks (columns of places and weights, as :func:`tfidf.weights` makes them; and the
    block's size) side by side, then the numeric columns, null as 0. Spark makes no sparse vectors from arrays, so batches are
    written as the vectors' own structs."""
    names, sizes = [name for name, _ in blocks], [n for _, n in blocks]
    size, bases, last = sum(sizes) + len(columns), np.cumsum([0, *sizes]).tolist(), np.arange(len(columns))
    kept = [c for c in rows.columns if c not in set(names)]
    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).cast("array<double>")
    rows = rows.select(*kept, *names, numbers.alias("__z"))

    def vectors(batches):
        for batch in batches:
            n = batch.num_rows
            parts = [(batch.column(name).field("place"), batch.column(name).field("weight"), base) for name, base in zip(names, bases, strict=False)]
            lengths = [pc.fill_null(pc.list_value_length(place), 0).to_numpy(zero_copy_only=False).astype(np.int64) for place, _, _ in parts]
            lengths.append(np.full(n, len(columns)))
            ends = np.cumsum(np.concatenate([[0], sum(lengths)]))
            at, values, start = np.empty(ends[-1], np.int32), np.empty(ends[-1]), ends[:-1].copy()
            for (place, weight, base), length in zip(parts, lengths, strict=False):
                to = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
                at[to] = place.flatten().to_numpy(zero_copy_only=False) + base
                values[to] = weight.flatten().to_numpy(zero_copy_only=False)
                start += length
            to = start[:, None] + last
            at[to] = bases[-1] + last
            values[to] = batch.column("__z").flatten().to_numpy(zero_copy_only=False).reshape(n, len(columns))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (at, values)]
            sparse = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.StructArray.from_arrays(sparse, ["type", "size", "indices", "values"])], [*kept, out])

    return rows.mapInArrow(vectors, T.StructType([*rows.select(*kept).schema.fields, T.StructField(out, VectorUDT())]))


def estimators(n: int) -> dict:
    """The three classifiers; logistic regression's strength matches one penalised by 1/n a row."""
    return {
        "lr": LogisticRegression(maxIter=100, regParam=1.0 / max(n, 1), standardization=False),
        "dt": ForestClassifier(numTrees=1, maxDepth=10, bootstrap=False, seed=42),
        "rf": ForestClassifier(numTrees=100, maxDepth=10, seed=42),
    }


def probabilities(model, df: DataFrame, id_col: str = "message_id") -> DataFrame:
    return model.transform(df).select(id_col, "label", vector_to_array("probability")[1].alias("prob"), F.col("prediction").cast("int").alias("pred"))


def isotonic_calibrate(held: DataFrame, scored: DataFrame) -> DataFrame:
    """``scored`` with prob calibrated on held-out (prob, label) rows, clipped to 0..1."""
    model = IsotonicRegression(featuresCol="prob", labelCol="label").fit(held.select("prob", F.col("label").cast("double")))
    fixed = model.transform(scored.withColumnRenamed("prob", "raw").withColumn("prob", F.col("raw")))
    return fixed.withColumn("calibrated", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("prediction")


def random_search_rf(train: DataFrame, draws: int = 5, folds: int = 3, seed: int = 42, grid: dict[str, list] | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows):
    """The best forest among seeded draws from a grid, by cross-validated F1. ``prepare`` adds the vectors where they are read, if
    ``train`` has none; so they are not kept."""
    grid = grid or {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15, 20], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2"], "maxBins": [32, 64, 128]}
    rng, metric = random.Random(seed), MulticlassClassificationEvaluator(metricName="f1")
    drawn = [ForestClassifier(seed=seed, **{k: rng.choice(v) for k, v in grid.items()}) for _ in range(draws)]
    rows, scores = fold_column(train, folds).persist(), []  # even within each label
    for k in range(folds):
        held = prepare(rows.where(F.col("fold") == k))
        scores.append([metric.evaluate(model.transform(held)) for model in fit_all(prepare(rows.where(F.col("fold") != k)), drawn)])
    means = np.mean(scores, axis=0).tolist()
    best = drawn[means.index(max(means))].fit(prepare(rows))
    rows.unpersist()
    return best, means


def stratified_cv(train: DataFrame, estimator, folds: int = 5, id_col: str = "message_id", prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> list[float]:
    """F1 of each fold. ``prepare`` as in :func:`random_search_rf`."""
    rows, out = fold_column(train, folds, id_col=id_col).persist(), []
    for k in range(folds):
        model = estimator.fit(prepare(rows.where(F.col("fold") != k)))
        out.append(MulticlassClassificationEvaluator(metricName="f1").evaluate(model.transform(prepare(rows.where(F.col("fold") == k)))))
    rows.unpersist()
    return out


def feature_importance_topk(spark: SparkSession, model, names: list[str], k: int = 20) -> DataFrame:
    rows = [(n, float(x)) for n, x in zip(names, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)


def feature_contributions(scaled: DataFrame, coefficients: dict[str, float], id_col: str = "message_id") -> DataFrame:
    """(id, contributions): coefficient x scaled value of each feature, four decimals."""
    keys = F.array(*[F.lit(n) for n in coefficients])
    values = F.array(*[rounded(F.col(n) * F.lit(b), 4) for n, b in coefficients.items()])
    return scaled.select(id_col, F.map_from_arrays(keys, values).alias("contributions"))


def contribution_topk(contributions: DataFrame, k: int = 12, id_col: str = "message_id") -> DataFrame:
    """The k largest by absolute value in each row's own map; no shuffle."""
    entries = F.transform(F.map_entries("contributions"), lambda e: F.struct((-F.abs(e["value"])).alias("s"), e["key"].alias("feature"), e["value"].alias("contribution")))
    top = contributions.select(id_col, F.posexplode(F.slice(F.sort_array(entries), 1, k)).alias("pos", "e"))
    return top.select(id_col, (F.col("pos") + 1).alias("rank"), F.col("e.feature").alias("feature"), F.col("e.contribution").alias("contribution"))


def artefact_sink(model: PipelineModel, threshold: float | None, path: str) -> None:
    """A fitted pipeline, and its threshold as a table beside it; without a threshold, the older format of a bare model."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    if threshold is not None:
        spark.createDataFrame([(float(threshold),)], "threshold double").write.mode("overwrite").parquet(f"{path}/threshold")


def artefact_source(path: str, default: float = 0.5) -> tuple[PipelineModel, float]:
    """The pipeline and threshold; a model stored alone gets the default threshold."""
    spark = SparkSession.getActiveSession()
    model = PipelineModel.load(f"{path}/model")
    try:
        return model, spark.read.parquet(f"{path}/threshold").first()["threshold"]
    except Exception as e:  # only a missing table means the older format
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return model, default
