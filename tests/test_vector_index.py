import random

import numpy as np
import pytest

from palisade.operators import proximity, vector_index

SCHEMA = "vec_id long, embedding array<float>, list string, shelf int"


def rows(n=1_500, dims=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    out = [(k, (centres[k % 12] + rng.normal(size=dims) * 0.7).astype(np.float32).tolist(), "x", 1) for k in range(n)]
    out += [(n, None, "x", 1), (n + 1, [None] * dims, "x", 1), (n + 2, [float("nan")] * dims, "x", 1), (n + 3, [0.0] * dims, "x", 1), (n + 4, [1.0] * 3, "x", 1), (n + 5, [float("inf")] * dims, "x", 1)]
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    df = spark.createDataFrame(rows(), SCHEMA)
    path = str(tmp_path_factory.mktemp("index") / "i")
    return df, vector_index.build(df, path, sample=800), path


def test_recall_and_rows_looked_at(spark, built):
    df, index, path = built
    queries = df.where("vec_id % 20 = 0")
    got = vector_index.search(queries, vector_index.load(spark, path)).toPandas()
    want = proximity.class_knn(queries.where("vec_id < 1500"), df.where("vec_id < 1500")).toPandas()
    found = set(zip(got["vec_id"], got["ref_id"], strict=True)) & set(zip(want["vec_id"], want["ref_id"], strict=True))
    assert len(found) >= 0.9 * len(want)
    assert got.groupby("vec_id")["looked"].first().mean() < 0.1 * 1_500
    assert index.rows == sum(index.sizes.values()) == 1_500 and 1_500 not in set(got["vec_id"])


def test_a_stored_index_is_the_one_that_was_built(spark, built):
    df, index, path = built
    loaded = vector_index.load(spark, path)
    assert np.array_equal(loaded.centres, index.centres) and loaded.sizes == index.sizes and np.array_equal(loaded.bar_codes, index.bar_codes)
    assert all(np.array_equal(a, b) for a, b in zip(loaded.books, index.books, strict=True))


def test_one_query_reads_few_folders(spark, built):
    df, index, _ = built
    plan = vector_index.search(df.where("vec_id = 0"), index, probes=1)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "shelf" in text.split("PartitionFilters")[1][:200]


def test_hot_lists_are_cut_into_chunks(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    data = [(k, [1.0, 0.0, rng.random() * 1e-3, 0.0], "x", 1) for k in range(300)] + [(300 + k, [rng.random() for _ in range(4)], "x", 1) for k in range(50)]
    df = spark.createDataFrame(data, SCHEMA)
    whole = vector_index.search(df.where("vec_id % 50 = 0"), vector_index.build(df, str(tmp_path / "a"))).toPandas()
    monkeypatch.setattr(vector_index, "CHUNK_ROWS", 40)
    cut = vector_index.search(df.where("vec_id % 50 = 0"), vector_index.load(spark, str(tmp_path / "a"))).toPandas()
    key = ["vec_id", "rank"]
    assert whole.sort_values(key)[["vec_id", "ref_id", "rank"]].values.tolist() == cut.sort_values(key)[["vec_id", "ref_id", "rank"]].values.tolist()


def test_an_empty_table_has_no_index(spark, tmp_path):
    assert vector_index.build(spark.createDataFrame([(1, None, "x", 1)], SCHEMA), str(tmp_path / "e")) is None


def test_many_queries_are_compared_a_few_at_a_time(built, monkeypatch):
    import pandas as pd

    _, index, _ = built
    q = np.random.default_rng(2).normal(size=(600, 24))
    pdf = pd.DataFrame({"id": range(600), "v": list(q / np.linalg.norm(q, axis=1, keepdims=True))})
    seen, bars = [], type(index).bars
    monkeypatch.setattr(type(index), "bars", lambda self, x: seen.append(len(x)) or bars(self, x))
    chunks = dict.fromkeys(range(len(index.centres)), 1)
    got = pd.concat(vector_index.asked_lists(index, pdf, chunks))
    assert max(seen) <= vector_index.ASKED and sum(seen) == 600
    assert got["id"].nunique() == 600 and len(got) == 600 * index.probes
