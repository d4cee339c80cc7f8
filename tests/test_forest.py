import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from palisade.operators import forest, tfidf, training
from palisade.operators.forest import ForestClassifier, ForestModel


@pytest.fixture(scope="module")
def rows(spark):
    rng, out, d = np.random.default_rng(1), [], 20
    for i in range(600):
        at = np.sort(rng.choice(d - 2, rng.integers(0, 9), replace=False))
        v, tail = np.round(rng.gamma(1, 1, len(at)), 2), np.round(rng.normal(size=2), 1)
        y = int(v[at < 4].sum() - 1 + tail[0] + rng.normal() * 0.5 > 0)
        x = Vectors.sparse(d, [*at.tolist(), d - 2, d - 1], [*v.tolist(), *tail.tolist()])
        out.append((i, y, x if i % 7 else Vectors.dense(x.toArray())))
    df = spark.createDataFrame([*out, *out[:50]], ["message_id", "label", "features"]).repartition(3).persist()
    yield df
    df.unpersist()


def found(model, df):
    got = model.transform(df).select("message_id", vector_to_array("probability").alias("p"), "prediction").collect()
    return sorted((r["message_id"], tuple(r["p"]), r["prediction"]) for r in got)


def test_a_tree_is_that_of_spark(rows, monkeypatch):
    """Also if few entries are counted at a time and few nodes meet in a task."""
    for bins, depth, least in ((32, 10, 1), (16, 4, 5)):
        want = DecisionTreeClassifier(maxBins=bins, maxDepth=depth, minInstancesPerNode=least, seed=42).fit(rows)
        got = ForestClassifier(numTrees=1, bootstrap=False, maxBins=bins, maxDepth=depth, minInstancesPerNode=least).fit(rows)
        assert len(got.trees[0]) == want.numNodes and found(got, rows) == found(want, rows)
        assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), atol=1e-12)
        monkeypatch.setattr(forest, "HELD", 500)
        monkeypatch.setattr(forest, "CELLS", 3_000)
        monkeypatch.setattr(forest, "BLOCK", 64)


def test_a_forest_is_the_same_for_any_layout_and_when_loaded(rows, tmp_path):
    least = ForestClassifier(numTrees=8, maxDepth=4)
    one = least.fit(rows.dropDuplicates(["message_id"]).coalesce(1).sortWithinPartitions("message_id"))
    other = least.fit(rows.dropDuplicates(["message_id"]).repartition(5))
    assert one.trees == other.trees and len({len(t) for t in one.trees}) > 1
    right = [p == (1.0 if m.asDict()["label"] else 0.0) for (_, _, p), m in zip(found(one, rows), sorted(rows.select("message_id", "label").collect()), strict=True)]
    assert np.mean(right) > 0.85
    one.write().overwrite().save(str(tmp_path / "m"))
    assert found(ForestModel.load(str(tmp_path / "m")), rows) == found(one, rows)


def test_tables_of_one_class_or_no_row(spark, rows):
    alone = ForestClassifier(numTrees=2).fit(rows.where("label = 0"))
    assert {p for _, p, _ in found(alone, rows)} == {(1.0, 0.0)}
    none = ForestClassifier(numTrees=1, bootstrap=False).fit(rows.where("false"))
    assert {p for _, p, _ in found(none, rows)} == {(0.0, 0.0)}


def test_rows_are_kept_as_their_own_entries(spark):
    """Blocks of 500 rows of 8,000 features, 20 of them not 0: Spark keeps 4 bytes for each feature, 16 MB."""
    rng = np.random.default_rng(2)
    data = [(k, k % 2, Vectors.sparse(8_000, np.sort(rng.choice(8_000, 20, replace=False)).tolist(), rng.random(20).tolist())) for k in range(500)]
    made = ForestClassifier()._binned(spark.createDataFrame(data, ["message_id", "label", "features"]))
    size = made.blocks.select(sum((F.length(c) for c in made.blocks.columns), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    made.blocks.unpersist()
    assert size < 500_000


def test_counts_hold_what_weights_need(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha gamma"), (2, ""), (3, None), (4, "beta beta delta")], "doc_id long, text string")
    for cut in (tfidf.word_terms(F.col("text")), tfidf.char_terms(F.col("text"))):
        vocabulary = tfidf.fit_vocabulary(docs, cut, 4, 12)
        kept = docs.select("doc_id", tfidf.counted(cut, vocabulary).alias("c"), tfidf.weights(cut, vocabulary).alias("w"))
        for r in kept.withColumn("v", tfidf.weighed(F.col("c"), vocabulary)).collect():
            assert r["v"] == r["w"]


def test_the_search_forms_all_forests_of_its_grid(rows):
    model, scores = training.random_search_rf(rows, draws=2, folds=2, grid={"numTrees": [2, 3], "maxDepth": [2, 3], "maxBins": [8, 16]})
    assert len(scores) == 2 and all(0.5 < s <= 1 for s in scores) and isinstance(model, ForestModel)


def test_the_query_searches_the_whole_grid(spark, rows, monkeypatch):
    from palisade.plans import table_queries

    asked = []
    monkeypatch.setattr(table_queries, "vector_parts", lambda *_: (rows.withColumn("message_id", F.col("message_id")), []))
    monkeypatch.setattr(training, "random_search_rf", lambda train, **how: asked.append(how) or (None, [0.5, 0.7]))
    table_queries.random_search_rf(spark, "")
    assert asked[0].get("grid") is None and asked[0]["draws"] == 5
