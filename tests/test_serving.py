import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from palisade.functions import phrases, rules, text
from palisade.operators import policy, serving

WORDS = ["alpha", "beta", "gamma", "delta"]
SCHEMA = "message_id long, text string, embedding array<float>, label int, key_present boolean"


def rows():
    out = []
    for k in range(40):
        bad = k % 2
        words = " ".join(WORDS[(k * 3 + j) % 4] for j in range(8)) + (" claim your prize, act now or lose it" if bad else " thanks for your order")
        vector = None if k % 5 == 0 else [float(bad), 1.0, float(k % 3)]
        out.append((k, words, vector, bad, k % 3 != 0))
    return [*out, (40, None, None, 0, True), (41, "", [0.0, 0.0, 0.0], 0, None), (42, "see http://bad.example.tk/login now please", None, 1, False)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    df = spark.createDataFrame(rows(), SCHEMA)
    vectors = df.where("embedding is not null").select("embedding", (F.lit(5) * (1 - F.col("label"))).alias("label"))
    model = serving.fit_serving(df, vectors, LogisticRegression(maxIter=10, regParam=0.01), word_terms=20, char_terms=30)
    path = str(tmp_path_factory.mktemp("serving") / "set")
    model.write().overwrite().save(path)
    return df, model, path


def probabilities(model, df):
    return {r["message_id"]: (r["prob"], r["positive"]) for r in model.transform(df).collect()}


def test_the_serving_set_is_the_same_in_another_session(spark, stored):
    df, model, path = stored
    want = probabilities(model, df)
    assert probabilities(PipelineModel.load(path), df) == want
    code = f"""
import json, sys; sys.path[:0] = [{str(Path(__file__).parents[1])!r}, {str(Path(__file__).parent)!r}]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from pyspark.ml import PipelineModel
from test_serving import rows, SCHEMA, probabilities
print("FOUND" + json.dumps(sorted((k, *v) for k, v in probabilities(PipelineModel.load({path!r}), spark.createDataFrame(rows(), SCHEMA)).items())))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
    assert "FOUND" in out.stdout, out.stderr[-800:]
    assert [tuple(x) for x in json.loads(out.stdout.split("FOUND")[1])] == sorted((k, *v) for k, v in want.items())


def test_vectors_hold_unit_blocks_and_scaled_numbers(spark, stored):
    df, model, _ = stored
    vectorizer = next(s for s in model.stages if isinstance(s, serving.MessageVectorizerModel))
    n_words = sum(kind == "word" for kind, _, _ in vectorizer.vocabulary)
    got = model.transform(df).select("message_id", "text_length", vector_to_array("features").alias("v")).toPandas().sort_values("message_id")
    v = np.array(got["v"].to_list())
    assert v.shape[1] == len(vectorizer.names) == len(vectorizer.vocabulary) + len(serving.NUMERIC)
    norms = np.linalg.norm(v[:, :n_words], axis=1)
    assert all(abs(x - 1) < 1e-9 or x == 0 for x in norms) and norms[40] == 0
    first = v[:, len(vectorizer.vocabulary)]
    assert abs(first.mean()) < 1e-9 and abs(first.std() - 1) < 1e-9


def test_stored_phrases_are_those_that_score(spark, tmp_path):
    stage = serving.MessageFeatures({"scam": {"alpha": 3}, "legit": {"beta": 2}})
    stage.write().overwrite().save(str(tmp_path / "f"))
    df = spark.createDataFrame([(1, "alpha beta alpha")], "message_id long, text string")
    r = serving.MessageFeatures.load(str(tmp_path / "f")).transform(df).first()
    assert (r["scam_phrase_score"], r["legit_phrase_score"]) == (3, 2)


def test_linear_risk_and_its_contributions(spark, tmp_path):
    serving.LinearRisk([("a", 1.0, 2.0, 0.5), ("b", 0.0, 1.0, -1.0)], 0.25).write().save(str(tmp_path / "l"))
    r = serving.LinearRisk.load(str(tmp_path / "l")).transform(spark.createDataFrame([(3.0, None)], "a double, b double")).first()
    assert r["contributions"] == {"a": 0.5, "b": 0.0} and r["prob"] == round(1 / (1 + np.exp(-0.75)), 4)


def test_the_record_on_a_stream_is_that_of_a_batch(spark, stored, tmp_path):
    from palisade.streaming import streams

    df, model, _ = stored
    links = spark.createDataFrame([("http://bad.example.tk/login", True, "MALWARE", 1, 0)], "url string, flagged boolean, threat_type string, malicious int, suspicious int")
    want = {r["message_id"]: r.asDict() for r in serving.score(df, model, links).collect()}
    assert want[42]["gsb_flagged"] and want[42]["gsb_threat_type"] == "MALWARE" and want[42]["urls_found"] == ["http://bad.example.tk/login"]
    assert want[40]["verdict"] == want[41]["verdict"] == "TOO_SHORT"
    for k in range(2):
        df.where(F.col("message_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.stream_score(stream, model, links)
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert {r["message_id"]: r.asDict() for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_phrase_scores_count_each_phrase_once(spark):
    scores = {"x": {"aa": 1, "aab": 2, "": 5}, "y": {"aa": 10}}
    df = spark.createDataFrame([("aaab aa",), ("",), (None,), ("b",)], "t string")
    assert [tuple(r["s"]) for r in df.select(phrases.phrase_scores(F.col("t"), scores).alias("s")).collect()] == [(3, 10), (0, 0), (0, 0), (0, 0)]
    for cues in (rules.LEGIT_PHRASES, dict.fromkeys(rules.PHRASES, 1)):
        sample = spark.createDataFrame([(" ".join(list(cues)[:7]),), ("no action is needed, do not share this code",)], "t string")
        both = sample.select(text.count_contained(F.col("t"), cues).alias("a"), phrases.phrase_scores(F.col("t"), {"s": cues})["s"].alias("b")).collect()
        assert all(r["a"] == r["b"] for r in both)


def test_rule_tables_of_many_phrases(spark):
    table = spark.range(50_000).select(F.lit("n").alias("score"), F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("q")).alias("phrase"), F.lit(1).alias("weight"))
    table = table.unionByName(spark.createDataFrame([("n", "p7q", 4), (None, "x", 1), ("m", None, 1)], "score string, phrase string, weight int"))
    got = phrases.with_phrase_scores(spark.createDataFrame([("p7q p8q p8q", 1)], "low string, n_ int"), table).first()
    assert got["n"] == 6 and got["low"] == "p7q p8q p8q"
    with pytest.raises(ValueError):
        old, phrases.MOST_BYTES = phrases.MOST_BYTES, 10
        try:
            phrases.rules_of(table)
        finally:
            phrases.MOST_BYTES = old


def test_reasons_as_sentences(spark):
    df = spark.createDataFrame([("ip_link|urgency", ["http://1.2.3.4/a"]), ("like_romance_scam", []), ("", []), (None, None)], "why_flagged string, urls array<string>")
    got = [r["x"] for r in df.select(policy.reason_texts().alias("x")).collect()]
    assert "http://1.2.3.4/a" in got[0][0] and got[0][1] == policy.REASON_TEXTS["urgency"]
    assert got[1] == ["The text reads like a case of romance scam."] and got[2] == got[3] == []
    assert set(policy.REASON_TEXTS) == {code for code, _ in policy.REASONS} | {"subtle_patterns"}


def test_contributions_are_rounded_as_their_sql_does(spark):
    """0.06495 x 10,000 is 649.4999... in doubles."""
    df = spark.createDataFrame([(0.2598, 57, 800)], "a double, n int, size int")
    stage = serving.LinearRisk([("a", 0.0, 2.0, 0.5)], 0.0)
    assert stage.transform(df).first()["contributions"] == {"a": 0.0649}
    assert df.select(text.rounded(text.share(F.col("n"), F.col("size")), 4).alias("x")).first()["x"] == 0.0712


def test_pieces_are_cut_once_for_a_word(monkeypatch):
    """Counts equal those of all terms one by one, and a word that repeats is not cut again."""
    texts = ["Alpha beta alpha", "", "a  été beta beta \U0001f600", "alpha alpha alpha"]
    cut, pieces = [], serving._pieces
    want_tf, want_df = Counter(), Counter()
    for t in texts:
        want_tf.update(serving.terms_of(t, "char"))
        want_df.update(set(serving.terms_of(t, "char")))
    monkeypatch.setattr(serving, "_pieces", lambda w: cut.append(w) or pieces(w))
    counter, known = serving.PieceCounter(), {p: k + 3 for k, p in enumerate(sorted(want_tf)) if k % 2}
    for t in texts:
        counter.add(t)
    got = {r.term: (r.tf, r.df) for r in counter.counts().itertuples()}
    assert got == {p: (n, want_df[p]) for p, n in want_tf.items()}
    assert sorted(cut) == sorted({w for t in texts for w in t.lower().split()})
    places = serving.PiecePlaces(known, len(want_tf) + 3)
    for t in texts:
        at, n = places(t)
        want = sorted((known[p], c) for p, c in Counter(p for w in t.lower().split() for p in pieces(w)).items() if p in known)
        assert list(zip(at.tolist(), n.tolist(), strict=True)) == want


def test_all_vectors_of_the_class_are_neighbours(spark, tmp_path):
    """Of 20,600 vectors each one counts, in blocks, from the fitted stage and from the stored one."""
    rng = np.random.default_rng(3)
    known = rng.normal(size=(20_600, 4)).astype(np.float32)
    vectors = spark.createDataFrame(pd.DataFrame({"embedding": known.tolist(), "label": np.arange(len(known)) % 5}), "embedding array<float>, label int")
    others = spark.createDataFrame([([9.0, 9.0, 9.0, 9.0], 5), ([9.0, 9.0, 9.0, 8.0], None), (None, 1)], vectors.schema)
    stage = serving.NeighbourProximity().fit(vectors.unionByName(others))
    assert sum(stage.sizes) == len(known) and len(stage.blocks) > 1
    stage.write().overwrite().save(str(tmp_path / "n"))
    loaded = serving.NeighbourProximityModel.load(str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n" / "vectors")).count() == len(known)
    asked = rng.normal(size=(50, 4)).astype(np.float32)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)] + [(50, None), (51, [0.0] * 4)], "id int, embedding array<float>")
    unit = known.astype(np.float64) / np.linalg.norm(known.astype(np.float64), axis=1, keepdims=True)
    s = asked.astype(np.float64) @ unit.T / np.linalg.norm(asked.astype(np.float64), axis=1, keepdims=True)
    want = [*np.sort(s, axis=1)[:, -10:].mean(axis=1), 0.0, 0.0]
    for model in (stage, loaded):
        got = {r["id"]: r["proximity_score"] for r in model.transform(queries).collect()}
        assert np.allclose([got[k] for k in range(52)], want, atol=6e-5)
    few = serving.NeighbourProximity().fit(vectors.limit(3))
    assert abs(few.transform(queries).where("id = 0").first()["proximity_score"]) <= 1
    assert serving.NeighbourProximity().fit(vectors.limit(0)).transform(queries).where("proximity_score <> 0").count() == 0


def test_vocabularies_are_the_same_if_few_terms_are_held(spark, monkeypatch):
    """A task holds a bounded number of words, of pairs and of pieces, however many there are; before it was a million of each."""
    assert serving.MOST_COUNTED <= 100_000
    texts = [(" ".join(f"w{(k * j) % 37}x" for j in range(1, 30)), float(k)) for k in range(40)]
    df = spark.createDataFrame([*texts, (None, None), ("one", 1.0)], "text string, a double").coalesce(2)

    def fitted():
        stage = serving.MessageVectorizer()
        stage._set(wordTerms=30, charTerms=40, numericCols=["a"])
        return stage.fit(df)

    want = fitted()
    monkeypatch.setattr(serving, "MOST_COUNTED", 5)
    got = fitted()
    assert got.vocabulary == want.vocabulary and got.scales == want.scales
    v = [r["features"].toArray() for r in got.transform(df).select("features").collect()]
    assert all(np.isfinite(x).all() for x in v) and [x[:30].any() for x in v].count(False) == 2
