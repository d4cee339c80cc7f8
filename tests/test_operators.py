import datetime
import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import features, rules, text, tone, urls
from palisade.operators import conversations, corpus, evaluation, policy, proximity, tfidf, training, vector_index
from palisade.operators.signals import with_signals
from palisade.streaming import streams


def one(spark, value, make):
    df = spark.createDataFrame([(value,)], "text string").withColumn("low", F.lower("text"))
    return df.select(make().alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("message", "n"),
    [("urgent", 1), ("this is not urgent", 0), ("urgent urgent", 2), ("not a b c d e f urgent", 1), ("not a b c d e urgent", 0), ("", 0), (None, 0)],
)
def test_negation_window(spark, message, n):
    assert one(spark, message, lambda: tone.tone("low", ("urgent",))) == n


def test_text_normalisation(spark):
    assert one(spark, "🆓 ⚠️", lambda: text.preprocess_text(F.col("text"))) == "free warning"
    assert one(spark, "a 🎁 <b>x</b>  https://bit.ly/q y", lambda: text.preprocess_text(F.col("text"))) == "a gift x SHORTURL y"
    assert one(spark, "ﬁ", lambda: text.normalize_nfkc(F.col("text"))) == "fi"
    assert one(spark, None, lambda: text.normalize_nfkc(F.col("text"))) == ""
    assert one(spark, "H3LL0 @", lambda: text.leet_normalize(F.col("text"))) == "hello a"


def test_extract_urls(spark):
    found = one(spark, "see http://a.com/x and b.org, mail me@c.com, again b.org", lambda: urls.extract_urls(F.col("text")))
    assert found == ["http://a.com/x", "https://b.org"]
    assert one(spark, "no link", lambda: urls.trusted_all(urls.explicit_urls(F.col("text")))) is False
    assert one(spark, "https://www.irs.gov/a", lambda: urls.trusted_all(urls.explicit_urls(F.col("text")))) is True
    assert one(spark, "https://chase.com.evil.top", lambda: urls.trusted_all(urls.explicit_urls(F.col("text")))) is False


def test_scam_type_ties_go_to_the_first(spark):
    types = {"a": ("x",), "b": ("y",)}
    assert one(spark, "x y", lambda: features.scam_type(features.type_scores(F.col("low"), types))) == "a"
    assert one(spark, "z", lambda: features.scam_type(features.type_scores(F.col("low"), types))) == rules.DEFAULT_TYPE


def test_append_skips_known_and_repeated(spark):
    known = spark.createDataFrame([(7, "a known message of some length")], "message_id long, text string")
    batch = spark.createDataFrame([(1, " a known message of some length "), (2, "short"), (3, "a new message of some length"), (4, "a new message of some length"), (5, None), (6, "another message of some length")], "pos long, text string")
    got = corpus.corpus_append(known, batch).orderBy("pos").collect()
    assert [(r["message_id"], r["pos"]) for r in got] == [(8, 3), (9, 6)]


def test_policy_keeps_bounds(spark):
    cols = {"legit_phrase_score": 0, "scam_phrase_score": 2, "sender_impersonation_score": 0, "currency_symbol_count": 0, "url_suspicious_tld": 0, "url_suspicious_keyword": 0, "url_has_ip": 0, "tone_urgency": 0, "tone_fear": 0, "tone_reward": 0, "tone_threat": 0, "romance": 0, "outreach": 0, "soft_invest": 0, "malicious": 0, "suspicious": 0, "n_urls": 0}
    df = spark.range(101).select((F.col("id") / 100.0).alias("prob"), *[F.lit(v).alias(k) for k, v in cols.items()], F.lit("general_spam").alias("scam_type"), F.lit(False).alias("trusted"), F.lit(False).alias("otp"), F.lit(False).alias("flagged"))
    rows = policy.verdicts(df).collect()
    assert all(r["p"] >= 0.72 and r["verdict"] == "SCAM" and 2 <= r["confidence"] <= 98 for r in rows)
    assert {r["why_flagged"] for r in rows} == {"known_phrases"}
    plain = df.withColumn("scam_phrase_score", F.lit(0)).withColumn("prob", F.lit(0.9))
    assert {r["why_flagged"] for r in policy.verdicts(plain).collect()} == {"subtle_patterns"}
    assert {r["why_flagged"] for r in policy.verdicts(plain.withColumn("scam_type", F.lit("phishing"))).collect()} == {"like_phishing"}
    assert {r["why_flagged"] for r in policy.verdicts(plain.withColumn("prob", F.lit(0.1))).collect()} == {""}
    many = df.withColumns({"url_has_ip": F.lit(1), "sender_impersonation_score": F.lit(2), "url_suspicious_tld": F.lit(1), "malicious": F.lit(1)})
    assert policy.verdicts(many).first()["why_flagged"] == "dangerous_link|ip_link|fake_company_link"


@pytest.mark.parametrize(("n", "final", "starts"), [(1, 0, [0]), (2, 1, [0, 1]), (5, 3, [0, 2, 4]), (90, 62, list(range(0, 90, 2)))])
def test_windows(spark, n, final, starts):
    turns = spark.createDataFrame([(1, k, f"a turn that is long enough {k}") for k in range(n)], "conv_id long, turn long, text string")
    rows = conversations.segments(conversations.by_chat(turns)).collect()
    assert sorted(r["start"] for r in rows if r["kind"] == "window") == starts
    assert [r["start"] for r in rows if r["kind"] == "final"] == [final]


def test_chat_formats(spark):
    texts = [
        "[1/2/2024, 10:00] A: hi\n[1/2/2024, 10:01] B: there",
        "1/2/2024, 10:00 - A: hi",
        "a plain line of text\nshort",
        "[1/2/2024, 10:00:33 AM] A: one: two\n[1/2/24,10:00] B B: three",
        "1/2/2024, 10:00 PM - A: hi",
    ]
    chats = spark.createDataFrame(list(enumerate(texts, 1)), "conv_id long, text string")
    got = {(r["conv_id"], r["turn"]): (r["timestamp"], r["sender"], r["text"]) for r in conversations.parse_chat_export(chats).collect()}
    assert got == {
        (1, 0): ("1/2/2024, 10:00", "A", "hi"), (1, 1): ("1/2/2024, 10:01", "B", "there"), (2, 0): ("1/2/2024, 10:00", "A", "hi"), (3, 0): ("", "Unknown", "a plain line of text"),
        (4, 0): ("1/2/2024, 10:00:33 AM", "A", "one: two"), (4, 1): ("1/2/24,10:00", "B B", "three"), (5, 0): ("1/2/2024, 10:00 PM", "A", "hi"),
    }


@pytest.mark.parametrize(("word", "n"), [("maple", 2), ("table", 2), ("agree", 2), ("the", 1), ("queue", 1), ("banana!", 3), ("rhythm", 1), ("idea", 2), ("don't", 1)])
def test_syllables(spark, word, n):
    assert one(spark, word, lambda: features.syllable_count(features.bare_word(F.col("text")))) == n


@pytest.mark.parametrize(
    ("message", "found"),
    [
        ("see http://y.com/z] now", ["http://y.com/z"]),
        ("it's http://a.com/o'brien and http://a.zz/q|x", ["http://a.com/o'brien", "http://a.zz/q"]),
        ("log in at paypal-verify.com/login or irs.gov", ["https://paypal-verify.com/login", "https://irs.gov"]),
        ("me@bank.com and me@mail.bank.com", ["https://bank.com"]),
        ("http://x.com and x.com and shop.co.uk/a", ["http://x.com", "https://shop.co.uk/a"]),
        ("no.suffix here. None", []),
        (None, None),
    ],
)
def test_links(spark, message, found):
    assert one(spark, message, lambda: urls.extract_urls(F.col("text"))) == found


def test_bare_hosts_reach_every_scorer(spark):
    df = spark.createDataFrame([(1, "log in at paypal-verify.com/login"), (2, "see irs.gov"), (3, "write to me@example.org please")], "message_id long, text string")
    got = {r["message_id"]: r for r in features.with_parts(df).select("message_id", *[c.alias(k) for k, c in features.engineered().items()]).collect()}
    assert got[1]["url_suspicious_keyword"] == 1 and got[1]["sender_impersonation_score"] == 3
    assert got[2]["url_suspicious_keyword"] == 0 and got[2]["sender_impersonation_score"] == 0
    assert got[3]["url_suspicious_keyword"] == 0


def test_rules_have_word_borders(spark):
    kind = lambda m: one(spark, m, lambda: features.scam_type(features.type_scores(F.col("low"))))
    assert kind("the first thing to wonder about") == rules.DEFAULT_TYPE
    assert one(spark, "I wonder what wonders", lambda: tone.tone("low", rules.TONE["reward"])) == 0
    assert one(spark, "you won, you have won", lambda: tone.tone("low", rules.TONE["reward"])) == 2
    assert kind("my uncle taught me to trade and showed you how i invest") == "pig_butchering"


def test_approximate_neighbours_recall(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(16)]) for k in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 20 = 0")
    exact = {(r["vec_id"], r["ref_id"]) for r in proximity.class_knn(asked, df).collect()}
    index = vector_index.build(df, str(tmp_path / "i"))
    found = {(r["vec_id"], r["ref_id"]) for r in vector_index.search(asked, index).collect()}
    assert len(exact) == 400 and len(exact & found) >= 0.9 * len(exact)


def test_neighbours_across_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, [float(rng.randint(-2, 2)) for _ in range(3)]) for k in range(60)]  # many ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    read = lambda: sorted((r["vec_id"], r["rank"], r["ref_id"]) for r in proximity.class_knn(df, df, 5).collect())
    whole = read()
    monkeypatch.setattr(proximity, "BLOCK", 16)
    monkeypatch.setattr(proximity, "CHUNK", 25)
    assert read() == whole and len(whole) == 300


def test_time_to_live_stream_over_batches(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(k, "a" if k % 3 else None, t0 + datetime.timedelta(minutes=7 * k + (k % 5))) for k in range(120)]
    schema = "event_id int, k string, ts timestamp"
    want = {r["event_id"] for r in streams.dedup_ttl_batch(spark.createDataFrame(rows, schema), "ts", ["k"], 3600, "event_id").collect()}
    for at in range(0, 120, 30):
        spark.createDataFrame(rows[at : at + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def drain():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        kept = streams.dedup_ttl_stream(stream, "ts", ["k"], 3600, "event_id")
        kept.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return [r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]

    got = drain()
    assert len(got) == len(want) and set(got) == want
    assert sorted(drain()) == sorted(got)  # started again, it replays nothing
    late = [(200, "a", t0 + datetime.timedelta(days=2)), (201, "a", t0 + datetime.timedelta(days=2, minutes=30))]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert set(drain()) == want | {200}


def test_bare_models_get_the_default_threshold(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(k, k % 2, float(k % 2) + k / 100) for k in range(20)], "message_id long, label int, x double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression(maxIter=5)]).fit(df)
    for name, threshold, found in (("new", 0.3, 0.3), ("old", None, 0.5)):
        training.artefact_sink(model, threshold, str(tmp_path / name))
        loaded, t = training.artefact_source(str(tmp_path / name))
        assert t == found and [r["prob"] for r in training.probabilities(loaded, df).collect()] == [r["prob"] for r in training.probabilities(model, df).collect()]


def test_record_of_a_short_text(spark):
    df = spark.createDataFrame([(1, "short", 0.5), (2, "act now, verify your account at http://paypal-login.xyz/a", 0.5)], "message_id long, text string, prob double")
    rows = with_signals(df, ("message_id", "text", "prob")).withColumns({"flagged": F.lit(False), "malicious": F.lit(0), "suspicious": F.lit(0)})
    rows = policy.verdicts(rows).withColumns({"leet": text.leet_normalize(F.col("text")), "proximity_score": F.lit(0.0), "key_present": F.lit(True), "threat_type": F.lit(None).cast("string"), "contributions": F.create_map(F.lit("a"), F.lit(0.5))})
    got = rows.select(*[c.alias(k) for k, c in policy.prediction_record().items()]).collect()
    assert len(got[0]) == 25
    short, long = sorted(got, key=lambda r: r["verdict"] != "TOO_SHORT")
    assert short["warnings"] == ["too_short"] and short["feature_contributions"] == {} and short["urls_found"] == [] and short["scam_type"] is None and short["vt_malicious"] == 0 and short["gsb_flagged"] is None
    assert long["verdict"] == "SCAM" and long["why_flagged"].startswith("fake_company_link|odd_suffix_link") and long["urls_found"] == ["http://paypal-login.xyz/a"] and long["feature_contributions"] == {"a": 0.5}


def test_auc_with_ties_and_bounds(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (1, 0.5, 1), (0, 0.5, 1), (0, 0.1, 0)], "label int, prob double, pred int")
    assert evaluation.auc(df).first()["auc"] == pytest.approx(0.875)
    assert evaluation.threshold_sweep(df).first()["threshold"] == 0.4
    assert {(r["label"], r["pred"]): r["n"] for r in evaluation.confusion_matrix(df).collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 2}


def test_knn_self_match_and_few_neighbours(spark):
    df = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(4)], "vec_id long, embedding array<float>")
    got = proximity.class_knn(df, df.where("vec_id < 2"), 10).collect()
    assert len(got) == 8
    assert {r["vec_id"]: r["ref_id"] for r in got if r["rank"] == 1}[1] == 1


def test_split_is_stratified_and_disjoint(spark):
    df = spark.range(200).select(F.col("id").alias("message_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    got = {(r["label"], r["is_test"]): r["count"] for r in training.stratified_split(df).groupBy("label", "is_test").count().collect()}
    assert got == {(0, True): 30, (0, False): 120, (1, True): 10, (1, False): 40}


def test_tfidf_has_unit_rows(spark):
    df = spark.createDataFrame([(1, "red green red"), (2, "green blue"), (3, "")], "doc_id long, text string")
    got = tfidf.tfidf(df, tfidf.word_terms(F.col("text")), 100).groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert {r["doc_id"] for r in got} == {1, 2}
    assert all(abs(r["s"] - 1) < 1e-9 for r in got)


def test_greedy_time_to_live(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(k, "a", t0 + datetime.timedelta(minutes=m)) for k, m in enumerate((0, 30, 59, 60, 90, 200))]
    df = spark.createDataFrame(rows, "event_id int, k string, ts timestamp")
    got = streams.dedup_ttl_batch(df, "ts", ["k"], 3600, "event_id").collect()
    assert sorted(r["event_id"] for r in got) == [0, 3, 5]


def test_queries_have_names_in_common():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "channel_scam_language" in entry.queries()


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-500:]


def test_greedy_time_to_live_cuts_large_keys(spark, monkeypatch):
    monkeypatch.setattr(streams, "SLICE", 40)
    rng = random.Random(4)
    t0 = datetime.datetime(2024, 1, 1)
    gaps = {"hot": 400, "dense": 20, "cold": 5000, None: 700}
    rows, want = [], set()
    for k, gap in gaps.items():
        at = 0
        for _ in range(30 if k == "cold" else 900):
            at += rng.choice([0, rng.randint(1, gap), gap])
            rows.append((len(rows), k, t0 + datetime.timedelta(seconds=at)))
        last = None
        for i, _, t in (r for r in rows if r[1] == k):
            if last is None or (t - last).total_seconds() >= 3600:
                last = t
                want.add(i)
    df = spark.createDataFrame(rows, "event_id int, k string, ts timestamp")
    assert {r["event_id"] for r in streams.dedup_ttl_batch(df, "ts", ["k"], 3600, "event_id").collect()} == want
    sizes = streams.time_slices(df, "ts", ["k"], "event_id").groupBy("k", "__slice").count().agg(F.max("count")).first()[0]
    assert sizes < 120  # no array holds a whole key


def test_one_pattern_for_many(spark):
    import random
    import re as python_re

    families = [*rules.TONE.values(), *rules.SCAM_TYPES.values(), rules.ROMANCE, rules.SOFT_INVEST, (r"\b(?:a)?b\b", r"\b(?:x)|(?:y)\b", r"\b(?:[qr]s)\b", r"\b(?:c?d(?:e|f))\b")]
    rng, words = random.Random(2), []
    for p in (p for f in families for p in f):
        words += python_re.sub(r"\\.|[^a-z0-9 ]+", " ", p.replace("[0-9]+", "7")).split()
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) + rng.choice(["", "s", ".", "_", "\n", "é"]) for _ in range(3_000)]
    lines += ["you have won", "xact now", "act now", "act nowx", "$5 bonus", "earn $5", "ab", "b", "y", "zy", "qs", "cde", "df", "", "é act fast"]
    for family in families:
        joined, each = python_re.compile(text.any_of(family)), [python_re.compile(p) for p in family]
        assert [bool(joined.search(x)) for x in lines] == [any(p.search(x) for p in each) for x in lines]
    frame = spark.createDataFrame([(x,) for x in lines], "t string")
    for family in families[:6]:
        assert frame.where(F.col("t").rlike(text.any_of(family)) != (text.count_matching(F.col("t"), family) > 0)).count() == 0


def test_documents_of_one_row_group_are_dealt_over_all_cores(spark):
    from palisade.plans.fixtures import dealt

    rows = spark.range(0, 1_000, 1, 1).unionByName(spark.range(0, 0, 1, 20))  # many splits, one with rows
    sizes = [len(x) for x in dealt(rows, "id").rdd.glom().collect()]
    assert sum(sizes) == 1_000 and max(sizes) < 300


def test_patterns_are_found_by_their_pieces(spark):
    from palisade.functions import patterns

    assert patterns.needles(r"\b(?:urgent(?:ly)?)\b") == {"urgent"}
    assert patterns.needles(r"\b(?:dear|darling)\b") == {"ear", "arling"}
    assert patterns.needles("[0-9]+") == set()
    rng, words = random.Random(5), "your account card is was suspended locked not never urgent urgently dear double act now 24 hours within you won have".split()
    lines = [" ".join(rng.choices(words, k=9)) for _ in range(300)] + ["", "urgent\x01not urgent"]
    families = features.MARKS | {"any": patterns.Family(("[0-9]+", "a|b?"))}
    finder, every = patterns.Finder(families), patterns.Finder(families)
    every.always = list(range(len(every.rules)))  # all patterns on all texts
    assert [finder.counts(x) for x in lines] == [every.counts(x) for x in lines]
    assert one(spark, "your account\u2028 is blocked", lambda: tone.tone("low", rules.TONE["fear"])) == 1  # a dot is any sign but a line feed
    assert one(spark, None, lambda: features.opener_hits(F.col("low"), rules.ROMANCE)) is None


def test_terms_of_a_text_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "Red  green, red\tx"), (2, "green blue")], "doc_id long, text string")
    got = tfidf.tfidf(df, tfidf.char_terms(F.col("text")), 100)
    assert "hashpartitioning(doc_id" not in got._jdf.queryExecution().toString()
    held = {r["term"] for r in got.where("doc_id = 1").collect()}
    assert {" re", "n, ", " x ", "reen,"} <= held and not any(t[1:-1].count(" ") for t in held)
    assert {r["term"] for r in tfidf.tfidf(df, tfidf.word_terms(F.col("text")), 100).where("doc_id = 1").collect()} == {"red", "green", "red green", "green red"}


def test_character_terms_by_keys_equal_those_by_pieces():
    from collections import Counter

    rng = random.Random(3)
    letters = "abcdé ü\x00 日本\U0001f600. "
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(60))).split(" ")) for _ in range(80)] + ["", " ", "a", " ab", "".join(map(chr, range(0x4E00, 0x5E10)))]
    tf, df = Counter(), Counter()
    for t in texts:
        found = tfidf.Terms("char").counts(t)
        tf.update(found)
        df.update(found.keys())
    got_tf, got_df = Counter(), Counter()
    for terms, n, docs in tfidf.char_totals(texts):
        got_tf.update(dict(zip(terms, n, strict=True)))
        got_df.update(dict(zip(terms, docs, strict=True)))
    assert (got_tf, got_df) == (tf, df)
    places = {t: i for i, t in enumerate(sorted(tf)[::3])}
    plain = tfidf.Terms("char", places)
    for t in texts:
        at, n = plain.arrays(t)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == plain.counts(t) and at.tolist() == sorted(at.tolist())
