import datetime
import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import rules, urls
from palisade.operators import analytics, corpus, domains, reputation
from palisade.sources import chat_files
from palisade.streaming import streams

T0 = datetime.datetime(2024, 1, 1)
LINKS = [
    (1, ["https://www.google.com/a", "http://mail.google.com:80/b"]), (2, ["https://google.com.evil.tk"]), (3, []), (4, None), (5, ["https://paypal.com", "https://paypa1.com"]),
    (6, ["https://secure-paypal.com"]), (7, ["https://verify.example.org/x"]), (8, ["https://x.example.org"]), (9, ["https://user@PayPal.com/login"]), (10, ["https://notpaypal.com", None]),
]


def test_domain_tables_judge_as_the_lists_do(spark):
    df = spark.createDataFrame(LINKS, "message_id int, urls array<string>").withColumn("urls", F.filter("urls", lambda u: u.isNotNull()))
    trusted = spark.createDataFrame([(d,) for d in rules.TRUSTED], "domain string")
    brands = spark.createDataFrame([(b, d) for b, own in rules.BRANDS.items() for d in own], "brand string, domain string")
    both = domains.lookalike_by_table(domains.trusted_by_table(df, trusted), brands)
    same = both.select("*", F.coalesce(urls.trusted_all(F.col("urls")), F.lit(False)).alias("t"), F.coalesce(F.exists("urls", lambda u: urls.lookalike(u)), F.lit(False)).alias("l")).collect()
    assert len(same) == 10 and all(r["trusted"] == r["t"] and r["lookalike"] == r["l"] for r in same)
    assert {r["message_id"] for r in same if r["trusted"]} == {1, 9}


def test_a_large_domain_table_is_no_literal(spark):
    table = spark.range(100_000).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".example")).alias("domain"))
    df = spark.createDataFrame([(1, ["http://a.b.d99999.example/x"]), (2, ["http://d100000.example"])], "message_id int, urls array<string>")
    out = domains.trusted_by_table(df, table)
    assert {r["message_id"]: r["trusted"] for r in out.collect()} == {1: True, 2: False}
    assert "d99999" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["trusted"] for r in domains.trusted_by_table(df, table.limit(0)).collect()] == [False, False]


def test_the_last_check_before_each_row(spark):
    rng = random.Random(2)
    at = lambda minutes: T0 + datetime.timedelta(minutes=minutes)
    checks = [(rng.choice("abc"), at(rng.randint(0, 4_000)), rng.random() < 0.5, rng.randint(0, 3), k) for k in range(60)] + [("a", None, True, 9, 9), (None, at(1), True, 9, 9)]
    rows = [(k, "a" if k % 3 else rng.choice("abcd"), at(rng.randint(0, 5_000))) for k in range(400)] + [(900, None, at(5)), (901, "a", None)]
    known = spark.createDataFrame([(u, t, f, f"T{m}", m, s) for u, t, f, m, s in checks], "url string, checked_at timestamp, flagged boolean, threat_type string, malicious int, suspicious int")
    asked = spark.createDataFrame(rows, "message_id int, url string, ts timestamp")

    def last(u, t):
        before = [c for c in checks if u is not None and t is not None and c[0] == u and c[1] is not None and c[1] <= t]
        best = max(before, key=lambda c: (c[1], c[2], f"T{c[3]}", c[3], c[4]), default=None)
        return (best[1], best[2], best[3]) if best and t - best[1] <= datetime.timedelta(hours=24) else (None, None, None)

    for size in (4_000, 20):
        got = reputation.known_before(asked, known, "ts", slice_rows=size).collect()
        assert sorted((r["message_id"], r["url"], r["checked_at"], r["flagged"], r["malicious"]) for r in got if r["url"]) == sorted((i, u, *last(u, t)) for i, u, t in rows if u)
        assert len(got) == len(rows)


def test_looked_up_sums_as_the_join_does(spark):
    known = spark.createDataFrame([("u1", True, "A", 5, 1), ("u2", False, None, 2, 3), ("u3", True, "B", 0, 0)], "url string, flagged boolean, threat_type string, malicious int, suspicious int")
    df = spark.createDataFrame([(1, ["u1", "u2", "u3", "u2"]), (2, ["u2", "zz"]), (3, []), (4, None), (5, ["zz", "u1"])], "message_id long, urls array<string>")
    a = {r["message_id"]: tuple(r)[2:] for r in reputation.looked_up(df, known).collect()}
    b = {r["message_id"]: tuple(r)[1:5] for r in reputation.url_reputation_join(reputation.url_explode(df), known).collect()}
    assert a[3] == a[4] == (False, 0, 0, None) and {k: a[k] for k in b} == b


def test_embedding_plan_and_upsert(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (None, "x")], "message_id long, text string")
    stored = spark.createDataFrame([(1, "a", [1.0]), (2, "B", [2.0]), (4, None, [4.0]), (9, "z", [9.0])], "message_id long, text string, e array<double>").withColumn("content_hash", corpus.content_hash()).drop("text")
    plan = corpus.embedding_plan(texts, stored)
    assert {r["message_id"]: r["action"] for r in plan.collect()} == {1: "kept", 2: "changed", 3: "new", 4: "kept", 9: "gone"}
    rebuilt = corpus.embedding_plan(texts, stored, rebuild=True)
    assert {r["message_id"]: r["action"] for r in rebuilt.collect()} == {1: "changed", 2: "changed", 3: "new", 4: "changed", 9: "gone"}
    fresh = texts.where("message_id is not null").select("message_id", F.array(F.lit(0.5)).alias("e"), corpus.content_hash().alias("content_hash"))
    after = corpus.embedding_upsert(stored, fresh, plan)
    assert {r["message_id"]: r["e"][0] for r in after.collect()} == {1: 1.0, 2: 0.5, 3: 0.5, 4: 4.0}
    assert {r["action"] for r in corpus.embedding_plan(texts, after).collect()} == {"kept"}


def test_sketches_are_near_the_exact_quartiles_and_merge(spark):
    rng = random.Random(3)
    rows = [(k % 4, "ab"[k % 2], int(rng.expovariate(0.01))) for k in range(20_000)] + [(0, "a", None)]
    df = spark.createDataFrame(rows, "day int, source string, n int")
    whole = {r["source"]: r for r in analytics.box_from_sketches(analytics.quantile_sketches(df, "n", "source"), "source").collect()}
    days = analytics.quantile_sketches(df, "n", "day", "source")
    merged_table = analytics.merged_sketches(days, "source")
    merged = {r["source"]: r for r in analytics.box_from_sketches(merged_table, "source").collect()}
    for s in "ab":
        values = sorted(n for _, source, n in rows if source == s and n is not None)
        rank = lambda x: sum(v <= x for v in values) / len(values)
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert abs(rank(whole[s][name]) - p) < 0.01 and abs(rank(merged[s][name]) - p) < 0.01
    exact = {(r["source"], r["bin"]): r["n"] for r in analytics.histogram(df.where("n is not null"), "n", 10, "source").collect()}
    near = {(r["source"], r["bin"]): r["n"] for r in analytics.histogram_from_sketches(merged_table, 10, "source").collect()}
    assert all(abs(exact.get(k, 0) - near.get(k, 0)) < 0.01 * 10_000 for k in set(exact) | set(near))
    assert analytics.quantile_sketches(df.limit(0), "n", "source").collect() == []


@pytest.fixture
def uploads(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b" hello \xff there \n")
    (root / "sub" / "b.LOG").write_text("x" * 100_000)
    (root / "c.csv").write_text("x" * 100_001)
    (root / "d.txt").write_text(" \n")
    (root / "e.json").write_text("{}")
    (root / "f.txt").write_bytes(b"y" * 1_048_577)
    (root / "_g.txt").write_text("no upload")
    return root


def test_chat_files_with_reasons(spark, uploads):
    chat_files.register(spark)
    df = spark.read.format("palisade_chats").option("path", str(uploads)).option("taskBytes", 1).load()
    got = {r["path"].rsplit("/", 1)[1]: (r["text"] and r["text"][:20], r["reason"]) for r in df.collect()}
    assert got == {"a.txt": ("hello  there", None), "b.LOG": ("x" * 20, None), "c.csv": (None, "length"), "d.txt": (None, "empty"), "e.json": (None, "type"), "f.txt": (None, "size")}
    assert df.rdd.getNumPartitions() == 6
    assert spark.read.format("palisade_chats").option("path", str(uploads / "none")).load().collect() == []


def test_a_stream_of_chat_files_picks_up_a_new_one(spark, uploads, tmp_path):
    chat_files.register(spark)

    def drain():
        stream = spark.readStream.format("palisade_chats").option("path", str(uploads)).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        return sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = drain()
    assert first == ["a.txt", "b.LOG", "c.csv", "d.txt", "e.json", "f.txt"]
    (uploads / "new.txt").write_text("a new chat")
    assert drain() == sorted([*first, "new.txt"])


def test_repeats_on_a_stream_have_the_first_record(spark, tmp_path):
    spark.conf.set(*streams.ROCKS)
    minutes = [("a", 0), ("a", 30), ("b", 31), ("a", 59), ("a", 60), ("a", 90), ("b", 95), ("a", 119), ("a", 200), ("b", 100)]
    rows = [(k, key, T0 + datetime.timedelta(minutes=m), f"r{k}") for k, (key, m) in enumerate(minutes)]
    df = spark.createDataFrame(rows, "event_id int, key string, ts timestamp, record string")
    for part in (df.where("event_id < 3"), df.where("event_id between 3 and 6"), df.where("event_id > 6")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.reuse_ttl_stream(stream, "ts", ["key"], 3600, "event_id", "record")
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    got = {r["event_id"]: (r["record"], r["reused"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {0: ("r0", False), 1: ("r0", True), 2: ("r2", False), 3: ("r0", True), 4: ("r4", False), 5: ("r4", True), 6: ("r6", False), 7: ("r4", True), 8: ("r8", False), 9: ("r6", True)}
    assert got == want


def test_keys_of_a_bucket_share_a_state(spark, tmp_path):
    """One bucket holds all keys, null ones and long ones among them; a state is read and written once a batch, not once a key."""
    spark.conf.set(*streams.ROCKS)
    big = (1 << 53) + 1
    rows = [(big + k, [None, big, big + 1, 7][k % 4], ["x", None][k // 4 % 2], T0 + datetime.timedelta(minutes=k), f"r{k}") for k in range(160)]
    df = spark.createDataFrame(rows, "event_id long, user long, kind string, ts timestamp, record string")
    for part in (df.where(f"event_id < {big + 80}"), df.where(f"event_id >= {big + 80}")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.reuse_ttl_stream(stream, "ts", ["user", "kind"], 3600, "event_id", "record", buckets=1)
    assert out.schema.simpleString() == "struct<event_id:bigint,user:bigint,kind:string,ts:timestamp,record:string,reused:boolean>"
    query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 6
    last, want = {}, {}
    for i, user, kind, at, record in rows:
        again = (user, kind) in last and at - last[user, kind][0] < datetime.timedelta(hours=1)
        if not again:
            last[user, kind] = (at, record)
        want[i] = (user, kind, last[user, kind][1], again)
    assert {r["event_id"]: (r["user"], r["kind"], r["record"], r["reused"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
