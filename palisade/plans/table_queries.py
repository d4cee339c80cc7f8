"""Queries over the corpus tables, feeds, TF-IDF, vectors, chats, streams and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import rules, text, urls
from palisade.operators import conversations, corpus, policy, proximity, reputation, serving, tfidf, training, vector_index
from palisade.plans import fixtures as fx
from palisade.plans import message_queries as mq
from palisade.plans.fixtures import messages, quoted, read, scratch
from palisade.operators.signals import with_signals
from palisade.plans.report_queries import rounded
from palisade.sources import chat_files, feeds
from palisade.streaming import streams

QUERIES, ORACLE_SQL = {}, {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = sql


# --- corpus
def corpus_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).withColumn("channel_id", F.expr("CASE channel WHEN 'en' THEN 1 WHEN 'fr' THEN 3 WHEN 'de' THEN 4 ELSE 5 END")).withColumn("source_id", F.expr("cast(substring(source, 4) as int)"))
    channels = spark.createDataFrame([(1, "email"), (3, "sms"), (4, "url")], "channel_id int, channel string")
    sources = rows.select("source_id", "source").distinct()
    stats = rows.select("message_id", *[c.alias(n) for n, c in text.basic_features(F.col("text")).items()])
    return corpus.corpus_join(rows.select("message_id", "channel_id", "source_id", "text", "label"), channels, sources, stats).select("message_id", "channel", "source", "label", "text_length", "word_count", "url_count")


_add("corpus_join", corpus_join, f"""WITH {fx.MESSAGES} SELECT message_id, CASE channel WHEN 'en' THEN 'email' WHEN 'fr' THEN 'sms' ELSE 'url' END AS channel, source, label, length(text) AS text_length,
len({fx.words('text')}) AS word_count, {fx.count('text', 'https?://[^ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n]+')} AS url_count FROM messages WHERE channel IN ('en', 'fr', 'de')""")


def corpus_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents appended to the benchmark texts as the corpus that is there."""
    known = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("message_id"), "text")
    batch = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    return corpus.corpus_append(known, batch).select("message_id", "pos", F.char_length("text").alias("n"))


_NEW = """t AS (SELECT doc_id AS pos, trim(text) AS text FROM documents WHERE length(trim(text)) >= 20),
f AS (SELECT text, min(pos) AS pos FROM t GROUP BY text), new AS (SELECT * FROM f WHERE text NOT IN (SELECT text FROM benchmark))"""
_add("corpus_append", corpus_append, f"WITH {_NEW} SELECT (SELECT max(item_id) FROM benchmark) + row_number() OVER (ORDER BY pos) AS message_id, pos, length(text) AS n FROM new")


def source_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "documents").select("source")
    known = names.where("source in ('src0', 'src1', 'src2')").distinct().select(F.expr("cast(substring(source, 4) as int) + 1").alias("source_id"), "source")
    return corpus.source_get_or_create(known, names)


_add("source_get_or_create", source_get_or_create, """WITH n AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), k AS (SELECT CAST(substring(source, 4) AS INT) + 1 AS source_id, source FROM n WHERE source IN ('src0', 'src1', 'src2'))
SELECT source_id, source FROM k UNION ALL SELECT CAST((SELECT max(source_id) FROM k) + row_number() OVER (ORDER BY source) AS INT), source FROM n WHERE source NOT IN (SELECT source FROM k)""")
_add("lure_wrap", lambda s, d: corpus.lure_wrap(read(s, d, "pages").select("page_id", "url"), "page_id").select("page_id", "text"), "SELECT page_id, replace(CASE page_id % " + str(len(rules.LURES)) + " " + " ".join(f"WHEN {k} THEN {quoted(x)}" for k, x in enumerate(rules.LURES)) + " END, '{url}', url) AS text FROM pages")


def label_balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select("message_id", "label")
    return corpus.label_balance_report(rows.where("message_id % 3 <> 0"), rows.where("message_id % 3 = 0"))


_add("label_balance_report", label_balance_report, f"WITH {fx.MESSAGES} SELECT count(*) FILTER (WHERE message_id % 3 <> 0) AS n_before, count(*) AS n_after, count(*) FILTER (WHERE label = 1) AS scam_after, count(*) FILTER (WHERE label = 0) AS legit_after FROM messages")
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be embedded, from the hashes that stored vectors remember: every seventh text has changed since, and
    every eleventh vector is of a text that is gone."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), "text")
    then = F.when(F.col("message_id") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_id"))
    stored = docs.join(vectors, "message_id").select(F.when(F.col("message_id") % 11 == 5, F.col("message_id") + 10**9).otherwise(F.col("message_id")).alias("message_id"), then.alias("text"))
    return corpus.embedding_plan(docs, stored.select("message_id", corpus.content_hash().alias("content_hash")))


_add("embedding_reuse", embedding_reuse, """WITH v AS (SELECT vec_id FROM embeddings), stored AS (SELECT doc_id + CASE WHEN doc_id % 11 = 5 THEN 1000000000 ELSE 0 END AS id, sha256(text || CASE WHEN doc_id % 7 = 3 THEN '!' ELSE '' END) AS h FROM documents JOIN v ON vec_id = doc_id)
SELECT coalesce(d.doc_id, s.id) AS message_id, CASE WHEN d.doc_id IS NULL THEN 'gone' WHEN s.id IS NULL THEN 'new' WHEN s.h <> sha256(d.text) THEN 'changed' ELSE 'kept' END AS action FROM documents d FULL JOIN stored s ON s.id = d.doc_id""")


def feed_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    read(spark, sf_dir, "pages").select(F.concat(F.lit(" "), "url", F.lit(" ")).alias("value")).write.text(path)
    return feeds.feed_lines_scan(spark, path)


def feed_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    read(spark, sf_dir, "pages").select("page_id", "url", F.lit("a, b").alias("note")).write.option("header", True).option("compression", "gzip").csv(path)
    return feeds.feed_csv_scan(spark, path)


_FEED = "SELECT trim(url) AS url FROM pages WHERE regexp_matches(url, '(?i)^https?://') ORDER BY 1 LIMIT "
_add("feed_lines_scan", feed_lines_scan, _FEED + "2000")
_add("feed_csv_scan", feed_csv_scan, _FEED + "5000")


# --- chats
def chat_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats as exported text: by id, bracketed lines, dashed lines, or bare lines."""
    turns = read(spark, sf_dir, "conversations").withColumn("said", F.regexp_replace("text", "[\r\n]+", " "))
    minute, way = F.format_string("10:%02d", (F.col("turn") % 60).cast("int")), F.col("conv_id") % 4
    bracket = F.concat(F.when(way == 3, "01/02/2024,").otherwise("01/02/2024, "), minute, F.when(way == 1, ":07").when(way == 2, " PM").when(way == 3, ":07 AM").otherwise(""))
    dash = F.concat(F.lit("01/02/2024, "), minute, F.when(way % 2 == 1, " PM").otherwise(""))
    line = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("["), bracket, F.lit("] "), "role", F.lit(": "), "said")).when(F.col("conv_id") % 3 == 1, F.concat(dash, F.lit(" - "), "role", F.lit(": "), "said")).otherwise(F.col("said"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def conversation_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats written as files of several kinds, and read back with the reasons of those that are rejected: of ten ids one has
    no text, one has too much and one is of a wrong type."""
    path, kind = scratch(spark), F.col("conv_id") % 10
    said = F.when(kind == 7, F.lit(" ")).when(kind == 8, F.repeat(F.rpad(F.lit("x"), 1_000, "y"), 101)).otherwise(F.col("text"))
    chats = chat_exports(spark, sf_dir).select(F.concat(said, F.lit("\n")).alias("value"), "conv_id")
    chats.where("conv_id % 10 <> 9").write.partitionBy("conv_id").text(path)
    chats.where("conv_id % 10 = 9").write.mode("append").partitionBy("conv_id").json(path)
    chat_files.register(spark)
    rows = spark.read.format("palisade_chats").option("path", path).load()
    return rows.select(F.regexp_extract("path", "conv_id=([0-9]+)", 1).cast("long").alias("conv_id"), F.char_length("text").alias("n"), "reason")


_MINUTE = "'10:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0')"
_BRACKET = f"CASE WHEN conv_id % 4 = 3 THEN '01/02/2024,' ELSE '01/02/2024, ' END || {_MINUTE} || CASE conv_id % 4 WHEN 1 THEN ':07' WHEN 2 THEN ' PM' WHEN 3 THEN ':07 AM' ELSE '' END"
_DASH = f"'01/02/2024, ' || {_MINUTE} || CASE WHEN conv_id % 2 = 1 THEN ' PM' ELSE '' END"
_EXPORT = f"""lines AS (SELECT conv_id, turn, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS said, role, {_BRACKET} AS bracket, {_DASH} AS dash FROM conversations), exports AS (
SELECT conv_id, string_agg(CASE WHEN conv_id % 3 = 0 THEN '[' || bracket || '] ' || role || ': ' || said WHEN conv_id % 3 = 1 THEN dash || ' - ' || role || ': ' || said ELSE said END, chr(10) ORDER BY turn) AS text FROM lines GROUP BY conv_id)"""
_add("conversation_file_scan", conversation_file_scan, f"""WITH {_EXPORT}, r AS (SELECT conv_id, regexp_replace(trim(text), '\\s+$', '') AS text,
CASE WHEN conv_id % 10 = 9 THEN 'type' WHEN conv_id % 10 = 8 THEN 'length' WHEN conv_id % 10 = 7 OR trim(text) = '' THEN 'empty' WHEN length(trim(text)) > 100000 THEN 'length' END AS reason FROM exports)
SELECT conv_id, CASE WHEN reason IS NULL THEN length(text) END AS n, reason FROM r""")
_add("parse_chat_export", lambda s, d: conversations.parse_chat_export(chat_exports(s, d)), f"""WITH {_EXPORT}, r AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN bracket ELSE dash END AS timestamp, role AS sender, trim(said) AS text FROM lines WHERE conv_id % 3 < 2 AND trim(said) <> ''
UNION ALL SELECT conv_id, turn, '', 'Unknown', trim(said) FROM lines WHERE conv_id % 3 = 2 AND length(trim(said)) > 10)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS turn, timestamp, sender, text FROM r""")

_chats = lambda s, d: conversations.by_chat(read(s, d, "conversations"))
_VALID = "v AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE length(trim(text)) > 5), chats AS (SELECT conv_id, list(t ORDER BY turn, t) AS texts, len(list(t)) AS n FROM v GROUP BY conv_id)"
_SEGMENTS = f"""{_VALID}, starts AS (SELECT conv_id, texts, n, least(5, n) AS size, unnest(range(0, n, greatest(1, least(5, n) // 2))) AS start FROM chats), segments AS (
SELECT conv_id, n, 'full' AS kind, 0 AS start, array_to_string(texts, ' ') AS text FROM chats
UNION ALL SELECT conv_id, n, 'window', start, array_to_string(texts[start + 1 : start + size], ' ') FROM starts WHERE length(array_to_string(texts[start + 1 : start + size], ' ')) >= 20
UNION ALL SELECT conv_id, n, 'final', CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT), array_to_string(texts[CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) + 1 :], ' ') FROM chats WHERE length(array_to_string(texts[CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) + 1 :], ' ')) > 20)"""
_add("valid_turns", lambda s, d: conversations.valid_turns(read(s, d, "conversations")), f"WITH {_VALID} SELECT conv_id, CAST(k - 1 AS INT) AS idx, texts[k] AS text FROM chats, unnest(range(1, n + 1)) AS t(k)")
for _kind, _name in (("full", "full_text_score"), ("window", "message_windows"), ("final", "final_segment")):
    _add(_name, lambda s, d, k=_kind: conversations.segments(_chats(s, d)).where(F.col("kind") == k).select("conv_id", "start", F.char_length("text").alias("n_chars"), F.md5("text").alias("digest")), f"WITH {_SEGMENTS} SELECT conv_id, start, length(text) AS n_chars, md5(text) AS digest FROM segments WHERE kind = '{_kind}'")


def cued_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats' turns, each with a cue by its place, so that the policy has something to find."""
    cue = F.element_at(F.array(*[F.lit(c) for c in fx.CUES]), ((F.col("conv_id") + F.col("turn")) % len(fx.CUES) + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), cue).alias("text"))


def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the chats scored by the verdict policy; the probability before it adds up what was found. Links are
    checked in the full text and in the final part, not in windows."""
    parts = conversations.segments(conversations.by_chat(cued_turns(spark, sf_dir)))
    linked = urls.with_links(parts.where("kind <> 'window'")).select(F.explode(F.slice("urls", 1, reputation.FIRST)).alias("url"))
    path = scratch(spark)
    reputation.fresh(mq.reputation_by_rule(linked), mq.ASOF).write.parquet(path)
    rows = with_signals(parts, ("conv_id", "kind", "start", "n", "text"))
    found = F.col("tone_urgency") + F.col("tone_fear") + F.col("tone_reward") + F.col("tone_threat")
    prob = F.least(F.lit(0.95), F.lit(0.05) + F.lit(0.10) * found + F.lit(0.12) * F.col("scam_phrase_score") + F.lit(0.15) * F.col("url_suspicious_keyword"))
    rows = rows.withColumns({"prob": F.round(prob, 6), "checked": F.when(F.col("kind") == "window", F.array().cast("array<string>")).otherwise(F.col("urls"))})
    rows = reputation.looked_up(rows, spark.read.parquet(path), "checked").drop("checked")
    conf = F.when(F.char_length(F.trim("text")) < text.MIN_CHARS, 0.0).otherwise(F.col("confidence") / 100)
    return policy.verdicts(rows).withColumn("conf", conf)


_CUED = "conversations AS (SELECT conv_id, turn, text || ' ' || CASE (conv_id + turn) % " + str(len(fx.CUES)) + f" {fx._CASES} END AS text FROM main.conversations)"
_RISK = f"""{_CUED}, {_SEGMENTS}, {mq.parts_sql('segments')}, s0 AS MATERIALIZED ({mq.signals_sql('conv_id, kind, start, n, text')}),
links AS (SELECT conv_id, kind, start, k - 1 AS pos, urls[k] AS url FROM m, unnest(range(1, least(len(urls), 3) + 1)) AS t(k) WHERE kind <> 'window'), {mq._REPUTATION},
rep AS ({mq._ROLLED.replace('message_id', 'conv_id, kind, start')}),
signals AS MATERIALIZED (SELECT s0.*, coalesce(rep.flagged, false) AS flagged, coalesce(rep.malicious, 0) AS malicious, coalesce(rep.suspicious, 0) AS suspicious, round(least(CAST(0.95 AS DOUBLE), CAST(0.05 AS DOUBLE) + CAST(0.10 AS DOUBLE) * (tone_urgency + tone_fear + tone_reward + tone_threat) + CAST(0.12 AS DOUBLE) * scam_phrase_score + CAST(0.15 AS DOUBLE) * url_suspicious_keyword), 6) AS prob FROM s0 LEFT JOIN rep ON rep.conv_id = s0.conv_id AND rep.kind = s0.kind AND rep.start = s0.start),
{mq.verdicts_sql()}, s AS (SELECT *, CASE WHEN length(trim(text)) < 20 THEN 0.0 ELSE confidence / 100 END AS conf, {mq.WHY} AS why_flagged FROM verdicts),
p AS (SELECT conv_id, max(n) AS n_turns, max(CASE WHEN kind = 'full' THEN conf END) AS full_score, coalesce(max(CASE WHEN kind = 'window' THEN least(conf * (CAST(start AS DOUBLE) / n + 1.0), 1.0) END), 0.0) AS peak, max(CASE WHEN kind = 'final' THEN conf END) AS final FROM s GROUP BY conv_id),
risk AS (SELECT conv_id, n_turns, full_score, peak, coalesce(final, full_score) AS final_score, round((CAST(0.40 AS DOUBLE) * full_score + CAST(0.35 AS DOUBLE) * peak + CAST(0.25 AS DOUBLE) * coalesce(final, full_score)) * 100, 1) AS risk FROM p),
verdict AS (SELECT *, CASE WHEN risk >= 43 THEN 'SCAM' WHEN risk >= 30 THEN 'SUSPICIOUS' ELSE 'LEGIT' END AS verdict FROM risk)"""
_risk = lambda s, d: conversations.conversation_risk(segment_scores(s, d))
_add("window_peak", lambda s, d: _risk(s, d).select("conv_id", "peak"), f"WITH {_RISK} SELECT conv_id, round(peak, 6) AS peak FROM verdict")
_add("conversation_risk", lambda s, d: _risk(s, d).select("conv_id", "risk"), f"WITH {_RISK} SELECT conv_id, risk FROM verdict")
_add("conversation_verdict", lambda s, d: _risk(s, d).select("conv_id", "verdict"), f"WITH {_RISK} SELECT conv_id, verdict FROM verdict")
_add("conversation_record", lambda s, d: conversations.conversation_record(_risk(s, d), cued_turns(s, d)).withColumn("urls_found", F.array_join("urls_found", " ")), f"""WITH {_RISK}
SELECT v.conv_id, v.verdict AS overall_verdict, v.risk AS risk_score, (SELECT count(*) FROM main.conversations c WHERE c.conv_id = v.conv_id) AS total_messages, n_turns AS messages_analyzed, round(full_score * 100, 1) AS full_conversation_score,
  round(peak * 100, 1) AS window_analysis_score, round(final_score * 100, 1) AS final_messages_score, why_flagged, array_to_string(urls, ' ') AS urls_found, malicious AS vt_malicious, flagged AS gsb_flagged, tone_urgency, tone_fear, tone_reward, tone_threat, scam_type
FROM verdict v JOIN s ON s.conv_id = v.conv_id AND s.kind = 'full'""")
_expected = lambda s, d: _risk(s, d).withColumn("expected", F.when(F.col("conv_id") % 2 == 0, "LEGIT").otherwise("SCAM"))
_add("conversation_suite", lambda s, d: conversations.conversation_suite(_expected(s, d)), f"WITH {_RISK}, e AS (SELECT verdict, CASE WHEN conv_id % 2 = 0 THEN 'LEGIT' ELSE 'SCAM' END AS expected FROM verdict) SELECT count(*) AS n, count(*) FILTER (WHERE verdict = expected) AS passed, count(*) FILTER (WHERE verdict = expected AND expected = 'SCAM') AS scam_passed, count(*) FILTER (WHERE verdict = expected AND expected = 'LEGIT') AS legit_passed FROM e")

# --- TF-IDF
_STOP = ", ".join(map(quoted, tfidf.STOP))
_WT = f"ws AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), {quoted(tfidf.WORD)}), lambda w: w NOT IN ({_STOP})) AS w FROM documents), t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ws)"
_CT = "ws AS (SELECT doc_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) || ' ' AS w FROM documents), t AS (SELECT doc_id, unnest(flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(w) - n + 2, 1)), lambda i: substring(w, i, n))))) AS term FROM ws)"


def _tfidf_sql(terms: str, size: int, fit: str = "true") -> str:
    return f"""WITH {terms}, c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term), nd AS (SELECT count(*) AS n FROM documents WHERE {fit}),
voc AS (SELECT term, ln((1.0 + (SELECT n FROM nd)) / (1.0 + count(*))) + 1.0 AS idf FROM c WHERE {fit} GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {size}),
raw AS (SELECT c.doc_id, c.term, (ln(tf) + 1.0) * idf AS w FROM c JOIN voc ON c.term = voc.term), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id)
SELECT raw.doc_id, term, round(w / norm, 6) AS weight FROM raw JOIN nm ON raw.doc_id = nm.doc_id"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.dealt(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def tfidf_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on even ids, applied to all."""
    docs, cut = _documents(spark, sf_dir), tfidf.word_terms(F.col("text"))
    even = docs.where("doc_id % 2 = 0")
    return tfidf.weigh(docs, cut, tfidf.fit_vocabulary(even, cut, even.count(), 2000))


_add("word_tfidf", lambda s, d: tfidf.tfidf(_documents(s, d), tfidf.word_terms(F.col("text")), 5000), _tfidf_sql(_WT, 5000))
_add("char_tfidf", lambda s, d: tfidf.tfidf(_documents(s, d), tfidf.char_terms(F.col("text")), 3000), _tfidf_sql(_CT, 3000))
_add("tfidf_transform", tfidf_transform, _tfidf_sql(_WT, 2000, "doc_id % 2 = 0"))
NUMERIC = list(mq.NUMERIC)


def numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 26 numeric features of each message. They are read more than once, so they are kept."""
    fx.small_batches(spark)
    rows = mq.with_proximity(spark, sf_dir, with_signals(messages(spark, sf_dir), ("message_id", "label", "text")))
    rows = rows.withColumn("proximity_scam_score", F.col("proximity_score") * 0.5)
    return rows.select("message_id", "label", "text", *[F.col(c).cast("double").alias(c) for c in NUMERIC]).persist()


_NUM = f"""{fx.MESSAGES}, {mq.parts_sql()}, s0 AS MATERIALIZED ({mq.signals_sql('message_id, label, text')}), {mq.NEAR},
f AS MATERIALIZED (SELECT message_id, label, {', '.join(f"CAST({'round(coalesce(near.scam, 0.0), 4) * CAST(0.5 AS DOUBLE)' if c == 'proximity_scam_score' else c} AS DOUBLE) AS {c}" for c in NUMERIC)} FROM s0 LEFT JOIN near ON near.vec_id = s0.message_id)"""
_Z = ", ".join(f"round(({c} - (SELECT avg({c}) FROM f)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END FROM f), 6) AS {c}" for c in NUMERIC)
_add("scale_numeric", lambda s, d: tfidf.scale_numeric(numeric(s, d), NUMERIC), f"WITH {_NUM} SELECT message_id, {_Z} FROM f")

# --- vectors
_vec = lambda s, d: read(s, d, "embeddings").select("vec_id", "embedding", "label")
_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS e FROM embeddings)"


def _knn_sql(cond: str, k: int) -> str:
    return f"SELECT vec_id, ref_id, similarity, rank FROM (SELECT a.vec_id, b.vec_id AS ref_id, round(list_inner_product(a.e, b.e), 12) AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.e, b.e), 9) DESC, b.vec_id) AS INT) AS rank FROM u a, u b WHERE {cond}) WHERE rank <= {k}"


_add("l2_normalize", lambda s, d: proximity.l2_normalize(_vec(s, d)).select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(F.element_at("embedding", 1), 6).alias("first")), f"WITH {_UNIT} SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS norm, round(e[1], 6) AS first FROM u")
_add("class_knn", lambda s, d: proximity.class_knn(_vec(s, d), _vec(s, d).where("label < 5")).drop("similarity"), f"WITH {_UNIT}, n AS ({_knn_sql('b.label < 5', 10)}) SELECT vec_id, ref_id, rank FROM n")
_prox = lambda s, d: proximity.proximity_scores(_vec(s, d), _vec(s, d).where("label < 5"), _vec(s, d).where("label >= 5"), scale=0.5)
_PROX = f"{_UNIT}, s AS (SELECT vec_id, avg(similarity) * 0.5 AS scam FROM ({_knn_sql('b.label < 5', 10)}) GROUP BY vec_id), l AS (SELECT vec_id, avg(similarity) * 0.5 AS legit FROM ({_knn_sql('b.label >= 5', 10)}) GROUP BY vec_id), prox AS (SELECT s.vec_id, scam, legit, scam - legit AS delta FROM s JOIN l ON s.vec_id = l.vec_id)"
_add("proximity_scores", _prox, f"WITH {_PROX} SELECT vec_id, round(scam, 6) AS scam, round(legit, 6) AS legit, round(delta, 6) AS delta FROM prox")
_add("proximity_by_label", lambda s, d: _prox(s, d).join(_vec(s, d).select("vec_id", (F.col("label") < 5).cast("int").alias("is_scam")), "vec_id").groupBy("is_scam").agg(*[F.avg(c).alias(c) for c in ("scam", "legit", "delta")]), f"WITH {_PROX} SELECT CAST(label < 5 AS INT) AS is_scam, round(avg(scam), 6) AS scam, round(avg(legit), 6) AS legit, round(avg(delta), 6) AS delta FROM prox JOIN embeddings e ON prox.vec_id = e.vec_id GROUP BY 1")
_add("similar_messages", lambda s, d: proximity.similar_messages(_vec(s, d), _vec(s, d).where("label < 5"), read(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")), f"WITH {_UNIT}, n AS ({_knn_sql('b.label < 5', 3)}) SELECT n.vec_id, ref_id, round(similarity, 4) AS similarity, rank, substring(text, 1, 150) AS snippet FROM n JOIN documents d ON d.doc_id = n.ref_id")
def knn_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every vector whose id is divisible by 100 among all vectors, from an index that was stored before."""
    path = scratch(spark)
    vector_index.build(_vec(spark, sf_dir), path)
    found = vector_index.search(_vec(spark, sf_dir).where("vec_id % 100 = 0"), vector_index.load(spark, path))
    return found.select("vec_id", "ref_id", "similarity", "rank")


_add("knn_approx", knn_approx)

# --- models
_split = lambda s, d: training.stratified_split(messages(s, d).select("message_id", "label"))
_SPLIT = f"{fx.MESSAGES}, h AS (SELECT message_id, label, CAST('0x' || substring(md5('42:' || CAST(message_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM messages), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS k, count(*) OVER (PARTITION BY label) AS n FROM h)"
_add("stratified_split", lambda s, d: _split(s, d).select("message_id", "label", "is_test"), f"WITH {_SPLIT} SELECT message_id, label, k <= round_even(n * 0.2, 0) AS is_test FROM r")


#: Sizes of the vocabularies of the model matrix.
WORD_TERMS, CHAR_TERMS = 5_000, 3_000


def vector_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[list[tuple[str, float]]]]:
    """What the messages' vectors are made of, in few bytes: counts of words and of characters, scaled numeric features. Also the
    two vocabularies. The vectors are several times larger, so they are made where they are read."""
    rows = numeric(spark, sf_dir)
    n, vocabularies, kept = rows.count(), [], ["message_id", "label"]
    for k, (cut, size) in enumerate(((tfidf.word_terms(F.col("text")), WORD_TERMS), (tfidf.char_terms(F.col("text")), CHAR_TERMS))):
        vocabularies.append(tfidf.fit_vocabulary(rows, cut, n, size))
        kept.append(tfidf.counted(cut, vocabularies[-1]).alias(f"__block{k}"))
    parts = tfidf.scale_numeric(rows, NUMERIC, keep=tuple(kept)).persist()
    parts.count()
    rows.unpersist()  # the texts are not needed any more
    return parts, vocabularies


def assembled(parts: DataFrame, vocabularies: list[list[tuple[str, float]]]) -> DataFrame:
    blocks = {f"__block{k}": tfidf.weighed(F.col(f"__block{k}"), v) for k, v in enumerate(vocabularies)}
    return training.assemble_features(parts.withColumns(blocks), NUMERIC, [(b, len(v)) for b, v in zip(blocks, vocabularies, strict=True)])


def places(vocabularies: list[list[tuple[str, float]]]) -> list[str]:
    """The names of all places of a vector."""
    return [prefix + t for prefix, v in zip(("", "char_"), vocabularies, strict=True) for t, _ in v] + NUMERIC


def matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The messages with their vectors: words, characters, scaled numeric features. Also the names of all places."""
    parts, vocabularies = vector_parts(spark, sf_dir)
    return assembled(parts, vocabularies), places(vocabularies)


def fitted(spark: SparkSession, sf_dir: str, name: str):
    """The model, what gives the rows of a condition with their vectors, and the names of all places."""
    parts, vocabularies = vector_parts(spark, sf_dir)
    parts = training.stratified_split(parts)
    rows = lambda cond="true": assembled(parts.where(cond), vocabularies)
    return training.estimators(parts.where("not is_test").count())[name].fit(rows("not is_test")), rows, places(vocabularies)


def _model_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, rows, _ = fitted(spark, sf_dir, name)
        return training.probabilities(model, rows("is_test"))

    return run


def isotonic_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows, _ = fitted(spark, sf_dir, "lr")
    scored = training.probabilities(model, rows())
    return training.isotonic_calibrate(scored.where("message_id % 2 = 0"), scored.where("message_id % 2 = 1")).select("message_id", "raw", "calibrated")


def random_search_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five draws from the grid."""
    parts, vocabularies = vector_parts(spark, sf_dir)
    _, scores = training.random_search_rf(training.stratified_split(parts).where("not is_test"), draws=5, prepare=lambda rows: assembled(rows, vocabularies))
    return spark.createDataFrame([(k, float(x), k == scores.index(max(scores))) for k, x in enumerate(scores)], "draw int, f1 double, best boolean")


def stratified_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, vocabularies = vector_parts(spark, sf_dir)
    scores = training.stratified_cv(parts, training.estimators(parts.count())["dt"], prepare=lambda rows: assembled(rows, vocabularies))
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(scores)], "fold int, f1 double")


def feature_importance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, names = fitted(spark, sf_dir, "rf")
    return training.feature_importance_topk(spark, model, names)


def assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each vector: entries and sums of its word and character parts, and some scaled numbers."""
    from pyspark.ml.functions import vector_to_array

    rows, names = matrix(spark, sf_dir)
    n_words = names.index("char_" + next(n for n in names if n.startswith("char_"))[5:])
    v, n_text = vector_to_array("features"), len(names) - len(NUMERIC)
    out = rows.select("message_id", F.slice(v, 1, n_words).alias("w"), F.slice(v, n_words + 1, n_text - n_words).alias("c"), F.slice(v, n_text + 1, len(NUMERIC)).alias("z"))
    some = lambda k: F.size(F.filter(k, lambda x: x != 0)).cast("long")
    total = lambda k: F.round(F.aggregate(k, F.lit(0.0), lambda a, x: a + x), 4)
    return out.select("message_id", some("w").alias("n_words"), total("w").alias("words"), some("c").alias("n_chars"), total("c").alias("chars"), F.round(F.col("z")[0], 4).alias("first"), F.round(F.col("z")[len(NUMERIC) - 1], 4).alias("last"))


def _block_sql(name: str, terms: str, size: int) -> str:
    terms = terms.replace("doc_id", "message_id").replace("documents", "messages").replace("ws AS", f"ws_{name} AS").replace("FROM ws)", f"FROM ws_{name})").replace("t AS (SELECT", f"t_{name} AS (SELECT")
    return f"""{terms}, c_{name} AS (SELECT message_id, term, count(*) AS tf FROM t_{name} GROUP BY message_id, term),
voc_{name} AS (SELECT term, ln((1.0 + (SELECT count(*) FROM messages)) / (1.0 + count(*))) + 1.0 AS idf FROM c_{name} GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {size}),
raw_{name} AS (SELECT message_id, (ln(tf) + 1.0) * idf AS w FROM c_{name} JOIN voc_{name} USING (term)),
{name} AS (SELECT message_id, count(*) AS n, sum(w) / sqrt(sum(w * w)) AS total FROM raw_{name} GROUP BY message_id)"""


_SOME_Z = [f"round(({c} - (SELECT avg({c}) FROM f)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END FROM f), 4) AS {k}" for c, k in ((NUMERIC[0], "first"), (NUMERIC[-1], "last"))]
_ASSEMBLED = f"""WITH {_NUM}, {_block_sql('wb', _WT, WORD_TERMS)}, {_block_sql('cb', _CT, CHAR_TERMS)}
SELECT f.message_id, coalesce(wb.n, 0) AS n_words, round(coalesce(wb.total, 0.0), 4) AS words, coalesce(cb.n, 0) AS n_chars, round(coalesce(cb.total, 0.0), 4) AS chars, {', '.join(_SOME_Z)}
FROM f LEFT JOIN wb ON f.message_id = wb.message_id LEFT JOIN cb ON f.message_id = cb.message_id"""


def serving_set(spark: SparkSession, sf_dir: str, path: str):
    """The serving set fitted on the messages and written; (fitted pipeline, messages)."""
    from pyspark.ml.classification import LogisticRegression

    fx.small_batches(spark)
    labels = messages(spark, sf_dir).select("message_id", "label")
    rows = mq.arriving(spark, sf_dir).join(labels, "message_id")
    model = serving.fit_serving(rows, _vec(spark, sf_dir).select("embedding", "label"), LogisticRegression(maxIter=20, regParam=0.001, standardization=False))
    model.write().overwrite().save(path)
    return model, rows


def artefact_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored serving set holds, by stage and table."""
    path = scratch(spark)
    model, _ = serving_set(spark, sf_dir, path)
    return spark.createDataFrame(serving.inventory(model, path), "place int, stage string, table string, n long")


def artefact_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and decisions of all messages under the serving set as it is loaded from its folder."""
    from pyspark.ml import PipelineModel

    path = scratch(spark)
    _, rows = serving_set(spark, sf_dir, path)
    loaded = PipelineModel.load(path)
    return loaded.transform(rows).select("message_id", "prob", "positive", F.lit(loaded.stages[-1].threshold).alias("threshold"))


COEFFICIENTS = {c: 0.25 * (k + 1) * (-1) ** k for k, c in enumerate(NUMERIC)}
_contrib = lambda s, d: training.feature_contributions(tfidf.scale_numeric(numeric(s, d), NUMERIC), COEFFICIENTS)
_CON = f"{_NUM}, z AS (SELECT message_id, {_Z.replace(', 6) AS', ', 12) AS')} FROM f), con AS (" + " UNION ALL ".join(f"SELECT message_id, '{c}' AS feature, round({c} * CAST({b} AS DOUBLE), 4) AS contribution FROM z" for c, b in COEFFICIENTS.items()) + ")"
_add("feature_contributions", lambda s, d: _contrib(s, d).select("message_id", F.explode("contributions").alias("feature", "contribution")), f"WITH {_CON} SELECT * FROM con")
_add("contribution_topk", lambda s, d: training.contribution_topk(_contrib(s, d), 3), f"WITH {_CON} SELECT message_id, CAST(rank AS INT) AS rank, feature, contribution FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY abs(contribution) DESC, feature) AS rank FROM con) WHERE rank <= 3")
for _m in ("lr", "dt", "rf"):
    _add(f"train_{_m}", _model_query(_m))
_add("isotonic_calibrate", isotonic_calibrate)
_add("random_search_rf", random_search_rf)
_add("stratified_cv", stratified_cv)
_add("feature_importance_topk", feature_importance_topk)
_add("assemble_features", assemble_features, _ASSEMBLED)
_add("artefact_sink", artefact_sink)
_add("artefact_source", artefact_source)


# --- streams
_events = lambda s, d: read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
_TTL = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_id, user_id, event_type, t, k, t AS last, true AS keep FROM e WHERE k = 1 UNION ALL
SELECT e.event_id, e.user_id, e.event_type, e.t, e.k, CASE WHEN e.t - w.last >= 21600000000 THEN e.t ELSE w.last END, e.t - w.last >= 21600000000 FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.k = w.k + 1)
SELECT event_id FROM w WHERE keep"""


def stream_dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over four appends in order of time, each read as a batch of its own: every event with the record of the one
    that was scored for it."""
    events = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", F.to_json(F.struct(F.col("event_id").alias("scored"), "value")).alias("record"))
    edges = events.select(F.unix_micros("ts").alias("t")).approxQuantile("t", [0.25, 0.5, 0.75], 0.01)
    source, n = scratch(spark), 4
    place = sum((F.unix_micros("ts") > e).cast("int") for e in map(F.lit, map(int, edges)))
    for k in range(4):
        events.where(place == k).repartition(n, "user_id", "event_type").write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", n).parquet(source)
    spark.conf.set(*streams.ROCKS)
    found = drained(streams.reuse_ttl_stream(stream, "ts", ["user_id", "event_type"], 6 * 3600, "event_id", "record", buckets=max(32, events.count() // 5_000)), spark)
    return found.select("event_id", "reused", F.get_json_object("record", "$.scored").cast("long").alias("scored"), F.round(F.get_json_object("record", "$.value").cast("double"), 6).alias("value"))


_REUSE = _TTL.replace("t AS last, true AS keep FROM e", "t AS last, event_id AS scored, true AS keep FROM e").replace("ELSE w.last END,", "ELSE w.last END, CASE WHEN e.t - w.last >= 21600000000 THEN e.event_id ELSE w.scored END,").replace(
    "SELECT event_id FROM w WHERE keep", "SELECT w.event_id, NOT keep AS reused, scored, round(s.value, 6) AS value FROM w JOIN events s ON s.event_id = w.scored"
)
_add("stream_dedup_ttl", stream_dedup_ttl, _REUSE)
_add("dedup_ttl_batch", lambda s, d: streams.dedup_ttl_batch(_events(s, d), "ts", ["user_id", "event_type"], 6 * 3600, "event_id").select("event_id"), _TTL)
_VAL = "WITH v AS (SELECT doc_id, length(trim(coalesce(text, ''))) AS n FROM documents) SELECT doc_id, n, CASE WHEN n = 0 THEN 'empty' WHEN n < 20 THEN 'too_short' WHEN n > 5000 THEN 'too_long' END AS reason FROM v"
_add("request_validation", lambda s, d: streams.request_validation(read(s, d, "documents").select("doc_id", "text")).select("doc_id", F.char_length("text").alias("n"), "reason"), _VAL)


def drained(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream until all that is there is read; the result is what the sink holds."""
    sink, state = scratch(spark), scratch(spark)
    query = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return spark.read.schema(T.StructType(stream.schema.fields)).parquet(sink)


def through_stream(df: DataFrame, change, spark: SparkSession) -> DataFrame:
    """``change`` over the table as a stream of files."""
    source = scratch(spark)
    df.write.parquet(source)
    return drained(change(spark.readStream.schema(df.schema).parquet(source)), spark)


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record over a stream of two appends, each read as a batch of its own, under a pipeline that was stored before."""
    model, links, source = mq.stored_model(spark, sf_dir, scratch(spark)), mq.known_links(spark, sf_dir, scratch(spark)), scratch(spark)
    rows = mq.arriving(spark, sf_dir)
    for k in range(2):
        rows.where(F.col("message_id") % 2 == k).repartition(4).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(source)
    return mq.flat_record(drained(streams.stream_score(stream, model, links, nfkc=False), spark))


_add("stream_score", stream_score, mq.ORACLE_SQL["prediction_record"])


def stream_reputation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = read(spark, sf_dir, "pages").select("page_id", "url", F.expr("timestamp'2024-01-10 12:00:00'").alias("ts"))
    known = read(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("p")).select("url", (F.col("p") % 5 == 0).alias("flagged"), (F.col("p") % 3).alias("malicious"), (F.col("p") % 2).alias("suspicious"), F.expr("timestampadd(HOUR, cast(p % 48 as int), timestamp'2024-01-09 00:00:00')").alias("checked_at"))
    path = scratch(spark)
    known.write.parquet(path)
    found = through_stream(links, lambda stream: streams.stream_reputation_join(stream, spark.read.parquet(path), "ts"), spark)
    return found.select("page_id", F.coalesce("flagged", F.lit(False)).alias("flagged"), *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("malicious", "suspicious")])


_add("stream_reputation_join", stream_reputation_join, """WITH k AS (SELECT url, min(page_id) AS p FROM pages GROUP BY url) SELECT page_id, CASE WHEN p % 48 >= 12 THEN p % 5 = 0 ELSE false END AS flagged, CASE WHEN p % 48 >= 12 THEN p % 3 ELSE -1 END AS malicious, CASE WHEN p % 48 >= 12 THEN p % 2 ELSE -1 END AS suspicious FROM pages JOIN k ON pages.url = k.url""")
