"""Queries of evaluation and corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import text
from palisade.operators import analytics, evaluation, policy
from palisade.plans import fixtures as fx
from palisade.plans import message_queries as mq
from palisade.plans.fixtures import messages

QUERIES, ORACLE_SQL = {}, {}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a made-up probability that leans towards them, and its prediction at 0.5."""
    rows = messages(spark, sf_dir).withColumn("prob", F.least(F.col("prob") * 0.7 + F.col("label") * 0.3, F.lit(1.0)))
    return rows.select("message_id", "label", "channel", "source", F.round("prob", 4).alias("prob"), (F.round("prob", 4) >= 0.5).cast("int").alias("pred"))


SCORED = f"""{fx.MESSAGES}, s0 AS (SELECT message_id, label, channel, source, round(least(prob * CAST(0.7 AS DOUBLE) + label * CAST(0.3 AS DOUBLE), 1.0), 4) AS prob FROM messages),
scored AS (SELECT *, CAST(prob >= CAST(0.5 AS DOUBLE) AS INT) AS pred FROM s0)"""


def _ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END, 6)"


def _n(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


_TP, _FP, _FN = _n("label = 1 AND pred = 1"), _n("label = 0 AND pred = 1"), _n("label = 1 AND pred = 0")
_METRICS = f"count(*) AS n, {_ratio(_n('label = pred'), 'count(*)')} AS accuracy, {_ratio(_TP, f'{_TP} + {_FP}')} AS precision, {_ratio(_TP, f'{_TP} + {_FN}')} AS recall, {_ratio(f'2 * {_TP}', f'2 * {_TP} + {_FP} + {_FN}')} AS f1"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = sql


_add("binary_metrics", lambda s, d: evaluation.binary_metrics(scored(s, d)), f"WITH {SCORED} SELECT {_METRICS} FROM scored")
_add("per_channel_metrics", lambda s, d: evaluation.binary_metrics(scored(s, d), "channel"), f"WITH {SCORED} SELECT channel, {_METRICS} FROM scored GROUP BY channel")


def _class_sql(c: int) -> str:
    tp, fp, fn = _n(f"label = {c} AND pred = {c}"), _n(f"label <> {c} AND pred = {c}"), _n(f"label = {c} AND pred <> {c}")
    r = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"
    return f"SELECT '{c}' AS class, {r(tp, f'{tp} + {fp}')} AS precision, {r(tp, f'{tp} + {fn}')} AS recall, {r(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1, {tp} + {fn} AS support FROM scored"


_add(
    "classification_report",
    lambda s, d: evaluation.classification_report(scored(s, d)),
    f"""WITH {SCORED} , classes AS ({_class_sql(0)} UNION ALL {_class_sql(1)}), allrows AS (SELECT * FROM classes
UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM classes
UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM classes)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM allrows""",
)
_add("confusion_matrix", lambda s, d: evaluation.confusion_matrix(scored(s, d)), f"WITH {SCORED} SELECT y AS label, p AS pred, (SELECT count(*) FROM scored WHERE label = y AND pred = p) AS n FROM (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(p)")
_ROC = "c AS (SELECT prob AS score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM scored GROUP BY prob), roc AS (SELECT score, CAST(sum(neg) OVER (ORDER BY score DESC) AS DOUBLE) / (SELECT sum(neg) FROM c) AS fpr, CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) / (SELECT sum(pos) FROM c) AS tpr FROM c)"
_add("roc_curve", lambda s, d: evaluation.roc_curve(scored(s, d)), f"WITH {SCORED}, {_ROC} SELECT score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM roc")
_add("auc", lambda s, d: evaluation.auc(scored(s, d)), f"WITH {SCORED}, {_ROC} SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc FROM (SELECT fpr, tpr, lag(fpr, 1, 0.0) OVER (ORDER BY score DESC) AS f0, lag(tpr, 1, 0.0) OVER (ORDER BY score DESC) AS t0 FROM roc)")


def _at(values: str) -> str:
    tp, fp, fn = _n("label = 1 AND prob >= threshold"), _n("label = 0 AND prob >= threshold"), _n("label = 1 AND prob < threshold")
    return f"grid AS ({values}), pr AS (SELECT threshold, {_ratio(tp, f'{tp} + {fp}')} AS precision, {_ratio(tp, f'{tp} + {fn}')} AS recall, {_ratio(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1 FROM scored, grid GROUP BY threshold)"


_add("pr_by_threshold", lambda s, d: evaluation.pr_by_threshold(scored(s, d), [0.4, 0.5, 0.6, 0.7]), f"WITH {SCORED}, {_at('SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES (0.4), (0.5), (0.6), (0.7)) v(t)')} SELECT threshold, precision, recall, f1 FROM pr")
_add("threshold_sweep", lambda s, d: evaluation.threshold_sweep(scored(s, d)), f"WITH {SCORED}, {_at('SELECT CAST(i AS DOUBLE) / 100.0 AS threshold FROM range(40, 91) t(i)')} SELECT threshold, f1 FROM pr ORDER BY f1 DESC, threshold LIMIT 1")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of three models: predictions at 0.4, 0.5 and 0.6."""
    rows, parts = scored(spark, sf_dir), None
    for k, t in enumerate((0.4, 0.5, 0.6)):
        one = evaluation.binary_metrics(rows.withColumn("pred", (F.col("prob") >= t).cast("int"))).select(F.lit(k).alias("ordinal"), F.lit(f"m{k}").alias("model"), "accuracy", "precision", "recall", "f1")
        parts = one if parts is None else parts.unionByName(one)
    return parts


_NAMES = ["accuracy", "precision", "recall", "f1"]
_MODELS = ", models AS (" + " UNION ALL ".join(f"SELECT {k} AS ordinal, 'm{k}' AS model, {', '.join(_NAMES)} FROM (SELECT {_METRICS} FROM (SELECT label, CAST(prob >= CAST({t} AS DOUBLE) AS INT) AS pred FROM scored))" for k, t in enumerate((0.4, 0.5, 0.6))) + ")"
_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM models" for m in _NAMES) + ")"
_melt = lambda s, d: evaluation.metrics_melt(rounded(models(s, d)), "model", _NAMES)
_add("select_best", lambda s, d: evaluation.select_best(rounded(models(s, d))).select("model", "f1"), f"WITH {SCORED}{_MODELS} SELECT model, f1 FROM models ORDER BY f1 DESC, ordinal LIMIT 1")
_add("metrics_melt", _melt, f"WITH {SCORED}{_MODELS}{_LONG} SELECT * FROM long")
_add("best_flags", lambda s, d: evaluation.best_flags(_melt(s, d)), f"WITH {SCORED}{_MODELS}{_LONG} SELECT *, value = max(value) OVER (PARTITION BY metric) AS best FROM long")
_add(
    "version_delta",
    lambda s, d: evaluation.version_delta(_melt(s, d).where("model = 'm1'").drop("model"), _melt(s, d).where("model = 'm0'").drop("model"), ["metric"]),
    f"WITH {SCORED}{_MODELS}{_LONG} SELECT a.metric, a.value, b.value AS old, round(a.value - b.value, 6) AS delta FROM long a LEFT JOIN long b ON a.metric = b.metric AND b.model = 'm0' WHERE a.model = 'm1'",
)


# --- suites over verdicts; the cue number is the category
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("verdict", policy.verdict_tier(F.col("prob"))).withColumn("category", F.col("message_id") % len(fx.CUES))
    return rows.withColumn("status", evaluation.outcome_status())


OUTCOMES = f"""{SCORED}, o0 AS (SELECT *, CASE WHEN prob >= CAST(0.6 AS DOUBLE) THEN 'SCAM' WHEN prob >= CAST(0.4 AS DOUBLE) THEN 'SUSPICIOUS' ELSE 'LEGIT' END AS verdict, message_id % {len(fx.CUES)} AS category FROM scored),
outcomes AS (SELECT *, CASE WHEN (label = 1 AND verdict = 'SCAM') OR (label = 0 AND verdict = 'LEGIT') THEN 'PASS' WHEN verdict = 'SUSPICIOUS' THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM o0)"""
_P, _Q, _F = (_n(f"status = '{s}'") for s in ("PASS", "PARTIAL", "FAIL"))
_add("outcome_status", lambda s, d: outcomes(s, d).select("message_id", "status"), f"WITH {OUTCOMES} SELECT message_id, status FROM outcomes")
_FNR, _FPR = _n("label = 1 AND verdict = 'LEGIT'"), _n("label = 0 AND verdict = 'SCAM'")
_add("suite_summary", lambda s, d: evaluation.suite_summary(outcomes(s, d)), f"WITH {OUTCOMES} SELECT count(*) AS n, {_P} AS passed, {_Q} AS partial, {_F} AS failed, {_ratio(_P, 'count(*)')} AS strict, {_ratio(f'({_P} + {_Q})', 'count(*)')} AS soft, {_ratio(_FNR, _n('label = 1'))} AS fn_rate, {_ratio(_FPR, _n('label = 0'))} AS fp_rate FROM outcomes")
_add("category_breakdown", lambda s, d: evaluation.category_breakdown(outcomes(s, d)), f"WITH {OUTCOMES} SELECT category, count(*) AS n, {_P} AS pass, {_Q} AS partial, {_F} AS fail, round({_P} * 100.0 / count(*), 6) AS pass_pct FROM outcomes GROUP BY category")
_add("failure_listing", lambda s, d: evaluation.failure_listing(outcomes(s, d)), f"WITH {OUTCOMES} SELECT message_id, label, verdict, kind FROM (SELECT *, CASE WHEN label = 1 AND verdict = 'LEGIT' THEN 'FN' WHEN label = 0 AND verdict = 'SCAM' THEN 'FP' WHEN verdict = 'SUSPICIOUS' THEN 'BORDERLINE' END AS kind FROM outcomes) WHERE kind IS NOT NULL")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.perturb_text(messages(spark, sf_dir).select("message_id", "text"))


def variant_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cheap rule score of each variant: cues per two."""
    rows = variants(spark, sf_dir)
    score = text.count_contained(F.lower("variant_text"), ("the", "and", "ing")) / 3.0
    return evaluation.variant_robustness(rows.select("message_id", "variant", policy.verdict_tier(score).alias("verdict")))


_CHARS = "list_filter(string_split(t, ''), lambda c: c <> '')"
_MIX = f"array_to_string(list_transform({_CHARS}, lambda c, i: CASE WHEN i % 2 = 1 THEN translate(c, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE lower(c) END), '')"
_VARIANTS = f"""{fx.MESSAGES}, cut AS (SELECT message_id, text AS t FROM messages), variants AS (
SELECT message_id, 'original' AS variant, t AS variant_text FROM cut UNION ALL SELECT message_id, 'leet', translate(lower(t), 'oieas', '01345') FROM cut
UNION ALL SELECT message_id, 'spaced', array_to_string({_CHARS}, ' ') FROM cut UNION ALL SELECT message_id, 'mixed', {_MIX} FROM cut
UNION ALL SELECT message_id, 'hyphenated', array_to_string({_CHARS}, '-') FROM cut)"""
_VS = "CAST(" + fx.contained("lower(variant_text)", ("the", "and", "ing")) + " AS DOUBLE) / 3.0"
_add("perturb_text", lambda s, d: variants(s, d), f"WITH {_VARIANTS} SELECT * FROM variants")
_add("variant_robustness", variant_robustness, f"WITH {_VARIANTS}, v AS (SELECT message_id, variant, CASE WHEN {_VS} >= CAST(0.6 AS DOUBLE) THEN 'SCAM' WHEN {_VS} >= CAST(0.4 AS DOUBLE) THEN 'SUSPICIOUS' ELSE 'LEGIT' END AS verdict FROM variants) SELECT v.*, o.verdict AS original_verdict, v.verdict <> o.verdict AS changed FROM v JOIN v o ON v.message_id = o.message_id AND o.variant = 'original' WHERE v.variant <> 'original'")

# --- corpus reports
_add("label_distribution", lambda s, d: analytics.distribution(messages(s, d), "label"), f"WITH {fx.MESSAGES} SELECT label, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM messages) AS DOUBLE), 6) AS share FROM messages GROUP BY label")
for _c in ("channel", "source"):
    _add(f"{_c}_counts", lambda s, d, c=_c: analytics.value_counts(messages(s, d), c), f"WITH {fx.MESSAGES} SELECT {_c}, count(*) AS n FROM messages GROUP BY {_c}")
_add("channel_label_pivot", lambda s, d: analytics.pivot_counts(messages(s, d), "channel", "label", [0, 1]), f"WITH {fx.MESSAGES} SELECT channel, {_n('label = 0')} AS n_0, {_n('label = 1')} AS n_1 FROM messages GROUP BY channel")
_add("source_label_composition", lambda s, d: analytics.pivot_counts(messages(s, d), "source", "label", [0, 1]), f"WITH {fx.MESSAGES} SELECT source, {_n('label = 0')} AS n_0, {_n('label = 1')} AS n_1 FROM messages GROUP BY source")


def _hist_sql(value: str, bins: int) -> str:
    return f"h AS (SELECT label, CAST({value} AS DOUBLE) AS v FROM messages), e AS (SELECT min(v) AS lo, max(v) AS hi FROM h) SELECT label, CAST(least(floor((v - lo) * {bins}.0 / (hi - lo)), {bins - 1}) AS INT) AS bin, count(*) AS n FROM h, e GROUP BY 1, 2"


_length = lambda s, d: messages(s, d).withColumn("n_chars", F.char_length("text"))
_add("text_length_hist", lambda s, d: analytics.histogram(_length(s, d), "n_chars", 60, "label", clip=3000.0), f"WITH {fx.MESSAGES}, {_hist_sql('least(length(text), 3000)', 60)}")


def proximity_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each message's nearness to the scam class, by label."""
    return analytics.histogram(mq.with_proximity(spark, sf_dir, messages(spark, sf_dir).select("message_id", "label")), "proximity_score", 60, "label")


def confidence_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the policy's confidence, after all overrides."""
    return analytics.confidence_hist(policy.verdicts(mq.signals(spark, sf_dir)))


_NEAR_SCORES = f"{mq.NEAR}, messages_near AS (SELECT m.*, round(coalesce(near.scam, 0.0), 4) AS proximity_score FROM messages m LEFT JOIN near ON near.vec_id = m.message_id)"
_add("proximity_hist", proximity_hist, f"WITH {fx.MESSAGES}, {_NEAR_SCORES}, {_hist_sql('proximity_score', 60)}".replace("AS v FROM messages)", "AS v FROM messages_near)"))
_add("confidence_hist", confidence_hist, f"WITH {mq.VERDICTS}, c AS (SELECT label, CAST(least(floor(confidence / 10), 9) AS INT) AS decile, count(*) AS n FROM verdicts GROUP BY 1, 2) SELECT label, decile, n, round(n * 100.0 / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE), 6) AS pct FROM c")
#: The columns of the correlation table.
_CORR = [
    "text_length", "word_count", "has_url", "url_count", "exclamation_count", "uppercase_ratio", "digit_ratio", "urgency_score", "tone_urgency", "tone_fear", "tone_reward", "tone_threat",
    "url_suspicious_tld", "url_suspicious_keyword", "url_has_ip", "scam_phrase_score", "sender_impersonation_score", "proximity_scam_score", "label",
]


def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mq.with_proximity(spark, sf_dir, mq.signals(spark, sf_dir)).withColumn("proximity_scam_score", F.col("proximity_score") * 0.5)
    return analytics.corr_matrix(rows, _CORR)


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 2) END AS r FROM f" for a in _CORR for b in _CORR)
_add("corr_matrix", corr_matrix, f"""WITH {mq._SIGNALS}, {mq.NEAR}, f AS MATERIALIZED (SELECT {', '.join(f's.{c}' for c in _CORR if c != 'proximity_scam_score')},
  round(coalesce(near.scam, 0.0), 4) * CAST(0.5 AS DOUBLE) AS proximity_scam_score FROM signals s LEFT JOIN near ON near.vec_id = s.message_id) {_PAIRS}""")


def word_count_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.box_stats(messages(spark, sf_dir).withColumn("word_count", F.size(text.tokens(F.col("text")))), "word_count", "source", "label")


_add("word_count_box", word_count_box, f"""WITH {fx.MESSAGES}, w AS (SELECT source, label, len({fx.words('text')}) AS n FROM messages), q AS (
SELECT source, label, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q3 FROM w GROUP BY source, label)
SELECT *, q1 - (q3 - q1) * 1.5 AS low, q3 + (q3 - q1) * 1.5 AS high FROM q""")
_add("corpus_summary", lambda s, d: analytics.corpus_summary(_length(s, d), length="n_chars"), f"WITH {fx.MESSAGES} SELECT count(*) AS total, {_n('label = 1')} AS scam, {_n('label = 0')} AS legit, round(avg(length(text)), 6) AS mean_length FROM messages")
_add("type_detection_rate", lambda s, d: analytics.detection_rate(policy.verdicts(mq.signals(s, d)).withColumn("detected", F.col("verdict") != "LEGIT")), f"WITH {mq.VERDICTS} SELECT scam_type, count(*) AS n, round(avg(CAST(verdict <> 'LEGIT' AS INT)), 6) AS rate FROM verdicts GROUP BY scam_type")


def channel_scam_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which channels carry scam language: tone and phrases by channel. The flagship query."""
    rows = mq.signals(spark, sf_dir)
    return rows.groupBy("channel").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in policy.TONES], F.sum("scam_phrase_score").alias("phrases"), F.count_if(F.col("n_urls") > 0).alias("with_links"))


_add("channel_scam_language", channel_scam_language, f"WITH {mq._SIGNALS} SELECT channel, count(*) AS n, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in policy.TONES)}, CAST(sum(scam_phrase_score) AS BIGINT) AS phrases, {_n('n_urls > 0')} AS with_links FROM signals GROUP BY channel")
