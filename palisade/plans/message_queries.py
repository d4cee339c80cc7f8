"""Queries over single messages: normalisation, statistics, tone, links, features, typing and the verdict policy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import features, rules, text, tone, urls
from palisade.operators import domains, policy, proximity, reputation, serving
from palisade.operators import signals as signals_ops
from palisade.operators.signals import NUMERIC
from palisade.plans import fixtures as fx
from palisade.plans.fixtures import messages, quoted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


_EDGES = "regexp_replace({0}, '^[!-/:-@\\[-`{{-~]+|[!-/:-@\\[-`{{-~]+$', '', 'g')"


def parts_sql(source: str = "messages") -> str:
    """CTEs that end in ``m``: the rows of a table with what features are made of."""
    return f"""m0 AS (SELECT *, lower(text) AS low, {fx.words('text')} AS words, regexp_extract_all(text, {quoted(urls.EXPLICIT)}) AS explicit,
  regexp_extract_all(text, {quoted('(?i)' + urls.bare_pattern())}) AS bare, regexp_extract_all(text, {quoted(urls.mail_or_bare_pattern())}) AS found FROM {source}),
m1 AS (SELECT * EXCLUDE (found), list_transform(words, lambda w: {_EDGES.format('lower(w)')}) AS bare_words, list_concat(explicit, list_transform(list_filter(found, lambda u: NOT starts_with(u, '@') AND NOT contains(array_to_string(explicit, ' '), u)),
  lambda u: CASE WHEN starts_with(u, 'http') THEN u ELSE 'https://' || u END)) AS l FROM m0),
m AS MATERIALIZED (SELECT * EXCLUDE (l), list_filter(l, lambda x, i: list_position(l, x) = i) AS urls FROM m1)"""


def _column(name: str, make: Callable[[], Column | dict[str, Column]], sql: str | dict[str, str] | None) -> None:
    """One query: columns made from ``text`` and the columns of :func:`features.with_parts`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = make()
        rows = features.with_parts(messages(spark, sf_dir))
        return rows.select("message_id", *[c.alias(n) for n, c in (made if isinstance(made, dict) else {name: made}).items()])

    QUERIES[name] = run
    if sql is not None:
        cols = ", ".join(f"{s} AS {n}" for n, s in (sql if isinstance(sql, dict) else {name: sql}).items())
        ORACLE_SQL[name] = f"WITH {fx.MESSAGES}, {parts_sql()} SELECT message_id, {cols} FROM m"


def _t() -> Column:
    return F.col("text")


# --- normalisation
_EMOJI = "text"
for _sign, _word in rules.EMOJI.items():
    _EMOJI = f"replace({_EMOJI}, {quoted(_sign)}, {quoted(f' {_word} ')})"
_HTML = "regexp_replace({0}, '<[^>]+>', ' ', 'g')"
_SHORT = "regexp_replace({0}, " + quoted(text.short_url_pattern()).replace("{", "{{").replace("}", "}}") + ", ' SHORTURL ', 'g')"
_BLANK = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_LEET = f"translate(lower({{0}}), {quoted(rules.LEET[0])}, {quoted(rules.LEET[1])})"
_column("normalize_nfkc", lambda: text.normalize_nfkc(_t()), None)
_column("emoji_to_token", lambda: text.emoji_to_token(_t()), _EMOJI)
_column("strip_html_tags", lambda: text.strip_html_tags(_t()), _HTML.format("text"))
_column("mark_short_urls", lambda: text.mark_short_urls(_t()), _SHORT.format("text"))
_column("collapse_whitespace", lambda: text.collapse_whitespace(_t()), _BLANK.format("text"))
_column("preprocess_text", lambda: text.preprocess_text(_t(), nfkc=False), _BLANK.format(_SHORT.format(_HTML.format(_EMOJI))))
_column("leet_normalize", lambda: text.leet_normalize(_t()), _LEET.format("text"))
_column("length_guard", lambda: F.when(F.char_length(F.trim("text")) < text.MIN_CHARS, "TOO_SHORT").otherwise("OK"), "CASE WHEN length(trim(text)) < 20 THEN 'TOO_SHORT' ELSE 'OK' END")
_column("truncate_5000", lambda: {"cut": F.substring("text", 1, text.MAX_CHARS), "warned": F.char_length("text") > text.MAX_CHARS}, {"cut": "substring(text, 1, 5000)", "warned": "length(text) > 5000"})
_SHARE = "CASE WHEN length(text) > 0 THEN 1.0 - CAST(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS DOUBLE) / length(text) ELSE 0.0 END"
_column("non_ascii_warning", lambda: {"non_ascii": F.round(text.non_ascii_share(_t()), 6), "warned": text.non_ascii_share(_t()) > 0.30}, {"non_ascii": f"round({_SHARE}, 6)", "warned": f"({_SHARE}) > 0.30"})
_column("display_confidence", lambda: {"shown": F.round(policy.display_confidence(policy.verdict_tier(F.col("prob")), F.col("prob") * 100), 6)}, {"shown": "round(greatest(least(CASE WHEN prob >= 0.4 THEN prob * 100 ELSE 100.0 - prob * 100 END, 100.0), 0.0), 6)"})
_column("score_band", lambda: policy.score_band(F.col("prob") * 100), "CASE WHEN prob * 100 < 26 THEN 'low' WHEN prob * 100 < 51 THEN 'moderate' WHEN prob * 100 < 75 THEN 'high' ELSE 'critical' END")


# --- basic statistics
def _basic_sql(col: str, cues: tuple[str, ...], digits: int | None) -> dict[str, str]:
    fix = (lambda s: f"round({s}, {digits})") if digits is not None else (lambda s: f"round({s}, 9)")
    n, url = f"length({col})", fx.count(col, "https?://[^ \\t\\r\\n]+")
    return {
        "text_length": n,
        "word_count": f"len({fx.words(col)})",
        "has_url": f"CAST({url} > 0 AS INT)",
        "url_count": url,
        "exclamation_count": fx.count(col, "!"),
        "uppercase_ratio": fix(fx.ratio(fx.count(col, text.UPPER), n)),
        "digit_ratio": fix(fx.ratio(fx.count(col, text.DIGIT), n)),
        "urgency_score": fx.contained(f"lower({col})", cues),
    }


_column("basic_features", lambda: text.basic_features(_t()), _basic_sql("text", rules.CUES, 4))
_column("basic_features_gap", lambda: text.basic_features(_t(), rules.CUES_GAP), _basic_sql("text", rules.CUES_GAP, 4))
# --- tone
TONE_SQL = {f"tone_{n}": fx.unnegated("low", p, rules.NEGATORS) for n, p in rules.TONE.items()}
for _name, _patterns in rules.TONE.items():
    _column(f"tone_{_name}", lambda p=_patterns: tone.tone("low", p), TONE_SQL[f"tone_{_name}"])
_PROBE = ("urgent", "worry")
_column("negation_window", lambda: tone.tone("low", _PROBE), fx.unnegated("low", _PROBE, rules.NEGATORS))
_column("tone_legacy", lambda: tone.tones_legacy(F.col("low")), {f"tone_{n}": fx.contained("low", w) for n, w in rules.TONE_LEGACY.items()})


_CLEAN = _BLANK.format(_SHORT.format(_HTML.format(_EMOJI)))
_NORM = f"n AS MATERIALIZED (SELECT *, lower({_CLEAN}) AS clean, {_LEET.format(_CLEAN)} AS leet FROM m)"


def _normalised(df: DataFrame) -> DataFrame:
    return text.normalised(df, nfkc=False)


def merged_tones() -> dict[str, Column]:
    clean, leet = tone.tones("clean"), tone.tones("leet")
    return {k: F.greatest(clean[k], leet[k]) for k in clean}


MERGED_SQL = {f"tone_{n}": f"greatest({fx.unnegated('clean', p, rules.NEGATORS)}, {fx.unnegated('leet', p, rules.NEGATORS)})" for n, p in rules.TONE.items()}


def tone_merge_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(messages(spark, sf_dir)).select("message_id", *[c.alias(k) for k, c in merged_tones().items()])


def inference_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the leet-normalised text; links are taken from the text as it came; urgency is the merged tone's."""
    rows = _normalised(urls.with_links(messages(spark, sf_dir)))
    stats = {k: F.round(c, 9) if k.endswith("ratio") else c for k, c in text.basic_features(F.col("leet"), digits=None).items()}
    stats |= {"has_url": (F.size("urls") > 0).cast("int"), "url_count": F.size("urls"), "urgency_score": merged_tones()["tone_urgency"]}
    return rows.select("message_id", *[c.alias(k) for k, c in stats.items()])


QUERIES |= {"tone_merge_max": tone_merge_max, "inference_features": inference_features}
ORACLE_SQL["tone_merge_max"] = f"WITH {fx.MESSAGES}, {parts_sql()}, {_NORM} SELECT message_id, {', '.join(f'{q} AS {k}' for k, q in MERGED_SQL.items())} FROM n"
_INFER = _basic_sql("leet", rules.CUES, None) | {"has_url": "CAST(len(urls) > 0 AS INT)", "url_count": "len(urls)", "urgency_score": MERGED_SQL["tone_urgency"]}
ORACLE_SQL["inference_features"] = f"WITH {fx.MESSAGES}, {parts_sql()}, {_NORM} SELECT message_id, {', '.join(f'{q} AS {k}' for k, q in _INFER.items())} FROM n"

# --- links
def _host(u: str) -> str:
    rest = f"regexp_replace(lower({u}), '^[a-z][a-z0-9+.-]*://', '')"
    return f"regexp_replace(regexp_extract({rest}, '^(?:[^/?#@]*@)?([^/:?#]*)', 1), '^www[.]', '')"


def _any(test: str, over: str = "urls") -> str:
    return f"len(list_filter({over}, lambda u: {test})) > 0"


def _ends(host: str, names: tuple[str, ...], dot: str = "") -> str:
    return "(" + " OR ".join(f"suffix({host}, {quoted(dot + n)})" for n in names) + ")"


def _under(host: str, names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{host} = {quoted(n)} OR suffix({host}, {quoted('.' + n)})" for n in names) + ")"


_PAIRS = f"list_transform(regexp_extract_all(text, {quoted(urls.PAIR)}, 1), lambda h: lower(h))"
_FAKE = f"(regexp_matches({_host('u')}, {quoted('|'.join(rules.HOST_ACTIONS))}) OR " + " OR ".join(f"(contains({_host('u')}, {quoted(b)}) AND NOT {_under(_host('u'), d)})" for b, d in rules.BRANDS.items()) + ")"
URL_SQL = {
    "url_suspicious_tld": f"CAST({_any(_ends('u', rules.TLDS), _PAIRS)} AS INT)",
    "url_suspicious_keyword": f"CAST({_any('regexp_matches(lower(u), ' + quoted('|'.join(rules.URL_KEYWORDS)) + ')', 'list_concat(explicit, bare)')} AS INT)",
    "url_has_ip": f"CAST(regexp_matches(text, {quoted(urls.IP)}) AS INT)",
}
_TRUSTED = f"(len(urls) > 0 AND len(list_filter(urls, lambda u: NOT {_under(_host('u'), rules.TRUSTED)})) = 0)"
_flags = lambda: urls.url_flags(F.col("explicit"), F.col("bare"), _t())
_column("extract_urls_explicit", lambda: F.col("explicit"), "explicit")
_column("extract_urls", lambda: F.col("urls"), "urls")
for _name in URL_SQL:
    _column(_name, lambda n=_name: _flags()[n], URL_SQL[_name])
_column("lookalike_domain", lambda: F.exists("urls", lambda u: urls.lookalike(u)), _any(_FAKE))
_column("trusted_all", lambda: urls.trusted_all(F.col("urls")), _TRUSTED)


def trusted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a table of domains, here the default ones."""
    table = spark.createDataFrame([(d,) for d in rules.TRUSTED], "domain string")
    return domains.trusted_by_table(urls.with_links(messages(spark, sf_dir)).select("message_id", "urls"), table).select("message_id", F.col("trusted").alias("trusted_all"))


def lookalike_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a table of brands and their domains."""
    table = spark.createDataFrame([(b, d) for b, own in rules.BRANDS.items() for d in own], "brand string, domain string")
    return domains.lookalike_by_table(urls.with_links(messages(spark, sf_dir)).select("message_id", "urls"), table).select("message_id", F.col("lookalike").alias("lookalike_domain"))


QUERIES |= {"trusted_all": trusted_all, "lookalike_domain": lookalike_domain}
_OLD_PAIRS = f"regexp_extract_all(low, {quoted(urls.PAIR)}, 1)"
_LEGACY = {
    "url_suspicious_tld": f"CAST({_any(_ends('u', rules.TLDS_LEGACY), _OLD_PAIRS)} AS INT)",
    "url_suspicious_keyword": f"CAST({_any('regexp_matches(lower(u), ' + quoted('|'.join(rules.URL_KEYWORDS_LEGACY)) + ')', _OLD_PAIRS)} AS INT)",
    "url_has_ip": URL_SQL["url_has_ip"],
}
_column("url_features_legacy", lambda: urls.url_flags_legacy(_t()), _LEGACY)


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "pages").select("page_id", urls.url_host(F.col("url")).alias("host"))


def url_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.url_explode(urls.with_links(messages(spark, sf_dir)).select("message_id", "urls"))


QUERIES |= {"url_host": url_host, "url_explode": url_explode}
ORACLE_SQL["url_host"] = f"SELECT page_id, {_host('url')} AS host FROM pages"
_LINKS = f"{parts_sql()}, links AS (SELECT message_id, k - 1 AS pos, urls[k] AS url FROM m, unnest(range(1, least(len(urls), 3) + 1)) AS t(k))"
ORACLE_SQL["url_explode"] = f"WITH {fx.MESSAGES}, {_LINKS} SELECT message_id, CAST(pos AS INT) AS pos, url FROM links"


def url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation_by_rule(url_explode(spark, sf_dir))


def reputation_by_rule(rows: DataFrame) -> DataFrame:
    """Two checks of each distinct link, by the link's length."""
    links = rows.select("url").distinct()
    n = F.char_length("url")
    old = links.select("url", (n % 2 == 0).alias("flagged"), F.lit("OLD").alias("threat_type"), (n % 4).alias("malicious"), (n % 3).alias("suspicious"), F.expr("timestamp'2024-01-01 00:00:00'").alias("checked_at"))
    at = F.expr("timestampadd(HOUR, cast(char_length(url) % 48 as int), timestamp'2024-01-09 00:00:00')")
    new = links.select("url", (n % 5 == 0).alias("flagged"), F.when(n % 5 == 0, F.concat(F.lit("T"), n.cast("string"))).alias("threat_type"), (n % 3).alias("malicious"), (n % 2).alias("suspicious"), at.alias("checked_at"))
    return old.unionByName(new)


ASOF = "timestamp'2024-01-10 12:00:00'"
_REPUTATION = """known AS (SELECT DISTINCT url FROM links),
reputation AS (
  SELECT url, length(url) % 2 = 0 AS flagged, 'OLD' AS threat_type, length(url) % 4 AS malicious, length(url) % 3 AS suspicious, TIMESTAMP '2024-01-01 00:00:00' AS checked_at FROM known
  UNION ALL
  SELECT url, length(url) % 5 = 0, CASE WHEN length(url) % 5 = 0 THEN 'T' || CAST(length(url) AS VARCHAR) END, length(url) % 3, length(url) % 2, TIMESTAMP '2024-01-09 00:00:00' + to_hours(CAST(length(url) % 48 AS INT)) FROM known),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY checked_at DESC) AS r FROM reputation) WHERE r = 1 AND checked_at >= TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 24 HOURS)"""


def reputation_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message's links with what was known of them at the message's own time, if it was known in the day before."""
    at = F.expr("timestampadd(MINUTE, cast(message_id * 17 % 5760 as int), timestamp'2024-01-08 00:00:00')")
    return reputation.known_before(url_explode(spark, sf_dir).withColumn("ts", at), url_reputation(spark, sf_dir), "ts").drop("checked_at")


def url_reputation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.url_reputation_join(url_explode(spark, sf_dir), reputation.fresh(url_reputation(spark, sf_dir), ASOF))


def reputation_attempt_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a key for the first service: it is asked about any link; the second counts as asked where its counts of a link
    that is not flagged are above 0; a warning where there are links and neither was."""
    rows = urls.with_links(messages(spark, sf_dir)).select("message_id", F.size("urls").alias("n"))
    found = reputation.url_explode(urls.with_links(messages(spark, sf_dir)).select("message_id", "urls")).join(reputation.fresh(url_reputation(spark, sf_dir), ASOF), "url", "left")
    asked = found.groupBy("message_id").agg(F.max(~F.coalesce("flagged", F.lit(False)) & (F.coalesce(F.col("malicious") + F.col("suspicious"), F.lit(0)) > 0)).alias("vt"))
    rows = rows.join(asked, "message_id", "left").withColumn("key", F.col("message_id") % 3 != 0)  # every third without a key
    gsb, vt = (F.col("n") > 0) & F.col("key"), F.coalesce("vt", F.lit(False))
    return rows.select("message_id", gsb.alias("gsb_attempted"), vt.alias("vt_attempted"), F.when((F.col("n") > 0) & ~gsb & ~vt, "checks skipped").alias("warning"))


QUERIES |= {"reputation_freshness": reputation_freshness, "url_reputation_join": url_reputation_join, "reputation_attempt_flags": reputation_attempt_flags}
ORACLE_SQL["reputation_freshness"] = f"""WITH {fx.MESSAGES}, {_LINKS}, {_REPUTATION},
dated AS (SELECT message_id, url, TIMESTAMP '2024-01-08 00:00:00' + to_minutes(CAST(message_id * 17 % 5760 AS INT)) AS ts FROM links),
found AS (SELECT d.message_id, d.url, ts, r.* EXCLUDE (url) FROM dated d ASOF LEFT JOIN reputation r ON r.url = d.url AND d.ts >= r.checked_at)
SELECT message_id, url, CASE WHEN checked_at >= ts - INTERVAL 24 HOURS THEN flagged END AS flagged, CASE WHEN checked_at >= ts - INTERVAL 24 HOURS THEN threat_type END AS threat_type,
  CASE WHEN checked_at >= ts - INTERVAL 24 HOURS THEN malicious END AS malicious, CASE WHEN checked_at >= ts - INTERVAL 24 HOURS THEN suspicious END AS suspicious FROM found"""
_ROLLED = """SELECT message_id, bool_or(flagged) AS flagged, CAST(sum(CASE WHEN flagged THEN 1 ELSE malicious END) AS BIGINT) AS malicious,
  CAST(sum(CASE WHEN flagged THEN 0 ELSE suspicious END) AS BIGINT) AS suspicious,
  arg_max(threat_type, CASE WHEN flagged THEN pos END) AS threat_type, count(*) AS n_urls
  FROM (SELECT message_id, pos, coalesce(flagged, false) AS flagged, coalesce(malicious, 0) AS malicious, coalesce(suspicious, 0) AS suspicious, threat_type FROM links LEFT JOIN latest ON links.url = latest.url) GROUP BY message_id"""
ORACLE_SQL["url_reputation_join"] = f"WITH {fx.MESSAGES}, {_LINKS}, {_REPUTATION} {_ROLLED}"
ORACLE_SQL["reputation_attempt_flags"] = f"""WITH {fx.MESSAGES}, {_LINKS}, {_REPUTATION},
asked AS (SELECT message_id, bool_or(NOT coalesce(flagged, false) AND coalesce(malicious + suspicious, 0) > 0) AS vt FROM links LEFT JOIN latest ON links.url = latest.url GROUP BY message_id),
a AS (SELECT m.message_id, len(urls) AS n, len(urls) > 0 AND m.message_id % 3 <> 0 AS g, coalesce(vt, false) AS v FROM m LEFT JOIN asked ON m.message_id = asked.message_id)
SELECT message_id, g AS gsb_attempted, v AS vt_attempted, CASE WHEN n > 0 AND NOT g AND NOT v THEN 'checks skipped' END AS warning FROM a"""

# --- engineered features
_SYLLABLES = "CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(len(regexp_extract_all(regexp_replace(w, '([aeiou])e$', '\\1'), '[aeiou]+')), 1) END"
_SYLL_SUM = f"coalesce(list_sum(list_transform(bare_words, lambda w: {_SYLLABLES})), 0)"
_SENT = "greatest(len(string_split_regex(text, '[.!?]+')), 1)"
FEATURE_SQL = {
    "avg_word_length": f"round({fx.ratio('list_sum(list_transform(bare_words, lambda w: length(w)))', 'len(words)')}, 4)",
    "capitalized_word_count": "len(list_filter(words, lambda w: length(w) >= 2 AND w = upper(w) AND w <> lower(w)))",
    "scam_phrase_score": fx.contained("low", rules.PHRASES),
    "legit_phrase_score": fx.contained("low", rules.LEGIT_PHRASES),
    "sender_impersonation_score": f"least(CAST({fx.contained('low', rules.IMPERSONATED)} > 0 AND {fx.contained('low', rules.IMPERSONATION_ACTIONS)} > 0 AS INT) + 2 * CAST({_any(_FAKE)} AS INT), 3)",
    "punctuation_density": f"round({fx.ratio(fx.count('text', '[!-/:-@' + chr(92) + '[-`{-~]'), 'length(text)')}, 4)",
    "question_mark_count": fx.count("text", "[?]"),
    "currency_symbol_count": fx.count("text", "[$€£¥]"),
    "readability_score": f"round(CASE WHEN len(words) = 0 THEN 0.0 ELSE least(greatest(CAST(206.835 AS DOUBLE) - CAST(1.015 AS DOUBLE) * (CAST(len(words) AS DOUBLE) / {_SENT}) - CAST(84.6 AS DOUBLE) * (CAST({_SYLL_SUM} AS DOUBLE) / len(words)), 0.0), 100.0) END, 2)",
    "unique_word_ratio": f"round({fx.ratio('len(list_distinct(bare_words))', 'len(words)')}, 4)",
}
for _name in FEATURE_SQL:
    _column(_name, lambda n=_name: signals_ops.engineered()[n], FEATURE_SQL[_name])
_column("syllable_count", lambda: F.coalesce(features.counted("syllables"), F.lit(0)), f"CAST({_SYLL_SUM} AS BIGINT)")
_column("feature_frame", lambda: signals_ops.engineered() | {k: features.counted(k) for k in signals_ops.TONES}, FEATURE_SQL | URL_SQL | TONE_SQL)
_TYPES = {f"type_{n}": fx.matching("low", p) for n, p in rules.SCAM_TYPES.items()}
_BEST = f"greatest({', '.join(_TYPES.values())})"
_TYPE = "CASE " + f"WHEN {_BEST} = 0 THEN '{rules.DEFAULT_TYPE}' " + " ".join(f"WHEN {s} = {_BEST} THEN {quoted(n[5:])}" for n, s in _TYPES.items()) + " END"
_column("scam_type_score", lambda: {f"type_{n}": c for n, c in features.type_scores(F.col("low")).items()}, _TYPES)
_column("scam_type", lambda: features.scam_type(features.type_scores(F.col("low"))), _TYPE)
_ROMANCE, _SOFT = fx.matching("low", rules.ROMANCE), fx.matching("low", rules.SOFT_INVEST)
_OUTREACH = fx.matching("low", rules.ROMANCE[: rules.OUTREACH])
_column("romance_opener_score", lambda: {"hits": features.opener_hits(F.col("low"), rules.ROMANCE), "outreach": features.opener_hits(F.col("low"), rules.ROMANCE[: rules.OUTREACH])}, {"hits": _ROMANCE, "outreach": _OUTREACH})
_column("soft_invest_score", lambda: features.opener_hits(F.col("low"), rules.SOFT_INVEST), _SOFT)
_OTP = f"(regexp_matches(low, {quoted(features.OTP)}) AND contains(low, 'do not share'))"
_column("otp_signal", lambda: features.otp_signal(_t()), _OTP)


# --- policy
def signals_sql(keep: str, source: str = "m") -> str:
    basic = {k: q for k, q in _basic_sql("text", rules.CUES, 4).items() if k not in ("has_url", "url_count", "word_count")}
    made = basic | {"word_count": "len(words)", "has_url": "CAST(len(urls) > 0 AS INT)", "url_count": "len(urls)"} | FEATURE_SQL | URL_SQL | TONE_SQL
    return f"""SELECT {keep}, urls, len(urls) AS n_urls, {', '.join(f'{q} AS {k}' for k, q in made.items())},
  {_TRUSTED} AS trusted, {_TYPE} AS scam_type, {_ROMANCE} AS romance, {_OUTREACH} AS outreach, {_SOFT} AS soft_invest, {_OTP} AS otp FROM {source}"""


def signals(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The messages' signals, with made-up reputation of their links."""
    rows = signals_ops.with_signals(messages(spark, sf_dir), ("message_id", "label", "source", "channel", "prob", *keep))
    n, k = F.col("n_urls"), F.col("message_id")
    return rows.withColumns({
        "flagged": (k % 41 == 0) & (n > 0),
        "malicious": F.when(n > 0, k % 13 % 3).otherwise(0),
        "suspicious": F.when(n > 0, (k % 7 == 0).cast("int")).otherwise(0),
    })


_MADE = """(message_id % 41 = 0 AND n_urls > 0) AS flagged, CASE WHEN n_urls > 0 THEN message_id % 13 % 3 ELSE 0 END AS malicious,
  CASE WHEN n_urls > 0 THEN CAST(message_id % 7 = 0 AS INT) ELSE 0 END AS suspicious"""
_SIGNALS = f"""{fx.MESSAGES}, {parts_sql()}, s0 AS MATERIALIZED ({signals_sql('message_id, label, source, channel, prob, text')}),
signals AS (SELECT *, {_MADE} FROM s0)"""


def _duck(sql: str) -> str:
    """Double literals as DuckDB writes them."""
    import re

    return re.sub(r"([0-9]+\.[0-9]+)D\b", r"CAST(\1 AS DOUBLE)", sql)


_FOLD = "q0 AS (SELECT *, prob AS p FROM signals)"
for _k, _rule in enumerate(policy.POLICY, 1):
    _FOLD += f", q{_k} AS {'MATERIALIZED ' * (_k % 3 == 0)}(SELECT * EXCLUDE (p), {_duck(_rule.sql('p'))} AS p, {_duck(_rule.sql('p'))} AS p_{_rule.name} FROM q{_k - 1})"
_LAST = f"q{len(policy.POLICY)}"
def reasons_sql(reasons: tuple[tuple[str, str], ...], none: str) -> str:
    held = "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {quoted(code)} END" for code, cond in reasons) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({held}) > 0 THEN {held} ELSE {none} END"


_TIERED = "CASE WHEN p >= CAST(0.60 AS DOUBLE) THEN 'SCAM' WHEN p >= CAST(0.40 AS DOUBLE) THEN 'SUSPICIOUS' ELSE 'LEGIT' END AS tier, round(least(greatest(p * 100.0, 2.0), 98.0), 2) AS pct"


def verdicts_sql(fold: str = _FOLD, last: str = _LAST) -> str:
    """CTEs from the folded policy to ``verdicts``."""
    return f"""{fold},
v0 AS MATERIALIZED (SELECT *, {_TIERED} FROM {last}),
v1 AS MATERIALIZED (SELECT *, CASE WHEN flagged OR malicious >= 2 THEN 'SCAM' WHEN malicious = 1 AND tier = 'LEGIT' THEN 'SUSPICIOUS' ELSE tier END AS v,
  CASE WHEN flagged THEN greatest(pct, 85.0) WHEN malicious >= 2 THEN greatest(pct, 75.0) WHEN malicious = 1 AND tier = 'LEGIT' THEN greatest(pct, 55.0) ELSE pct END AS c FROM v0),
v2 AS MATERIALIZED (SELECT *, v = 'LEGIT' AND n_urls > 0 AND NOT trusted AS base, url_suspicious_tld = 1 OR url_suspicious_keyword = 1 AS marked FROM v1),
verdicts AS MATERIALIZED (SELECT *, CASE WHEN base AND (marked OR url_has_ip = 1) THEN 'SUSPICIOUS' ELSE v END AS verdict,
  CASE WHEN base AND marked THEN greatest(c, 50.0) WHEN base AND url_has_ip = 1 THEN greatest(c, 55.0) ELSE c END AS confidence FROM v2)"""


_NO_REASON = f"CASE WHEN verdict = 'LEGIT' THEN [] WHEN scam_type <> '{rules.DEFAULT_TYPE}' THEN ['like_' || scam_type] ELSE ['subtle_patterns'] END"
WHY = f"array_to_string(({reasons_sql(policy.REASONS, _NO_REASON)})[1:3], '|')"
_NO_DASHBOARD = "CASE WHEN verdict = 'LEGIT' THEN ['none'] WHEN proximity_score > CAST(0.50 AS DOUBLE) THEN ['proximity_elevated'] ELSE ['subtle_patterns'] END"
VERDICTS = f"{_SIGNALS}, {verdicts_sql()}"
#: Mean similarity to the ten nearest vectors of the scam class, by message; 0 without a vector.
NEAR = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS e FROM embeddings),
near AS (SELECT vec_id, avg(similarity) AS scam FROM (SELECT a.vec_id, list_inner_product(a.e, b.e) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.e, b.e), 9) DESC, b.vec_id) AS rank FROM u a, u b WHERE b.label < 5) WHERE rank <= 10 GROUP BY vec_id)"""
PROXIMITY = NEAR + """,
scored AS (SELECT verdicts.*, round(coalesce(near.scam, 0.0), 4) AS proximity_score FROM verdicts LEFT JOIN near ON near.vec_id = verdicts.message_id)"""


def with_proximity(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    vectors = fx.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    near = proximity.class_knn(vectors, vectors.where("label < 5")).groupBy(F.col("vec_id").alias("message_id")).agg(F.avg("similarity").alias("scam"))
    return rows.join(near, "message_id", "left").withColumn("proximity_score", F.round(F.coalesce("scam", F.lit(0.0)), 4)).drop("scam")


def proximity_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_proximity(spark, sf_dir, messages(spark, sf_dir).select("message_id"))
    return rows.select("message_id", policy.proximity_band(F.col("proximity_score")).alias("proximity_band"))


QUERIES["proximity_band"] = proximity_band
ORACLE_SQL["proximity_band"] = f"""WITH {NEAR}, s AS (SELECT doc_id AS message_id, round(coalesce(near.scam, 0.0), 4) AS x FROM documents LEFT JOIN near ON near.vec_id = doc_id)
SELECT message_id, CASE WHEN x > CAST(0.65 AS DOUBLE) THEN 'high' WHEN x > CAST(0.45 AS DOUBLE) THEN 'medium' ELSE 'low' END AS proximity_band FROM s"""


def _policy_query(rule: policy.Rule) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return policy.apply_policy(signals(spark, sf_dir)).select("message_id", F.round(f"p_{rule.name}", 6).alias("p"))

    return run


for _rule in policy.POLICY:
    QUERIES[_rule.name] = _policy_query(_rule)
    ORACLE_SQL[_rule.name] = f"WITH {_SIGNALS}, {_FOLD} SELECT message_id, round(p_{_rule.name}, 6) AS p FROM {_LAST}"


def _final(*columns: str, prob: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: policy.verdicts(signals(spark, sf_dir)).select("message_id", *columns)


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policy.apply_policy(signals(spark, sf_dir))
    return rows.select("message_id", policy.verdict_tier(F.col("p")).alias("verdict"), policy.confidence_pct(F.col("p")).alias("confidence"))


def override_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policy.apply_policy(signals(spark, sf_dir)).withColumns({"v": policy.verdict_tier(F.col("p")), "c": policy.confidence_pct(F.col("p"))})
    v, c = policy.override_reputation(F.col("v"), F.col("c"))
    return rows.select("message_id", v.alias("verdict"), c.alias("confidence"))


def why_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.verdicts(signals(spark, sf_dir)).select("message_id", "why_flagged")


def dashboard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_proximity(spark, sf_dir, policy.verdicts(signals(spark, sf_dir)))
    return rows.select("message_id", policy.dashboard_reasons().alias("reasons"))


#: A stored score of the numeric features, by rule: typical means and deviations, coefficients of either sign.
_TYPICAL = {"text_length": (2_500.0, 3_000.0), "word_count": (400.0, 500.0), "readability_score": (60.0, 30.0), "avg_word_length": (6.0, 2.0), "unique_word_ratio": (0.8, 0.25)}
LINEAR = [(c, *_TYPICAL.get(c, (0.0, 2.0)), round(0.6 / (1 + j % 4) * (-1) ** (j % 5 == 3), 3)) for j, c in enumerate(NUMERIC)]


def stored_model(spark: SparkSession, sf_dir: str, path: str) -> PipelineModel:
    """The serving set, written as one pipeline and read back: rules, neighbours of the scam class, the linear score."""
    neighbours = serving.NeighbourProximity().fit(fx.read(spark, sf_dir, "embeddings").select("embedding", "label"))
    PipelineModel([serving.MessageFeatures(), neighbours, serving.ScaledProximity(), serving.LinearRisk(LINEAR, -1.0)]).write().overwrite().save(path)
    return PipelineModel.load(path)


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, text, embedding, key_present): every third message is checked without a key."""
    vectors = fx.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_id"), "embedding")
    return messages(spark, sf_dir).select("message_id", "text").join(vectors, "message_id", "left").withColumn("key_present", F.col("message_id") % 3 != 0)


def known_links(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    reputation.fresh(url_reputation(spark, sf_dir), ASOF).write.parquet(path)
    return spark.read.parquet(path)


def flat_record(record: DataFrame) -> DataFrame:
    """The record with its map as sorted text, which can be compared."""
    units = lambda k, v: F.concat(k, F.lit("="), F.round(v * 100).cast("long").cast("string"))  # hundredths: the engines round ties apart
    return record.withColumn("feature_contributions", F.array_sort(F.transform(F.map_entries("feature_contributions"), lambda e: units(e["key"], e["value"]))))


def prediction_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 25 fields for each message. A text below 20 characters has the record of a message that is too short."""
    model, links = stored_model(spark, sf_dir, fx.scratch(spark)), known_links(spark, sf_dir, fx.scratch(spark))
    return flat_record(serving.score(arriving(spark, sf_dir), model, links, nfkc=False))


def _record_sql() -> str:
    short, n = "length(trim(text)) < 20", "NULL"
    zero = lambda q, none="0": f"CASE WHEN {short} THEN {none} ELSE {q} END"
    double = lambda x: f"CAST({x!r} AS DOUBLE)"
    scaled = {c: f"((CAST({c} AS DOUBLE) - {double(m)}) / {double(s)} * {double(b)})" for c, m, s, b in LINEAR}
    contributions = [f"'{k}=' || CAST(CAST(round(round({q}, 4) * 100) AS BIGINT) AS VARCHAR)" for k, q in scaled.items()]
    warned = f"""list_filter([CASE WHEN {short} THEN 'too_short' END, CASE WHEN NOT {short} AND length(text) > 5000 THEN 'long_text' END,
      CASE WHEN NOT {short} AND ({_SHARE}) > 0.30 THEN 'non_english' END, CASE WHEN NOT {short} AND n_urls > 0 AND message_id % 3 = 0 AND NOT (NOT flagged AND malicious + suspicious > 0) THEN 'reputation_skipped' END], lambda x: x IS NOT NULL)"""
    fields = {
        "verdict": zero("verdict", "'TOO_SHORT'"), "confidence": zero("confidence", "0.0"), "threshold_used": "CAST(0.4 AS DOUBLE)", "scam_type": zero("scam_type", n), "why_flagged": zero(WHY, n),
        **{t: zero(t) for t in policy.TONES}, **{k: zero(k) for k in URL_SQL}, "scam_phrase_score": zero("scam_phrase_score"), "sender_impersonation": zero("sender_impersonation_score"),
        "proximity_score": zero("proximity_score", "0.0"), "urls_found": zero("urls", "[]"), "gsb_flagged": zero("flagged", n), "gsb_threat_type": zero("CASE WHEN flagged THEN threat_type END", n),
        "gsb_attempted": zero("n_urls > 0 AND message_id % 3 <> 0", n), "vt_malicious": zero("malicious"), "vt_suspicious": zero("suspicious"), "vt_attempted": zero("NOT flagged AND malicious + suspicious > 0", n),
        "normalized_text": zero("leet", "''"), "feature_contributions": zero("list_sort([" + ", ".join(contributions) + "])", "[]"), "warnings": warned,
    }
    made = f"""{fx.MESSAGES}, {_LINKS}, s0 AS MATERIALIZED ({signals_sql('message_id, label, source, channel, text')}), {_REPUTATION}, rep AS ({_ROLLED}), {NEAR},
s1 AS MATERIALIZED (SELECT s0.*, coalesce(rep.flagged, false) AS flagged, coalesce(rep.malicious, 0) AS malicious, coalesce(rep.suspicious, 0) AS suspicious, rep.threat_type,
  round(coalesce(near.scam, 0.0), 4) AS proximity_score, round(coalesce(near.scam, 0.0), 4) * CAST(0.5 AS DOUBLE) AS proximity_scam_score
  FROM s0 LEFT JOIN rep ON rep.message_id = s0.message_id LEFT JOIN near ON near.vec_id = s0.message_id),
signals AS MATERIALIZED (SELECT *, round(CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-({' + '.join(scaled.values())} - CAST(1.0 AS DOUBLE)))), 4) AS prob FROM s1)"""
    normal = f"scored_norm AS (SELECT *, {_LEET.format(_CLEAN)} AS leet FROM verdicts)"
    return f"WITH {made}, {verdicts_sql()}, {normal} SELECT message_id, {', '.join(f'{q} AS {k}' for k, q in fields.items())} FROM scored_norm"


QUERIES |= {
    "verdict_tier": lambda s, d: _tiers(s, d).select("message_id", "verdict"),
    "confidence_pct": lambda s, d: _tiers(s, d).select("message_id", "confidence"),
    "override_reputation": override_reputation,
    "override_url": _final("verdict", "confidence"),
    "why_flagged": why_flagged,
    "dashboard_reasons": dashboard_reasons,
    "prediction_record": prediction_record,
}
ORACLE_SQL |= {
    "verdict_tier": f"WITH {VERDICTS} SELECT message_id, tier AS verdict FROM verdicts",
    "confidence_pct": f"WITH {VERDICTS} SELECT message_id, pct AS confidence FROM verdicts",
    "override_reputation": f"WITH {VERDICTS} SELECT message_id, v AS verdict, c AS confidence FROM verdicts",
    "override_url": f"WITH {VERDICTS} SELECT message_id, verdict, confidence FROM verdicts",
    "why_flagged": f"WITH {VERDICTS} SELECT message_id, {WHY} AS why_flagged FROM verdicts",
    "dashboard_reasons": f"WITH {VERDICTS}, {PROXIMITY} SELECT message_id, {_duck('array_to_string(' + reasons_sql(policy.DASHBOARD, _NO_DASHBOARD))}, '|') AS reasons FROM scored",
    "prediction_record": _record_sql(),
}
