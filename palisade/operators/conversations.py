"""Chats: parsing exports, valid turns, overlapping windows, and the fused risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TURN, MIN_WINDOW, WINDOW = 5, 20, 5
#: The two export formats, with seconds and AM or PM where they are written.
BRACKET = r"\[([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4},\s*[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\s*[AP]M)?)\]\s*([^:]+):\s*([^\n]+)"
DASH = r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4},\s*[0-9]{1,2}:[0-9]{2}(?:\s*[AP]M)?)\s*-\s*([^:]+):\s*([^\n]+)"


def _turns(text: Column, pattern: str) -> Column:
    stamp, sender, said = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2, 3))
    return F.zip_with(F.arrays_zip(stamp.alias("a"), sender.alias("b")), said, lambda x, s: F.struct(x["a"].alias("timestamp"), F.trim(x["b"]).alias("sender"), F.trim(s).alias("text")))


def parse_chat_export(chats: DataFrame, text: str = "text", id_col: str = "conv_id") -> DataFrame:
    """(id, turn, timestamp, sender, text): bracketed lines; if there are none, dashed lines; if none, plain lines of
    over ten characters by an unknown sender. Time stamps stay text."""
    t = F.col(text)
    lines = F.filter(F.transform(F.split(t, "\n"), F.trim), lambda x: F.char_length(x) > 10)
    plain = F.transform(lines, lambda x: F.struct(F.lit("").alias("timestamp"), F.lit("Unknown").alias("sender"), x.alias("text")))
    rows = chats.select(id_col, _turns(t, BRACKET).alias("b"), _turns(t, DASH).alias("d"), plain.alias("p"))
    best = F.when(F.size("b") > 0, F.col("b")).when(F.size("d") > 0, F.col("d")).otherwise(F.col("p"))
    return rows.select(id_col, F.posexplode(best).alias("turn", "m")).select(id_col, "turn", "m.*")


def by_chat(turns: DataFrame, id_col: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(id, texts): each chat's valid turns in order. A chat is a row: its turns are few."""
    kept = turns.withColumn("t", F.trim(text)).where(F.char_length("t") > MIN_TURN)
    return kept.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "t"))), lambda x: x["t"]).alias("texts"))


def valid_turns(turns: DataFrame, id_col: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    return by_chat(turns, id_col, order, text).select(id_col, F.posexplode("texts").alias("idx", "text"))


def segments(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, kind, start, n, text): the full text, the windows (partial ones at the end too) and the final part, in
    one table, so one scoring pass serves all three."""
    n = F.size("texts")
    size = F.least(F.lit(WINDOW), n)
    step = F.greatest(F.lit(1), F.floor(size / 2).cast("int"))
    start = F.floor(n * F.lit(0.7)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), n - 1, step), lambda i: F.struct(F.lit("window").alias("kind"), i.alias("start"), F.array_join(F.slice("texts", i + 1, size), " ").alias("text")))
    full = F.array(F.struct(F.lit("full").alias("kind"), F.lit(0).alias("start"), F.array_join("texts", " ").alias("text")))
    final = F.array(F.struct(F.lit("final").alias("kind"), start.alias("start"), F.array_join(F.slice("texts", start + 1, F.greatest(n - start, F.lit(1))), " ").alias("text")))
    rows = chats.select(id_col, n.alias("n"), F.explode(F.concat(full, windows, final)).alias("s")).select(id_col, "n", "s.*")
    length = F.char_length("text")
    return rows.where((F.col("kind") == "full") | ((F.col("kind") == "window") & (length >= MIN_WINDOW)) | ((F.col("kind") == "final") & (length > MIN_WINDOW)))


#: Columns of the full text's score that a chat's record carries.
CARRIED = ("why_flagged", "urls", "malicious", "flagged", "tone_urgency", "tone_fear", "tone_reward", "tone_threat", "scam_type")


def conversation_risk(scored: DataFrame, id_col: str = "conv_id", conf: str = "conf") -> DataFrame:
    """(id, full_score, peak, final_score, risk, verdict, ...) from segments with a confidence between 0 and 1, and what
    the full text's score says besides, where it is there."""
    c, full = F.col(conf), F.col("kind") == "full"
    carried = [k for k in CARRIED if k in scored.columns]
    peak = F.max(F.when(F.col("kind") == "window", F.least(c * (F.col("start") / F.col("n") + 1.0), F.lit(1.0))))
    parts = scored.groupBy(id_col).agg(
        F.max("n").alias("n_turns"),
        F.max(F.when(full, c)).alias("full_score"),
        F.coalesce(peak, F.lit(0.0)).alias("peak"),
        F.max(F.when(F.col("kind") == "final", c)).alias("final"),
        *[F.first(F.when(full, F.col(k)), ignorenulls=True).alias(k) for k in carried],
    )
    parts = parts.withColumn("final_score", F.coalesce("final", "full_score")).drop("final")
    risk = F.round((F.lit(0.40) * F.col("full_score") + F.lit(0.35) * F.col("peak") + F.lit(0.25) * F.col("final_score")) * 100, 1)
    return parts.withColumn("risk", risk).withColumn("verdict", conversation_verdict(F.col("risk")))


def conversation_record(risk: DataFrame, turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The record of each chat: scores in percent, and what the full text's score says."""
    total = turns.groupBy(id_col).agg(F.count("*").alias("total_messages"))
    percent = lambda k: F.round(F.col(k) * 100, 1)
    return risk.join(total, id_col).select(
        id_col, F.col("verdict").alias("overall_verdict"), F.col("risk").alias("risk_score"), "total_messages", F.col("n_turns").alias("messages_analyzed"),
        percent("full_score").alias("full_conversation_score"), percent("peak").alias("window_analysis_score"), percent("final_score").alias("final_messages_score"),
        "why_flagged", F.col("urls").alias("urls_found"), F.col("malicious").alias("vt_malicious"), F.col("flagged").alias("gsb_flagged"), "tone_urgency", "tone_fear", "tone_reward", "tone_threat", "scam_type",
    )


def conversation_verdict(risk: Column) -> Column:
    return F.when(risk >= 43, "SCAM").when(risk >= 30, "SUSPICIOUS").otherwise("LEGIT")


def conversation_suite(df: DataFrame) -> DataFrame:
    """Pass counts of chats with an expected verdict."""
    ok = F.col("verdict") == F.col("expected")
    return df.agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.count_if(ok & (F.col("expected") == "SCAM")).alias("scam_passed"), F.count_if(ok & (F.col("expected") == "LEGIT")).alias("legit_passed"))
