"""Tables of messages, links, chats and reputation that Spark derives from the given tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Appended to a text by its id, so that every rule has rows that it fires on.
CUES = (
    "",
    "URGENT act now, your account is suspended, verify immediately at http://secure-login.example.tk/verify",
    "This is not urgent, do not worry, never act now.",
    "You have won a cash prize of $5000, claim your reward today!!!",
    "Visit http://192.168.10.5/login to update your details",
    "Your statement is ready at https://www.wikipedia.org/statements thank you for your business",
    "Check https://paypa1-secure.com and https://paypal-support.xyz/confirm please",
    "See https://bit.ly/abc123 for info",
    "Get $500 and €300 guaranteed profit, double your bitcoin investment and claim the bonus",
    "Your code is 482913. Do not share this code with anyone, it is a one-time code.",
    "Your appointment is confirmed, receipt attached, thank you for your order, no action is needed",
    "We will file a lawsuit and the police will arrest you if you fail to pay",
    "Hi dear, I saw your profile, are you single? I am a widow stationed abroad",
    "My uncle taught me crypto trading and I made a great return, let me show you how, just DM me",
    "🎉 Congratulations 🎁 you are selected 💰",
    "<b>Click</b> <a href=x>here</a> to unlock",
    "Y0ur acc0unt h4s been l1mited, v3rify n0w @ bank",
    "Work from home and earn $300 per day, no experience needed, why wait?",
    "Your parcel is held at customs, pay the delivery fee at http://usps-track.top/pay",
    "IRS notice: tax refund pending, submit your SSN at https://irs-refund.click",
    "Contact billing@mail.example.com or visit example.org for help, log in at paypal-verify.com/login (see irs.gov/help).",
    "Your computer has a virus, call Microsoft support now",
    "Final warning: your insurance will be cancelled unless you confirm",
    "I have no fear and without worry; nothing is urgent. Hi dear, nice to meet you, true love",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder of spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="palisade-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/query-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The table dealt over all cores, whatever its files: of a large file's splits only those with a row group's middle have rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(3 * cores, df.rdd.getNumPartitions()), key)


#: Rows that a Python worker gets at a time: a text's terms and vector take several kilobytes.
ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the rows of a batch for Python workers, for this and later queries of the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, str(ROWS))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, text, source, channel, label, prob): documents with a cue, labels, and a made-up probability."""
    docs, labels = dealt(read(spark, sf_dir, "documents"), "doc_id"), read(spark, sf_dir, "labels")
    cue = F.element_at(F.array(*[F.lit(c) for c in CUES]), (F.col("doc_id") % len(CUES) + 1).cast("int"))
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("message_id"),
        F.concat("text", F.lit(" "), cue).alias("text"),
        "source",
        F.col("lang").alias("channel"),
        F.coalesce("toxic", F.lit(0)).alias("label"),
        ((F.col("doc_id") * 37) % 100 / 100.0).alias("prob"),
    )


_CASES = " ".join(f"WHEN {k} THEN {quoted(c)}" for k, c in enumerate(CUES))
MESSAGES = f"""messages AS (
  SELECT d.doc_id AS message_id, d.text || ' ' || CASE d.doc_id % {len(CUES)} {_CASES} END AS text,
    d.source, d.lang AS channel, coalesce(l.toxic, 0) AS label, CAST((d.doc_id * 37) % 100 AS DOUBLE) / 100.0 AS prob
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def contained(col: str, cues: tuple[str, ...] | dict[str, int]) -> str:
    weights = cues if isinstance(cues, dict) else dict.fromkeys(cues, 1)
    phrases = ", ".join(quoted(c) for c, w in weights.items() for _ in range(w))
    return f"len(list_filter([{phrases}], lambda phrase: contains({col}, phrase)))"


def matching(col: str, patterns: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({col}, {quoted(p)}) AS INT)" for p in patterns) + ")"


def count(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {quoted(pattern)}))"


def words(col: str) -> str:
    return f"list_filter(string_split_regex({col}, '\\s+'), lambda w: w <> '')"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"


def unnegated(col: str, patterns: tuple[str, ...], negators: tuple[str, ...]) -> str:
    """Matches with no negator among the six words in the 40 characters before them."""
    total = []
    for p in patterns:
        parts = f"string_split(regexp_replace({col}, {quoted(f'({p})')}, chr(1) || '\\1', 'g'), chr(1))"
        before = f"list_filter(string_split_regex(right(array_to_string(({parts})[1:k - 1], ''), 40), '[ \\t\\r\\n]+'), lambda w: w <> '')"
        void = f"list_has_any(({before})[-6:], [{', '.join(map(quoted, negators))}])"
        total.append(f"CASE WHEN regexp_matches({col}, {quoted(p)}) THEN len(list_filter(range(2, len({parts}) + 1), lambda k: NOT {void})) ELSE 0 END")
    return "(" + " + ".join(total) + ")"
