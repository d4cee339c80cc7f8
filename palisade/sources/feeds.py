"""File feeds: link lists, link tables, uploaded chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES, CSV_ROWS = 2_000, 5_000
CHAT_BYTES, CHAT_CHARS, CHAT_SUFFIXES = 1_048_576, 100_000, (".txt", ".log", ".csv")


def feed_lines_scan(spark: SparkSession, path: str, n: int | None = LINES) -> DataFrame:
    """Links of a text feed, one a line, the first ``n`` in order of link."""
    urls = spark.read.text(path).select(F.trim("value").alias("url")).where(F.col("url").rlike("(?i)^https?://"))
    return urls.orderBy("url").limit(n) if n else urls


def feed_csv_scan(spark: SparkSession, path: str, n: int | None = CSV_ROWS, column: str = "url") -> DataFrame:
    """Links of a CSV feed with header (gzip is read as is); quoted commas are read as CSV reads them."""
    urls = spark.read.option("header", True).option("multiLine", False).csv(path).select(F.trim(column).alias("url")).where(F.col("url").rlike("(?i)^https?://"))
    return urls.orderBy("url").limit(n) if n else urls


def conversation_file_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted chats (path, text), and rejected files (path, reason)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    suffix = F.regexp_extract(F.lower("path"), r"([.][a-z0-9]+)$", 1)
    text = F.trim(F.regexp_replace(F.decode("content", "UTF-8"), "�", ""))
    checked = files.select("path", "length", suffix.alias("suffix"), F.when(F.col("length") <= CHAT_BYTES, text).alias("text")).withColumn(
        "reason",
        F.when(~F.col("suffix").isin(*CHAT_SUFFIXES), "type").when(F.col("length") > CHAT_BYTES, "size").when(F.col("text") == "", "empty").when(F.char_length("text") > CHAT_CHARS, "length"),
    )
    return checked.where("reason is null").select("path", "text"), checked.where("reason is not null").select("path", "reason")
