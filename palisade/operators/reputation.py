"""Link reputation: explode, freshness, join and roll-up by message."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST, HOURS = 3, 24


def url_explode(messages: DataFrame, urls: str = "urls", id_col: str = "message_id", first: int = FIRST) -> DataFrame:
    return messages.select(id_col, F.posexplode(F.slice(urls, 1, first)).alias("pos", "url"))


def fresh(reputation: DataFrame, asof: str, hours: int = HOURS) -> DataFrame:
    """The latest row of each link, if it was checked within the hours before ``asof``."""
    latest = reputation.groupBy("url").agg(F.max_by(F.struct("flagged", "threat_type", "malicious", "suspicious", "checked_at"), "checked_at").alias("r")).select("url", "r.*")
    return latest.where(F.col("checked_at") >= F.expr(f"{asof} - INTERVAL {hours} HOURS"))


def url_reputation_join(links: DataFrame, reputation: DataFrame, id_col: str = "message_id") -> DataFrame:
    """Sums by message: a flagged link counts as one malicious, others add their counts; the last flagged's threat."""
    both = links.join(reputation, "url", "left")
    flagged = F.coalesce("flagged", F.lit(False))
    return both.groupBy(id_col).agg(
        F.bool_or(flagged).alias("flagged"),
        F.sum(F.when(flagged, 1).otherwise(F.coalesce("malicious", F.lit(0)))).alias("malicious"),
        F.sum(F.when(flagged, 0).otherwise(F.coalesce("suspicious", F.lit(0)))).alias("suspicious"),
        F.max_by(F.col("threat_type"), F.when(flagged, F.col("pos"))).alias("threat_type"),
        F.count("*").alias("n_urls"),
    )


def looked_up(rows: DataFrame, reputation: DataFrame, urls: str = "urls", first: int = FIRST) -> DataFrame:
    """Adds flagged, malicious, suspicious and threat_type of the first links of each row, as :func:`url_reputation_join`
    sums them, by a join for each place: no state and no regrouping, so it runs on streams too. ``reputation`` has a row a link.
    Rows without a link at a place get a key of their own, since nulls would meet in one task."""
    out = rows
    for k in range(first):
        own = F.concat(F.lit(" "), F.xxhash64(*[c for c in rows.columns if c == urls or rows.schema[c].dataType.simpleString() in ("bigint", "string")]).cast("string"))
        known = reputation.select(F.col("url").alias(f"__u{k}"), F.struct("flagged", "threat_type", "malicious", "suspicious").alias(f"__r{k}"))
        out = out.withColumn(f"__l{k}", F.coalesce(F.get(urls, F.lit(k)), own)).join(known, F.col(f"__l{k}") == F.col(f"__u{k}"), "left")
    found = [F.col(f"__r{k}") for k in range(first)]
    flags = [F.coalesce(r["flagged"], F.lit(False)) for r in found]
    flagged, malicious, suspicious = F.lit(False), F.lit(0).cast("long"), F.lit(0).cast("long")
    for r, is_flagged in zip(found, flags, strict=True):
        flagged = flagged | is_flagged
        malicious = malicious + F.when(is_flagged, 1).otherwise(F.coalesce(r["malicious"], F.lit(0)))
        suspicious = suspicious + F.when(is_flagged, 0).otherwise(F.coalesce(r["suspicious"], F.lit(0)))
    threat = F.coalesce(*[F.when(is_flagged, r["threat_type"]) for r, is_flagged in reversed(list(zip(found, flags, strict=True)))])
    return out.select(*rows.columns, flagged.alias("flagged"), malicious.alias("malicious"), suspicious.alias("suspicious"), threat.alias("threat_type"))


def known_before(rows: DataFrame, checks: DataFrame, ts: str, *, key: str = "url", id_col: str = "message_id", hours: int = HOURS, slice_rows: int = 4_000) -> DataFrame:
    """(id, key, checked_at, flagged, threat_type, malicious, suspicious): for each row the last check of its link at or before
    ``ts``, null where there is none or it is older than ``hours``. Of checks at one time the greatest counts.

    An as-of join: rows and checks of a link in one order of time, the last check carried on. A link of many rows is cut into
    slices of about ``slice_rows`` by quantiles of its times, and each slice begins with the last check before it, so a hot link
    is spread over tasks. Rows without time or link get nulls.
    """
    what = F.struct(F.col("checked_at").alias("at"), "flagged", "threat_type", "malicious", "suspicious")
    right = checks.where(F.col(key).isNotNull() & F.col("checked_at").isNotNull()).groupBy(F.col(key).alias("k"), F.col("checked_at").alias("t")).agg(F.max(what).alias("check"))
    left = rows.select(F.col(id_col).alias("id"), F.col(key).alias("k"), F.col(ts).alias("t"))
    none = F.lit(None).cast(right.schema["check"].dataType)
    timed = left.where("k is not null and t is not null")
    edges = timed.groupBy("k").agg(F.count("*").alias("n"), F.expr("percentile_approx(unix_micros(cast(t as timestamp)), array(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), 1000)").alias("tenths"))
    edges = edges.where(F.col("n") > slice_rows).select("k", F.array_distinct("tenths").alias("edges"))
    place = F.expr("if(edges is null, 0, size(filter(edges, e -> e < unix_micros(cast(t as timestamp)))))")
    # hot links are few rows of edges; the join is left to Spark and skewed sides are split at run time
    marked = timed.join(edges, "k", "left").select("id", "k", "t", none.alias("check"), place.alias("place"))
    dated = right.join(edges, "k", "left").select(F.lit(None).cast(left.schema["id"].dataType).alias("id"), "k", "t", "check", place.alias("place"), "edges")
    # a slice also gets, as from before it, the last check of each earlier slice
    last = dated.where("edges is not null").groupBy("k", "place", "edges").agg(F.max_by(F.struct("t", "check"), "t").alias("l"))
    carried = last.select(F.lit(None).cast(left.schema["id"].dataType).alias("id"), "k", F.col("l.t").alias("t"), F.col("l.check").alias("check"), F.explode(F.expr("filter(sequence(0, size(edges)), p -> p > place)")).alias("place"))
    line = marked.unionByName(dated.drop("edges")).unionByName(carried)
    # at one time, checks come before rows
    order = Window.partitionBy("k", "place").orderBy("t", F.col("check").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = line.withColumn("last", F.last("check", ignorenulls=True).over(order)).where("check is null").select("id", "k", "t", "last")
    seen = seen.unionByName(left.where("k is null or t is null").select("id", "k", "t", none.alias("last")))
    young = F.col("last.at") >= F.col("t") - F.expr(f"INTERVAL {int(hours)} HOURS")
    fields = {"checked_at": "at", "flagged": "flagged", "threat_type": "threat_type", "malicious": "malicious", "suspicious": "suspicious"}
    return seen.select(F.col("id").alias(id_col), F.col("k").alias(key), *[F.when(young, F.col(f"last.{f}")).alias(name) for name, f in fields.items()])
