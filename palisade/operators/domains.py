"""Domain tables of any size: trusted hosts and borrowed brands, by joins.

Every distinct host is taken apart once, into its parent domains or into its substrings of the lengths that brands have, and
these are joined with the table by equality. Messages then look their hosts up. No table is written into a plan, and Spark
broadcasts a side only where its size is known to be small; skewed hosts are split at run time.

Defined cases: a row without links is not trusted and holds no lookalike; null links are left out; domains are compared in
lower case; an empty table trusts no host; ``id_col`` tells rows apart: rows of one id are judged by all their links together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.functions.urls import url_host


def parents(host: Column) -> Column:
    """A host and the domains above it: a.b.c, b.c and c."""
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _pieces(host: Column, n: int) -> Column:
    """All substrings of n characters; of a shorter host, the host."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(host) - (n - 1), F.lit(1))), lambda i: F.substring(host, i, F.lit(n)))


def _links(df: DataFrame, id_col: str, urls: str) -> DataFrame:
    links = df.select(F.col(id_col).alias("id"), F.explode(F.filter(urls, lambda u: u.isNotNull())).alias("url"))
    return links.select("id", url_host(F.col("url")).alias("host"))


def _judged(df: DataFrame, links: DataFrame, hosts: DataFrame, name: str, every: bool, id_col: str) -> DataFrame:
    """Adds whether every (or any) host of a row is among ``hosts``."""
    marked = links.join(hosts.select("host", F.lit(True).alias("__in")), "host", "left").withColumn("__in", F.coalesce("__in", F.lit(False)))
    found = marked.groupBy("id").agg((F.every if every else F.some)("__in").alias(name)).withColumnRenamed("id", "__id")
    return df.join(found, F.col(id_col) == F.col("__id"), "left").select(*df.columns, F.coalesce(name, F.lit(False)).alias(name))


def trusted_by_table(df: DataFrame, domains: DataFrame, *, id_col: str = "message_id", urls: str = "urls", domain: str = "domain") -> DataFrame:
    """Adds ``trusted``: at least one link, and every host is a domain of the table or lies below one."""
    links = _links(df, id_col, urls)
    up = links.select("host").distinct().select("host", F.explode(parents(F.col("host"))).alias("d"))
    known = domains.select(F.lower(domain).alias("d")).distinct()
    return _judged(df, links, up.join(known, "d", "left_semi").select("host").distinct(), "trusted", True, id_col)


def lookalike_by_table(df: DataFrame, brands: DataFrame, *, id_col: str = "message_id", urls: str = "urls", brand: str = "brand", domain: str = "domain", actions: tuple[str, ...] = rules.HOST_ACTIONS) -> DataFrame:
    """Adds ``lookalike``: some host holds a brand and is none of that brand's domains nor below one, or holds an action word.
    ``brands`` has a row for each domain of a brand; brands without a domain of their own have a null there."""
    table = brands.select(F.lower(brand).alias("b"), F.lower(domain).alias("d")).where("b <> ''").distinct()
    sizes = sorted(r[0] for r in table.select(F.char_length("b")).distinct().limit(256).collect())
    links = _links(df, id_col, urls)
    hosts = links.select("host").distinct()
    cut = F.flatten(F.array(*[_pieces(F.col("host"), n) for n in sizes])) if sizes else F.array().cast("array<string>")
    held = hosts.select("host", F.explode(F.array_distinct(cut)).alias("b")).join(table.select("b").distinct(), "b", "left_semi")
    own = hosts.select("host", F.explode(parents(F.col("host"))).alias("d")).join(table, "d").select("host", "b")
    fake = held.join(own, ["host", "b"], "left_anti").select("host").unionByName(hosts.where(F.col("host").rlike("|".join(actions)))).distinct()
    return _judged(df, links, fake, "lookalike", False, id_col)
