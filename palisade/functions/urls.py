"""Links in messages: extraction, hosts, suspicious marks, trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import rules
from palisade.functions.measures import link_words

#: What belongs to a link that is written with its scheme.
EXPLICIT = r'https?://[^\s<>"{}|\\^`\[\]]+'
PAIR = r"https?://(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z]{2,})"
IP = r"https?://[0-9]{1,3}(?:\.[0-9]{1,3}){3}"


def bare_pattern(suffixes: tuple[str, ...] = rules.BARE_SUFFIXES) -> str:
    """Host names without scheme, with the path that follows."""
    names = "|".join(s.replace(".", r"\.") for s in suffixes)
    return rf"\b(?:[a-zA-Z0-9-]+\.)*[a-zA-Z0-9-]+\.(?:{names})(?:/\S*)?\b"


def mail_or_bare_pattern(suffixes: tuple[str, ...] = rules.BARE_SUFFIXES) -> str:
    """Bare hosts, where the word right after an @ is taken apart first: no host begins there."""
    return "(?i)@[a-zA-Z0-9_]*|" + bare_pattern(suffixes)


def explicit_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EXPLICIT), F.lit(0))


def bare_hosts(text: Column) -> Column:
    """All bare hosts, also those of mail addresses; a text without a dot is not looked through."""
    return F.when(F.contains(text, F.lit(".")), F.regexp_extract_all(text, F.lit("(?i)" + bare_pattern()), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))


def all_urls(text: Column, explicit: Column) -> Column:
    """Explicit links, then bare hosts that are no part of those, with a scheme put before; each once, in order."""
    found = F.when(F.contains(text, F.lit(".")), F.regexp_extract_all(text, F.lit(mail_or_bare_pattern()), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    bare = F.filter(found, lambda u: ~F.startswith(u, F.lit("@")) & ~F.contains(F.array_join(explicit, " "), u))
    return F.array_distinct(F.concat(explicit, F.transform(bare, lambda u: F.when(F.startswith(u, F.lit("http")), u).otherwise(F.concat(F.lit("https://"), u)))))


def extract_urls(text: Column) -> Column:
    return all_urls(text, explicit_urls(text))


def with_links(df: DataFrame, text_col: str = "text", words: Column | None = None) -> DataFrame:
    """Adds ``explicit``, ``bare`` and ``urls``: later steps read these columns instead of the text. ``words`` are the text's
    :func:`link_words`, where they are known."""
    text = F.col("__words")
    rows = df.withColumn("__words", link_words(F.col(text_col)) if words is None else words).withColumns({"explicit": explicit_urls(text), "bare": bare_hosts(text)})
    return rows.withColumn("urls", all_urls(text, F.col("explicit"))).drop("__words")


def url_host(url: Column) -> Column:
    """Lower-case host without port and leading www.; the first path segment where there is no scheme."""
    rest = F.regexp_replace(F.lower(url), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(rest, "^(?:[^/?#@]*@)?([^/:?#]*)", 1), "^www[.]", "")


def has_suspicious_tld(text: Column, tlds: tuple[str, ...] = rules.TLDS) -> Column:
    """Only a host's first two labels are looked at, as the scorer that this replaces does."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)), F.lower)
    return F.exists(pairs, lambda u: F.exists(F.array(*[F.lit(t) for t in tlds]), lambda t: F.endswith(u, t)))


def has_keyword(links: Column, words: tuple[str, ...] = rules.URL_KEYWORDS) -> Column:
    return F.exists(links, lambda u: F.lower(u).rlike("|".join(words)))


def has_ip(text: Column) -> Column:
    return text.rlike(IP)


def is_or_under(host: Column, domain: Column) -> Column:
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def lookalike(url: Column, brands: dict[str, tuple[str, ...]] = rules.BRANDS, actions: tuple[str, ...] = rules.HOST_ACTIONS) -> Column:
    """A host that holds a brand but is none of its domains, or that holds an action word."""
    return lookalike_host(url_host(url), brands, actions)


def lookalike_host(host: Column, brands: dict[str, tuple[str, ...]] = rules.BRANDS, actions: tuple[str, ...] = rules.HOST_ACTIONS) -> Column:
    fake = host.rlike("|".join(actions))
    for brand, real in brands.items():
        own = F.lit(False)
        for d in real:
            own = own | is_or_under(host, F.lit(d))
        fake = fake | (F.contains(host, F.lit(brand)) & ~own)
    return fake


def trusted_all(urls: Column, domains: tuple[str, ...] = rules.TRUSTED) -> Column:
    """True with at least one link and every host a trusted domain or below one."""
    return trusted_hosts(F.transform(urls, url_host), domains)


def trusted_hosts(hosts: Column, domains: tuple[str, ...] = rules.TRUSTED) -> Column:
    names = F.array(*[F.lit(d) for d in domains])
    return (F.size(hosts) > 0) & F.forall(hosts, lambda h: F.exists(names, lambda d: is_or_under(h, d)))


def url_flags(explicit: Column, bare: Column, text: Column) -> dict[str, Column]:
    return {
        "url_suspicious_tld": has_suspicious_tld(text).cast("int"),
        "url_suspicious_keyword": has_keyword(F.concat(explicit, bare)).cast("int"),
        "url_has_ip": has_ip(text).cast("int"),
    }


def url_flags_legacy(text: Column) -> dict[str, Column]:
    """The older flags: host names of explicit links only."""
    pairs = F.regexp_extract_all(F.lower(text), F.lit(PAIR), F.lit(1))
    return {
        "url_suspicious_tld": F.exists(pairs, lambda h: F.exists(F.array(*[F.lit(t) for t in rules.TLDS_LEGACY]), lambda t: F.endswith(h, t))).cast("int"),
        "url_suspicious_keyword": has_keyword(pairs, rules.URL_KEYWORDS_LEGACY).cast("int"),
        "url_has_ip": has_ip(text).cast("int"),
    }
