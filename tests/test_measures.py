"""What is counted in texts in one pass, against plain Python."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from palisade.functions import features, measures, patterns, rules, urls

SIGNS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())


def plain(text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    bare = [w.lower().strip(SIGNS) for w in words]
    syllables = sum(1 if len(b) <= 3 else max(1, len(re.findall("[aeiou]+", re.sub("([aeiou])e$", r"\1", b)))) for b in bare)
    kind = lambda k: sum(unicodedata.category(c) == k for c in text)
    return [
        len(words), sum(map(len, bare)), syllables, len(set(bare)), sum(len(w) > 1 and w == w.upper() and w != w.lower() for w in words), len(re.split("[.!?]+", text)),
        sum(c in SIGNS for c in text), text.count("!"), text.count("?"), sum(c in "$€£¥" for c in text), kind("Lu"), kind("Nd"),
    ]


def test_counts_and_links_of_odd_texts(spark):
    rng = random.Random(4)
    parts = ["URGENT", "éa", "É!", "İST", "ΣΑΣ", "...", "--", "tree,", "a.b", "http://x", "x.com/y.", "@ab.org", "٣", "9", "$5", "€", "\n", "\x0b", "\x1c", "ǅ", "Aª", "queue?", "!!", " "]
    lines = ["", " ", "."] + ["".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\t"]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*lines, None])], "id int, text string")
    rows = features.with_parts(df).select("id", "measures", "explicit", "bare", "urls").orderBy("id").collect()
    assert [[r["measures"][c] for c in measures.COUNTS] for r in rows[:-1]] == [plain(t) for t in lines]
    assert all(rows[-1]["measures"][c] is None for c in (*measures.COUNTS, "link_words")) and rows[-1]["urls"] is None
    whole = df.select("id", urls.explicit_urls(F.col("text")).alias("explicit"), urls.bare_hosts(F.col("text")).alias("bare"), urls.extract_urls(F.col("text")).alias("urls")).orderBy("id").collect()
    assert [(r["explicit"], r["bare"], r["urls"]) for r in rows[:-1]] == [(r["explicit"], r["bare"], r["urls"]) for r in whole[:-1]]


def test_patterns_are_tried_where_they_begin():
    finder, rng = patterns.Finder(features.MARKS), random.Random(7)
    words = [w for p in [p for f in features.MARKS.values() for p in f.patterns] for w in re.sub(r"\\.|[^a-z0-9 ]+", " ", p).split()] + list(rules.NEGATORS)
    for _ in range(1_000):
        text = " ".join(rng.choices(words, k=25))
        want = [sum(bool(re.search(p, text, re.ASCII)) if f.negators is None else patterns.unnegated(re.compile(p, re.ASCII), frozenset(f.negators), text) for p in f.patterns) for f in features.MARKS.values()]
        assert finder.counts(text) == want
    tried = [p for f in features.MARKS.values() for p in f.patterns if not patterns.beginnings(p)]
    assert len(tried) < 5  # the others are not looked for in whole texts
