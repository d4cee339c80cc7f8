import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from palisade.llm import collocations, repeats, suffix_groups, vector_codes

DOCS = "doc_id long, text string, lang string, block string, Bucket long, id double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 0.5) for i, t, lang in rows], DOCS)


def test_suffix_orders_are_the_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(200):
        strings = [[rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 30))] + [0] for _ in range(rng.randint(1, 6))]
        offsets = np.cumsum([0] + [len(s) for s in strings])
        want = [int(at) + i for s, at in zip(strings, offsets) for i in sorted(range(len(s)), key=lambda i: s[i:])]
        assert suffix_groups.suffix_orders(np.array(sum(strings, [])), offsets).tolist() == want


def without_repeats(rows, length):
    first = {}
    for i, t, _ in rows:
        data = (t or "").encode()
        for k in range(len(data) - length + 1):
            if i is not None:
                first[data[k : k + length]] = min(first.get(data[k : k + length], i), i)
    out = []
    for i, t, _ in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if i is not None and first[data[k : k + length]] < i:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return Counter(out)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé \0") for _ in range(rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [rng.choice(shared)[rng.randint(0, 20) :] if rng.random() < 0.5 else text(rng.randint(1, 20)) for _ in range(rng.randint(0, 5))]
        rows.append((k, rng.choice(["", " ", "-"]).join(parts), "xx"))
    long = text(6_000)
    rows += [(-5, rows[3][1], "xx"), (None, rows[4][1], "xx"), (7, rows[8][1], "xx"), (70, None, "xx"), (71, "", "xx"), (72, "a" * 3_000, "xx"), (73, "b" + "a" * 2_000, "xx")]
    rows += [(80, long, "xx"), (81, long[:20_000] + "!" + long[20_001:], "xx"), (82, long, "xx"), (82, long, "xx"), (83, "ab" * 900, "xx"), (84, "ba" * 400, "xx")]
    return rows


@pytest.mark.parametrize("how", [{}, {"block_bytes": 4_000}, {"block_bytes": 4_000, "family_blocks": 1}])
def test_repeats_match_brute_force(spark, how):
    rows = passages(2)
    got = repeats.deduplicated(table(spark, rows), **how).collect()
    assert Counter(map(tuple, got)) == without_repeats(rows, repeats.LENGTH)


def test_large_families_are_dealt_out_by_window(monkeypatch):
    rng = random.Random(5)
    core = bytes(rng.choice(b"abc") for _ in range(40))
    sent = []
    for _ in range(3):
        texts = sorted({bytes(rng.choice(b"xy") for _ in range(14)) + core + bytes(rng.choice(b"xy") for _ in range(14)) for _ in range(400)})
        sent.append((np.array([len(t) for t in texts]), np.full(len(texts), 7, np.uint64), np.array([rng.randint(0, 900) for _ in texts]), b"".join(texts)))
    dealt = repeats.sorted_bucket(sent, 50)
    monkeypatch.setattr(repeats, "FAMILY_BYTES", 10**9)
    assert dealt == repeats.sorted_bucket(sent, 50)


def test_repeats_of_a_table_that_is_read_in_another_order_each_time(spark):
    rng = random.Random(6)
    parts = ["".join(rng.choice("abc ") for _ in range(90)) for _ in range(12)]
    rows = [(2**60 + k, "".join(rng.sample(parts, 4)) + f" {k}", "xx") for k in range(200)]

    def shuffled(frames):
        for pdf in frames:
            yield pdf.sample(frac=1, random_state=random.SystemRandom().randrange(2**31))

    docs = table(spark, rows).select("doc_id", "text")
    docs = docs.withColumn("doc_id", docs["doc_id"].cast("string")).coalesce(1).mapInPandas(shuffled, "doc_id string, text string")
    spark.conf.set("spark.sql.exchange.reuse", "false")  # as where a shuffle's parts come from several machines
    try:
        got = repeats.deduplicated(docs, block_bytes=4_000).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert Counter(map(tuple, got)) == without_repeats(rows, repeats.LENGTH)


def test_large_ids_stay_beside_rows_without_id(spark):
    rows = [(None, "x" * 60, "xx")] + [(2**60 + k, "y" * 55 + str(k % 3), "xx") for k in range(6)]
    got = repeats.deduplicated(table(spark, rows)).collect()
    assert Counter(map(tuple, got)) == without_repeats(rows, repeats.LENGTH)


def test_repeats_of_an_empty_table(spark):
    assert repeats.deduplicated(table(spark, []).limit(0)).collect() == []


def phrases(rows, least, top):
    out = []
    by = defaultdict(Counter)
    for _, t, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                by[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in by.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rows_ = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in found.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [4_000_000, 1_000])
def test_collocations_match_brute_force(spark, block_bytes):
    rng = random.Random(3)
    words = ["ba", "Do", "ki", "lu", "mé", "É", "x\x1cy", "it's", "　"]
    rows = []
    for k in range(150):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((k, t, rng.choice(["xx", "yy", None, "und"])))
    rows += [(200, rows[5][1], "xx"), (201, None, "xx"), (202, "", None), (203, ".,!", "zz"), (204, "ki " * 30_000, "yy"), (204, "ki lu " * 50, "yy"), (204, "ki lu " * 50, "yy")]
    got = collocations.collocations(table(spark, rows), top=40, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got)) == phrases(rows, 30, 40)


def test_collocations_that_run_into_the_next_block(spark):
    names = [f"w{k}" for k in range(200)]
    w = collocations.Words(" ".join(names).encode())
    starts = [x for x, t in zip(names, w.trigger) if t]
    others = [x for x, t in zip(names, w.trigger) if not t]
    rows = [(k, f"{others[2 * j]} {others[2 * j + 1]} {starts[j % len(starts)]} {others[-1 - j]}", "xx") for j in range(20) for k in range(40)]
    got = collocations.collocations(table(spark, rows), block_bytes=200).collect()
    assert sorted(map(tuple, got)) == phrases(rows, 30, 2000)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(table(spark, []).limit(0)).collect() == []


def test_chunks_hold_every_phrase_once():
    rng = random.Random(4)
    text = " ".join(rng.choice(["ab", "cd.", "efg", "hij\n", "k", "lmno"]) for _ in range(4_000)).encode()
    phrases_of = lambda w, own: Counter(tuple(w.data[s:e] for s, e in zip(w.starts[i : i + 4], w.ends[i : i + 4])) for i in own if i + 3 < len(w.piece) and w.piece[i] == w.piece[i + 3])
    whole = collocations.Words(text.translate(collocations.TABLE))
    found = Counter()
    for _, chunk in collocations.chunks([text], 3):
        w = collocations.Words(chunk)
        later = np.flatnonzero(w.trigger[1:])
        found += phrases_of(w, range(later[0] + 1 if len(later) else len(w.starts)))
    assert found == phrases_of(whole, range(len(whole.starts)))


def full_search(rows, parts, entries, rounds):
    kept_rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept_rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept_rows:
        return []
    dims = len(kept_rows[0][1])
    kept_rows = [r for r in kept_rows if len(r[1]) == dims]
    width = -(-dims // parts)
    ints = [[math.floor(256 * x) if abs(x) < 2**40 else 256 * int(x) for x in r[1]] + [0] * (width * parts - dims) for r in kept_rows]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(members[k]) for x in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [(r[0], r[2], [near(c[p], books[p]) for p in range(parts)]) for r, c in zip(kept_rows, cut)]
    sums = Counter()
    for _, label, at in found:
        sums[label] += sum(d for d, _ in at)
    return sorted(((i, "".join(f"{k:02x}" for _, k in at), min(sum(d for d, _ in at), 2**63 - 1), min(sums[label], 2**63 - 1), digest) for i, label, at in found), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string, error double, part int"


def vectors(rng, n, dims, scale=1.0):
    rows = [(k, [float(np.float32(rng.gauss(k % 3, 1) * scale)) for _ in range(dims)], rng.choice([1, 2, None])) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * dims, 1), (n + 2, [float("nan")] + [0.0] * (dims - 1), 1), (n + 3, [float("inf")] * dims, 2), (n + 4, [1.0] * (dims + 1), 2)]
    return rows + [(5, rows[5][1], 1), (None, rows[6][1], 2), (n + 6, rows[7][1], None), (n + 7, rows[7][1], None)]


@pytest.mark.parametrize(("n", "dims", "scale"), [(300, 32, 1.0), (300, 19, 0.02), (20, 16, 3.0), (90, 16, 2.0**30)])
def test_vector_codes_match_a_full_search(spark, n, dims, scale):
    rows = vectors(random.Random(6), n, dims, scale)
    df = spark.createDataFrame([(*r, "c", 0.0, 1) for r in rows], VECTORS)
    assert sorted(map(tuple, vector_codes.vector_codes(df).collect()), key=repr) == full_search(rows, 16, 64, 2)


def test_vector_codes_of_an_empty_table(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []


def test_rings_give_the_nearest_entries():
    rng = np.random.default_rng(7)
    for _ in range(20):
        book = rng.integers(-20, 20, (rng.integers(1, 30), 3))
        x = rng.integers(-30, 30, (200, 3))
        balls = vector_codes.Balls(book)
        for before in (rng.integers(0, len(book), 200), balls.guess(x)):
            index, d = balls.assign(x, before)
            full = ((x[:, None] - book[None]) ** 2).sum(2)
            assert index.tolist() == full.argmin(1).tolist() and d.tolist() == full.min(1).tolist()
