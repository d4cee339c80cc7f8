"""Document fingerprints after I-Match, in DataFrame expressions only.

Terms whose document frequency lies in a band form the lexicon: frequent enough to be shared, rare enough to tell
texts apart. At most (mean terms of a text) / LOW terms can reach the lower bound, whatever the corpus's size, so the
lexicon is a literal of the plan. Each of SUBSETS randomised lexicons holds every term of it with probability MEMBER /
SUBSETS, and they overlap: a term is in MEMBER of them. For each, the sorted distinct terms that the text has in that
lexicon are hashed together; likeness is the share of equal hashes among the lexicons that either text has terms in.

Defined cases: null text counts as empty; a text with fewer than FEW lexicon terms takes all its terms, dealt over the
randomised lexicons by the same rule (such short or rare texts would have an empty fingerprint else); texts without
terms have an all-zero fingerprint and are like each other (1.0) and unlike others (0.0); rows that share an id follow
each other in order of a hash of their texts, and lie in one run; null ids come last in descending order, dealt over
runs by that hash; equal rows are alike; a lone document follows itself; texts of any length are taken whole; an empty
table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Band of document frequencies as shares of all documents.
LOW, HIGH = 0.01, 0.05
#: Randomised lexicons (64 at most), how many of them a term is in, and band terms below which a text takes all terms.
SUBSETS, MEMBER, FEW = 64, 4, 8
#: Documents in a run of neighbours, quantile cells of ids, runs in a block, and runs whose first rows are broadcast.
RUN, CELLS, RUNS, BROADCAST = 1_000, 256, 4_096, 1_000_000


def terms(text: str) -> str:
    """SQL for the 64-bit hashes of the words of a text, in order."""
    return f"transform(filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{Nd}}]+'), w -> w <> ''), w -> xxhash64(w))"


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms in the band; partial counts are made before the shuffle."""
    n = docs.count()
    words = docs.select(F.explode(F.expr(f"array_distinct({terms(text_col)})")).alias("t"))
    kept = words.groupBy("t").agg(F.count("*").alias("df")).where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= high * n))
    return sorted(r["t"] for r in kept.select("t").collect())


def in_lexicon(lexicon_terms: list[int]) -> str:
    """SQL for whether term t is in the lexicon: a look at one of many small literal arrays."""
    n = 1 << max(len(lexicon_terms), 1).bit_length()
    cells: list[list[int]] = [[] for _ in range(n)]
    for t in lexicon_terms:
        cells[t % n].append(t)
    rows = ", ".join(f"array({', '.join(f'bigint({t})' for t in c)})" if c else "cast(array() as array<bigint>)" for c in cells)
    return f"array_contains(array({rows})[cast(pmod(t, {n}L) as int)], t)"


def fingerprint(text: str, lexicon_terms: list[int]) -> str:
    """SQL for SUBSETS hashes of 16 bits, 0 where a randomised lexicon has none of the text's terms."""
    band = f"filter(a, t -> {in_lexicon(lexicon_terms)})"
    own = f"transform(array({band}), b -> if(size(b) >= {FEW}, b, a))[0]"
    member = " | ".join(f"shiftleft(1L, cast(pmod(shiftright(t, {10 + 9 * k}), {SUBSETS}L) as int))" for k in range(MEMBER))
    marked = f"transform({own}, t -> struct(t as t, {member} as m))"
    held = "filter(own, x -> (shiftright(x.m, j) & 1L) = 1L)"
    hashed = f"transform(array({held}), s -> if(size(s) = 0, 0L, pmod(xxhash64(s), 65535L) + 1L))[0]"
    whole = f"transform(array(array_sort(array_distinct({terms(text)}))), a -> {marked})"
    return f"transform({whole}, own -> transform(sequence(0, {SUBSETS - 1}), j -> {hashed}))[0]"


def likeness(a: str, b: str) -> Column:
    either = f"size(filter(zip_with({a}, {b}, (x, y) -> x <> 0L or y <> 0L), x -> x))"
    same = f"size(filter(zip_with({a}, {b}, (x, y) -> x <> 0L and x = y), x -> x))"
    return F.expr(f"if({either} = 0, 1.0D, cast({same} as double) / {either})")


def as_text(prints: str) -> Column:
    return F.expr(f"lower(array_join(transform({prints}, x -> lpad(hex(x), 4, '0')), ''))")


def runs(docs: DataFrame, id_col: str) -> tuple[Column, int]:
    """A number that rises with the id and holds about RUN documents: cells between quantiles, cut evenly."""
    row = docs.agg(F.count("*").alias("n"), F.percentile_approx(id_col, [i / CELLS for i in range(CELLS + 1)], CELLS * 20).alias("q")).first()
    n = row["n"]
    edges = sorted(set(row["q"] or []))
    inner = max(1, -(-n // (RUN * max(len(edges), 1))))
    if len(edges) < 2:
        return F.when(F.col(id_col).isNotNull(), F.lit(0)).cast("long"), 1
    x = F.col(id_col)
    array = F.array(*[F.lit(e) for e in edges[1:]])
    cell = F.least(F.size(F.filter(array, lambda e: e <= x)), F.lit(len(edges) - 2))
    lo, hi = F.element_at(F.array(*[F.lit(e) for e in edges[:-1]]), cell + 1), F.element_at(array, cell + 1)
    within = F.floor((x - lo).cast("double") / F.greatest(hi - lo, F.lit(1)).cast("double") * inner)
    place = cell.cast("long") * inner + F.greatest(F.least(within, F.lit(inner - 1)), F.lit(0))
    return F.when(x.isNotNull(), place.cast("long")), inner * len(edges)


def with_next(docs: DataFrame, columns: list[str], *, id_col: str, prepared: dict[str, Column]) -> DataFrame:
    """Each row, with ``prepared`` columns, and a struct ``next`` of some columns of the document after it in
    descending order of id.

    Rows are dealt into runs of neighbouring ids, and the first row of each run also goes to the run before it (the
    very first to the last), so one shuffle of the texts is enough and no run needs another.
    """
    place, n_runs = runs(docs, id_col)
    null_runs = max(1, -(-docs.where(F.col(id_col).isNull()).count() // RUN))
    mark = F.xxhash64("text")
    part = F.shiftrightunsigned(mark, 32) * F.lit(null_runs) / F.lit(float(1 << 32))
    rows = docs.withColumn("mark", F.bitwise_not(mark)).withColumn("run", F.coalesce(place, F.lit(-1) - F.floor(part)))
    heads = rows.groupBy("run").agg(F.max(F.struct(F.col(id_col).alias("id"), "mark")).alias("head"))
    heads = heads.withColumn("block", F.floor(F.col("run") / RUNS))
    order = Window.orderBy(F.desc("block"))  # a row for each block of runs
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = heads.groupBy("block").agg(F.min("run").alias("lowest"))
    blocks = blocks.select("block", F.coalesce(F.lag("lowest").over(order), F.last("lowest").over(whole)).alias("outer"))
    above = F.lag("run").over(Window.partitionBy("block").orderBy(F.desc("run")))
    heads = heads.join(blocks, "block").select("head", F.col("run").alias("own"), F.coalesce(above, "outer").alias("to"))
    if n_runs + null_runs <= BROADCAST:
        heads = F.broadcast(heads)
    is_head = rows[id_col].eqNullSafe(heads["head.id"]) & (rows["mark"] == heads["head.mark"]) & (rows["run"] == heads["own"])
    guests = rows.join(heads, is_head).select(*docs.columns, "mark", F.col("to").alias("run"), F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    both = both.withColumns(prepared)
    within = Window.partitionBy("run").orderBy("guest", F.desc_nulls_last(id_col), F.desc("mark"))
    return both.withColumn("next", F.lead(F.struct(*columns)).over(within)).where("not guest").drop("run", "guest", "mark")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = lexicon(rows, low=LOW, high=HIGH)
    both = with_next(rows, ["text", "own"], id_col=id_col, prepared={"own": F.expr(fingerprint("text", found))})
    both = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("k", F.expr("cast(n_chars div 3 as int)"))
    edited = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - k), substring(next.text, 1, k))"))
    edited = edited.withColumn("changed", F.expr(fingerprint("edited", found)))
    return edited.select(
        id_col,
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "next.own").alias("near_next"),
    )
