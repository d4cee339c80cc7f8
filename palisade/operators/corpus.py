"""The message corpus: joins, deduplicated appends, dimension upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import rules

#: Rows up to which a dimension is broadcast.
SMALL_DIMENSION = 100_000


def dimension(df: DataFrame) -> DataFrame:
    """Marked for broadcast after its size is checked; a large one is left to the optimiser."""
    return F.broadcast(df) if df.limit(SMALL_DIMENSION + 1).count() <= SMALL_DIMENSION else df


def corpus_join(messages: DataFrame, channels: DataFrame, sources: DataFrame, features: DataFrame) -> DataFrame:
    """Messages with channel and source names and their stored features; rows without a partner go."""
    return messages.join(dimension(channels), "channel_id").join(dimension(sources), "source_id").join(features, "message_id")


def source_get_or_create(known: DataFrame, names: DataFrame, id_col: str = "source_id", name_col: str = "source") -> DataFrame:
    """The dimension with new names appended; ids go on from the greatest. New names are few next to the rows."""
    new = names.select(name_col).where(F.col(name_col).isNotNull()).distinct().join(known, name_col, "left_anti")
    top = known.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).first()["top"]
    numbered = new.withColumn(id_col, (F.row_number().over(Window.orderBy(name_col)) + top).cast(known.schema[id_col].dataType))
    return known.select(id_col, name_col).unionByName(numbered.select(id_col, name_col))


def new_messages(existing: DataFrame, batch: DataFrame, *, text: str = "text", pos: str = "pos", min_len: int = 20, dedup: bool = True) -> DataFrame:
    """Stripped rows of a batch that are long enough, not in the corpus and, of equal texts, first by position."""
    clean = batch.withColumn(text, F.trim(text)).where((F.col(text) != "") & (F.char_length(text) >= min_len))
    if not dedup:
        return clean
    first = clean.groupBy(text).agg(F.min_by(F.struct(*[c for c in clean.columns if c != text]), pos).alias("r")).select(text, "r.*")
    return first.join(existing.select(text).distinct(), text, "left_anti")


def with_next_ids(rows: DataFrame, top: int, *, pos: str = "pos", id_col: str = "message_id", range_rows: int = 200_000) -> DataFrame:
    """Dense ids from top + 1 in order of ``pos``. Rows are ranked inside ranges of about ``range_rows`` rows; only range sizes
    meet in one place."""
    parts = min(10_000, 1 + rows.count() // range_rows)  # at 10,000 the ranges grow instead
    edges = rows.agg(F.percentile_approx(pos, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).first()["q"] or []
    cut = F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast("array<long>")
    ranged = rows.withColumn("__r", F.size(F.filter(cut, lambda e: e < F.col(pos))))
    sizes = ranged.groupBy("__r").count()
    before = sizes.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("__r").orderBy(pos))
    return ranged.withColumn("__n", rank).join(F.broadcast(before), "__r").withColumn(id_col, F.col("__n") + F.col("__before") + top).drop("__r", "__n", "__before")


def corpus_append(existing: DataFrame, batch: DataFrame, *, text: str = "text", pos: str = "pos", id_col: str = "message_id", min_len: int = 20, dedup: bool = True) -> DataFrame:
    """The rows to append, with ids after the greatest one known."""
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).first()["top"]
    return with_next_ids(new_messages(existing, batch, text=text, pos=pos, min_len=min_len, dedup=dedup), top, pos=pos, id_col=id_col)


def lure_wrap(urls: DataFrame, key: str, url: str = "url", lures: tuple[str, ...] = rules.LURES) -> DataFrame:
    """A text around each bare link, from a template chosen by the key."""
    chosen = F.element_at(F.array(*[F.lit(x) for x in lures]), (F.pmod(F.col(key), F.lit(len(lures))) + 1).cast("int"))
    return urls.withColumn("text", F.replace(chosen, F.lit("{url}"), F.col(url)))


def label_balance_report(before: DataFrame, appended: DataFrame, label: str = "label") -> DataFrame:
    both = before.select(label, F.lit(0).alias("new")).unionByName(appended.select(label, F.lit(1).alias("new")))
    return both.agg(
        F.count_if(F.col("new") == 0).alias("n_before"),
        F.count("*").alias("n_after"),
        F.count_if(F.col(label) == 1).alias("scam_after"),
        F.count_if(F.col(label) == 0).alias("legit_after"),
    )


def content_hash(text: str = "text"):
    """What a stored vector remembers of its text; null texts are empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def embedding_plan(messages: DataFrame, stored: DataFrame, *, rebuild: bool = False, id_col: str = "message_id", text: str = "text", hash_col: str = "content_hash") -> DataFrame:
    """(id, action) for every id of either table: ``new`` texts, ``changed`` ones (stored under another hash, or ``rebuild``),
    ``kept`` ones and ``gone`` ones, which have no text any more. An id that stands several times is judged by its least hash."""
    now = messages.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(content_hash(text)).alias("now"))
    then = stored.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.coalesce(hash_col, F.lit(""))).alias("then"))
    action = F.when(F.col("now").isNull(), "gone").when(F.col("then").isNull(), "new").when(F.lit(rebuild) | (F.col("now") != F.col("then")), "changed").otherwise("kept")
    return now.join(then, id_col, "full").select(id_col, action.alias("action"))


def embedding_upsert(stored: DataFrame, fresh: DataFrame, plan: DataFrame, *, id_col: str = "message_id") -> DataFrame:
    """The stored table after a plan: kept rows as they are, new and changed ones from ``fresh``, gone ones left out."""
    held = stored.join(plan.where("action = 'kept'").select(id_col), id_col, "left_semi")
    made = fresh.join(plan.where("action in ('new', 'changed')").select(id_col), id_col, "left_semi")
    return held.unionByName(made.select(*stored.columns))
