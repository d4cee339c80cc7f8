"""Scoring, deduplication and reputation on streams, and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.functions.text import MAX_CHARS, MIN_CHARS
from palisade.operators.serving import score


def message_key(text: Column) -> Column:
    return F.sha2(F.lower(F.trim(text)), 256)


def request_validation(df: DataFrame, text: str = "text", low: int = MIN_CHARS, high: int = MAX_CHARS) -> DataFrame:
    """Adds the trimmed text and a reason: null for rows that pass. Split by ``reason is null`` to quarantine."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    n = F.char_length(t)
    return df.withColumn(text, t).withColumn("reason", F.when(n == 0, "empty").when(n < low, "too_short").when(n > high, "too_long"))


def stream_score(messages: DataFrame, model: Transformer, reputation: DataFrame, **how) -> DataFrame:
    """The record of each arriving message under a stored pipeline, as in batch; stateless, so it runs in append mode."""
    return score(messages, model, reputation, **how)


#: Rows of a key from which it is cut into time slices of about so many rows.
SLICE = 4_000


def time_slices(events: DataFrame, ts: str, key: list[str], id_col: str) -> DataFrame:
    """(key, __t, __i, __slice, __cut): each time of a key in microseconds with its least id. Keys of more than SLICE
    times are cut (``__cut``) into slices of equal duration; rows without a time are left out."""
    rows = events.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp"))).where("__t is not null")
    rows = rows.groupBy(*key, "__t").agg(F.min(F.struct(F.col(id_col).alias("i"))).getField("i").alias("__i"))
    spans = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("__t").alias("__low"), F.max("__t").alias("high")).where(F.col("n") > SLICE)
    width = F.ceil((F.col("high") - F.col("__low") + 1) / F.col("n") * SLICE).cast("long")
    hot = spans.select(*[F.col(k).alias(f"__key{j}") for j, k in enumerate(key)], "__low", width.alias("__width"))
    same = [F.col(k).eqNullSafe(F.col(f"__key{j}")) for j, k in enumerate(key)]
    cut = F.col("__width").isNotNull()
    place = F.when(cut, F.floor((F.col("__t") - F.col("__low")) / F.col("__width"))).otherwise(F.lit(0)).cast("long")
    return rows.join(hot, same, "left").select(*key, "__t", "__i", place.alias("__slice"), cut.alias("__cut"))


def slice_map(times: np.ndarray, life: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps (at, left) of a slice with distinct sorted times: if the last row kept before it is at x, the last one kept
    in it is ``left`` of the least ``at`` of x + life or more; if there is none, no row is kept."""
    follow = np.searchsorted(times, times + life)
    left = times.copy()
    for k in range(len(times) - 1, -1, -1):
        if follow[k] < len(times):
            left[k] = left[follow[k]]
    open_to = int(follow[0]) + 1  # rows that may be the first one kept
    at, left = times[:open_to], left[:open_to]
    ends = np.append(left[1:] != left[:-1], True)
    return at[ends], left[ends]


def dedup_ttl_batch(events: DataFrame, ts: str, key: list[str], seconds: int, id_col: str) -> DataFrame:
    """Rows kept by a greedy time to live: a row stays if no kept row of its key is less than ``seconds`` older.

    A key of many rows is cut into time slices. Each gives a map from the last kept time before it to the last kept
    time in it; the maps are chained by key, and then every slice is folded on its own.
    """
    life = seconds * 1_000_000
    sliced = time_slices(events, ts, key, id_col)
    keys = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in key)

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        at, left = slice_map(np.sort(pdf["__t"].to_numpy(np.int64)), life)
        out = pdf.iloc[np.zeros(len(at), int)][[*key, "__slice"]].reset_index(drop=True)
        return out.assign(__at=at, __left=left)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__slice", "__at"])
        at, left = pdf["__at"].to_numpy(np.int64), pdf["__left"].to_numpy(np.int64)
        slices, starts = np.unique(pdf["__slice"].to_numpy(), return_index=True)
        last, before = None, []
        for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
            before.append(last)
            k = a if last is None else a + int(np.searchsorted(at[a:b], last + life))
            last = int(left[k]) if k < b else last
        out = pdf.iloc[starts][[*key, "__slice"]].reset_index(drop=True)
        return out.assign(__last=pd.array(before, "Int64"))

    maps = sliced.where("__cut").groupBy(*key, "__slice").applyInPandas(steps, f"{keys}, __slice long, __at long, __left long")
    entered = maps.groupBy(*key).applyInPandas(chain, f"{keys}, __slice long, __last long")
    entered = entered.select(*[F.col(k).alias(f"__key{j}") for j, k in enumerate(key)], F.col("__slice").alias("__place"), "__last")
    rows = sliced.groupBy(*key, "__slice").agg(F.sort_array(F.collect_list(F.struct(F.col("__t").alias("t"), F.col("__i").alias("i")))).alias("r"))
    same = [F.col(k).eqNullSafe(F.col(f"__key{j}")) for j, k in enumerate(key)]
    rows = rows.join(entered, [*same, F.col("__slice") == F.col("__place")], "left")
    step = F.aggregate(
        "r",
        F.struct(F.col("__last").alias("last"), F.array().cast(f"array<{events.schema[id_col].dataType.simpleString()}>").alias("kept")),
        lambda a, x: F.when(a["last"].isNull() | (x["t"] - a["last"] >= life), F.struct(x["t"].alias("last"), F.array_append(a["kept"], x["i"]).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    return rows.select(*key, F.explode(step).alias(id_col))


def dedup_ttl_stream(events: DataFrame, ts: str, key: list[str], seconds: int, id_col: str, delay: str = "1 hour") -> DataFrame:
    """The greedy time to live on a stream: the state of a key is the time of its last kept row, dropped when the watermark
    has passed its life. Rows of a key must come in order of time from batch to batch, or within ``delay``."""

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values([ts, id_col], kind="stable")
        held = []
        for at, x in zip(rows.index, (rows[ts].astype("datetime64[us]").astype("int64")).tolist(), strict=True):
            if last is None or x - last >= seconds * 1_000_000:
                last = x
                held.append(at)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[held]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    return events.withWatermark(ts, delay).groupBy(*key).applyInPandasWithState(keep, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


class Reuse(StatefulProcessor):
    """Of each key of a bucket: when its last scored row came, and that row's record. A bucket's keys are one packed table, read and
    written once a batch; keys whose life is over go when the bucket gets rows, and when the last one's is."""

    def __init__(self, record: str, life: int):
        self.record, self.life = record, life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "keys binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["reuse_at", "reuse_id"], kind="stable")
        held, reused, records = self.opened(), [], []
        for k, x, new in zip(pdf["reuse_key"].tolist(), pdf["reuse_at"].tolist(), pdf[self.record].tolist(), strict=True):
            last = held.get(k)
            again = last is not None and x - last[0] < self.life
            if not again:
                last = held[k] = (x, new)
            reused.append(again)
            records.append(last[1])
        if left := self.put(held, timerValues.getCurrentWatermarkInMs()):
            self.handle.registerTimer(max(left, timerValues.getCurrentWatermarkInMs() + 1))
        yield pdf.drop(columns=["reuse_bucket", "reuse_key", "reuse_at", "reuse_id"]).assign(**{self.record: records, "reused": reused})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.put(self.opened(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def opened(self) -> dict[str, tuple[int, str | None]]:
        got = self.held.get()
        if got is None:
            return {}
        table = pa.ipc.open_stream(bytes(got[0])).read_all()
        return dict(zip(table["key"].to_pylist(), zip(table["at"].to_pylist(), table["record"].to_pylist(), strict=True), strict=True))

    def put(self, held: dict[str, tuple[int, str | None]], now: int) -> int:
        """Keeps the keys that are alive; the time in milliseconds when none is."""
        alive = {k: last for k, last in held.items() if (last[0] + self.life) // 1000 > now}
        if not alive:
            self.held.clear()
            return 0
        table = pa.table({"key": pa.array(alive, pa.string()), "at": pa.array([at for at, _ in alive.values()], pa.int64()), "record": pa.array([r for _, r in alive.values()], pa.string())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(),))
        return (max(at for at, _ in alive.values()) + self.life) // 1000

    def close(self) -> None:
        pass


#: The state store that value state and timers need.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def reuse_ttl_stream(rows: DataFrame, ts: str, key: list[str], seconds: int, id_col: str, record: str, delay: str = "1 hour", buckets: int = 256) -> DataFrame:
    """Each row with the record (a text column, such as JSON) of the scored row that stands for it, and ``reused``: a row is
    scored anew if no scored row of its key is less than ``seconds`` older, else it has that row's record. The time of a key runs
    from its scored row; repeats do not renew it. Rows of a key must come in order of time from batch to batch, or within
    ``delay``; the rows of one batch are put in order. The session must use the state store of :data:`ROCKS`.

    Keys are dealt over ``buckets``, whose state is read and written at once: some hundreds of living keys a bucket are well. Their
    number is fixed while the stream's checkpoint lives. Rows without a time are the first of their batch."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    # whole numbers pass pandas as text, since nulls among them would make them floats
    passed = [F.col(c).cast("string").alias(c) if kind in _WHOLE else F.col(c) for c, kind in kinds.items()]
    named = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{j}") for j, c in enumerate(key)]))
    time = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 62)))
    # names that begin with underscores are changed on their way to the processor
    marked = rows.withWatermark(ts, delay).select(*passed, named.alias("reuse_key"), time.alias("reuse_at"), F.col(id_col).alias("reuse_id")).withColumn("reuse_bucket", F.pmod(F.xxhash64("reuse_key"), F.lit(buckets)))
    schema = ", ".join(f"`{c}` {'string' if kind in _WHOLE else kind}" for c, kind in kinds.items()) + ", reused boolean"
    found = marked.groupBy("reuse_bucket").transformWithStateInPandas(Reuse(record, seconds * 1_000_000), outputStructType=schema, outputMode="append", timeMode="eventTime")
    return found.select(*[F.col(c).cast(kind).alias(c) if kind in _WHOLE else F.col(c) for c, kind in kinds.items()], "reused")


def stream_reputation_join(links: DataFrame, reputation: DataFrame, ts: str, hours: int = 24) -> DataFrame:
    """Stream of links left-joined with a static reputation table; stale rows count as unknown."""
    young = F.col("checked_at") >= F.col(ts) - F.expr(f"INTERVAL {hours} HOURS")
    joined = links.join(reputation, "url", "left")
    return joined.select(*[links[c] for c in links.columns], *[F.when(young, F.col(c)).alias(c) for c in ("flagged", "malicious", "suspicious")])
