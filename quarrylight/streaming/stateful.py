"""Streams with state: sessions, finalized counts with late rows apart, deduplicated interval joins, debounce by timers.

All of it works on event time. A watermark says how late rows may be; state that no row within it can need is dropped,
so the state follows the rate of events and the delay, not the length of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylight.streaming.feeds import QUIET_MS

#: transformWithState needs a state store with several column families.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"


def sessions(events: DataFrame, keys: list[str], gap: str, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """The sessions of each key: runs of events of which each is at most `gap` after the one before, with their first and last event and size.

    Over a stream, `delay` is its watermark; a session comes out (append mode) once no event can extend it."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay:
        timed = timed.withWatermark(ts, delay)
    out = timed.groupBy(*keys, F.session_window(ts, gap).alias("session")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"))
    return out.select(*keys, "first_ts", "last_ts", "events")


def sliding_counts(events: DataFrame, keys: list[str], width: str, slide: str, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Counts by key in overlapping windows: an event counts in each window that holds it."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if delay:
        timed = timed.withWatermark(ts, delay)
    return timed.groupBy(*keys, F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")


def finalized_counts(events: DataFrame, keys: list[str], width: str, delay: str, ts: str = "ts") -> DataFrame:
    """Counts by key and window for append mode: a count comes out once, when the watermark has passed its window.

    Rows of a window that came out before are too late and don't count; `late_counts` finds them."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), "n")


def late_counts(arrived: DataFrame, finalized: DataFrame, keys: list[str], width: str, until, ts: str = "ts") -> DataFrame:
    """For each window that ends by `until` (the last watermark): what was counted in time, and what came too late.

    `arrived` is everything that was delivered, `finalized` what append mode gave."""
    w = F.window(F.col(ts).cast("timestamp"), width)
    total = arrived.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("total")).filter(F.col("w.end") <= until).select(*keys, F.col("w.start").alias("window_start"), "total")
    joined = total.join(finalized, [*keys, "window_start"], "left").withColumn("on_time", F.coalesce("n", F.lit(0)).cast("long"))
    return joined.select(*keys, "window_start", "on_time", (F.col("total") - F.col("on_time")).alias("late"))


def once(rows: DataFrame, keys: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """A stream without the rows that are delivered again within the watermark; later copies are too late themselves."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], before: str, left_ts: str, right_ts: str) -> DataFrame:
    """Pairs of rows with equal keys of which the right one lies at most `before` ahead of the left one (or at its time).

    Both sides need watermarks if they are streams: then a right row is kept for `before` and the delays, a left row for the
    delays. The columns of the sides must differ, but for the keys."""
    r = right.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    near = (F.col(right_ts) <= F.col(left_ts)) & (F.col(right_ts) >= F.col(left_ts) - F.expr(f"INTERVAL {before}"))
    return left.join(r, same & near).drop(*(f"_{k}" for k in keys))


class Debounce(StatefulProcessor):
    """Keeps the last event of a key and emits it after `quiet_ms` without another one.

    An event that follows sooner takes its place. The timer runs on event time: it fires when the watermark passes the end of the quiet,
    and then no event can come that would have broken it."""

    def __init__(self, quiet_ms: int = QUIET_MS):
        self.quiet_us = quiet_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("us", T.LongType()), T.StructField("id", T.LongType())]))

    def due(self, us: int) -> int:
        """The first millisecond at which the quiet after a moment is over."""
        return -(-(us + self.quiet_us) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))  # a key's events of one micro-batch
        new = sorted(zip(new["us"].tolist(), new["event_id"].tolist(), strict=True))
        kept = self.last.get()
        if kept is not None:
            self.handle.deleteTimer(self.due(kept[0]))
            new = sorted([(kept[0], kept[1]), *new])
        out = [b for (a, b), (c, _) in zip(new, new[1:], strict=False) if c - a >= self.quiet_us]
        self.last.update(new[-1])
        self.handle.registerTimer(self.due(new[-1][0]))
        yield self.told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self.last.get()
        self.last.clear()
        yield self.told(key, [] if kept is None else [kept[1]])

    def told(self, key, ids: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": pd.Series([key[0]] * len(ids), dtype="int64"), "event_id": pd.Series(ids, dtype="int64")})

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, delay: str, quiet_ms: int = QUIET_MS) -> DataFrame:
    """event_id and user_id of the events of a stream (event_id, user_id, ts) after which their user was quiet."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).filter("user_id is not null")
    rows = timed.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(Debounce(quiet_ms), "user_id long, event_id long", "Append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """The session's state store for the streams that are started inside."""
    before = spark.conf.get(STORE_SETTING, None)
    spark.conf.set(STORE_SETTING, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE_SETTING) if before is None else spark.conf.set(STORE_SETTING, before)


def replay(slices: list[DataFrame], folder: str, build: Callable[[Callable[[str], DataFrame]], DataFrame], watch: Callable | None = None) -> DataFrame:
    """Deliver tables one after the other to a stream, and return all that it appended.

    Each delivery is written as Parquet and the query is started again from its checkpoint until everything is read,
    as after a restart. A slice is a frame or, for several sources, a dict of frames; `build` gets a function that opens
    a source by its name. `watch` is told the progress of each run."""
    spark = None
    for told in slices:
        sources = told if isinstance(told, dict) else {"rows": told}
        for name, rows in sources.items():
            spark = rows.sparkSession
            rows.write.mode("append").parquet(f"{folder}/{name}")
        schemas = {name: rows.schema for name, rows in sources.items()}
        out = build(lambda name, schemas=schemas: spark.readStream.schema(schemas[name]).parquet(f"{folder}/{name}"))
        query = out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").format("parquet").trigger(availableNow=True).start()
        query.awaitTermination()
        if watch:
            watch(query.recentProgress)
        schema = out.schema
    return spark.read.schema(schema).parquet(f"{folder}/out")
