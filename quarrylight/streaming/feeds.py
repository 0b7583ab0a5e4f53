"""Refreshing feeds: a 30-second trigger, debounce, and latest-wins."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

POLL = "30 seconds"
QUIET_MS = 500


def debounce(events: DataFrame, keys: list[str], ts: str = "ts", tie: str = "event_id", quiet_ms: int = QUIET_MS) -> DataFrame:
    """Of each key's events those after which it was quiet for quiet_ms; the last one is always among them."""
    after = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts, tie))
    gap = F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("_gap", gap).filter(F.col("_gap").isNull() | (F.col("_gap") >= quiet_ms * 1000)).drop("_gap")


def latest(rows: DataFrame, keys: list[str], *version: str) -> DataFrame:
    """The row with the largest version of each key: max_by needs no sort and combines before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in others)).select(*rows.columns)


def snapshot_counts(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Counts by kind and hour; over a stream in complete mode each result replaces the one before."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(kind, F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(kind, F.col("w.start").alias("hour"), "n")


def stream_of(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path)


def refresh(stream: DataFrame, replace: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, failed: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """Hand every new snapshot to `replace` (complete mode, every 30 seconds or until all input is read).

    If `replace` fails, the last good snapshot stays; `failed` is told.
    """

    def each(df: DataFrame, batch: int) -> None:
        try:
            replace(df, batch)
        except Exception as e:
            if failed is None:
                raise
            failed(batch, e)
            df.write.format("noop").mode("overwrite").save()  # the batch's state must be complete all the same

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def refresh_sources(sources: dict[str, Callable[[], DataFrame]], defaults: dict[str, DataFrame], replace: Callable[[str, DataFrame], None]) -> DataFrame:
    """One round of polling: every source is read and handed to `replace` as its new snapshot, all at a time; the round
    ends when all have. A source that fails, wherever it does, is replaced by its default, and the others don't notice.

    The result has a row for each source: its name, whether it is fresh, and the problem otherwise."""

    def one(name: str) -> tuple[str, bool, str | None]:
        try:
            replace(name, sources[name]())
        except Exception as e:  # noqa: BLE001  whatever goes wrong with one source is its own
            replace(name, defaults[name])
            return name, False, type(e).__name__
        return name, True, None

    with ThreadPoolExecutor(max(1, len(sources))) as pool:
        told = list(pool.map(one, sources))
    spark = next(iter(defaults.values())).sparkSession
    return spark.createDataFrame(told, "source string, fresh boolean, problem string")
