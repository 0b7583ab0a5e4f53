"""Joins on time: the last row before a moment, and moments inside ranges, as equi-joins and windows of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_US = 3_600_000_000


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, tie: str, within_us: int | None = None, bucket_us: int = BUCKET_US) -> DataFrame:
    """Each left row with the last right row of its key at or before its time; nulls where there is none.

    Of right rows at one time the one with the largest `tie` counts. Both sides are dealt by key and time bucket, so a key that holds most
    rows is spread over its buckets. Inside a bucket a window carries the last right row on; the last right rows of the
    buckets, one each, are carried on to the buckets after them, and serve left rows that find none in their own.
    Rows without a key or time match nothing: left ones stay, with nulls. With `within_us`, an older right row is none.
    The right side's columns must have other names than the left's, but for the keys."""
    values = [c for c in right.columns if c not in keys]
    row = F.struct(*(F.col(c) for c in values))
    usable = F.col("_us").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    bucket = F.expr(f"_us div {bucket_us}") - F.when(F.expr(f"_us % {bucket_us} < 0"), 1).otherwise(0)
    found = right.withColumn("_us", _us(right_ts)).filter(usable).select(*keys, "_us", bucket.alias("_bucket"), F.struct("_us", F.col(tie).alias("tie")).alias("_version"), row.alias("_right"))
    asked = left.withColumn("_us", _us(left_ts)).withColumn("_bucket", F.when(usable, bucket))
    own = F.struct(*(F.col(c) for c in left.columns))

    nothing = F.lit(None)
    right_type, left_type = found.schema["_right"].dataType, asked.select(own.alias("l")).schema["l"].dataType
    version_type = found.schema["_version"].dataType
    both = found.select(*keys, "_bucket", "_us", F.lit(0).alias("_side"), "_version", "_right", nothing.cast(left_type).alias("_left")).unionByName(
        asked.select(*keys, "_bucket", "_us", F.lit(1).alias("_side"), nothing.cast(version_type).alias("_version"), nothing.cast(right_type).alias("_right"), own.alias("_left"))
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy("_us", "_side", F.col("_version.tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_near", F.last(F.when(F.col("_side") == 0, F.struct("_version", "_right")), ignorenulls=True).over(within)).filter("_side = 1")

    latest = found.groupBy(*keys, "_bucket").agg(F.max_by(F.struct("_version", "_right"), "_version").alias("_last"))
    needed = asked.filter("_bucket is not null").select(*keys, "_bucket").distinct()
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    steps = needed.join(latest, [*keys, "_bucket"], "full_outer").withColumn("_far", F.last("_last", ignorenulls=True).over(before)).filter("_far is not null")
    carried = steps.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_bucket").alias("_b"), "_far")
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    match = F.when(F.col("_bucket").isNotNull(), F.coalesce("_near", "_far"))
    joined = near.join(carried, same, "left").select("_left", "_us", match.alias("_m"))
    if within_us is not None:
        joined = joined.withColumn("_m", F.when(F.col("_us") - F.col("_m._version._us") <= within_us, F.col("_m")))
    return joined.select("_left.*", *(F.col(f"_m._right.{c}").alias(c) for c in values))


def range_join(points: DataFrame, ranges: DataFrame, ts: str, start: str, end: str, keys: list[str] | None = None, bin_us: int = BUCKET_US) -> DataFrame:
    """Each point with each range [start, end) that holds it, once (and with equal keys, if any are given).

    A range goes to the two or three bins that it meets on the level whose bins are about as long as the range, so a
    long one is not cut into many; a point looks in its one bin of each level that has ranges. That is an equi-join on level
    and bin, with the exact comparison behind it. Empty ranges and rows without a time match nothing."""
    keys = keys or []
    r = ranges.withColumns({"_start": _us(start), "_end": _us(end)}).filter(F.col("_start") < F.col("_end"))
    # A double's rounding can move a length near a power of two by one level; the bins are right on any.
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("_end") - F.col("_start")) / F.lit(float(bin_us))))).cast("int")
    r = r.withColumn("_level", level)
    size = F.lit(bin_us).cast("long") * F.pow(F.lit(2.0), F.col("_level")).cast("long")
    floor = lambda us, width: (us - F.pmod(us, width)) / width  # noqa: E731  whole, as a double below 2^53
    r = r.withColumn("_bin", F.explode(F.sequence(floor(F.col("_start"), size).cast("long"), floor(F.col("_end") - 1, size).cast("long"))))
    levels = sorted(x[0] for x in ranges.select(F.greatest(F.lit(0), F.ceil(F.log2((_us(end) - _us(start)) / F.lit(float(bin_us))))).cast("int").alias("l")).filter("l is not null").distinct().collect())
    if not levels:
        levels = [0]
    p = points.withColumn("_us", _us(ts)).filter("_us is not null").withColumn("_level", F.explode(F.array(*(F.lit(x) for x in levels))))
    p = p.withColumn("_bin", floor(F.col("_us"), F.lit(bin_us).cast("long") * F.pow(F.lit(2.0), F.col("_level")).cast("long")).cast("long"))
    shared = [*keys, "_level", "_bin"]
    # The sort-merge hint keeps a range side of unknown size off the driver.
    joined = p.join(r.hint("merge"), shared).filter((F.col("_us") >= F.col("_start")) & (F.col("_us") < F.col("_end")))
    return joined.drop("_us", "_level", "_bin", "_start", "_end")
