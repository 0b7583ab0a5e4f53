"""Comparing and synchronizing article sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.sources.writers import read_version, write_version


def with_hash(articles: DataFrame, *content: str) -> DataFrame:
    return articles.withColumn("content_hash", F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content)), 256))


def new_rows(source: DataFrame, current: DataFrame, key: str = "source_id") -> DataFrame:
    return source.join(current.select(key), key, "left_anti")


def modified_rows(source: DataFrame, current: DataFrame, key: str = "source_id") -> DataFrame:
    old = current.select(key, F.col("content_hash").alias("old_hash"))
    return source.join(old, key).filter(~F.equal_null("content_hash", "old_hash")).drop("old_hash")


def upsert(source: DataFrame, current: DataFrame, key: str = "source_id") -> DataFrame:
    """Every row of either side with its outcome: inserted, updated, unchanged or kept (not in the source).

    One full outer join on the key does it all; the current side's values stand where nothing changed.
    """
    columns = [c for c in current.columns if c not in (key, "outcome")]
    s = source.select(key, F.struct(*columns).alias("s"))
    c = current.select(key, F.struct(*columns).alias("c"))
    joined = s.join(c, key, "full_outer")
    outcome = F.when(F.col("c").isNull(), "inserted").when(F.col("s").isNull(), "kept").when(F.equal_null("s.content_hash", "c.content_hash"), "unchanged").otherwise("updated")
    row = F.when(F.col("s").isNotNull(), F.col("s")).otherwise(F.col("c"))
    return joined.withColumn("outcome", outcome).withColumn("row", F.when(F.col("outcome") == "unchanged", F.col("c")).otherwise(row)).select(key, *(F.col(f"row.{x}").alias(x) for x in columns), "outcome")


def deactivate(current: DataFrame, gone: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows whose key is in `gone` become inactive; they aren't deleted."""
    mark = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return current.join(mark, key, "left").withColumn("active", F.when(F.col("_gone"), False).otherwise(F.coalesce("active", F.lit(True)))).drop("_gone")


def delete(current: DataFrame, gone: DataFrame, key: str = "source_id") -> DataFrame:
    return current.join(gone.select(key), key, "left_anti")


def run_sync(source: DataFrame, folder: str, version: int) -> DataFrame:
    """Synchronize version `version` in a folder with a source snapshot into the next version; the outcomes' counts.

    The new version is written beside the old one. If anything fails, the old one is still there.
    """
    spark = source.sparkSession
    result = upsert(source, read_version(spark, folder, version))
    path = write_version(result, folder, version + 1)
    return spark.read.parquet(path).groupBy("outcome").count()


BUCKETS = 64


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def write_buckets(snapshot: DataFrame, folder: str, version: int, key: str = "source_id", buckets: int = BUCKETS) -> None:
    """The first version of a snapshot in hash buckets: a folder of files for each bucket, and a manifest that names, for each
    bucket, the version whose files hold it."""
    snapshot.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/data/v{version:010d}")
    held = {b: version for b in range(buckets)}
    _write_manifest(snapshot, folder, version, held)


def _write_manifest(df: DataFrame, folder: str, version: int, held: dict[int, int]) -> None:
    """Written last: a version is there when its manifest is."""
    df.sparkSession.createDataFrame(sorted(held.items()), "bucket int, data_version long").coalesce(1).write.parquet(f"{folder}/manifest/v{version:010d}")


def manifest(spark, folder: str, version: int) -> dict[int, int]:
    """Bucket to data version; as many entries as buckets."""
    return {r.bucket: r.data_version for r in spark.read.parquet(f"{folder}/manifest/v{version:010d}").collect()}


def read_buckets(spark, folder: str, version: int, schema=None, only: set[int] | None = None) -> DataFrame:
    """A version of the snapshot (or some of its buckets), from the files of all the versions that its manifest names.

    With the columns' schema given, a snapshot without any row can be read too."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())]))
    by_version: dict[int, list[int]] = {}
    for bucket, held in manifest(spark, folder, version).items():
        if only is None or bucket in only:
            by_version.setdefault(held, []).append(bucket)
    frames = [reader.parquet(f"{folder}/data/v{held:010d}").filter(F.col("bucket").isin(wanted)) for held, wanted in sorted(by_version.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def sync_buckets(source: DataFrame, folder: str, version: int, key: str = "source_id") -> DataFrame:
    """Synchronize a bucketed snapshot into its next version, writing only the buckets in which something changed; the counts of the outcomes.

    Keys and content hashes tell the changes; then the touched buckets alone are read in full, merged and written. All other
    files stay where they are, and the old version is still readable. The source has the snapshot's columns."""
    spark = source.sparkSession
    held = manifest(spark, folder, version)
    current = read_buckets(spark, folder, version, source.schema)
    thin = upsert(source.select(key, "content_hash"), current.select(key, "content_hash"), key)
    told = thin.groupBy(_bucket(key, len(held)), "outcome").count().collect()  # four rows a bucket at most
    touched = {r.bucket for r in told if r.outcome in ("inserted", "updated")}
    if touched:
        mine = source.withColumn("bucket", _bucket(key, len(held))).filter(F.col("bucket").isin(sorted(touched))).drop("bucket")
        merged = upsert(mine, read_buckets(spark, folder, version, source.schema, touched).drop("bucket"), key).drop("outcome")
        merged.withColumn("bucket", _bucket(key, len(held))).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/data/v{version + 1:010d}")
    _write_manifest(source, folder, version + 1, {b: version + 1 if b in touched else v for b, v in held.items()})
    counts: dict[str, int] = {}
    for r in told:
        counts[r.outcome] = counts.get(r.outcome, 0) + r["count"]
    return spark.createDataFrame(sorted(counts.items()), "outcome string, n long")
