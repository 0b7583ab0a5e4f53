"""Tables laid out for their joins: bucketed by a key, or partitioned by a column that joins select on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """df as a table of the warehouse in buckets of a key, sorted by it: tables with equal buckets join on the key, and add
    up by it, without a shuffle."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("errorifexists").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def partitioned(df: DataFrame, path: str, *columns: str) -> DataFrame:
    """df as Parquet with a folder for each value: a join with filtered rows of a small table on these columns reads only the
    folders that the small side names (dynamic partition pruning)."""
    df.write.partitionBy(*columns).mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: str) -> None:
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
