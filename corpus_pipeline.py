"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Every stage reads what the one before it kept, as Parquet, and its decisions take effect. All but the last
return the columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import decontam, linededup, packing, quality, simhash
from quarrylight.llm.common import crc_mod, cut, ensure_checkpoint_dir, free_name, read_table
from quarrylight.llm.queries import KEEP_AT, byte_bpe


def with_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with an id for every row, and the name of the column that holds the given ids.

    A row without a doc_id gets one from its text, above 2^62, so that given ids come first."""
    given = free_name(docs, "given_id")
    made = F.xxhash64("text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    return docs.withColumn(given, F.col("doc_id")).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), made)), given


def as_given(kept: DataFrame, given: str, docs: DataFrame) -> DataFrame:
    return kept.withColumn("doc_id", F.col(given)).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good; it learns from the labelled rows that aren't held out."""
    labels = read_table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    name = free_name(docs, "quality_score")
    scored = quality.score(docs, quality.fit(docs, labels), name=name)
    return scored.filter(F.col(name) >= KEEP_AT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing is left."""
    own, given = with_ids(docs)
    removed = free_name(own, "lines_removed")
    out = linededup.dedup_lines(own, name=removed)
    kept = out.filter((F.col(removed) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return as_given(kept, given, docs)


def with_hash(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a hash of the text; doc_id and hash together name a document, as ids may be given twice."""
    name = free_name(docs, "text_hash")
    return docs.withColumn(name, F.xxhash64("text")), name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id (then the smallest hash); of repeated rows one."""
    own, given = with_ids(docs)
    own, text_hash = with_hash(own)
    groups = simhash.near_duplicates(own, keep=(text_hash,), **simhash.WIDE)
    members = groups.groupBy("group_no", "doc_id", text_hash).agg(F.count("*").alias("times"))
    first = cut(members.groupBy("group_no").agg(F.min(F.struct("doc_id", text_hash, "times")).alias("first")).select("first.*"))
    kept = own.join(first.select("doc_id", text_hash), ["doc_id", text_hash], "left_semi")
    if not first.filter("times > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", text_hash])
    return as_given(kept, given, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage of eight words or more go; a shorter phrase alone is no evidence."""
    own, given = with_ids(docs)
    own, text_hash = with_hash(own)
    found = decontam.contaminated(own, read_table(spark, sf_dir, "benchmark"), keys=("doc_id", text_hash))
    leaks = found.filter(F.col("window") >= decontam.SHORTEST).select("doc_id", text_hash).distinct()
    return as_given(own.join(leaks, ["doc_id", text_hash], "left_anti"), given, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, byte_bpe())


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A trained classifier, hashes and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
