"""Reading JSON entities, API pages and log files, with what is invalid kept apart."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CORRUPT = "_corrupt_record"
MAX_FILES = 10


#: Where entities come from if the session names no other source.
SOURCE_SETTING, DEFAULT_SOURCE = "spark.quarrylight.source", "/data/quarrylight"


def configured_source(spark: SparkSession, entity: str = "") -> str:
    """The configured source folder, or the default one; with an entity, its path there. An empty setting counts as none."""
    folder = (spark.conf.get(SOURCE_SETTING, "") or DEFAULT_SOURCE).rstrip("/")
    return f"{folder}/{entity}" if entity else folder


def read_entities(spark: SparkSession, path: str, schema: T.StructType, domain: dict[str, tuple[str, ...]] | None = None, required: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines with this schema, and the quarantined ones: corrupt records, null keys, and
    values outside their domain, each with a reason."""
    raw = spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    reason = F.when(F.col(CORRUPT).isNotNull(), "corrupt record")
    for name in required:
        reason = reason.when(F.col(name).isNull(), f"no {name}")
    for name, values in (domain or {}).items():
        reason = reason.when(F.col(name).isNotNull() & ~F.col(name).isin(*values), f"unknown {name}")
    return split_valid(raw.withColumn("reason", reason), CORRUPT)


def split_valid(checked: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and the rest with it."""
    return checked.filter("reason is null").drop("reason", *extra), checked.filter("reason is not null")


def page_items(body: Column, schema: T.StructType) -> Column:
    """The items of a JSON page; a page without them has none."""
    item = schema["items"].dataType
    return F.coalesce(F.from_json(body, schema)["items"], F.array().cast(item))


def chosen_files(slots: DataFrame, limit: int = MAX_FILES) -> DataFrame:
    """The filled slots (slot, path) of an upload; none or too many of them are errors."""
    files = slots.filter(F.col("path").isNotNull())
    n = files.limit(limit + 1).count()
    if not n:
        raise ValueError("select at least one log file")
    if n > limit:
        raise ValueError(f"at most {limit} log files can be analysed at once")
    return files


def without_slot(slots: Column, position: int) -> Column:
    """An array of slots without the one at a position (from 0)."""
    return F.filter(slots, lambda x, i: i != position)


LOG_LINE = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?Z?)\s+\[?(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\]?[\s:-]+(.*)$"


def parse_lines(lines: DataFrame) -> DataFrame:
    """ts, level and message of raw lines; what doesn't parse keeps null in them and its raw text as message."""
    part = lambda k: F.nullif(F.regexp_extract("raw", LOG_LINE, k), F.lit(""))
    level = part(2)
    level = F.when(level == "WARNING", "WARN").when(level.isin("FATAL", "CRITICAL"), "ERROR").otherwise(level)
    return lines.withColumns({"ts": F.try_to_timestamp(F.replace(part(1), F.lit(","), F.lit("."))), "level": level, "message": F.coalesce(part(3), F.col("raw"))})


def read_logs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parsed lines of all readable files, and a status row for each path (also those that can't be read).

    Lines are numbered by their place in the file (in a folder, in the order of its files' names). Spark splits files: the
    lines of a split are numbered where they are read, and the splits before add theirs, so no file is sorted.
    """
    if not 0 < len(paths) <= MAX_FILES:
        raise ValueError(f"1 to {MAX_FILES} log files are analysed at once")
    frames, failed = [], []
    for path in paths:
        try:
            frames.append(spark.read.text(path, wholetext=False).select(F.lit(path).alias("file"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("begin"), "_metadata.file_size", "_metadata.file_modification_time"))
        except AnalysisException as e:
            failed.append((path, "inaccessible", str(e).splitlines()[0][:200]))
    status_schema = "file string, file_status string, problem string"
    status = spark.createDataFrame([(p, "read", None) for p in paths if p not in {f[0] for f in failed}] + failed, status_schema)
    if not frames:
        return spark.createDataFrame([], "file string, line_no long, raw string, ts timestamp, level string, message string, file_size long, file_modification_time timestamp"), status
    raw = frames[0]
    for f in frames[1:]:
        raw = raw.unionByName(f)
    split = ["file", "part", "begin"]
    sizes = raw.groupBy(*split).agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each split
    before = sizes.select(*split, "first", (F.sum("n").over(Window.partitionBy("file").orderBy("part", "begin")) - F.col("n")).alias("before"))
    numbered = raw.join(before, split).withColumn("line_no", F.col("at") - F.col("first") + F.col("before") + 1)
    return parse_lines(numbered).select("file", "line_no", "raw", "ts", "level", "message", "file_size", "file_modification_time"), status
