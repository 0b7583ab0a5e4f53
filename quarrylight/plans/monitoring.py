"""Log analysis: rules, anomalies, status and notification events.

Levels give errors and warnings, rules give issues, and hours with more than mean + 3 sigma events of a kind are
anomalies. Finding issues is apart from telling anyone: notifications are a DataFrame that a writer delivers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.functions.maps import notification_type
from quarrylight.functions.scalars import content_id

SIGMAS = 3.0
MAX_RULES = 1_000


def rule_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    """(pattern, regex, severity, description, recommended_action, related_article); of any number, for `rules.rule_issues`."""
    return spark.createDataFrame(rules, "pattern string, regex string, severity string, description string, recommended_action string, related_article string")


def issues(lines: DataFrame, rules: list[tuple]) -> DataFrame:
    """An issue for each line and rule whose expression it matches.

    The rules are few by contract, so each becomes one expression of a single pass over the lines: no join. More rules
    than MAX_RULES are joined with the lines by `rules.rule_issues`.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    fields = ("pattern", "severity", "description", "recommended_action", "related_article")
    found = [F.when(F.col("message").rlike(regex), F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(fields, (pattern, severity, text, action, article), strict=True)))) for pattern, regex, severity, text, action, article in rules]
    return lines.select("file", "line_no", "ts", "level", "message", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("file", "line_no", "ts", "level", "message", "i.*")


def level_issues(lines: DataFrame) -> DataFrame:
    """Errors are critical, warnings early signs."""
    return lines.filter(F.col("level").isin("ERROR", "WARN")).select("file", "line_no", "ts", "level", "message", F.lower("level").alias("pattern"), F.when(F.col("level") == "ERROR", "CRITICAL").otherwise("WARNING").alias("severity"))


def anomalies(events: DataFrame, *series: str, sigmas: float = SIGMAS) -> DataFrame:
    """Hours of a series (the columns that name it; level if none is given) with more events than the series' mean +
    sigmas x standard deviation over the hours it has."""
    names = list(series or ("level",))
    hours = events.groupBy(*names, F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"))
    usual = hours.groupBy(*names).agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))
    return hours.join(usual, names).filter(F.col("n") > F.col("mean") + sigmas * F.coalesce("sd", F.lit(0.0))).select(*names, "hour", "n")


def findings(lines: DataFrame, rules: list[tuple]) -> DataFrame:
    """All that an analysis finds in the lines: rule matches, errors and early warnings by level, and anomalous hours of a
    file and level, as file, line_no (null for an hour), pattern and severity."""
    columns = ("file", "line_no", "pattern", "severity")
    hours = anomalies(lines.filter("level is not null"), "file", "level")
    told = hours.select("file", F.lit(None).cast("long").alias("line_no"), F.lit("anomaly").alias("pattern"), F.lit("WARNING").alias("severity"))
    return issues(lines, rules).select(*columns).unionByName(level_issues(lines).select(*columns)).unionByName(told)


def status(found: DataFrame, files: DataFrame) -> DataFrame:
    """OK, WARNING or CRITICAL for each file, also those without issues, with the number of issues."""
    rank = F.when(F.col("severity") == "CRITICAL", 2).otherwise(1)
    worst = found.groupBy("file").agg(F.max(rank).alias("worst"), F.count("*").alias("issues"))
    return files.select("file").distinct().join(worst, "file", "left").select("file", F.element_at(F.array(F.lit("OK"), F.lit("WARNING"), F.lit("CRITICAL")), F.coalesce("worst", F.lit(0)) + 1).alias("status"), F.coalesce("issues", F.lit(0)).cast("long").alias("issues"))


def analyse(lines: DataFrame, rules: list[tuple], sigmas: float = SIGMAS) -> DataFrame:
    """file, status and number of issues of every file, from all findings, in one pass over the lines.

    Each line's findings by rules and by level are counted in its row; the lines are added up by file, level and hour, and the
    hours of a file and level, which are few, give the anomalies."""
    matched = [F.when(F.col("message").rlike(regex), F.when(F.lit(severity) == "CRITICAL", 2).otherwise(1)) for _, regex, severity, *_ in rules]
    by_level = F.when(F.col("level") == "ERROR", 2).when(F.col("level") == "WARN", 1)
    found = F.filter(F.array(*matched, by_level), lambda x: x.isNotNull())
    hours = lines.select("file", "level", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), F.size(found).alias("issues"), F.coalesce(F.array_max(found), F.lit(0)).alias("worst"))
    hours = hours.groupBy("file", "level", "hour").agg(F.count("*").alias("n"), F.sum("issues").alias("issues"), F.max("worst").alias("worst"))
    series = Window.partitionBy("file", "level")
    usual = F.avg("n").over(series) + sigmas * F.coalesce(F.stddev_samp("n").over(series), F.lit(0.0))
    marked = hours.withColumn("anomaly", (F.col("level").isNotNull() & (F.col("n") > usual)).cast("int"))
    files = marked.groupBy("file").agg(F.greatest(F.max("worst"), F.max("anomaly")).alias("worst"), (F.sum("issues") + F.sum("anomaly")).alias("issues"))
    return files.select("file", F.element_at(F.array(F.lit("OK"), F.lit("WARNING"), F.lit("CRITICAL")), F.col("worst") + 1).alias("status"), F.col("issues").cast("long").alias("issues"))


def run(lines: DataFrame, access: DataFrame, rules: list[tuple]) -> DataFrame:
    """A monitoring run over the files of `read_logs`: a row for each path, read or not, with its status and issues, the
    notification that it gives (null where there is none) and the run's trace record."""
    told = access.join(analyse(lines, rules), "file", "left")
    empty = (F.col("file_status") == "read") & F.col("status").isNull()  # a readable file without lines is in order
    told = told.withColumns({"status": F.when(empty, "OK").otherwise(F.coalesce("status", F.lit("FAILED"))), "issues": F.when(empty, 0).otherwise(F.col("issues"))})
    title = F.when(F.col("status").isin("WARNING", "CRITICAL"), F.concat(F.lit("Log analysis: "), F.col("status"))).when(F.col("status") == "FAILED", F.concat(F.lit("Log analysis failed: "), F.col("file_status")))
    kind = F.when(title.isNotNull(), F.when(F.col("status") == "WARNING", "warning").otherwise("error"))
    return told.select("file", "file_status", "status", "issues", title.alias("title"), kind.alias("type"), content_id(F.lit("run"), F.col("file")).alias("event_id"))


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("level").isNull()).alias("unparsed"))


def recent_events(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines in time order."""
    return lines.orderBy(F.desc("ts"), F.desc("line_no")).limit(n).orderBy("ts", "line_no")


def positions(lines: DataFrame) -> DataFrame:
    """The lines with their position (from 0) in their file by time: the lines of an hour are numbered, and the hours
    before add theirs, so no task sorts a whole file."""
    dealt = lines.withColumn("hour", F.date_trunc("hour", "ts"))
    hours = dealt.groupBy("file", "hour").agg(F.count("*").alias("n"))
    before = hours.select("file", "hour", (F.sum("n").over(Window.partitionBy("file").orderBy("hour")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "hour").orderBy("ts", "line_no")) - 1
    same = F.equal_null(F.col("a.hour"), F.col("b.hour")) & (F.col("a.file") == F.col("b.file"))
    numbered = dealt.withColumn("inside", inside)
    return numbered.alias("a").join(before.alias("b"), same).select("a.*", (F.col("b.before") + F.col("a.inside")).cast("long").alias("position")).drop("hour", "inside")


def notifications(statuses: DataFrame) -> DataFrame:
    """A notification event for each file that isn't OK."""
    told = statuses.filter("status <> 'OK'")
    title = F.concat(F.lit("Log analysis: "), F.col("status"))
    message = F.concat(F.col("issues").cast("string"), F.lit(" issues in "), F.col("file"))
    return told.select(content_id(F.col("file"), F.col("status"), F.col("issues").cast("string")).alias("id"), title.alias("title"), message.alias("message"), notification_type(F.col("status")).alias("type"), F.lit(False).alias("read"))


def unnest_issues(analyses: DataFrame) -> DataFrame:
    return analyses.select(F.explode("issues").alias("i")).select("i.*")


def unnest_events(analyses: DataFrame) -> DataFrame:
    """Events in the payload's order, with their positions from 0."""
    return analyses.select(F.posexplode("recent_events").alias("position", "e")).select("position", "e.*")


def file_info(analyses: DataFrame) -> DataFrame:
    return analyses.select("file_status", F.col("file_info.size").alias("size"), F.col("file_info.last_modified").alias("last_modified"))
