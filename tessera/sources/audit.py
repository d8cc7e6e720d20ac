"""Audit logs: JSON lines in a file or folder for each day, read by day, counted and paged."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "ts string, user string, roles array<string>, action string, method string, path string, status int, duration_ms double, ip string"
BROKEN = "_malformed"


def write_audit(entries: DataFrame, path: str) -> None:
    """Append entries (day, line) as text, a folder for each day."""
    entries.select("day", F.col("line").alias("value")).write.mode("append").partitionBy("day").text(path)


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The lines of the folders day=... from first to last, both included; other folders are not opened.

    A line that is no JSON object has its text in the column _malformed, and null elsewhere.
    """
    lines = spark.read.schema("value string, day date").text(path)
    if first:
        lines = lines.where(F.col("day") >= F.lit(first).cast("date"))
    if last:
        lines = lines.where(F.col("day") <= F.lit(last).cast("date"))
    return _parsed(lines)


def read_daily_files(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """The same of files named 2024-01-31.jsonl; only names of these days are listed, missing days are none."""
    lo, hi = date.fromisoformat(first), date.fromisoformat(last)
    days = [(lo + timedelta(days=k)).isoformat() for k in range((hi - lo).days + 1)]
    if not days:
        return _parsed(spark.createDataFrame([], "value string, day date"))
    lines = spark.read.option("pathGlobFilter", "{" + ",".join(days) + "}.jsonl").text(folder)
    return _parsed(lines.select("value", F.to_date(F.regexp_extract("_metadata.file_name", r"^(\d{4}-\d\d-\d\d)\.jsonl$", 1)).alias("day")))


def _parsed(lines: DataFrame) -> DataFrame:
    lines = lines.where(F.trim("value") != "")
    entry = F.from_json("value", f"{ENTRY}, {BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    return lines.select("day", entry.alias("e")).select("day", "e.*")


def matching(entries: DataFrame, user: str | None = None, action: str | None = None) -> DataFrame:
    """Well-formed entries of a user, whose action begins with action."""
    rows = entries.where(F.col(BROKEN).isNull()).drop(BROKEN)
    if user:
        rows = rows.where(F.col("user") == user)
    if action:
        rows = rows.where(F.col("action").startswith(action))
    return rows


def audit_page(entries: DataFrame, page: int = 1, size: int = 50, user: str | None = None, action: str | None = None) -> DataFrame:
    """Page `page` (from 1) of the newest matching entries, with total, the number of all that match.

    Each task keeps the newest page * size of its lines; only those are merged.
    """
    rows = matching(entries, user, action)
    order = [F.desc_nulls_last("ts"), F.col("user"), F.col("action"), F.col("path")]
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def audit_stats(entries: DataFrame, most: int = 50) -> DataFrame:
    """(kind, name, n): events and malformed lines in all, and the most frequent users and actions."""
    good = entries.where(F.col(BROKEN).isNull())
    total = entries.agg(F.count(F.when(F.col(BROKEN).isNull(), 1)).alias("good"), F.count(BROKEN).alias("bad")).select(F.explode(F.array(F.struct(F.lit("events").alias("kind"), F.col("good").alias("n")), F.struct(F.lit("malformed").alias("kind"), F.col("bad").alias("n")))).alias("x")).select("x.kind", F.lit(None).cast("string").alias("name"), "x.n")
    for column in ("user", "action"):
        each = good.groupBy(F.coalesce(column, F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)
        total = total.unionByName(each.select(F.lit(column).alias("kind"), "name", "n"))
    return total


def audit_days(spark: SparkSession, path: str) -> DataFrame:
    """The days that have a folder, the newest first; no line is read."""
    return spark.read.schema("value string, day date").text(path).select("day").distinct().orderBy(F.desc("day"))
