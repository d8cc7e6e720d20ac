"""Readers and writers of the formats around the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import csv_guard


def read_codebook(spark: SparkSession, path: str, name: str, sep: str = ";", encoding: str = "utf-8") -> DataFrame:
    """(name, code, description) of a CSV codebook with a header; the first row of a code wins."""
    rows = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    code, text = rows.columns[:2]
    rows = rows.select(F.lit(name).alias("name"), F.trim(F.regexp_replace(code, "﻿", "")).alias("code"), F.col(text).alias("description"), F.monotonically_increasing_id().alias("__at")).where("code is not null and code <> ''")
    first = Window.partitionBy("code").orderBy("__at")
    return rows.withColumn("__k", F.row_number().over(first)).where("__k = 1").select("name", "code", "description")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; text cells can't be taken for formulas."""
    safe = [csv_guard(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes]
    df.select(*safe).write.option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of CSV files for each table."""
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")


def write_embeddings(df: DataFrame, path: str, model: str, append: bool = False) -> None:
    """(id, vector array<float>) as Parquet, tagged with the model that made the vectors."""
    df.withColumn("model", F.lit(model)).write.mode("append" if append else "overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, model: str) -> DataFrame:
    """The vectors of a model; those of another model are as good as absent."""
    return spark.read.parquet(path).where(F.col("model") == model).drop("model")


def write_snapshot(df: DataFrame, path: str, cdm: str, domain: str, version: int) -> None:
    df.withColumns({"cdm": F.lit(cdm), "domain": F.lit(domain), "version": F.lit(version)}).write.mode("append").partitionBy("cdm", "domain", "version").parquet(path)


def read_snapshot(spark: SparkSession, path: str, cdm: str, domain: str, version: int | None = None) -> DataFrame:
    """A version of a snapshot, the last one if none is named; partitions prune the read."""
    rows = spark.read.parquet(path).where((F.col("cdm") == cdm) & (F.col("domain") == domain))
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == version)
