"""CSV files from elsewhere: encoding, delimiter and columns found by looking, and typed rows beside their rejects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names of the columns of code and of text, the first that a file has counts
CODE_NAMES = ("ccam", "code_ccam", "code_cim", "cim", "code_acte", "code")
TEXT_NAMES = ("description", "libelle", "libellé", "label", "nom", "designation", "désignation")


def file_forms(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, sep, header) of each CSV file, in one pass over the bytes of all.

    A file whose bytes all are UTF-8 is UTF-8 (a mark at its begin is no part of the header), any other ISO-8859-1.  The
    delimiter is ; if the first line has more of them than of commas.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    each = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.min_by(F.col("value").cast("binary"), "at").alias("first"))
    first = F.when(F.col("utf8"), F.decode("first", "UTF-8")).otherwise(F.decode("first", "ISO-8859-1"))
    each = each.select("file", F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"), F.regexp_replace(first, "^﻿|\r$", "").alias("header"))
    count = lambda c: F.length("header") - F.length(F.replace("header", F.lit(c), F.lit("")))
    return each.select("file", "encoding", F.when(count(";") > count(","), ";").otherwise(",").alias("sep"), "header")


def _rows(spark: SparkSession, path: str) -> list[tuple[list[str], DataFrame]]:
    """The columns, and the rows as text with __file and __at, of each group of files of one form; files are few."""
    groups: dict[tuple, list[str]] = {}
    for f in file_forms(spark, path).collect():
        groups.setdefault((f["encoding"], f["sep"], f["header"]), []).append(f["file"])
    out = []
    for (encoding, sep, header), files in sorted(groups.items()):
        names = [c.strip().strip('"').strip().lower() for c in header.split(sep)]
        fields = ", ".join(f"c{k} string" for k in range(len(names)))
        rows = spark.read.schema(fields).option("header", True).option("enforceSchema", True).option("sep", sep).option("encoding", encoding).option("quote", '"').option("escape", '"').csv(sorted(files))
        out.append((names, rows.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.struct("_metadata.file_block_start", F.monotonically_increasing_id())})))
    return out


def read_codebooks(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(name, code, description) of CSV codebooks; a codebook is named by `name`, else by its file.

    The column of codes is the first of CODE_NAMES, else the first column; that of texts the first of TEXT_NAMES, else the
    second.  Rows without either are left out; of rows of one code the first counts (files in the order of their
    names, where several are one codebook).
    """
    parts = []
    for names, rows in _rows(spark, path):
        if len(names) < 2:
            raise ValueError("a codebook has two columns at least")
        code = next((names.index(c) for c in CODE_NAMES if c in names), 0)
        text = next((names.index(c) for c in TEXT_NAMES if c in names), 1)
        book = F.lit(name) if name else F.regexp_extract("__file", r"([^/]+?)(\.csv)?$", 1)
        parts.append(rows.select(book.alias("name"), F.trim(f"c{code}").alias("code"), F.trim(f"c{text}").alias("description"), "__file", "__at"))
    found = reduce(DataFrame.unionByName, parts).where("code <> '' and description <> ''")
    return found.groupBy("name", "code").agg(F.min_by("description", F.struct("__file", "__at")).alias("description"))


def _number(names: list[str], column: str, kind: str, default) -> Column:
    """A column of a kind; default where the file has no such column, null where a cell is none."""
    return F.trim(f"c{names.index(column)}").try_cast(kind) if column in names else F.lit(default).cast(kind)


def read_mappings(spark: SparkSession, path: str, domain: str) -> tuple[DataFrame, DataFrame]:
    """Typed rows of embedding mappings, and the rejected rows (file, line, reason).

    A row needs source_code and target_concept_id; rank, target_concept_id and similarity must be numbers where the
    file has them (1 and 0 where it hasn't).  Other columns are text, empty where missing.
    """
    parts = []
    for names, rows in _rows(spark, path):
        text = lambda c: F.coalesce(F.trim(f"c{names.index(c)}"), F.lit("")) if c in names else F.lit("")  # noqa: B023, E731
        whole = F.concat_ws("|", *[F.coalesce(f"c{k}", F.lit("")) for k in range(len(names))])
        values = {
            "source_code": text("source_code"), "source_name": text("source_name"), "rank": _number(names, "rank", "int", 1),
            "target_concept_id": _number(names, "target_concept_id", "int", None), "target_concept_code": text("target_concept_code"),
            "target_concept_name": text("target_concept_name"), "target_vocabulary_id": text("target_vocabulary_id"), "similarity": _number(names, "similarity", "double", 0),
        }
        missing = (text("source_code") == "") | (text("target_concept_id") == "")
        wrong = F.array_compact(F.array(*[F.when(values[c].isNull(), F.lit(c)) for c in ("rank", "target_concept_id", "similarity")]))
        reason = F.when(missing, "no code or target").when(F.size(wrong) > 0, F.concat(F.lit("no number: "), F.array_join(wrong, ", ")))
        parts.append(rows.select(F.col("__file").alias("file"), whole.alias("line"), reason.alias("reason"), F.struct(*[v.alias(c) for c, v in values.items()]).alias("m")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where("reason is null").select(F.lit(domain).alias("domain"), "m.*"), rows.where("reason is not null").select("file", "line", "reason")
