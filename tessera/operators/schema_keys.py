"""Keys and relations of a schema, from the data.

One pass over (type, value, column) groups of all tables tells both: how often a column has a value (a key has each once, and no
null), and which columns have it (a column refers to a key if every value it has is one of the key's).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import written

#: Types whose values name things; integers are one type, as tables disagree on their width.
KINDS = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "string": "string", "date": "date"}


def _groups(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, value, columns): of each value the columns (table.column) that have it and how often; null values included."""
    parts = []
    for name, df in tables.items():
        fields = [(c, KINDS[t]) for c, t in df.dtypes if t in KINDS]
        cells = [F.struct(F.lit(f"{name}.{c}").alias("column"), F.lit(kind).alias("kind"), F.col(f"`{c}`").cast("string").alias("value")) for c, kind in fields]
        if cells:
            parts.append(df.select(F.explode(F.array(*cells)).alias("x")).select("x.*"))
    each = reduce(DataFrame.unionByName, parts).groupBy("column", "kind", "value").agg(F.count("*").alias("n"))
    return each.groupBy("kind", "value").agg(F.collect_list(F.struct("column", "n")).alias("columns"))


def schema_keys(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The columns (table_name, column_name, n_rows, n_null, n_distinct, is_key), and the relations between them
    (from_table, from_column, to_table, to_column, n_values): every value of the one column is in the key column of another
    table.  Columns of other types than KINDS, and empty ones, are no part of either.
    """
    groups = written(_groups(tables))
    flat = groups.select("value", F.explode("columns").alias("c")).select("value", "c.*")
    some = F.col("value").isNotNull()
    stats = written(flat.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).cast("long").alias("n_null"), F.count(F.when(some, 1)).alias("n_distinct"), F.max(F.when(some, F.col("n"))).alias("most")))
    table, column = F.split_part("column", F.lit("."), F.lit(1)), F.split_part("column", F.lit("."), F.lit(2))
    is_key = F.coalesce((F.col("most") == 1) & (F.col("n_null") == 0), F.lit(False))
    columns = stats.select(table.alias("table_name"), column.alias("column_name"), "n_rows", "n_null", "n_distinct", is_key.alias("is_key"))

    keys = stats.where(is_key).select(F.col("column").alias("key"))
    # of each value, every pair of columns that have it: as many as columns, not rows
    pairs = groups.where(some).select(F.explode("columns.column").alias("column"), F.col("columns.column").alias("others")).select("column", F.explode("others").alias("key"))
    both = pairs.join(F.broadcast(keys), "key").where(F.split_part("key", F.lit("."), F.lit(1)) != F.split_part("column", F.lit("."), F.lit(1))).groupBy("column", "key").agg(F.count("*").alias("n_values"))
    whole = both.join(stats.select("column", "n_distinct"), "column").where("n_values = n_distinct")
    part = lambda c, k: F.split_part(c, F.lit("."), F.lit(k))
    return columns, whole.select(part("column", 1).alias("from_table"), part("column", 2).alias("from_column"), part("key", 1).alias("to_table"), part("key", 2).alias("to_column"), "n_values")
