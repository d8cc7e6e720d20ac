"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id that an edge (a, b) names; component is the smallest id reachable.

    Alternates two star contractions: each node hangs its larger neighbours, then its smaller ones, under the
    smallest id it knows.  The number of rounds grows with the logarithm of the longest path; hot centres are only
    aggregated and joined, never collected.  Self-loops and repeated edges are allowed.
    """
    loops = edges.where("a = b").select(F.col("a").alias("id"))
    stars = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = max(4, stars.count() // 200_000)  # a round has as many edges at most; few files for few edges
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.coalesce(tasks))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small_star = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        stars = materialize(small_star.coalesce(tasks))
        roots = stars.select(F.col("v").alias("u")).distinct()
        total, sources = stars.agg(F.count("*"), F.countDistinct("u")).first()
        if total == sources and not stars.join(roots, "u", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    named = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("id")).unionByName(loops).distinct().join(named.select("id"), "id", "left_anti")
    return materialize(named.unionByName(roots.select("id", F.col("id").alias("component"))).coalesce(tasks))
