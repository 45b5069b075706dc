"""Connected components of a graph of integer vertices, by alternating large and small stars.

Each round is two aggregations and two joins over the edges, written to the shared
folder; the number of edges never grows beyond that of the first round, and no vertex's
neighbours are collected anywhere (minimums are pre-aggregated before the shuffle, and
the joins are plain sort-merge joins whose hot keys adaptive execution may split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _work


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, root) for every vertex that has an edge in ``edges`` (a, b) and isn't the root of its
    component; the root is the smallest vertex of the component. Direction, repeats and loops don't matter."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e = _work.keep(e, "edges")
    before = _state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.join(low, both["a"] == low["v"]).where("b > v").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = _work.keep(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        small = large.join(least, large["a"] == least["v"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = _work.keep(small.unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        after = _state(new)
        _work.drop_table(e)
        _work.drop_table(large)
        e = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select("a", F.col("b").alias("root"))
