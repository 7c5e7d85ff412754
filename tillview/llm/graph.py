"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillview.session import stage


def _tidy(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, from the larger to the smaller node; loops and nulls go."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b AND a IS NOT NULL AND b IS NOT NULL").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); a component is named by its smallest node.

    Alternates two steps until nothing moves: every node hands its smallest neighbour to its larger neighbours, and
    every node links its smaller neighbours to the smallest of them. Both shorten paths to the smallest node, in
    logarithmically many rounds as a rule; edges only grow fewer. Minima are taken map-side before a shuffle, the
    rounds are staged tables, and nothing but two numbers a round reaches the driver.
    """
    now = stage(_tidy(edges))
    mark = _mark(now)
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = _tidy(large)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = stage(_tidy(small))
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
