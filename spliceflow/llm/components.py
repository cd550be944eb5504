"""Connected components of link tables, by alternating large-star and small-star steps, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step: links (u, v), v < u, are replaced by links to smallest neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, F.col("u") == F.col("k"))
    large = larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    to_lowest = large.join(lowest, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_lowest.unionByName(lowest.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node with a link to a smaller one has that link only: the links are stars around smallest nodes."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("x")).select("x.*")
    return not ends.groupBy("node").agg(F.max("up").alias("up"), F.count("*").alias("n")).where("up = 1 and n > 1").agg(F.count("*")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable. links: a, b of one type.

    Steps go on until the links are stars, which no step would change; that takes a number of rounds that grows with the
    logarithm of a component's size. Each round's links are a table in the shared folder. The steps never gather a
    component: a node's smallest neighbour is a pre-aggregated minimum, and hot nodes meet in sort-merge joins that Spark
    may split. No links give no rows; links of a node to itself and null links count for nothing; repeated ones count once.
    """
    edges = links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges)
    while not _settled(edges):
        old = edges
        edges = written(_step(old))
        discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
