"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.text import Scratch


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Links every larger (or no larger) neighbour of a node to the least of its neighbourhood."""
    if large:
        pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = pairs.join(least, "a")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of links (a, b); each round is written to the shared folder, the one before goes."""
    with Scratch(links.sparkSession, "components") as scratch:
        pairs = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
        state = None
        while True:
            before, pairs = pairs, scratch.save(_star(_star(pairs, True), False), "round", keep=True)
            scratch.drop(before)
            now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if now == state:
                break
            state = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
