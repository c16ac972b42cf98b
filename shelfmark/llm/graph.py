"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import settled


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id each id reaches by ``links`` (a, b), for all ids in a link.

    In each round every id joins its neighbour of the least hash, or stays where its own is less, and the links between
    the groups so made go on. Where all link to one, two rounds do; along a path the ids left fall by a constant
    factor a round. Aggregates combine before they shuffle and the joins are plain equi-joins, which the planner can
    split for an id that many others link to. What each round did is put together once, at the end.
    """
    left = settled(links.select("a", "b").where("a <> b").distinct())
    labels = left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("root", F.col("id"))
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = F.least(F.min(F.struct(F.xxhash64("v"), F.col("v"))), F.struct(F.xxhash64("u"), F.col("u").alias("v")))
        steps = settled(both.groupBy("u").agg(least.alias("least")).select("u", F.col("least.v").alias("to")))
        moved = left.join(steps.toDF("a", "a2"), "a").join(steps.toDF("b", "b2"), "b").where("a2 <> b2")
        left = settled(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        labels = labels.join(steps.toDF("root", "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    labels = settled(labels)
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    return labels.join(least, "root").select("id", "component")
