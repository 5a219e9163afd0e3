"""Connected components of a link table by alternating stars, without gathering anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that is reachable.

    Every round points each node and its larger neighbours to the smallest neighbour
    (large star, small star); the links are stored between rounds. It ends when all
    links point straight at a node that points nowhere.
    """
    e = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        ends = e.select("a", F.lit(1).alias("points"), F.lit(0).alias("pointed")).unionAll(e.select("b", F.lit(0), F.lit(1)))
        loose = (ends.groupBy("a").agg(F.sum("points").alias("points"), F.max("pointed").alias("pointed"))
                 .where("points > 1 OR (points = 1 AND pointed = 1)").limit(1).count())
        if not loose:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select("b", "b").distinct())
        both = e.unionAll(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.where("low < a").select("a", "low")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(least).where("a <> b").distinct()
        e, before = stored(small, "links"), e
        dropped(before)
    raise RuntimeError("components did not settle")
