"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b): each node that is joined to a smaller one, with the smallest node ``b`` of its component.

    Nodes are of any ordered type. Each round is written to the shared folder, so a lost executor costs one round.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(F.col("a") != F.col("b")).distinct())
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a")))).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.distinct().withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter(F.col("a") != F.col("b")).distinct()
        after = materialize(small)
        stars = after.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() == 0 and after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0
        discard(now)
        now = after
        if stars:
            return now
