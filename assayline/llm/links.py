"""Connected components of links, by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import discard, written


def smallest_reachable(links: DataFrame) -> DataFrame:
    """Links (two columns) -> (node, root) for every node that has a link to another; the root is the smallest name it reaches.

    In a round every node moves to the first node at most two links away, in an order drawn anew for the round, and the links are
    rewritten accordingly, until none is left: a star collapses in one round, and a long chain loses two thirds of its
    nodes in a round, whatever their names.  Minima are pre-aggregated, and the joins are plain shuffle joins, whose hot partitions
    adaptive execution splits.  Every round is written to the shared folder, and the links that it replaces are deleted.
    Null ends and links of a node with itself are ignored.
    """
    links = links.toDF("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = written(links, "round")
    rounds: list[DataFrame] = []
    while links.limit(1).count():
        both = links.union(links.select("b", "a"))
        place = lambda c, n=len(rounds): F.struct(F.xxhash64(F.lit(n), c).alias("h"), F.col(c).alias("n"))
        near = both.groupBy("a").agg(F.least(F.min(place("b")), place("a")).alias("m"))
        far = both.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("m").alias("m"))
        moved = written(far.select("a", F.col("m.n").alias("to")), "moved")
        old = links
        once = links.join(moved, "a").select(F.col("to").alias("c"), "b")
        twice = once.join(moved.withColumnRenamed("a", "b"), "b").select("c", F.col("to").alias("d"))
        links = written(
            twice.where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "round"
        )
        discard(old)
        rounds.append(moved)
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[0].toDF("node", "root")  # every node of a later round is where one of the round before moved to
    for moved in rounds[1:]:
        roots = roots.join(moved.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.col("least").alias("root"))
