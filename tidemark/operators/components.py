"""Connected components of an edge table, in distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.scratch import scope, written


def connected(edges: DataFrame) -> DataFrame:
    """item_id, group_id: for every node of an edge (a, b), the smallest node that it is joined to.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest of them, so chains
    shorten quickly; rounds end when the edges are stars. A round is a written table, so a lost executor
    repeats one round at most; nothing is gathered. Edges with a null end, of a node to itself, and repeated ones join nothing; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    with scope() as keep:
        now = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
        before = None
        while (mark := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != before and mark[0]:
            before = mark
            around = now.union(now.select(b.alias("a"), a.alias("b")))
            least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
            large = around.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").select(b.alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
            now = written(small.where(a != b).distinct(), "edges")
        keep(now)
    return now.select(a.alias("item_id"), b.alias("group_id")).union(now.select(b, b).distinct())
