"""Connected components of a link table, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; roots are any member.

    Every round, each node hooks onto its neighbour of least priority (a hash
    that changes with the round, so chains stay short) if that is below its
    own, follows its parent once more, and links are rewritten to parents.
    Only aggregates and joins on nodes are used, nothing is gathered; rounds
    end when no link is left, after about log(nodes) of them.  Loops and
    repeated links are allowed; an empty table has no components.
    """
    edges = stored(links.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    number = 0
    while not edges.isEmpty():
        def prio(c, n=number):
            return F.struct(F.xxhash64(F.lit(n), c).alias("p"), F.col(c).alias("v"))

        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy("a").agg(F.min(prio("b")).alias("m")).select(
            F.col("a").alias("node"), F.when(F.col("m") < prio("a"), F.col("m.v")).otherwise(F.col("a")).alias("parent"))
        hooked = stored(hooked, "hooks")
        up = hooked.select(F.col("node").alias("parent"), F.col("parent").alias("__top"))
        parents = stored(hooked.join(up, "parent").select("node", F.col("__top").alias("parent")), "parents")
        to = parents.select(F.col("node").alias("root"), F.col("parent").alias("__top"))
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            roots = stored(roots.join(to, "root", "left").select("node", F.coalesce("__top", "root").alias("root")), "roots")
        for side in ("a", "b"):
            edges = edges.join(to.withColumnRenamed("root", side), side).withColumn(side, F.col("__top")).drop("__top")
        edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        number += 1
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
