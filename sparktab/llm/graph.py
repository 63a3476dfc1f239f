"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import save


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) -> (node, root): root is the smallest node reachable.

    A round of the large star hooks a node's larger neighbours on its smallest
    one, a round of the small star its smaller neighbours.  Minima combine
    before the shuffle and the joins have one row for each node on one side,
    so a node with very many neighbours can be split.  Every round is written
    to the shared folder; the rounds grow with the logarithm of the size.
    Self-loops and rows with nulls are left out; an empty list gives no rows.
    """
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .distinct(), "cc-edges")
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        nxt = save(small, "cc-round")
        # done when every node points straight at a root, that is, at a node that points nowhere
        deep = nxt.select(F.col("v").alias("x")).join(nxt.select(F.col("u").alias("x")), "x", "left_semi").limit(1).count()
        e = nxt
        if not deep and e.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components: not settled; raise max_rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
