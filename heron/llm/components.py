"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import discard, skew_join, stored


def components(links: DataFrame) -> DataFrame:
    """doc, comp (smallest id reachable) of every endpoint of links (a, b).

    Each round every node takes the smallest label in its neighbourhood, then the label of that
    label; the number of rounds grows with the logarithm of the diameter. Nodes of high degree are
    joined without shuffling their edges.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    label = stored(edges.groupBy("a").agg(F.count(F.lit(1)).alias("cnt"), F.min("b").alias("b")).select(F.col("a").alias("doc"), F.least("a", "b").alias("comp"), "cnt"), "label")
    total = edges.count()
    while total:
        near = skew_join(edges.withColumnRenamed("b", "doc"), label, ["doc"], total).groupBy(F.col("a").alias("doc")).agg(F.min("comp").alias("near"))
        mine = stored(label.join(near, "doc").select("doc", "cnt", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")), "near")
        # a label is a node: follow it once; labels that many nodes hold are few
        held = mine.groupBy("comp").agg(F.count(F.lit(1)).alias("cnt"))
        jump = stored(held.join(mine.select(F.col("doc").alias("comp"), F.col("comp").alias("root")), "comp").select("comp", "root", "cnt"), "jump")
        step = skew_join(mine.withColumnRenamed("cnt", "degree"), jump, ["comp"], mine.count())
        new = stored(step.select("doc", F.least("comp", "root").alias("comp"), F.col("degree").alias("cnt"), (F.least("comp", "root") != F.col("was")).alias("moved")), "label")
        discard(label, mine, jump)
        label = new.drop("moved")
        label._heron_path = new._heron_path
        if new.filter("moved").isEmpty():
            break
    return label.select("doc", "comp")
