"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.llm.store import forget, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs to (k, c): every linked node and the smallest node it reaches.

    Each round gives a node the smallest label among its neighbours and then follows that
    label's own label; rounds end when none changes. Labels fall with doubling reach.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("k").alias("b"), "c"), "b").groupBy(F.col("a").alias("k")).agg(F.min("c").alias("m"))
        step = labels.join(near, "k").select("k", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        jump = step.join(labels.select(F.col("k").alias("c"), F.col("c").alias("far")), "c").select("k", "was", F.least("c", "far").alias("c"))
        new = written(jump, "labels")
        more = new.where("c <> was").limit(1).count()
        forget(labels)
        labels = new.select("k", "c")
        if not more:
            forget(both)
            return labels
