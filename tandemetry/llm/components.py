"""Connected components of an edge table, in rounds of joins.

Labels hook onto the smallest grandparent label among neighbours and jump over
their own label's label in every round, so chains halve.  Nothing is collected:
the driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemetry.llm.common import drop_staged, staged


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) from edges (a, b) of any direction; self-links and repeats are harmless."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = staged(both.where("a <> b").distinct(), "links")
    labels = staged(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("f")), "labels")
    while True:
        up = labels.select(F.col("node").alias("p"), F.col("f").alias("g"))
        grand = labels.join(up, F.col("f") == F.col("p")).select("node", "f", "g")
        near = links.join(grand.select(F.col("node").alias("b"), "g"), "b").groupBy(F.col("a").alias("node")).agg(F.min("g").alias("m"))
        met = grand.join(near, "node").select("node", "f", "g", F.least("g", "m").alias("m"))
        # each node proposes to itself and to its label; both keep the least proposal
        offers = met.select(F.explode(F.array(F.struct("node", F.col("m").alias("f")), F.struct(F.col("f").alias("node"), F.col("m").alias("f")))).alias("o")).select("o.*")
        new = staged(offers.groupBy("node").agg(F.min("f").alias("f")), "labels")
        changed = new.join(labels.withColumnRenamed("f", "old"), "node").where("f <> old").limit(1).count()
        drop_staged(labels)
        labels = new
        if not changed:
            drop_staged(links)
            return labels.withColumnRenamed("f", "component")
