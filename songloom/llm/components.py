"""Connected components of a link table that is never collected.

Each round every node takes the smallest name among itself and its neighbours' names, then the name that this name
itself has taken. Names only fall, and a round halves long ways, so few rounds are needed. Minima are combined
before the shuffle, and the joins are plain equi-joins that adaptive execution can split at a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.session import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for links ``a, b``: the smallest node that can be reached. Rows with equal ends give nodes alone."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.distinct(), "links")
    names = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("name")), "names")
    while True:
        seen = edges.join(names.select(F.col("node").alias("b"), "name"), "b")
        lowest = seen.groupBy(F.col("a").alias("node")).agg(F.min("name").alias("near"))
        nearer = names.join(lowest, "node").select("node", F.least("name", "near").alias("near"), "name")
        jump = names.select(F.col("node").alias("near"), F.col("name").alias("next"))
        fallen = stored(
            nearer.join(jump, "near").select("node", F.least("near", "next").alias("name"), (F.least("near", "next") < F.col("name")).alias("moved")),
            "names",
        )
        names = fallen.select("node", "name")
        if fallen.where("moved").isEmpty():
            return names.withColumnRenamed("name", "component")
