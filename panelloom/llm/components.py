"""Connected components of a link table, by contraction in Spark.

Each round every node points to the smallest of itself and its neighbours, and links are
redrawn between the nodes pointed to, until none is left. Nodes are hashes, so rounds are
few (about the logarithm of the longest chain). A node with a third of all links is combined
before the shuffle when minima are taken, and split by adaptive execution when links are
redrawn. Every round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.sources.storage import store


def components(links: DataFrame) -> DataFrame:
    """links: columns x, y. Returns node, component for every node that is linked."""
    links = store(links.select("x", "y").where("x <> y").distinct(), "links")
    steps: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select("y", "x"))
        smallest = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least"))
        step = store(smallest.select("node", F.least("node", "least").alias("parent")), "parents")
        steps.append(step)
        ends = [step.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_parent")) for c in ("x", "y")]
        redrawn = links.join(ends[0], "x").join(ends[1], "y").select(
            F.least("x_parent", "y_parent").alias("x"), F.greatest("x_parent", "y_parent").alias("y")
        )
        links = store(redrawn.where("x <> y").distinct(), "links")
    if not steps:
        return links.select(F.col("x").alias("node"), F.col("y").alias("component"))
    found = steps[0].select("node", F.col("parent").alias("component"))
    for step in steps[1:]:
        renamed = step.select(F.col("node").alias("component"), "parent")
        found = found.join(renamed, "component", "left").select(
            "node", F.coalesce("parent", "component").alias("component")
        )
    return store(found, "components")
