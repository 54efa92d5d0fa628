"""Connected components of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.shared import release, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): component is the smallest node that can be reached.

    Links may be repeated, in either direction or from a node to itself; those with a null are ignored. Each round
    takes the smallest label among the neighbours and then that label's own label, so the rounds grow with the
    logarithm of the longest path; each is written to the shared folder, so nothing is computed twice.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a is not null and b is not null").distinct()
    edges = stored(both)
    now = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        seen = edges.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        near = now.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        far = now.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = near.join(far, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        after = stored(after.select("node", "label", (F.col("label") < F.col("old")).alias("moved")))
        release(now)
        now = after
        if after.where("moved").isEmpty():
            release(edges)
            return now.select("node", F.col("label").alias("component"))
