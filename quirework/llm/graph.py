"""Connected components of a link table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged

#: Rounds at most. Labels reach twice as far in each round, so a chain of 2 ** 59 nodes settles.
MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    ``links`` has long columns a and b. Every round works on all links: each node takes the
    smallest label around it, then the label of its label, so long chains shrink by
    doubling. Labels are written to the shared folder after each round, which cuts the
    lineage; only one number per round reaches the driver.
    """
    both = staged(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .filter("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(MAX_ROUNDS):
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("around")))
        best = labels.join(near, labels.node == near.a).select(
            "node", F.col("root").alias("old"), F.least("root", "around").alias("root"))
        up = labels.select(F.col("node").alias("_n"), F.col("root").alias("above"))
        following = staged(
            best.join(up, best.root == up._n, "left")
            .select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "labels")
        changed = following.filter("root <> old").limit(1).count()
        labels = following.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
