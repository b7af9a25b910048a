"""Connected components of a link table by repeated minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """links (a, b) -> (node, component), the smallest node id that can be reached; only linked nodes are listed.

    Each round takes the least label among a node's neighbours and then follows labels once, so chains halve.
    Null ends and self links are left out; an empty table gives an empty table.
    """
    pairs = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src is not null and dst is not null and src <> dst")
    both = materialize(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("best"))
        moved = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "best").alias("component"))
        ahead = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = materialize(moved.join(ahead, "component").select("node", "old", F.least("component", "further").alias("component")), f"{name}-labels")
        changed = moved.where("component <> old").limit(1).count()
        discard(labels)
        labels = moved.select("node", "component")
        if not changed:
            discard(both)
            return labels
