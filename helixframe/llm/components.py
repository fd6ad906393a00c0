"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import dropped, viewed, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    Each round gives every node the smallest label of itself and its neighbours, then the label of that label, and is
    written to the shared folder; the tables of earlier rounds are deleted.  Following labels halves long chains when
    labels grow along them; the worst order of labels takes a round per node of the longest chain, and the result is
    the same.  A node with very many links is one row per map task after partial aggregation.  Null ends are no links;
    an empty table gives an empty one.
    """
    both = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = written(both.select(F.col(a).alias("u"), F.col(b).alias("v")).union(both.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.select("node", "label").join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        now = written(hooked.join(jump, "new", "left").select("node", F.least("new", F.coalesce("jump", "new")).alias("label"), F.col("label").alias("old")), "labels")
        done = now.where("label <> old").isEmpty()
        dropped(labels)
        if done:
            dropped(edges)
            return viewed(now.select("node", F.col("label").alias("component")), now)
        labels = now
