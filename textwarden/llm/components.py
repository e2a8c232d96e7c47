"""Connected components of a graph of long ids, by joins: no driver-side graph, any number of vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scoped

#: No graph of 64-bit ids needs as many rounds, as each halves the depth of the labels' trees.
MOST_ROUNDS = 200


@scoped
def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (src, dst): component is the smallest id that links reach.

    Each round, every vertex takes the smallest label among its own and its neighbours', offers it to the vertex that
    its old label names, and then jumps to its label's label. The minima are combined before they are shuffled.
    Links that lead inside a component fall away as they are found. Links with a null end are ignored.
    """
    links = links.where("src is not null and dst is not null and src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    links = cut(links)
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = cut(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("id"), F.least("src", "low").alias("label")))
    for _ in range(MOST_ROUNDS):
        # links, told by the labels of their ends
        tops = links.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
        tops = tops.where("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()
        links = cut(tops)
        if not links.limit(1).count():
            up = labels.select(F.col("id").alias("label"), F.col("label").alias("top"))
            after = cut(labels.join(up, "label", "left").select("id", F.coalesce("top", "label").alias("label"), (F.coalesce("top", "label") < F.col("label")).alias("moved")))
            labels = after.select("id", "label")
            if not after.where("moved").limit(1).count():
                break
            continue
        offers = links.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("label"), "low")
        labels = cut(labels.join(offers, "label", "left").select("id", F.coalesce("low", "label").alias("label")))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("top"))
        labels = cut(labels.join(up, "label", "left").select("id", F.coalesce("top", "label").alias("label")))
    return labels.select("id", F.col("label").alias("component"))
