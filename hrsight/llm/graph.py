"""Connected components of a link table, wholly in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.llm.tasks import drop, saved

#: Rows of a label table that one task writes; only the number of files follows from it.
ROWS_PER_TASK = 250_000


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) for every row of `nodes`; equal labels are connected by `links` (a, b).

    Labels start as the node itself. A round takes the smallest label among a node, its neighbours and the
    node that its label names; it ends when nothing changes. Star-shaped links
    need two or three rounds, a path of n nodes about log2(n). Each round is
    written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = nodes.select("node", F.col("node").alias("label"))
    parts = max(6, links.count() // ROWS_PER_TASK)
    before = None
    while True:
        far = now.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        seen = both.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        after = (now.join(far, now["label"] == far["at"]).join(seen, now["node"] == seen["a"], "left")
                 .select("node", F.least("label", "beyond", F.coalesce("near", "label")).alias("label"), F.col("label").alias("old")))
        after = saved(after, "labels", parts)
        changed = not after.where("label != old").isEmpty()
        if before is not None:
            drop(before)
        before, now = after, after.select("node", "label")
        if not changed:
            now._hrsight_path = after._hrsight_path
            return now


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """`comp` (node, label) after further `links` (a, b): only the labels that they join are worked on."""
    parts = max(6, links.count() // ROWS_PER_TASK)
    ends = (links.join(comp.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
            .join(comp.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            .where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    ends = saved(ends, "joined", parts)
    labels = saved(ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct(), "joined", parts)
    small = components(labels, ends).select(F.col("node").alias("label"), F.col("label").alias("to"))
    out = saved(comp.join(small, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    drop(ends, labels)
    return out
