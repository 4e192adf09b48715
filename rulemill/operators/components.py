"""Connected components by hooking and shortcutting over parent tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemill.session import cut

#: Rounds after which an error is raised; each round at least halves the nodes of every component.
MOST_ROUNDS = 60


def _grand(parent: DataFrame) -> DataFrame:
    """``node, parent, grand``: every parent has a row of its own."""
    return parent.join(parent.select(F.col("node").alias("up"), F.col("parent").alias("grand")), F.col("parent") == F.col("up")).select("node", "parent", "grand")


def _shortcut(parent: DataFrame) -> DataFrame:
    return _grand(parent).select("node", F.col("grand").alias("parent"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is its least node.

    Rows with a null on either side, self links and repeated links change nothing but that both
    ends of a self link are nodes. Each round hooks every node to its least neighbour, shortcuts
    parents of parents until all are roots, and contracts the links to the roots, so at least half
    of the nodes go per round. Tables are cut by checkpoints in the session's checkpoint folder, so
    a lost executor costs one round. Nothing but a count reaches the driver.
    """
    links = edges.select("a", "b").where("a is not null and b is not null")
    labels = cut(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")))
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(MOST_ROUNDS):
        if links.isEmpty():
            return labels
        both = links.union(links.select("b", "a"))
        parent = cut(_shortcut(_shortcut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")))))
        for _ in range(MOST_ROUNDS):  # until every parent is a root; the depth halves each time
            if _grand(parent).where("parent <> grand").isEmpty():
                break
            parent = cut(_shortcut(_shortcut(parent)))
        pa, pb = (parent.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}")) for c in ("a", "b"))
        joined = links.join(pa, "a").join(pb, "b").where("pa <> pb")
        links = cut(joined.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        up = parent.select(F.col("node").alias("component"), "parent")
        labels = cut(labels.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
    raise RuntimeError("components did not settle")
