"""Connected components of a table of links, by hooking and pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (u, v): root is the least node that links lead to.

    In each round every root hooks onto the least root that it is linked with, and all nodes then follow their roots' new roots.
    Links inside one component go; the loop ends when none is left. Rows are aggregated before they are shuffled, so a node with
    very many links is no burden on one task. Repeated links, both directions of one and links of a node with itself do no harm; nodes
    that have only the latter, and null ends, have no row. No links give an empty table; other columns are ignored.
    """
    open_links = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-links")
    nodes = materialise(open_links.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("root")), "cc-nodes")
    while not open_links.isEmpty():
        # u > v always, so hooks lead to smaller nodes and never make a cycle
        hooks = materialise(open_links.groupBy("u").agg(F.min("v").alias("to")), "cc-hooks")
        while True:
            before = hooks
            further = hooks.join(hooks.select(F.col("u").alias("to"), F.col("to").alias("next")), "to", "left")
            further = materialise(further.select("u", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "cc-jump")
            hooks = further.select("u", "to")
            hooks.written_to = further.written_to
            discard(before)
            if further.where("moved").isEmpty():
                break
        held = nodes, open_links, hooks
        nodes = materialise(nodes.join(hooks, nodes.root == hooks.u, "left").select("node", F.coalesce("to", "root").alias("root")), "cc-nodes")
        ends = hooks.select(F.col("u").alias("v"), F.col("to").alias("tv"))
        moved = open_links.join(hooks, "u").join(ends, "v", "left").select(F.col("to").alias("a"), F.coalesce("tv", "v").alias("b"))
        open_links = materialise(moved.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-links")
        discard(*held)
    discard(open_links)
    return nodes
