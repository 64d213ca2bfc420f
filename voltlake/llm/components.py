"""Connected components of a link table, by contraction on the cluster.

Each round every node takes the least node (in a hashed order, new each round) within two
hops, and the graph is contracted along these choices: stars vanish in one round and paths shrink by a
constant share, so rounds are logarithmic. Nothing but a flag reaches the driver.

Node joins are between stored tables, so adaptive execution can split a hub's rows.
Edge cases: an empty link table gives an empty result; self links make their node a component;
repeated links count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm import scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of a link."""
    pair = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = scratch.table(pair.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = scratch.table(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    stored, left, turn = edges, edges.where("a <> b"), 0
    while not left.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = left.select("a", "b").union(left.select("b", "a"))
        near = scratch.table(both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a"))).alias("m")).withColumnRenamed("a", "v"), "near")
        far = both.join(near, both["b"] == near["v"]).groupBy("a").agg(F.min("m").alias("m"))
        step = scratch.table(far.select(F.col("a").alias("node"), F.col("m.n").alias("root")), "step")
        s, t = step.withColumnsRenamed({"node": "a", "root": "x"}), step.withColumnsRenamed({"node": "b", "root": "y"})
        moved = left.join(s, "a").join(t, "b").where("x <> y")
        left = scratch.table(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        after = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        old, nodes = nodes, scratch.table(nodes.join(after, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        scratch.drop(stored, near, step, old)
        stored = left
    least = scratch.table(nodes.groupBy("root").agg(F.min("node").alias("component")), "least")
    got = scratch.table(nodes.join(least, "root").select("node", "component"), "components")
    scratch.drop(stored, nodes, least)
    return got
