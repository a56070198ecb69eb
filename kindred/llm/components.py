"""Connected components by alternating large-star and small-star steps, on edges alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import drop_written, tidy, written

#: Edges up to which a table of one row a node (16 bytes of numbers) is broadcast; the edges are counted before.
BROADCAST_EDGES = 500_000


@tidy
def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """node, component (the smallest node it is linked with): a row for each node of an edge between two nodes.

    Each step takes minima by node with map-side combining and joins them back.  Few minima are broadcast, so that the
    edges of a hub stay where they are; many are written first, so that the join has plain exchanges on either side
    and the planner can split a hub.  Rounds, each written to the shared folder, grow with the logarithm of a component.
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    n, seen = now.count(), None
    for _ in range(max_rounds):
        few = n <= broadcast_edges
        side = F.broadcast if few else lambda d: written(d, "minima")
        # large star: what is above a node is linked to the least of its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = side(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # small star: what is below a node, and the node, are linked to the least below it
        low = side(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after = written(small, "edges")
        n, mixed = after.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first()
        for done in (now, large, *(() if few else (least, low))):
            drop_written(done)
        now = after
        if seen == (n, mixed):
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        seen = n, mixed
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
