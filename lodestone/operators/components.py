"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): each node of an undirected graph with the smallest node of its component.

    Alternating large-star and small-star rounds: each is one aggregation and one join of the
    edge table, the number of rounds grows with the logarithm of the component size, and no
    round has more edges than the graph. Whether a round changed anything is told by the number of its
    edges and a sum over 128 bits of their hashes. Edges with a null end and loops are ignored; isolated
    nodes don't appear. A hub's edges are joined to one row of minima, never paired. Every
    round is cut to a table in the shared folder, and the one before it deleted.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _sum_of(e)
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour (or itself)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: every smaller neighbour, and the node, is linked to the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        new = cut(small.where("u <> v").distinct(), "edges")
        now = _sum_of(new)
        drop(e)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _sum_of(edges: DataFrame) -> tuple:
    hashes = [F.sum(F.xxhash64("u", "v", F.lit(i)).cast("decimal(38,0)")) for i in (1, 2)]
    return tuple(edges.agg(F.count("*"), *hashes).first())
