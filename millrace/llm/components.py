"""Connected components as distributed union-find over an edge table.

Alternates the two star operations of the MapReduce union-find: each node hangs
its larger neighbours below the smallest node it knows (large star), then its
smaller neighbours and itself (small star). Edges only ever move to smaller
nodes, components stay as they are, and after a number of rounds in the order of
the logarithm of the size every node hangs directly below the smallest one. No
edge or component reaches the driver; it sees two numbers per round. A hub is an
aggregation with map-side partial minima and a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u")
    return below.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return r["n"], r["h"] or 0


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """Rows (node, root) for every node with an edge; root is the smallest node of its component.

    `a` and `b` are columns of one orderable type. Loops, repeated edges and nulls
    are let go; without edges the result is empty. The order of the nodes decides
    the root, so ties can't occur.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = scratch.save(now, "edges")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS if mark[0] else 0):
        last = now
        now = scratch.save(_small_star(_large_star(last)), "stars")
        scratch.drop(last)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
