"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Each step links every vertex to the least vertex it knows of. Minima are aggregated before the shuffle, written to
the shared folder, and then joined to the edges: both sides of that join are plain shuffles, so adaptive execution
deals the star of a vertex with very many edges to several tasks (or sends few minima to all). What each step leaves
is written too, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.llm.workspace import Workspace


def _linked(edges: DataFrame, key: str, work: Workspace) -> DataFrame:
    """``edges`` with ``m``: the least neighbour of the vertex in column ``key``."""
    other = "v" if key == "u" else "u"
    least = work.save(edges.groupBy(F.col(key).alias("k")).agg(F.min(other).alias("m")), "least")
    return edges.join(least, edges[key] == least["k"]).drop("k")


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """``edges``: columns u, v (long, not null). Returns ``id, component`` for every vertex of an edge.

    ``component`` is the least vertex that can be reached. Vertices without edges aren't listed.
    """
    # each edge once, from the greater to the lesser vertex
    now = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = work.save(now, "edges")
    before, rounds = None, 8 + now.count().bit_length() ** 2  # a star contraction takes O(log^2) steps
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each greater neighbour of u is linked to the least of u and its neighbours
        large = _linked(both, "u", work).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = work.save(large, "large")
        # small star: u and its lesser neighbours are linked to the least of them
        least = _linked(large, "u", work)
        small = least.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = work.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # a fixed point is a set of stars; then the steps change nothing
        sign = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        work.drop(now, large)
        now = after
        if before == tuple(sign):
            break
        before = tuple(sign)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
