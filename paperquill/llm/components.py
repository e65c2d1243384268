"""Connected components of a table of edges, by alternating large and small stars.

Each round rewrites the edges with joins and aggregates, so no component is gathered anywhere; the number of rounds
grows with the logarithm of the longest chain. The smallest neighbour of a vertex is found with a partial aggregate, and
the join that ties its neighbours to it is spread over several tasks where they are very many (hot_join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Scratch, hot_join

MAX_ROUNDS = 100


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of each vertex of edges (a, b): component is the smallest vertex that links reach.

    Edges with a null end and loops are passed over, repeated ones are harmless; without edges the result is empty.
    """
    e = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = e.agg(F.count("*"), F.lit(None)).first()
    for _ in range(MAX_ROUNDS):
        # large star: every larger neighbour of a vertex is tied to the smallest vertex of its neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hot_join(both, least, "u", "v", "n", 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a vertex and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, low, "u", "v", "n", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = scratch.save(small.filter("u <> v").distinct(), "edges")
        scratch.drop(e)
        e = new
        got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == state:
            break
        state = got
    else:
        raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
