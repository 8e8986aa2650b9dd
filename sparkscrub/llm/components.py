"""Connected components of a graph of links, as joins and groupings.

Alternates two steps until nothing changes: every node ties its larger neighbours to
its smallest neighbour (large star), then its smaller neighbours and itself (small
star). The number of rounds grows with the logarithm of the graph's size. A node with
very many neighbours is reduced by map-side minimum and joined with one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.llm.common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Loops, repeated edges and edges with nulls are ignored. Each round is written to the
    shared folder, so a lost executor costs no more than one round.
    """
    high, low = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    edges = edges.dropna(subset=[a, b]).where(F.col(a) != F.col(b)).select(high.alias("a"), low.alias("b")).distinct()
    edges = materialize(edges, "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(least).distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state or now["n"] == 0:
            break
        state = now
    # Stars: every other node points to the smallest one.
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
