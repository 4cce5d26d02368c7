"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import discard, stored

#: A guard only: each round at least halves the depth of every tree.
MAX_ROUNDS = 60


def _hooked(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation: neighbours of each node hang on its least neighbour.

    Large: the larger neighbours of u take the least of u and all neighbours.
    Small: u and its smaller neighbours take the least of them.
    """
    own = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = own.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = own.join(least, "u")
    if small:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        out = out.select("e.u", "e.v")
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node reachable.

    ``edges`` has two columns of a comparable type; loops, both directions and
    repeats are welcome; nulls count as no edge. Large-star and small-star
    rounds alternate, each written to the shared folder, until the stars stand
    still; nothing is gathered on the driver but two sums.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    now, before = stored(edges, "edges"), None
    for _ in range(MAX_ROUNDS):
        following = stored(_hooked(_hooked(now, small=False), small=True), "edges")
        discard(now)
        now = following
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
