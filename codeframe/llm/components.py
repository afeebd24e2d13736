"""Connected components of a distributed edge table, by alternating star contractions.

Each round points every vertex at the least neighbour it knows, first for larger
and then for smaller neighbours; the number of rounds grows with the logarithm of
the longest chain.  Edges stay in the shared folder between rounds; the driver
sees one row of counts a round.  A vertex with very many edges, as the root of a giant
component is, is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeframe.llm._common import salted, write_shared


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("hits"))
    return salted(both.where("v > u"), least, "u", "v", n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("hits"))
    return (
        salted(down, least, "u", "v", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every id on an edge (u, v); root is the least id of its component.

    Self-loops and rows with a null end are ignored; ids that are on no edge get no row.
    """
    e = write_shared(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "edges")
    before, n = None, e.count()
    for _ in range(max_rounds):
        e = write_shared(_small_star(_large_star(e, n), n), "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before, n = now, max(n, now[0])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
