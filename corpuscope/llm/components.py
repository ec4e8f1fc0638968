"""Connected components of a graph that no machine holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import drop, kept


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 60) -> DataFrame:
    """Maps every node of ``edges`` to the smallest node that it reaches: columns ``node``, ``root``.

    Large-star and small-star rounds in turn: each hangs neighbours on the smallest node in sight, with one minimum
    and one join on the node, so no task gathers a node's neighbours and Spark can split the join of a hub. Rounds
    end when a round leaves the edges as they were; the edges of each round are a table in the shared folder.
    Loops, repeated edges and edges with a null end have no effect; no edges give no rows.
    """
    spark = edges.sparkSession
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now, path = kept(edges.select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "edges")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    mark = print_of(now)
    for _ in range(limit):
        if not mark[0]:
            break
        both = now.select(F.col("u").alias("n"), F.col("v").alias("o")).union(now.select(F.col("v").alias("n"), F.col("u").alias("o")))
        low = both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"))
        # large star: every larger neighbour of n hangs on n's smallest
        large = now.select(F.col("u").alias("n"), "v").join(low, "n").select("v", F.col("m").alias("u"))
        small_in = large.where("v != u").distinct()
        # small star: every smaller neighbour of v, and v, hang on the smallest
        least = small_in.groupBy("v").agg(F.min("u").alias("m"))
        small = small_in.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u").where("v != u").distinct()
        after, new_path = kept(small, "edges")
        drop(spark, path)
        new_mark = print_of(after)
        now, path = after, new_path
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
