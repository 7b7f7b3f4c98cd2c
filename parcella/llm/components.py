"""Connected components over an edge table, without collecting links or components anywhere.

Alternates two star contractions (large-star: every node links its larger neighbours to its smallest one; small-star: the
same for its smaller neighbours) until the edges are stars whose centre is the smallest node of its component. A round
takes four joins or aggregations on node keys and the number of rounds grows with the logarithm of the largest
component. A hub's edges arrive through an ordinary equi-join, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcella.llm.common import checkpointed


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node that it reaches.

    edges: columns a and b of one orderable type. Rows with a null end and self-links are left out; order and repeats
    don't matter. An empty table gives an empty result.
    """
    e = checkpointed(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.col("a").isNull().alias("x"), F.col("b").isNull().alias("y"))
        .where("not x and not y and u <> v")
        .select("u", "v")
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = checkpointed(small.distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
