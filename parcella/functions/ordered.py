"""Order over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcella.session import checkpointed

#: Rows of one chunk of a running window.
CHUNK = 1 << 16


def numbered(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """df with each row's position, from 0, in an order that must be total.

    A range-partitioned sort, cut from its lineage, gives every row its place within its partition; the counts of the
    partitions, a row each, give the offsets.
    """
    at = checkpointed(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = at.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return at.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")


def with_previous(df: DataFrame, position: str, columns: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """df with columns of the row before, by dense positions: {new name: column}. Chunks share their edge rows."""
    home = df.withColumn("__chunk", F.floor(F.col(position) / chunk)).withColumn("__edge", F.lit(False))
    edges = home.where(F.col(position) % chunk == chunk - 1).withColumn("__chunk", F.col("__chunk") + 1).withColumn("__edge", F.lit(True))
    w = Window.partitionBy("__chunk").orderBy(position)
    both = home.unionByName(edges)
    for new, c in columns.items():
        both = both.withColumn(new, F.lag(c).over(w))
    return both.where(~F.col("__edge")).drop("__chunk", "__edge")
