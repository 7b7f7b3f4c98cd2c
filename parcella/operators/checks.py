"""Checks of exports and partitions: sets that must agree, keys that must be unique, trees that must be equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side that has them."""
    a, b = left.distinct(), right.distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def orphans(indexed: DataFrame, members: DataFrame) -> DataFrame:
    return indexed.join(members, "camera_index", "left_anti")


def tree_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths (path, digest) whose digests differ or that one tree lacks."""
    r = right.select("path", F.col("digest").alias("other"))
    return left.join(r, "path", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other")))


def stale_sources(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Fields (field, digest) whose recorded digest isn't the current one."""
    return recorded.join(current.select("field", F.col("digest").alias("now")), "field", "left").where(~F.col("digest").eqNullSafe(F.col("now")))


def agree(a: Column, b: Column, relative: float = 1e-12) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def partition_faults(owned: DataFrame) -> DataFrame:
    """Cameras (camera_index, owners) that don't have exactly one owner."""
    return owned.where("owners <> 1")


def same_layout(schemas: list[list[tuple[str, str]]]) -> None:
    """Vertex tables merge only if their properties agree in order, name and type."""
    for k, s in enumerate(schemas[1:], 1):
        if s != schemas[0]:
            raise ValueError(f"part {k} has properties {s}, the first one {schemas[0]}")


def ordered_union(parts: list[tuple[int, DataFrame]], order: str) -> DataFrame:
    """UNION ALL of blocks' rows with block_id, in the order of blocks and, within them, of a column."""
    same_layout([df.dtypes for _, df in parts])
    out = None
    for block, df in sorted(parts, key=lambda p: p[0]):
        tagged = df.withColumn("block_id", F.lit(block))
        out = tagged if out is None else out.unionByName(tagged)
    return out.orderBy("block_id", order)
