"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcella.session import checkpointed, give_back, passing, shared_path, stored  # noqa: F401

#: Rows of one Arrow batch for operators on whole texts: bounds what a Python worker holds at once.
TEXT_BATCH = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a word consists of, as the contracts state it.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_arrow_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> None:
    """Bounds Arrow batches for the operators that hand whole texts or pages to Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
