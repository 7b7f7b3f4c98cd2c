"""The table of word counts that puts tokens in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcella.llm import linededup


def test_words_of_one_bucket_of_the_old_table_are_told_apart(spark):
    """A rare word stays before a frequent one whose hash has the same 16 low bits."""
    h = F.xxhash64(F.concat(F.lit("v"), F.col("id")))
    low = spark.range(3000).select("id", h.bitwiseAND(F.lit(0xFFFF)).alias("b"), h.bitwiseAND(F.lit(linededup.RARITY - 1)).alias("c"))
    a = low.alias("x").join(low.alias("y"), "b").where("x.c <> y.c").select(F.col("x.id").alias("x"), F.col("y.id").alias("y"), F.col("x.c").alias("cx"), F.col("y.c").alias("cy")).first()
    classes, _ = linededup.rarity(spark.createDataFrame([(f"v{a['x']} " * 500 + f"v{a['y']}",)], "text string"), "text")
    got = spark.range(1).select(*(linededup.class_of(classes, F.lit(a[c]).cast("long")) for c in ("cx", "cy"))).first()
    assert got[0] > got[1] > 0
