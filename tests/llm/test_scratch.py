"""What line dedup and near-dedup leave behind, and the pairs that near-dedup considers."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from parcella.llm import linededup, shingles
from parcella.session import CLEANUP, shared_dir

ROWS = [(i, "\n".join(" ".join(f"w{(i * 7 + k * 3 + j) % 90}" for j in range(12)) for k in range(4)), "en", "s", 0) for i in range(60)]


def tables(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def left_behind(spark, f):
    before = tables(spark)
    out = f(spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long"))
    assert out.count() > 0
    new = tables(spark) - before
    return sorted(x.split("-")[0] for x in new if x.startswith(("line", "shingle")))


def test_only_what_the_result_reads_stays(spark):
    assert left_behind(spark, linededup.dedup) == ["linegone"]
    assert left_behind(spark, shingles.one_of_each) == ["shinglegone"]


def test_the_setting_for_shuffle_files_is_known_and_put_back(spark):
    before = spark.conf.get(CLEANUP)
    left_behind(spark, linededup.dedup)
    assert spark.conf.get(CLEANUP) == before


def test_a_first_shared_shingle_that_comes_late_rules_a_pair_out(spark):
    # of 100 shingles each, 90 must be shared, and from place 15 on there are 85
    row = spark.range(1).select(*(F.struct(F.lit(100).alias("n"), F.lit(pos).alias("pos")).alias(f"p{pos}") for pos in (0, 10, 15)))
    fits = lambda a, b: row.select(shingles._fits(F.col(a), F.col(b), 0.8)).first()[0]
    assert fits("p0", "p10") and fits("p10", "p10")
    assert not fits("p15", "p15") and not fits("p0", "p15")
