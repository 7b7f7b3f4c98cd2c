"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a target number of words: weights share the total of all words, and a target stops at `most` times its
source's words, the excess being shared again by weight. A target is met by whole copies of the source and, for the
rest, by the documents whose hash lies below a threshold. The threshold is found without a sort of documents: words are
summed by source and leading hash bits, the bucket where the running sum passes the rest is refined by the next bits,
and so on until one hash value is left, which joins when that brings the sum nearer to the target.

Only histogram rows (at most 4096 a source and level) and per-source rows are shuffled, after partial sums; a source
with a third of all rows costs no more than any other. Native DataFrame operations throughout.

Cases: null and empty texts have size 0 and take part with no words. A null source is a source of its own, ordered last.
Rows that share an id, or have none, are told apart by their
texts; rows equal in both share their hash, hence their decision (a source of nothing but one text is taken whole or not). A source without words has target 0. An empty
table gives an empty result. Results depend on ids, sources and texts only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcella.llm.common import stored, word_count

#: Bits of a document's hash, and bits that one level of histograms resolves.
BITS, LEVEL = 48, 12
WEIGHTS = (5, 2, 1)
MOST = 3


def hash48(id_col: str, text_col: str) -> Column:
    """Of id and text: rows that share an id, or have none, are told apart by their texts."""
    named = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sums: (source, words). Adds target, copies (whole copies of the source) and rest (words still to be taken).

    Sources by code point take the weights in turn. Sorted by how soon they reach their limit, a source is limited if its
    limit is below its share of what the sources before it leave; the share of the first one that is not, the largest of
    those left, holds for the rest.
    The windows run over per-source sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("double"))
    order = (F.col("words") * most / F.col("weight"), F.col("source").asc_nulls_last())
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("words").over(every) - F.coalesce(F.sum(F.col("words") * most).over(before), F.lit(0))) / F.sum("weight").over(onward)
    shared = ranked.withColumn("level", level).withColumn("limited", F.col("words") * most <= F.col("level") * F.col("weight"))
    final = shared.withColumn("final", F.max(F.when(~F.col("limited"), F.col("level"))).over(every))
    target = F.when(F.col("limited"), (F.col("words") * most).cast("double")).otherwise(F.col("final") * F.col("weight"))
    copies = F.when(F.col("limited"), F.lit(most)).otherwise(F.floor(F.col("target") / F.col("words"))).cast("long")
    return final.withColumn("target", target).withColumn("copies", copies).withColumn("rest", F.when(F.col("limited"), F.lit(0.0)).otherwise(F.col("target") - F.col("copies") * F.col("words"))).select("source", "words", "target", "copies", "rest")


def thresholds(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: (source, rest). For each source with words, the hash below which its documents are taken once more (below)."""
    state = wanted.select("source", "rest", F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("prefix"))
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        s = state.select(F.col("source").alias("s"), "rest", "sum", "prefix")
        inside = sized.join(s, sized["source"].eqNullSafe(s["s"]) & (F.shiftright("hash", shift + LEVEL) == F.col("prefix")))
        histogram = inside.groupBy("source", "rest", "sum", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = histogram.withColumn("upto", F.col("sum") + F.sum("words").over(running))
        # the boundary: the first bucket whose running sum passes the rest
        state = summed.where("upto > rest").groupBy("source", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("sum"), "words")).alias("at")).select("source", "rest", F.col("at.sum").alias("sum"), F.col("at.bucket").alias("prefix"), F.col("at.words").alias("words"))
    nearer = F.col("sum") + F.col("words") - F.col("rest") < F.col("rest") - F.col("sum")
    return state.select("source", (F.col("prefix") + nearer.cast("long")).alias("below"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, hash) of every row of docs, written once, as several passes follow."""
    return stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash48(id_col, text_col).alias("hash")), "mixing")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row per source, written, so that a join with it knows its size; its columns are marked, as they meet any others."""
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("words")), weights, most)
    # a source that whole copies serve needs no threshold, which texts without words could lie below
    below = thresholds(sized, goals.where("rest > 0")).select(F.col("source").alias("b"), "below")
    rows = goals.join(below, goals["source"].eqNullSafe(below["b"]), "left")
    return stored(rows.select(F.col("source").alias("__source"), F.col("words").alias("__words"), F.col("target").alias("__target"), F.col("copies").alias("__whole"), F.col("below").alias("__below")), "mixplan")


def copies(rows: DataFrame, sources: DataFrame, hashed: Column, source_col: str = "source") -> DataFrame:
    """rows with the columns of sources and __copies, how often each is taken."""
    joined = rows.withColumn("__hash", hashed).join(sources, rows[source_col].eqNullSafe(sources["__source"]), "left")
    taken = F.coalesce("__whole", F.lit(0)) + F.coalesce(F.col("__hash") < F.col("__below"), F.lit(False)).cast("long")
    return joined.withColumn("__copies", taken)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies): how often every row of docs is taken."""
    sized = measured(docs, id_col, text_col, source_col)
    taken = copies(sized, plan(sized, weights, most), F.col("hash"))
    return taken.select("id", "source", "size", F.col("__words").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as it is taken. Texts stay where they are."""
    sources = plan(measured(docs, id_col, text_col, source_col), weights, most)
    taken = copies(docs, sources, hash48(id_col, text_col), source_col).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


#: DuckDB: sizes and hashes, targets by the same sharing, and the documents in the order of their hashes.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS words FROM sized GROUP BY source),
ranked AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sums),
levels AS (
  SELECT *, (sum(words) OVER () - coalesce(sum(words * 3) OVER (ORDER BY words * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY words * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
limited AS (SELECT *, words * 3 <= level * weight AS full_up FROM levels),
goals AS (
  SELECT source, words, full_up, CASE WHEN full_up THEN (words * 3)::DOUBLE ELSE max(level) FILTER (NOT full_up) OVER () * weight END AS target
  FROM limited),
rests AS (
  SELECT *, CASE WHEN full_up THEN 3 ELSE floor(target / words)::BIGINT END AS copies,
         CASE WHEN full_up THEN 0.0::DOUBLE ELSE target - floor(target / words)::BIGINT * words END AS rest
  FROM goals),
hashes AS (SELECT source, h, sum(size)::BIGINT AS words FROM sized GROUP BY source, h),
upto AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM hashes),
edge AS (
  SELECT u.source, min(u.h) AS h FROM upto u JOIN rests r ON u.source IS NOT DISTINCT FROM r.source WHERE u.upto > r.rest GROUP BY u.source),
below AS (
  SELECT e.source, e.h + CASE WHEN u.upto - r.rest < r.rest - (u.upto - u.words) THEN 1 ELSE 0 END AS below
  FROM edge e JOIN upto u ON e.source IS NOT DISTINCT FROM u.source AND e.h = u.h JOIN rests r ON e.source IS NOT DISTINCT FROM r.source WHERE r.rest > 0)
SELECT s.doc_id, s.size, r.words AS source_size, r.target,
       (s.size * (r.copies + CASE WHEN coalesce(s.h < b.below, false) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN below b ON s.source IS NOT DISTINCT FROM b.source
"""
