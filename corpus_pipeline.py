"""A corpus pipeline: toxicity, line dedup, near-dedup, mixing sources to target weights, byte-level BPE.

Every stage takes all documents that its predecessor kept and decides about them: toxic documents go, later matches of lines go,
one document of each group of near copies (Jaccard similarity of 0.8 on five-word shingles; candidates come from SimHash
links and from an exact join for what fingerprints lose, see shingles.py) stays, the one of smallest id, documents are
taken as often as their source's target asks, and the result is encoded. Stages are written as Parquet between one another.

Cases: a null text has the toxicity of no features, and no lines; null and empty texts are one group of near copies, of which one row stays.
Rows that repeat an id or have none are told apart by their texts. Only the columns of documents go on; n_chars is that of the
text as it is after line dedup. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcella.llm import bpe, linededup, mixing, shingles, toxicity
from parcella.llm.common import give_back, read_table, shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remeasured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back(spark)
    model = toxicity.fit(*toxicity.sample(docs, read_table(spark, sf_dir, "labels")))
    give_back(spark)
    return toxicity.mark(docs.select(*COLUMNS), model, score_col="__toxicity").where("__toxicity < 0.5").select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remeasured(linededup.dedup(docs.select(*COLUMNS)))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of smallest id; rows of different groups may share an id or have none."""
    return shingles.one_of_each(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as its source's target asks."""
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    give_back(spark)
    coded = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.ids_digest(F.col("ids")).alias("ids_sha256"), same.alias("round_trip"))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", one_of_near_copies),
    ("mixing", mixed),
    ("byte-level bpe", encoded),
]
#: SQL can't express the trees, the fingerprints or the merges; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
