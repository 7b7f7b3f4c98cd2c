"""The registered query of every operator, with production parameters over its whole table, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcella.llm import bpe, chat, itq, license, linededup, mixing, onebit, simhash, toxicity, warc
from parcella.llm.common import read_table, shared_path


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_dedup(read_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), removed_col="lines_removed")
    return docs.select("doc_id", "lines_removed", F.length("text").cast("long").alias("chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_dedup(read_table(spark, sf_dir, "embeddings"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path).where(F.col("type").isin("response", "revisit"))
    name = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    page = lambda c: F.when(name(c) != "", name(c).cast("long"))
    digest = F.when(F.col("type") == "response", F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1))
    return records.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.windows(turns))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    whole = license.scan_texts(docs)
    lines = license.scan_lines(docs).groupBy(F.col("id").alias("line_of")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ";").alias("names"))
    joined = whole.join(lines, F.col("id").eqNullSafe(F.col("line_of")), "left")
    return joined.select(F.col("id").alias("doc_id"), F.col("digest").alias("canonical_sha256"), "license", F.coalesce("n", F.lit(0)).alias("notice_lines"), F.coalesce("names", F.lit("")).alias("notices"))


def learnable(id_col: str = "doc_id"):
    """Rows whose labels may be learned from; the rest is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(*toxicity.sample(docs, read_table(spark, sf_dir, "labels"), learnable()))
    scored = toxicity.score(docs, model)
    held_out = ~F.coalesce(learnable("id"), F.lit(True))
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_onebit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = onebit.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded", keep=["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_itq": op3_itq,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_chat": op6_chat,
    "op7_license": op7_license,
    "op8_toxicity": op8_toxicity,
    "op9_onebit": op9_onebit,
    "op10_bpe": op10_bpe,
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": linededup.SQL, "op3_itq": itq.SQL, "op4_mixing": mixing.SQL, "op5_warc": warc.SQL, "op6_chat": chat.SQL, "op7_license": license.SQL}
