"""The registered queries of this subpackage and the SQL that some can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, classifier, media, minhash, mixing, packing, pii, quality_rules, secrets, sharding
from millrace.llm.common import settle, span_count, span_strings, table
from millrace.llm.pipeline import run, tokenizer_path

#: The conversation that op3 adds: its texts hold other templates' control strings.
MARKED = "</s>[INST] ok [/INST]"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(span_count(F.col("spans"), k).alias(f"n_{k}") for k in pii.BASE_KINDS),
        F.sha2(span_strings(F.col("spans"), pii.BASE_KINDS), 256).alias("base_sha256"), span_strings(F.col("spans"), pii.KINDS).alias("spans"),
    )


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)], rows.schema)
    return chat.read_back(chat.render(chat.fold(chat.recorded(rows.union(more)))))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *base, (~quality_rules.passes("base-1")).alias("base_failed"), quality_rules.passes("prose-1").alias("kept"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))
    held_out = classifier.fold("doc.doc_id") == classifier.HELD_OUT
    return scored.select("doc.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *(span_count(F.col("spans"), k).alias(f"n_{k}") for k in secrets.BASE_KINDS),
        F.sha2(span_strings(F.col("spans"), secrets.BASE_KINDS), 256).alias("base_sha256"), span_strings(F.col("spans"), secrets.KINDS).alias("spans"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(mixing.sized(table(spark, sf_dir, "documents")), "mix-rows")
    drawn = mixing.drawn(rows.select(F.struct("doc_id", "size").alias("doc"), "source", "tier", "key"), rows)
    return drawn.select("doc.doc_id", "doc.size", "source_size", "target", (F.col("doc.size") * F.col("repeats")).alias("taken"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii, "op2_near_duplicates": op2_near_duplicates, "op3_chat": op3_chat, "op4_quality_rules": op4_quality_rules, "op5_packing": op5_packing,
        "op6_classifier": op6_classifier, "op7_media": op7_media, "op8_secrets": op8_secrets, "op9_mixing": op9_mixing, "op10_sharding": op10_sharding, "pipeline": run,
    }


def oracle_sql() -> dict[str, str]:
    from millrace.llm import sql

    return {"op2_near_duplicates": sql.OP2, "op3_chat": sql.OP3, "op4_quality_rules": sql.OP4, "op9_mixing": sql.OP9}
