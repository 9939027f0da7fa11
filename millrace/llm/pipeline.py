"""The corpus pipeline: each stage applies one operator to what its predecessor kept.

The stages take documents with repeated rows, null ids, null, empty and very long texts, columns of any
other names, and empty tables; what each does with them is its operator's defined result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import classifier, minhash, mixing, packing, secrets
from millrace.llm.common import Scope, remove, table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: each row by its text alone, so repeated ones go or stay together; null texts count as empty."""
    scored = classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= classifier.THRESHOLD).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id, null ids last; rows without words all stay."""
    return minhash.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their secrets replaced by the secrets' kinds; n_chars, where there is one, is the new text's; null texts stay null."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, each at most three times; a null source is one like others, a source without words is not taken."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's text, null and empty ones too: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("secrets", mask_secrets), ("mixing", mix), ("packing", pack)]
#: The model, the packing and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. What a stage has written goes as soon as the next one has ended."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with Scope(spark) as scope:
            docs = scope.out(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        for path in before:
            remove(spark, path)
        before = scope.kept
    return STAGES[-1][1](spark, docs, sf_dir)
