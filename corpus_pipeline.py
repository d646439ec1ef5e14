"""A training-data pipeline over ``documents``: filter, dedup twice, decontaminate, tokenize.

Each stage is one operator of ``cohortspan.llm``, takes what its predecessor kept and returns a
frame, which is written as Parquet and reread before the next. All but the last return the columns
of ``documents``. Stages work on any rows: null texts count as empty, rows without a doc_id are kept
unless a rule rejects their text, columns that they don't know pass through, and an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.byte_bpe import decode_documents, encode_documents, production_vocabulary
from cohortspan.llm.common import stored, table
from cohortspan.llm.decontamination import decontaminate
from cohortspan.llm.line_dedup import line_dedup
from cohortspan.llm.minhash_dedup import near_dedup
from cohortspan.llm.quality_rules import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_filter(docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a later document (by doc_id) and two others at least share."""
    return line_dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (by doc_id) of each group with shingle similarity of 0.8 or more."""
    return near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and the hash of the text that they decode to."""
    vocabulary = production_vocabulary()
    encoded = encode_documents(docs.select("doc_id", "lang", "source", "text"), *vocabulary)
    return decode_documents(encoded.drop("text"), *vocabulary).select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_shared_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level bpe", tokenize),
]

#: SQL cannot express the encoding; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
