"""A corpus pipeline: classify, drop near-duplicates, take secrets out, mix, pack.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir), works on all rows that the one before it
kept, and returns the columns of documents, but for the last, which returns the pieces of the packed
sequences. run() applies them to the table documents and writes each result to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.llm.common import materialise
from quiltgraph.llm.mixing import mix_sources
from quiltgraph.llm.packing import pack_documents
from quiltgraph.llm.quality import score_quality, train_quality
from quiltgraph.llm.queries import default_tokenizer
from quiltgraph.llm.resemblance import SHINGLE, similar_groups
from quiltgraph.llm.secrets import redact_secrets
from quiltgraph.llm.simhash import keep_one

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Documents with a lower score go.
QUALITY = 0.5

#: Bits of 64 in which fingerprints of candidates for near duplicates may differ.
NEAR_BITS = 7

#: Tokens that are packed at once; within them, sequences follow the schedule only about.
ORDERED_TOKENS = 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule ensemble, fitted to the labelled ones, scores below QUALITY. Without
    labels every document has the score 0.5 and stays. Null texts are scored as empty ones."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs.select(*COLUMNS), model, score_col="_score").where(F.col("_score") >= QUALITY).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of documents with a five-word Jaccard similarity of 0.8 or more the one with the
    smallest id (null last). Null texts and those without words are alike. SimHash finds candidates within NEAR_BITS
    bits; the exact check adds those that 64 bits can't tell, and compares whole texts."""
    return keep_one(docs.select(*COLUMNS), tau=NEAR_BITS, shingle=SHINGLE, check=similar_groups)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in texts; n_chars follows, but for null texts, which stay null. Every document stays."""
    clean = redact_secrets(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in mixed order: rows are range-partitioned and sorted by their place in the schedule.
    Every document stays; a null source is a source of its own, and null ids are documents like others."""
    return _scheduled(spark, docs)


def _scheduled(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs in contiguous ranges of the schedule, which depends on their ids and sources alone, not on files."""
    mixed = mix_sources(docs.select(*COLUMNS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "mix_position").sortWithinPartitions("mix_position").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids; sequence ids follow the mixing schedule. Readers
    of stored tables deal files out by size, so the rows are put in the schedule's order again. A null text is packed as
    an empty one, a null id stays null."""
    return pack_documents(_scheduled(spark, docs), default_tokenizer(), block_tokens=ORDERED_TOKENS, in_order=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the classifier's fit nor the fingerprints nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
