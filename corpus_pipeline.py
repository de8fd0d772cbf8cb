"""From raw documents to token ids: five stages, each written as Parquet and read again.

Quality rules reject documents, near-duplicates leave one of each class, personal data is replaced
by its kind, sources are mixed to target weights (documents may come twice), and texts become ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leakloom.llm import _shared, byte_bpe, minhash_dedup, mixing, pii_crf, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts fail, repeated rows and other columns stay as they are."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, with all its columns; of repeated rows one stays, null texts count as empty."""
    return minhash_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; null texts stay null, rows and other columns stay."""
    return pii_crf.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in shuffled order; null sources are one source, other columns stay."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text's ids, as little-endian unsigned 32-bit integers, and their number; null counts as empty.

    The last stage's rows are (doc_id, lang, source, n_tokens, ids); other columns end here.
    """
    from pyspark.sql import functions as F

    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("byte-level BPE", token_ids),
]

#: The first stage's references, signatures and message passing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over a data folder's documents; what lies between goes to the shared checkpoint folder."""
    docs = _shared.table(spark, sf_dir, "documents")
    folder = f"{_shared.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
