"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, exact_dedup, language_id, mixing, simhash
from sparkloom.llm.common import read, shared_folder

#: A document is rejected if less of its n-grams than this belong to the language found.
LEAST_KNOWN = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or mostly of n-grams of no learned language, go; lang becomes what was found.

    The filters learn from the stage's own input, by the folds of the registered query.
    """
    filters = language_id.train(docs.where(~language_id.in_fold(4, 2)))
    return language_id.identified(docs, filters, LEAST_KNOWN)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space apart: the one with most code points, then the smallest doc_id; of rows that repeat it, one.

    Null and empty texts are equal; long texts are digested whole; columns of any names pass, and an empty table stays empty."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link, the one with the smallest doc_id; of rows that repeat it, one.

    Null and empty texts have fingerprint zero and link like any other; long texts are read whole; columns of any names pass, and an empty table
    stays empty."""
    return simhash.keep_one(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the epochs take them, each time with all its columns; the last one of a leaf is cut where its token-prefix ends.

    Null and empty texts have no tokens and take no part; a long text counts with all its tokens; rows that repeat a doc_id are documents of their own in an
    order that their texts decide; null lang and source are leaves like any other, and an empty table stays empty."""
    return mixing.mixed_documents(docs, mixing.PRODUCTION)


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (32-bit little-endian) and the text decoded from them, a row for each row: repeated ones too, null and empty texts without
    ids; long texts whole. Other columns don't pass; an empty table gives no rows."""
    return bpe.encode_decode(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_to_weights),
    ("bpe", encode_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read from there."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Language ID, SimHash links and BPE can't be said in SQL; the tests hold run() against brute force.
ORACLE_SQL = None
