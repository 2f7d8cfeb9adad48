"""Exact dedup: sorted digest runs that merge in binomial rounds, all in DataFrame operations.

Texts are equal when they agree after every ASCII white-space character is deleted. Each
document gets the SHA-256 digest of that normalised text and belongs to one of R runs, by a
hash of its doc_id. Within a run the documents of a digest collapse to one entry (the best
document so far and a count). Rounds then merge FAN_IN neighbouring runs at a time, by digest:
a round's partitions hold one digest range of the runs that meet, so no round gathers a whole
run, and a digest is at most FAN_IN entries wide when it is merged. After the last round one entry per
distinct text is left. The result goes down the same tree: entries of the first level look up
the final ones, and documents look up the entry of their own run, so that a text that a third
of all rows share is dealt over all runs on the way up and down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import SPACE, checkpointed, keep_rows, read, shuffle_partitions, text_of

#: Runs that meet in a round: 2^3, three binomial rounds in one shuffle.
FAN_IN_BITS = 3

_DIGEST = ["digest", "bytes"]


def digests(docs: DataFrame, runs: int) -> DataFrame:
    """One row per document: doc_id, run, digest, bytes (of the normalised text), chars, row_no."""
    norm = F.regexp_replace(text_of(), SPACE, "")
    return docs.select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(runs)).cast("int").alias("run"),
        norm.alias("norm"),
        F.char_length(text_of()).alias("chars"),
    ).select(
        "doc_id",
        "run",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.octet_length("norm").alias("bytes"),
        "chars",
        F.monotonically_increasing_id().alias("row_no"),
    )


def merge_tree(entries: DataFrame, runs: int) -> DataFrame:
    """Merges entries (run, digest, bytes, best, size) of `runs` runs, round by round, into one run."""
    while runs > 1:
        entries = (
            entries.withColumn("run", F.shiftright("run", FAN_IN_BITS))
            .groupBy("run", *_DIGEST)
            .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        )
        runs = -(-runs >> FAN_IN_BITS)
    return entries.drop("run")


def grouped(docs: DataFrame) -> DataFrame:
    """One row per document: those of exact_dedup() and chars, the code points of its text."""
    runs = 1 << max(3, (shuffle_partitions(docs.sparkSession) - 1).bit_length())
    rows = checkpointed(digests(docs, runs))
    best = F.struct((-F.col("chars")).alias("neg_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    first = rows.groupBy("run", *_DIGEST).agg(F.min(best).alias("best"), F.count("*").alias("size"))
    final = merge_tree(first, runs)
    in_run = first.select("run", *_DIGEST).join(final, _DIGEST)
    return rows.join(in_run, ["run", *_DIGEST]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "chars",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Groups documents of equal text; one document of each group stays.

    docs: doc_id, text; other columns are ignored.
    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.
    Of a group, the row with the most code points in its original text stays, then the one with the
    smallest doc_id; null text counts as empty, a null doc_id comes after all others. Rows that
    repeat a doc_id are rows like any other: of equal ones just one is kept. Equal digests are
    held to be equal texts only if the texts' lengths agree as well; long texts are digested whole. An empty table gives no rows.
    """
    return grouped(docs).drop("chars")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of equal texts one row, with all its columns, whatever their names.

    It is the row that exact_dedup() keeps; of rows that repeat its doc_id with as long a text, the one of least text. Null
    texts are a group with the empty ones; long texts are read whole; an empty table stays empty.
    """
    mark = lambda sha256, chars: F.concat_ws(":", sha256, chars.cast("string"))
    rows = grouped(docs).select("doc_id", mark(F.col("text_sha256"), F.col("chars")).alias("mark"), F.col("kept").alias("stays"))

    def of(text):
        text = F.coalesce(text, F.lit(""))
        return mark(F.sha2(F.regexp_replace(text, SPACE, ""), 256), F.char_length(text))

    return keep_rows(docs, rows, of)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}

ORACLE_SQL = {
    "op6_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
}
