"""What the operators for training data share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import checkpointed, shared_folder

__all__ = ["SPACE", "WORD", "checkpointed", "keep_rows", "read", "shared_folder", "shuffle_partitions", "text_of"]

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Pairs of doc_id and mark that are broadcast; more of them meet the documents in a shuffle.
BROADCAST_ROWS = 100_000


def keep_rows(docs: DataFrame, rows: DataFrame, mark: Callable[[Column], Column]) -> DataFrame:
    """The rows of docs that stay, with all their columns, exactly one for each pair (doc_id, mark) of rows marked `stays`.

    rows: doc_id, mark, stays, one row per row of docs; mark gives the same mark from a text column. Where a
    doc_id is in one row only, that row is found by its doc_id. Of rows that repeat a doc_id, null included, those with the right mark
    are aggregated to one, the one of least text, so that a row repeated any number of times meets in no task.
    """
    ids = checkpointed(rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("stays").alias("k"))).where("k > 0")
    same = lambda left, right: F.col(left).eqNullSafe(F.col(right))
    packed = docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("d"))
    once = packed.join(ids.where("n = 1").select(F.col("doc_id").alias("id")), same("d.doc_id", "id"), "left_semi")
    wanted = rows.where("stays").select("doc_id", "mark").join(ids.where("n > 1").select(F.col("doc_id").alias("id")), same("doc_id", "id"), "left_semi").distinct()
    wanted = checkpointed(wanted.select(F.col("doc_id").alias("id"), F.col("mark").alias("of")))
    n = wanted.count()
    if not n:
        return once.select("d.*")
    sized = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    repeated = packed.join(sized(wanted.select("id").distinct()), same("d.doc_id", "id"), "left_semi").withColumn("mark", mark(F.col("d.text")))
    repeated = repeated.join(sized(wanted), same("d.doc_id", "id") & (F.col("mark") == F.col("of")), "left_semi")
    one = repeated.groupBy("d.doc_id", "mark").agg(F.min_by("d", F.coalesce("d.text", F.lit(""))).alias("d"))
    return once.unionByName(one.select("d")).select("d.*")
