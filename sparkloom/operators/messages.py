"""Message logs: dense positions, exchanges of a conversation, recent questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.session import table


def positions(messages: DataFrame) -> DataFrame:
    """Adds the dense position from 0 of each message in its conversation."""
    return messages.withColumn("position", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long") - 1)


def exchanges(messages: DataFrame) -> DataFrame:
    """A user turn opens an exchange and later turns belong to it; turns before the first one are dropped."""
    number = F.count_if(F.col("role") == "user").over(W.partitionBy("conv_id").orderBy("turn"))
    return messages.withColumn("exchange_no", number).where("exchange_no > 0")


def bounded_exchanges(messages: DataFrame, most: int, last: bool) -> DataFrame:
    """The last `most` exchanges of each conversation, or the first ones."""
    found = exchanges(messages).withColumn("of", F.max("exchange_no").over(W.partitionBy("conv_id")))
    kept = F.col("exchange_no") > F.col("of") - most if last else F.col("exchange_no") <= most
    return found.where(kept).drop("of")


def recent_questions(messages: DataFrame, most: int) -> DataFrame:
    """The last `most` user texts, latest first, joined by line feeds."""
    users = messages.where("role = 'user'").withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))).where(F.col("back") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("back", F.coalesce("text", F.lit("")).alias("text"))))
    return users.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("questions"))


def append_conflicts(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered messages whose place is taken: `same` tells repeats from conflicts."""
    old = stored.select("conv_id", "turn", F.struct("role", "text").alias("old"))
    return offered.join(old, ["conv_id", "turn"]).select("conv_id", "turn", F.struct("role", "text").eqNullSafe(F.col("old")).alias("same"))


def _log(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def message_log_positions(spark, sf_dir):
    return positions(_log(spark, sf_dir)).select("conv_id", "turn", "position", "role")


def conversation_exchanges(spark, sf_dir):
    return exchanges(_log(spark, sf_dir)).groupBy("conv_id", "exchange_no").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.count_if(F.col("role") == "assistant").alias("answers"))


def conversation_last_exchanges(spark, sf_dir):
    return bounded_exchanges(_log(spark, sf_dir), 2, last=True).select("conv_id", "turn", "exchange_no")


def conversation_first_exchanges(spark, sf_dir):
    return bounded_exchanges(_log(spark, sf_dir), 2, last=False).select("conv_id", "turn", "exchange_no")


def recent_user_turns(spark, sf_dir):
    return recent_questions(_log(spark, sf_dir), 3).select("conv_id", F.sha2("questions", 256).alias("digest"))


def message_append_check(spark, sf_dir):
    log = _log(spark, sf_dir)
    offered = log.withColumn("text", F.when(F.col("conv_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return append_conflicts(log, offered)


QUERIES = {f.__name__: f for f in (message_log_positions, conversation_exchanges, conversation_last_exchanges, conversation_first_exchanges, recent_user_turns, message_append_check)}

_EXCHANGES = "x AS (SELECT *, CAST(count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS exchange_no FROM conversations), e AS (SELECT *, max(exchange_no) OVER (PARTITION BY conv_id) AS of_ FROM x WHERE exchange_no > 0)"

ORACLE_SQL = {
    "message_log_positions": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role FROM conversations",
    "conversation_exchanges": f"WITH {_EXCHANGES} SELECT conv_id, exchange_no, count(*) AS turns, min(turn) AS first_turn, count(*) FILTER (role = 'assistant') AS answers FROM e GROUP BY ALL",
    "conversation_last_exchanges": f"WITH {_EXCHANGES} SELECT conv_id, turn, exchange_no FROM e WHERE exchange_no > of_ - 2",
    "conversation_first_exchanges": f"WITH {_EXCHANGES} SELECT conv_id, turn, exchange_no FROM e WHERE exchange_no <= 2",
    "recent_user_turns": "WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user') SELECT conv_id, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY back)) AS digest FROM b WHERE back <= 3 GROUP BY conv_id",
    "message_append_check": "SELECT conv_id, turn, conv_id % 2 <> 0 OR text IS NULL AS same FROM conversations",
}
