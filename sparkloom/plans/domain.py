"""The library's objects, read from the driver tables.

Versions come from `events`: each user is an identity; events other than sign-ups are its formal
versions in time order (an `error` is a tombstone), sign-ups are conflict candidates at the
version before them, and the zone is the user's number modulo 4. Relations are suppliers' deliveries of
parts, one per pair, weighted by quantity; the journal is `events` as a stream per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.session import table, tasks_for

ZONES = 4


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_id, id, version, candidate_number (0: formal), deleted, description, content_hash, source_id, frequency."""
    by_time = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("version", F.count_if(F.col("event_type") != "signup").over(by_time)).where("version > 0")
    candidate = F.col("event_type") == "signup"
    number = F.row_number().over(W.partitionBy("user_id", "version", "event_type").orderBy("ts", "event_id"))
    return rows.select(
        (F.col("user_id") % ZONES).alias("zone_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
        "version",
        F.when(candidate, number).otherwise(0).cast("long").alias("candidate_number"),
        (F.col("event_type") == "error").alias("deleted"),
        F.col("props").alias("description"),
        F.sha2("props", 256).alias("content_hash"),
        F.col("event_id").alias("source_id"),
        F.floor("value").cast("long").alias("frequency"),
    )


VERSIONS_SQL = """
ev AS (SELECT *, CAST(count(*) FILTER (event_type <> 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS version FROM events),
versions AS (
  SELECT user_id % 4 AS zone_id, 'u' || user_id AS id, version,
    CAST(CASE WHEN event_type = 'signup' THEN row_number() OVER (PARTITION BY user_id, version, event_type ORDER BY ts, event_id) ELSE 0 END AS BIGINT) AS candidate_number,
    event_type = 'error' AS deleted, props AS description, sha256(props) AS content_hash, event_id AS source_id, CAST(floor(value) AS BIGINT) AS frequency
  FROM ev WHERE version > 0)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, source, target, weight: deliveries in the order of their first line."""
    lines = table(spark, sf_dir, "lineitem")
    # most pairs have one line, so nothing is summed before the shuffle: a scan would only hold its split's pairs
    dealt = lines.select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").cast("decimal(18,2)").alias("weight")).repartition(tasks_for(lines), "l_suppkey", "l_partkey")
    pairs = dealt.groupBy("l_suppkey", "l_partkey").agg(F.min("pos").alias("pos"), F.sum("weight").cast("double").alias("weight"))
    return pairs.select("pos", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), "weight")


RELATIONS_SQL = """
relations AS (
  SELECT min(l_orderkey * 16 + l_linenumber) AS pos, 's' || l_suppkey AS source, 'p' || l_partkey AS target,
         CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS weight
  FROM lineitem GROUP BY l_suppkey, l_partkey)"""


def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse graph with several components: every customer linked with its nation."""
    customers = table(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS source", "concat('n', c_nationkey) AS target", "c_custkey AS pos", "c_acctbal AS weight")
    return customers


REGION_EDGES_SQL = "edges AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, c_custkey AS pos, c_acctbal AS weight FROM customer)"


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, zone_id, stream_id, event_type, occurred_at, body: proposed events, not yet numbered."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % ZONES).alias("zone_id"), F.col("user_id").alias("stream_id"), "event_type", F.col("ts").alias("occurred_at"), F.col("props").alias("body"))


JOURNAL_SQL = "journal AS (SELECT event_id, user_id % 4 AS zone_id, user_id AS stream_id, event_type, ts AS occurred_at, props AS body FROM events)"
