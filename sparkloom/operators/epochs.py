"""Epochs: immutable published snapshots and the pointer to the current one; readiness of what they consist of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import knowledge, publication
from sparkloom.plans import domain
from sparkloom.plans.domain import VERSIONS_SQL
from sparkloom.session import checkpointed, table


def publish(snapshot: DataFrame, folder: str, number: int, expected: int) -> int:
    """Writes a snapshot as epoch `number` and moves the pointer, if the current epoch is `expected` (0: none).

    The data are written first; readers see them only when the pointer has moved, which one writer alone can do from where it stands. The data
    of one that comes too late are deleted. An equal epoch isn't overwritten.
    """
    spark = snapshot.sparkSession
    now = current(spark, folder)
    if now != expected:
        raise publication.Conflict(f"epoch {now} is current, not {expected}")
    snapshot.withColumn("epoch_id", F.lit(number).cast("long")).write.mode("errorifexists").parquet(f"{folder}/epoch={number}")
    if not publication.create_once(spark, f"{folder}/pointer/{expected}", {"next": number}):
        publication.discard(spark, f"{folder}/epoch={number}")
        raise publication.Conflict(f"epoch {current(spark, folder)} is current, not {expected}")
    return number


def current(spark, folder: str) -> int:
    """The current epoch's number, 0 if none is published: the end of the pointer's moves, each a file named by where it starts."""
    number = 0
    while (step := publication.read_once(spark, f"{folder}/pointer/{number}")) is not None:
        number = step["next"]
    return number


def read_epoch(spark, folder: str, number: int | None = None) -> DataFrame:
    """The rows of an epoch, by default the current one: time travel by number."""
    return spark.read.parquet(f"{folder}/epoch={current(spark, folder) if number is None else number}")


def readiness(required: DataFrame, entity_vectors: DataFrame, report_vectors: DataFrame) -> DataFrame:
    """One row: members (kind, id) without a vector of their kind, and whether the epoch may be published."""
    have = entity_vectors.select(F.lit("entity").alias("kind"), "id").unionByName(report_vectors.select(F.lit("report").alias("kind"), "id"))
    lost = required.join(have, ["kind", "id"], "left_anti")
    return lost.agg(F.count_if(F.col("kind") == "entity").alias("entities"), F.count_if(F.col("kind") == "report").alias("reports")).withColumn("ready", F.col("entities") + F.col("reports") == 0)


def rebuild_decision(changes: DataFrame, threshold: int = 5) -> DataFrame:
    """Per zone whether enough relations have changed to rebuild its communities."""
    return changes.groupBy("zone_id").agg(F.count("*").alias("changes")).withColumn("rebuild", F.col("changes") >= threshold)


def epoch_readiness(spark, sf_dir):
    refs = knowledge.active(domain.versions(spark, sf_dir)).select("id")
    reports = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    required = refs.select(F.lit("entity").alias("kind"), "id").unionByName(reports.select(F.lit("report").alias("kind"), "id"))
    return readiness(required, refs.where("substring(id, 2) % 9 <> 0"), reports)


def epoch_rebuild(spark, sf_dir):
    return rebuild_decision(domain.versions(spark, sf_dir).where("frequency > 150"), 25)


def epoch_snapshot(spark, sf_dir):
    """Two epochs published one after the other: the first one can still be read."""
    refs = knowledge.active(domain.versions(spark, sf_dir)).select("zone_id", "id", "version")
    checkpointed(spark.range(1))  # names the shared folder
    import uuid

    folder = f"{spark.sparkContext.getCheckpointDir()}/epochs-{uuid.uuid4().hex}"
    publish(refs.where("zone_id < 2"), folder, 1, 0)
    publish(refs, folder, 2, 1)
    return read_epoch(spark, folder, 1).unionByName(read_epoch(spark, folder))


QUERIES = {f.__name__: f for f in (epoch_readiness, epoch_rebuild, epoch_snapshot)}

_ACTIVE = f"{VERSIONS_SQL}, latest AS (SELECT * FROM versions WHERE candidate_number = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1), act AS (SELECT * FROM latest WHERE NOT deleted)"

ORACLE_SQL = {
    "epoch_readiness": f"WITH {_ACTIVE} SELECT count(*) AS entities, CAST(0 AS BIGINT) AS reports, count(*) = 0 AS ready FROM act WHERE substr(id, 2)::INT % 9 = 0",
    "epoch_rebuild": f"WITH {VERSIONS_SQL} SELECT zone_id, count(*) AS changes, count(*) >= 25 AS rebuild FROM versions WHERE frequency > 150 GROUP BY zone_id",
    "epoch_snapshot": f"WITH {_ACTIVE} SELECT zone_id, id, version, 1::BIGINT AS epoch_id FROM act WHERE zone_id < 2 UNION ALL SELECT zone_id, id, version, 2 FROM act",
}
