"""The append-only journal: dense sequences, per-consumer positions, pending work, trigger policies, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import graph
from sparkloom.plans import domain
from sparkloom.plans.domain import JOURNAL_SQL


def sequenced(proposed: DataFrame) -> DataFrame:
    """Adds stream_sequence (dense from 1 in each zone and stream) and event_sequence (dense from 0 in each zone and type)."""
    order = ["occurred_at", "event_id"]
    typed = graph.numbered_within(proposed, ["zone_id", "event_type"], order).withColumnRenamed("place", "event_sequence")  # a type may hold most of a journal
    return typed.withColumn("stream_sequence", F.row_number().over(W.partitionBy("zone_id", "stream_id").orderBy(*order)).cast("long")).select(*proposed.columns, "stream_sequence", "event_sequence")


def append(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """Exactly once by event_id: outcome `skipped` (stored with the same body), `conflict` (with another) or `appended` with its sequences
    after those of the stream and the type."""
    old = stored.select("event_id", F.col("body").alias("stored_body"))
    marked = proposed.join(old, "event_id", "left")
    outcome = F.when(F.col("stored_body").isNull(), "appended").when(F.col("stored_body") == F.col("body"), "skipped").otherwise("conflict")
    marked = marked.withColumn("outcome", outcome)
    heads = stored.groupBy("zone_id", "stream_id").agg(F.max("stream_sequence").alias("stream_head"))
    types = stored.groupBy("zone_id", "event_type").agg(F.max("event_sequence").alias("type_head"))
    new = sequenced(marked.where("outcome = 'appended'")).join(heads, ["zone_id", "stream_id"], "left").join(types, ["zone_id", "event_type"], "left")
    new = new.withColumn("stream_sequence", F.col("stream_sequence") + F.coalesce("stream_head", F.lit(0))).withColumn("event_sequence", F.col("event_sequence") + F.coalesce("type_head", F.lit(-1)) + 1)
    kept = marked.where("outcome <> 'appended'").withColumn("stream_sequence", F.lit(0).cast("long")).withColumn("event_sequence", F.lit(0).cast("long"))
    columns = ["event_id", "outcome", "stream_sequence", "event_sequence"]
    return new.select(*columns).unionByName(kept.select(*columns))


def sequence_faults(journal: DataFrame) -> DataFrame:
    """Streams whose sequence isn't dense from 1."""
    return journal.groupBy("zone_id", "stream_id").agg(F.count("*").alias("n"), F.min("stream_sequence").alias("low"), F.max("stream_sequence").alias("high")).where("low <> 1 OR high <> n")


def atomic_batches(batches: DataFrame, completion: str) -> DataFrame:
    """Per batch (batch_id): whether it ends with its only completion event and stays on one stream."""
    return batches.groupBy("batch_id").agg(
        ((F.count_if(F.col("event_type") == completion) == 1) & (F.max_by("event_type", "stream_sequence") == completion) & (F.count_distinct("stream_id") == 1)).alias("valid")
    )


def pending(journal: DataFrame, positions: DataFrame) -> DataFrame:
    """Events at or after a consumer's position for their zone and type; without a position, all."""
    return journal.join(positions, ["zone_id", "event_type"], "left").where(F.col("event_sequence") >= F.coalesce("position", F.lit(0))).drop("position")


def pending_summary(journal: DataFrame, positions: DataFrame) -> DataFrame:
    """Per zone and type: pending events, head position, and the oldest pending time."""
    return pending(journal, positions).groupBy("zone_id", "event_type").agg(F.count("*").alias("pending"), F.max("event_sequence").alias("head"), F.min("occurred_at").alias("since"))


def next_zone(journal: DataFrame, positions: DataFrame) -> DataFrame:
    """The zone whose oldest pending event is oldest, ties to the smaller zone."""
    return pending(journal, positions).groupBy("zone_id").agg(F.min("occurred_at").alias("since")).orderBy("since", "zone_id").limit(1)


def triggered(summary: DataFrame, policies: DataFrame, now) -> DataFrame:
    """Whether a policy (event_type, mode, minimum, wait_seconds) fires: automatic with enough pending or waiting long enough; manual with any pending if asked."""
    age = F.timestamp_diff("SECOND", F.col("since"), now)
    fires = F.when(F.col("mode") == "automatic", (F.col("pending") >= F.col("minimum")) | (age >= F.col("wait_seconds"))).otherwise(F.col("asked") & (F.col("pending") > 0))
    return summary.join(policies, "event_type").select("zone_id", "event_type", "pending", fires.alias("fires"))


def changed_policies(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """A policy that differs gets the next revision; an equal one keeps its own."""
    old = stored.select("event_type", F.struct("mode", "minimum").alias("old"), "revision")
    return offered.join(old, "event_type").select("event_type", "mode", "minimum", (F.col("revision") + F.when(F.struct("mode", "minimum") == F.col("old"), 0).otherwise(1)).cast("long").alias("revision"))


def through(journal: DataFrame, exclusive: DataFrame) -> DataFrame:
    """Events before an exclusive position of their zone and type."""
    return journal.join(exclusive, ["zone_id", "event_type"]).where("event_sequence < exclusive")


def stream_page(journal: DataFrame, stream_id: int, after: int, most: int) -> DataFrame:
    return journal.where((F.col("stream_id") == stream_id) & (F.col("stream_sequence") > after)).orderBy("stream_sequence").limit(most)


def boundary_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of events of two types that carry the same boundary (zone and body), whichever came first."""
    return left.select("zone_id", "body", F.col("event_id").alias("left_event")).join(right.select("zone_id", "body", F.col("event_id").alias("right_event")), ["zone_id", "body"])


def causal_chains(journal: DataFrame, first: str, then: str) -> DataFrame:
    """Events of type `first` whose next event in the stream is of type `then`: a consumer follows these at once."""
    by = W.partitionBy("zone_id", "stream_id").orderBy("stream_sequence")
    return journal.withColumn("next_type", F.lead("event_type").over(by)).withColumn("next_event", F.lead("event_id").over(by)).where((F.col("event_type") == first) & (F.col("next_type") == then)).select("event_id", "next_event")


def advance(positions: DataFrame, handled: DataFrame) -> DataFrame:
    """Compare and set: a position moves only if `expected` is where it stands."""
    return positions.join(handled, ["zone_id", "event_type"]).select("zone_id", "event_type", F.when(F.col("position") == F.col("expected"), F.col("to")).otherwise(F.col("position")).alias("position"), (F.col("position") == F.col("expected")).alias("moved"))


def _journal(spark, sf_dir):
    return sequenced(domain.journal(spark, sf_dir))


def _positions(journal: DataFrame) -> DataFrame:
    """A consumer that has handled three quarters of each type but clicks."""
    return journal.where("event_type <> 'click'").groupBy("zone_id", "event_type").agg(F.floor(F.count("*") * 3 / 4).cast("long").alias("position"))


_POLICIES = [("view", "automatic", 100, 3600, False), ("error", "automatic", 1_000_000, 86_400, False), ("click", "manual", 1, 0, True), ("purchase", "manual", 1, 0, False), ("signup", "automatic", 1_000_000, 10**9, False)]


def _policies(spark) -> DataFrame:
    return spark.createDataFrame(_POLICIES, "event_type string, mode string, minimum long, wait_seconds long, asked boolean")


def journal_sequences(spark, sf_dir):
    return _journal(spark, sf_dir).select("event_id", "stream_sequence", "event_sequence")


def journal_append(spark, sf_dir):
    rows = domain.journal(spark, sf_dir)
    stored = sequenced(rows.where("event_id % 4 <> 0"))
    return append(stored, rows.withColumn("body", F.when(F.col("event_id") % 7 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body"))))


def journal_sequence_faults(spark, sf_dir):
    return sequence_faults(_journal(spark, sf_dir).where("event_id % 97 <> 0")).select("zone_id", "stream_id", "n", "high")


def journal_atomic_batches(spark, sf_dir):
    journal = _journal(spark, sf_dir)
    return atomic_batches(journal.withColumn("batch_id", F.concat_ws("-", F.col("stream_id").cast("string"), F.floor((F.col("stream_sequence") - 1) / 3).cast("string"))), "purchase")


def journal_pending(spark, sf_dir):
    journal = _journal(spark, sf_dir)
    return pending_summary(journal, _positions(journal))


def journal_pending_zone(spark, sf_dir):
    journal = _journal(spark, sf_dir)
    return next_zone(journal, _positions(journal))


def journal_policy_trigger(spark, sf_dir):
    journal = _journal(spark, sf_dir)
    return triggered(pending_summary(journal, _positions(journal)), _policies(spark), F.expr("TIMESTAMP_NTZ'2024-01-31 00:00:00'"))


def journal_policy_change(spark, sf_dir):
    stored = _policies(spark).withColumn("revision", F.lit(3).cast("long"))
    return changed_policies(stored, _policies(spark).withColumn("minimum", F.when(F.col("mode") == "manual", 2).otherwise(F.col("minimum")).cast("long")).select("event_type", "mode", "minimum"))


def journal_through(spark, sf_dir):
    journal = _journal(spark, sf_dir)
    return through(journal, _positions(journal).withColumnRenamed("position", "exclusive")).groupBy("zone_id", "event_type").agg(F.count("*").alias("events"))


def journal_stream_page(spark, sf_dir):
    return stream_page(_journal(spark, sf_dir), 8, 10, 20).select("event_id", "stream_sequence", "event_type")


def journal_boundary_match(spark, sf_dir):
    journal = _journal(spark, sf_dir).withColumn("body", F.concat_ws(":", "stream_id", "body"))
    return boundary_matches(journal.where("event_type = 'signup'"), journal.where("event_type = 'purchase'"))


def journal_causal_chains(spark, sf_dir):
    return causal_chains(_journal(spark, sf_dir), "view", "purchase")


def journal_position_advance(spark, sf_dir):
    positions = _positions(_journal(spark, sf_dir))
    handled = positions.select("zone_id", "event_type", (F.col("position") - F.when(F.col("zone_id") == 2, 1).otherwise(0)).alias("expected"), (F.col("position") + 5).alias("to"))
    return advance(positions, handled)


def journal_event_ids(spark, sf_dir):
    return _journal(spark, sf_dir).select("event_id", T.deterministic_id(F.col("event_id").cast("string"), F.col("event_type")).alias("derived_id"))


QUERIES = {
    f.__name__: f
    for f in (
        journal_sequences, journal_append, journal_sequence_faults, journal_atomic_batches, journal_pending, journal_pending_zone, journal_policy_trigger,
        journal_policy_change, journal_through, journal_stream_page, journal_boundary_match, journal_causal_chains, journal_position_advance, journal_event_ids,
    )
}

_SEQ = "row_number() OVER (PARTITION BY zone_id, stream_id ORDER BY occurred_at, event_id) AS stream_sequence, row_number() OVER (PARTITION BY zone_id, event_type ORDER BY occurred_at, event_id) - 1 AS event_sequence"
_J = f"{JOURNAL_SQL}, j AS (SELECT *, {_SEQ} FROM journal), p AS (SELECT zone_id, event_type, CAST(floor(count(*) * 3 / 4) AS BIGINT) AS position FROM j WHERE event_type <> 'click' GROUP BY ALL), todo AS (SELECT j.* FROM j LEFT JOIN p ON j.zone_id = p.zone_id AND j.event_type = p.event_type WHERE event_sequence >= coalesce(position, 0)), s AS (SELECT zone_id, event_type, count(*) AS pending, max(event_sequence) AS head, min(occurred_at) AS since FROM todo GROUP BY ALL)"
_POLICY_SQL = "pol(event_type, mode, minimum, wait_seconds, asked) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::BIGINT, {d}::BIGINT, {e})" for a, b, c, d, e in _POLICIES) + ")"

ORACLE_SQL = {
    "journal_sequences": f"WITH {_J} SELECT event_id, stream_sequence, event_sequence FROM j",
    "journal_append": f"""WITH {JOURNAL_SQL}, st AS (SELECT *, {_SEQ} FROM journal WHERE event_id % 4 <> 0), nw AS (SELECT *, {_SEQ} FROM journal WHERE event_id % 4 = 0)
SELECT event_id, 'appended' AS outcome, stream_sequence + coalesce((SELECT max(stream_sequence) FROM st WHERE st.zone_id = nw.zone_id AND st.stream_id = nw.stream_id), 0) AS stream_sequence,
  event_sequence + coalesce((SELECT max(event_sequence) FROM st WHERE st.zone_id = nw.zone_id AND st.event_type = nw.event_type), -1) + 1 AS event_sequence FROM nw
UNION ALL SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'conflict' ELSE 'skipped' END, 0, 0 FROM st""",
    "journal_sequence_faults": f"WITH {_J} SELECT zone_id, stream_id, count(*) AS n, max(stream_sequence) AS high FROM j WHERE event_id % 97 <> 0 GROUP BY ALL HAVING min(stream_sequence) <> 1 OR max(stream_sequence) <> count(*)",
    "journal_atomic_batches": f"WITH {_J} SELECT stream_id || '-' || CAST((stream_sequence - 1) // 3 AS BIGINT) AS batch_id, count(*) FILTER (event_type = 'purchase') = 1 AND max_by(event_type, stream_sequence) = 'purchase' AND count(DISTINCT stream_id) = 1 AS valid FROM j GROUP BY 1",
    "journal_pending": f"WITH {_J} SELECT * FROM s",
    "journal_pending_zone": f"WITH {_J} SELECT zone_id, min(occurred_at) AS since FROM todo GROUP BY zone_id ORDER BY since, zone_id LIMIT 1",
    "journal_policy_trigger": f"WITH {_J}, {_POLICY_SQL} SELECT zone_id, event_type, pending, CASE WHEN mode = 'automatic' THEN pending >= minimum OR (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(since)) // 1000000 >= wait_seconds ELSE asked AND pending > 0 END AS fires FROM s JOIN pol USING (event_type)",
    "journal_policy_change": f"WITH {_POLICY_SQL} SELECT event_type, mode, CASE WHEN mode = 'manual' THEN 2 ELSE minimum END AS minimum, CAST(CASE WHEN mode = 'manual' THEN 4 ELSE 3 END AS BIGINT) AS revision FROM pol",
    "journal_through": f"WITH {_J} SELECT zone_id, event_type, position AS events FROM p",
    "journal_stream_page": f"WITH {_J} SELECT event_id, stream_sequence, event_type FROM j WHERE stream_id = 8 AND stream_sequence > 10 ORDER BY stream_sequence LIMIT 20",
    "journal_boundary_match": f"WITH {_J} SELECT a.zone_id, a.stream_id || ':' || a.body AS body, a.event_id AS left_event, b.event_id AS right_event FROM j a JOIN j b ON a.zone_id = b.zone_id AND a.stream_id = b.stream_id AND a.body = b.body WHERE a.event_type = 'signup' AND b.event_type = 'purchase'",
    "journal_causal_chains": f"WITH {_J}, n AS (SELECT event_id, event_type, lead(event_type) OVER w AS next_type, lead(event_id) OVER w AS next_event FROM j WINDOW w AS (PARTITION BY zone_id, stream_id ORDER BY stream_sequence)) SELECT event_id, next_event FROM n WHERE event_type = 'view' AND next_type = 'purchase'",
    "journal_position_advance": f"WITH {_J} SELECT zone_id, event_type, CASE WHEN zone_id = 2 THEN position ELSE position + 5 END AS position, zone_id <> 2 AS moved FROM p",
    "journal_event_ids": "SELECT event_id, sha256(event_id || chr(0) || event_type) AS derived_id FROM events",
}
