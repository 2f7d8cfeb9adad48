"""Observations of recall, normalised and held to their rules in built-in expressions; what isn't sound says why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import table

# fixed values: what an observation may say
COVERAGES = ["complete", "partial", "unknown"]
REASONS = ["no_recall", "target_mismatch", "insufficient_evidence", "answer_exposed", "exposure_unknown", "difficulty_unknown", "interrupted", "evaluation_failed"]

EVIDENCE = "array<struct<ref: string, speaker: string, kind: string, source: string, role: string, text: string, completed_at: timestamp, recalls: boolean, coverage: string, context: array<string>>>"


def _missing(text: Column) -> Column:
    """Null, blank, or with a NUL in it."""
    return text.isNull() | F.regexp_like(text, F.lit(r"(?U)^\s*$")) | F.contains(text, F.lit("\0"))


def _repeats(values: Column) -> Column:
    return F.size(F.array_distinct(values)) < F.size(values)


def normalised(observations: DataFrame) -> DataFrame:
    """Reference sets sorted and without repeats: the assessment's refs, and each recall's context. Order and texts of the evidence stay."""
    context = lambda x: F.when(x["recalls"], F.array_sort(F.array_distinct(F.coalesce(x["context"], F.array().cast("array<string>")))))
    evidence = F.transform("evidence", lambda x: x.withField("context", context(x)))
    return observations.withColumns({"evidence": evidence, "refs": F.array_sort(F.array_distinct(F.coalesce("refs", F.array().cast("array<string>"))))})


def fault(evidence: str = "evidence") -> Column:
    """The first rule that an observation of normalised() breaks, or null.

    Its columns: id, actor, evaluator, protocol, subject, version, occurred_at, evidence (see EVIDENCE; kind is `message` or `inline`), status, grade, reason_code,
    rationale, refs.
    """
    items = F.coalesce(F.col(evidence), F.array().cast(EVIDENCE))
    refs = F.transform(items, lambda x: x["ref"])
    recalls = F.filter(items, lambda x: F.coalesce(x["recalls"], F.lit(False)))
    last = F.element_at(F.transform(recalls, lambda x: x["completed_at"]), -1)
    any_recall = F.size(recalls) > 0
    sourceless = lambda x: (~F.coalesce(x["kind"].isin("message", "inline"), F.lit(False))) | _missing(x["source"]) | ((x["kind"] == "inline") & (_missing(x["role"]) | _missing(x["text"])))
    backwards = F.exists(F.transform(recalls, lambda x, i: (i > 0) & (x["completed_at"] < F.get(recalls, i - 1)["completed_at"])), lambda x: F.coalesce(x, F.lit(False)))
    # a recall's context lies before it, and was complete before it was
    place = lambda ref: F.array_position(refs, ref)
    of_recalls = lambda wrong: F.exists(F.transform(items, lambda x, i: F.coalesce(x["recalls"], F.lit(False)) & F.exists(F.coalesce(x["context"], F.array().cast("array<string>")), lambda ref: wrong(x, i, ref))), lambda x: x)
    unseen = of_recalls(lambda x, i, ref: (place(ref) == 0) | (place(ref) > i))
    later = of_recalls(lambda x, i, ref: F.coalesce(F.get(items, (place(ref) - 1).cast("int"))["completed_at"] > x["completed_at"], F.lit(False)))
    graded, unscorable = F.col("status") == "graded", F.col("status") == "unscorable"
    rules = [
        (_missing(F.col("id")) | _missing(F.col("actor")) | _missing(F.col("evaluator")) | _missing(F.col("protocol")) | _missing(F.col("subject")), "identity or protocol"),
        (F.coalesce(F.col("version") <= 0, F.lit(True)) | F.col("occurred_at").isNull(), "version or time"),
        (F.size(items) == 0, "no evidence"),
        (F.exists(items, lambda x: _missing(x["ref"]) | _missing(x["speaker"])), "reference or speaker"),
        (_repeats(refs), "repeated reference"),
        (F.exists(items, sourceless), "source"),
        (_repeats(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["source"]))), "repeated source"),
        (F.exists(recalls, lambda x: (x["speaker"] != F.col("actor")) | x["completed_at"].isNull()), "recall of another or without time"),
        (backwards, "recalls out of order"),
        (F.exists(recalls, lambda x: ~F.coalesce(x["coverage"].isin(COVERAGES), F.lit(False))), "coverage"),
        (unseen, "context not before the recall"),
        (later, "context completed after the recall"),
        (_missing(F.col("rationale")), "rationale"),
        (F.size("refs") == 0, "no references"),
        (F.size(F.array_except(F.col("refs"), refs)) > 0, "unknown reference"),
        (~F.coalesce(graded | unscorable, F.lit(False)), "status"),
        (graded & (F.col("grade").isNull() | (F.coalesce("reason_code", F.lit("")) != "")), "graded with a reason or without a grade"),
        (graded & ~F.col("grade").between(1, 4), "grade"),
        (graded & (~any_recall | F.exists(recalls, lambda x: x["coverage"] != "complete")), "graded without complete recall"),
        (unscorable & (F.col("grade").isNotNull() | ~F.coalesce(F.col("reason_code").isin(REASONS), F.lit(False))), "unscorable with a grade or without a reason"),
        (any_recall & (F.col("occurred_at") != last), "time is not that of the last recall"),
    ]
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for broken, name in rules])


def checked(observations: DataFrame) -> DataFrame:
    """Normalised observations with `fault`, the first rule that they break, or null."""
    return normalised(observations).withColumn("fault", fault())


# --- over the driver tables -------------------------------------------------------------------------


def observation_faults(spark, sf_dir):
    """Conversations as observations, each of their users' turns a recall, of which some break a rule by their numbers; how many break which."""
    turns = table(spark, sf_dir, "conversations").withColumn("at", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, turn)"))
    user, kind = F.col("role") == "user", F.col("conv_id") % 10
    before = F.when((F.col("turn") > 0) & (kind == 3), F.array(F.lit("t99"))).when(F.col("turn") > 0, F.array(F.concat(F.lit("t"), (F.col("turn") - 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    item = F.struct(
        F.col("turn").alias("n"), F.when(kind == 1, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("ref"), F.when(user, F.lit("actor")).otherwise(F.lit("host")).alias("speaker"),
        F.lit("message").alias("kind"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("source"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.col("at").alias("completed_at"),
        user.alias("recalls"), F.when(kind == 4, F.lit("partial")).otherwise(F.lit("complete")).alias("coverage"), before.alias("context"),
    )
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max(F.when(user, F.col("at"))).alias("last"), F.min(F.col("turn")).alias("first"))  # a conversation's turns
    evidence = F.transform("items", lambda x: x.dropFields("n")).cast(EVIDENCE)
    kind = F.col("conv_id") % 10
    rows = rows.select(
        F.concat(F.lit("o"), F.col("conv_id").cast("string")).alias("id"), F.lit("actor").alias("actor"), F.when(kind == 0, F.lit(" ")).otherwise(F.lit("judge")).alias("evaluator"), F.lit("p1").alias("protocol"), F.lit("e1").alias("subject"),
        F.lit(1).cast("long").alias("version"), F.when(kind == 2, F.expr("timestamp '2030-01-01 00:00:00'")).otherwise(F.col("last")).alias("occurred_at"), evidence.alias("evidence"), F.lit("graded").alias("status"),
        F.when(kind == 5, F.lit(5)).otherwise(F.lit(3)).alias("grade"), F.when(kind == 6, F.lit("no_recall")).otherwise(F.lit("")).alias("reason_code"), F.when(kind == 7, F.lit("")).otherwise(F.lit("because")).alias("rationale"),
        F.when(kind == 8, F.array(F.lit("zz"))).otherwise(F.array(F.concat(F.lit("t"), F.col("first").cast("string")))).alias("refs"),
    )
    return checked(rows).select("id", F.coalesce("fault", F.lit("")).alias("fault"))


QUERIES = {"observation_faults": observation_faults}

ORACLE_SQL = {
    "observation_faults": """WITH c AS (SELECT conv_id, conv_id % 10 AS k, count(*) AS n, count(*) FILTER (role = 'user') AS users, max(turn) FILTER (role = 'user') AS last_user, min(turn) AS first_ FROM conversations GROUP BY conv_id)
SELECT 'o' || conv_id AS id, CASE
  WHEN k = 0 THEN 'identity or protocol' WHEN k <> 2 AND users = 0 THEN 'version or time' WHEN k = 1 AND n > 1 THEN 'repeated reference'
  WHEN k = 3 AND last_user > 0 THEN 'context not before the recall' WHEN k = 1 AND last_user > 0 THEN 'context not before the recall' WHEN k = 7 THEN 'rationale' WHEN k IN (1, 8) THEN 'unknown reference'
  WHEN k = 6 THEN 'graded with a reason or without a grade' WHEN k = 5 THEN 'grade' WHEN users = 0 THEN 'graded without complete recall' WHEN k = 4 THEN 'graded without complete recall'
  WHEN k = 2 THEN 'time is not that of the last recall' ELSE '' END AS fault FROM c""",
}
