"""Map step of the global search: points that cite the reports of their batch, with the outcome of every batch.

A batch ends as `succeeded`, `model failure` or `invalid response`. An answer that can't be read, or one of whose points isn't sound, is
corrected once, with the rejected answer and the reason; if it still isn't, the whole batch is rejected. A batch that doesn't succeed gives one
point of score 0 and ends nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import citation, context, extraction, search
from sparkloom.session import checkpointed, table

Model = Callable[[str], str]


def _faults(outputs: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points (key, point, description, score, reports) of outputs (key, output), and the first fault (key, reason) of those that aren't sound as a whole.

    scope: (key, report). A point above 0 needs a description and a citation; only reports of the batch may be cited, by citations that are well formed.
    """
    points = checkpointed(extraction.parse_points(outputs))
    blank = "error = 'description' AND score = 0"  # a point that says nothing needs no words
    numbered = points.where(f"error = '' OR {blank}").select("key", "point", "description", "score")
    keys = numbered.select((F.col("key") * 100_000 + F.col("point")).alias("key"), F.coalesce("description", F.lit("")).alias("answer"))  # a batch has fewer points
    cited = checkpointed(citation.parsed(keys).select(F.floor(F.col("key") / 100_000).cast("long").alias("key"), (F.col("key") % 100_000).alias("point"), "dataset", "record_id", "error"))
    outside = cited.where("error IS NULL AND dataset = 'Reports'").join(scope.withColumnRenamed("report", "record_id"), ["key", "record_id"], "left_anti")
    good = cited.where("error IS NULL AND dataset = 'Reports'").groupBy("key", "point").agg(F.array_sort(F.collect_set("record_id")).alias("reports"))  # of one description
    found = numbered.join(good, ["key", "point"], "left").select("key", "point", "description", "score", F.coalesce("reports", F.array().cast("array<long>")).alias("reports"))
    faults = points.where(f"error <> '' AND NOT ({blank})").select("key", "point", F.lit(0).alias("rank"), F.col("error").alias("reason"))
    faults = faults.unionByName(cited.where("error IS NOT NULL").select("key", "point", F.lit(1).alias("rank"), F.col("error").alias("reason")))
    faults = faults.unionByName(cited.where("error IS NULL AND dataset <> 'Reports'").select("key", "point", F.lit(2).alias("rank"), F.lit("cites other than reports").alias("reason")))
    faults = faults.unionByName(outside.select("key", "point", F.lit(3).alias("rank"), F.lit("cites a report outside the batch").alias("reason")))
    faults = faults.unionByName(found.where("score > 0 AND size(reports) = 0").select("key", "point", F.lit(4).alias("rank"), F.lit("cites no report").alias("reason")))
    return found, faults.groupBy("key").agg(F.min_by("reason", F.struct("point", "rank")).alias("reason"))


def map_points(batches: DataFrame, scope: DataFrame, model: Model, corrector: search.Corrector | None = None) -> DataFrame:
    """(batch, status, reason, calls, point, description, score, reports) of batches (batch, prompt), whose reports are scope (batch, report).

    A batch that succeeds has a row for each of its points, any other one row of score 0 with the reason.
    """
    scope = scope.withColumnRenamed("batch", "key")
    prompts = batches.select(F.col("batch").alias("key"), "prompt")
    first = checkpointed(search.ask_outcomes(prompts, model).withColumnRenamed("answer", "output"))
    points, faults = _faults(first.where("outcome = 'succeeded'").select("key", "output"), scope)
    faults = checkpointed(faults)
    state = first.join(faults.withColumnRenamed("reason", "fault"), "key", "left").select("key", "output", F.when(F.col("outcome") != "succeeded", F.col("outcome")).when(F.col("fault").isNull(), F.lit("succeeded")).otherwise(F.lit("invalid response")).alias("status"), F.coalesce("reason", "fault").alias("reason"), "calls")
    if corrector is not None and not faults.isEmpty():
        asked = state.where("status = 'invalid response'").join(prompts, "key")
        told = asked.select("key", F.to_json(F.struct("prompt", "output", F.col("reason").alias("error"))).alias("prompt"))
        second = checkpointed(search.ask_outcomes(told, search.Corrected(corrector)).withColumnRenamed("answer", "output"))
        more, still = _faults(second.where("outcome = 'succeeded'").select("key", "output"), scope)
        new = second.join(still.withColumnRenamed("reason", "fault"), "key", "left").select("key", F.when(F.col("outcome") != "succeeded", F.col("outcome")).when(F.col("fault").isNull(), F.lit("succeeded")).otherwise(F.lit("invalid response")).alias("new_status"), F.coalesce("reason", "fault").alias("new_reason"))
        points = points.join(second.select("key"), "key", "left_anti").unionByName(more)
        again = F.col("new_status").isNotNull()
        state = state.join(new, "key", "left").select("key", F.coalesce("new_status", "status").alias("status"), F.when(again, F.col("new_reason")).otherwise(F.col("reason")).alias("reason"), (F.col("calls") + again.cast("int")).alias("calls"))
    state = checkpointed(state.select("key", "status", "reason", "calls"))
    sound = state.where("status = 'succeeded'").join(points, "key")
    failed = state.where("status <> 'succeeded'").select("key", "status", "reason", "calls", F.lit(0).cast("long").alias("point"), F.lit(None).cast("string").alias("description"), F.lit(0).alias("score"), F.array().cast("array<long>").alias("reports"))
    return sound.unionByName(failed).withColumnRenamed("key", "batch")


# --- over the driver tables -------------------------------------------------------------------------


def _stub(prompt: str) -> str:
    """An offline model: a point for the rows of a batch, by the first report's number now and then wrong."""
    rows = [int(x.split(" ")[0]) for x in prompt.split("\n")[1:]]
    kind = rows[0] % 6
    if kind == 0:
        raise RuntimeError("no answer")
    if kind == 1:
        return "no json"
    cites = ", ".join(map(str, sorted(rows)[:3]))
    wrong = {2: "[Data: Reports (999999999)]", 3: "[Data: Sources (1)]"}.get(kind, f"[Data: Reports ({cites})]")
    return json.dumps({"points": [{"description": f"{len(rows)} rows {wrong}", "score": str(rows[0] % 101)}, {"description": "", "score": "0"}]})


def _mend(prompt: str, rejected: str, reason: str) -> str:
    rows = [int(x.split(" ")[0]) for x in prompt.split("\n")[1:]]
    if rows[0] % 6 == 3:
        return "no json"
    return json.dumps({"points": [{"description": f"{reason} [Data: Reports ({rows[0]})]", "score": "7"}]})


def global_map_outcomes(spark, sf_dir):
    """Parts as reports in batches of 40 tokens, under a model that fails, gives no JSON, or cites what it mustn't."""
    reports = table(spark, sf_dir, "part").select(F.lit(0).alias("question"), F.col("p_partkey").alias("report"), F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("text"))
    sized = reports.withColumn("tokens", F.size(F.split("text", " ")).cast("long"))
    batches = checkpointed(reports.join(context.packed(sized, "question", "report", 40).select("report", "batch"), "report"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("report", "text"))), lambda x: x["text"])  # within the budget
    prompts = batches.groupBy("batch").agg(F.concat(F.lit("What is made?\n"), F.array_join(lines, "\n")).alias("prompt"))
    found = map_points(prompts, batches.select("batch", "report"), _stub, _mend)
    return found.withColumns({"reports": F.array_join(F.transform("reports", lambda x: x.cast("string")), ","), "description": F.coalesce("description", F.lit("")), "score": F.col("score").cast("long")})


QUERIES = {"global_map_outcomes": global_map_outcomes}

ORACLE_SQL = {
    "global_map_outcomes": f"""WITH RECURSIVE {context.packed_sql("pk", "SELECT 0 AS question, p_partkey AS report, len(string_split(p_name, ' ')) + 1 AS tokens FROM part", "question", "report", 0, 40).strip()},
b AS (SELECT batch, min(report) AS first_, count(*) AS n, list(report ORDER BY report) AS all_ FROM pk GROUP BY batch),
k AS (SELECT *, first_ % 6 AS kind, array_to_string(list_transform(all_[1 : 3], lambda x: CAST(x AS VARCHAR)), ', ') AS cites FROM b)
SELECT batch, 'succeeded' AS status, NULL AS reason, CAST(1 AS INT) AS calls, CAST(0 AS BIGINT) AS point, n || ' rows [Data: Reports (' || cites || ')]' AS description, CAST(first_ % 101 AS BIGINT) AS score, replace(cites, ' ', '') AS reports FROM k WHERE kind > 3
UNION ALL SELECT batch, 'succeeded', NULL, 1, 1, '', 0, '' FROM k WHERE kind > 3
UNION ALL SELECT batch, 'model failure', 'RuntimeError: no answer', 1, 0, '', 0, '' FROM k WHERE kind = 0
UNION ALL SELECT batch, 'invalid response', 'no points', 2, 0, '', 0, '' FROM k WHERE kind = 3
UNION ALL SELECT batch, 'succeeded', NULL, 2, 0, CASE kind WHEN 1 THEN 'no points' ELSE 'cites a report outside the batch' END || ' [Data: Reports (' || first_ || ')]', 7, CAST(first_ AS VARCHAR) FROM k WHERE kind IN (1, 2)""",
}
