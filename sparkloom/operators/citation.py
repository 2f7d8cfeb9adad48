"""Citations in answers, [Data: Dataset (1, 2, +more); ...]: parsing, audit against the context, rewriting."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import table

DATASETS = ["Reports", "Entities", "Relationships", "Claims", "Sources"]
MOST_IDS = 5
_BLOCK = r"\[Data:([^\]]*)\]"
_GROUP = r"([A-Za-z]+)\s*\(([^()]*)\)"
_WHOLE_GROUP = re.compile(r"\s*([A-Za-z][A-Za-z ]*?)\s*\(([^()]*)\)\s*")


def references(answers: DataFrame) -> DataFrame:
    """(key, block, dataset, record_id) of well-formed citations, in built-in functions alone."""
    blocks = answers.select("key", F.posexplode(F.regexp_extract_all("answer", F.lit(_BLOCK), 1)).alias("block", "content"))
    groups = blocks.select("key", "block", F.explode(F.regexp_extract_all("content", F.lit(r"[A-Za-z]+\s*\([^()]*\)"), 0)).alias("group"))
    split = groups.select("key", "block", F.regexp_extract("group", _GROUP, 1).alias("dataset"), F.split(F.regexp_extract("group", _GROUP, 2), r"\s*,\s*").alias("ids"))
    ids = split.where(F.col("dataset").isin(DATASETS) & (F.size(F.filter("ids", lambda x: x != "+more")) <= MOST_IDS))
    one = ids.select("key", F.col("block").cast("long").alias("block"), "dataset", F.explode("ids").alias("id"))
    return one.where(F.regexp_like("id", F.lit("^[0-9]{1,18}$"))).select("key", "block", "dataset", F.col("id").cast("long").alias("record_id"))


def parse(text: str) -> list[tuple[int, str | None, int | None, str | None]]:
    """(block, dataset, record_id, error) of every citation; errors: malformed, unknown_dataset, invalid_record, too_many_records."""
    found: list[tuple[int, str | None, int | None, str | None]] = []
    start, block = text.find("[Data:"), 0
    while start >= 0:
        end = text.find("]", start)
        if end < 0:
            return [*found, (block, None, None, "malformed")]
        content = text[start + 6 : end]
        whole = re.split(r"[;,](?![^()]*\))", content)
        groups = [_WHOLE_GROUP.fullmatch(x) for x in whole]
        if not all(groups):
            found.append((block, None, None, "malformed"))
        else:
            for m in groups:
                ids = [x.strip() for x in m[2].split(",")]
                if ids and ids[-1] == "+more":
                    ids.pop()
                if m[1] not in DATASETS:
                    found.append((block, m[1], None, "unknown_dataset"))
                elif not ids or not all(re.fullmatch("0|[1-9][0-9]*", x) for x in ids):
                    found.append((block, m[1], None, "invalid_record"))
                elif len(ids) > MOST_IDS:
                    found.append((block, m[1], None, "too_many_records"))
                else:
                    found += [(block, m[1], int(x), None) for x in ids]
        start, block = text.find("[Data:", end), block + 1
    return found


def parsed(answers: DataFrame) -> DataFrame:
    """(key, block, dataset, record_id, error): every citation, malformed ones included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *found) for key, answer in zip(batch["key"], batch["answer"], strict=True) for found in parse(answer or "")]
            frame = pd.DataFrame(rows, columns=["key", "block", "dataset", "record_id", "error"])
            yield frame.astype({"record_id": "Int64"})

    return answers.select("key", "answer").mapInPandas(run, "key long, block long, dataset string, record_id long, error string")


def audit(found: DataFrame, scope: DataFrame, sources: DataFrame) -> DataFrame:
    """Status of each reference: outside_context (not in scope), unresolved (its units have no source) or valid.

    scope: key, dataset, record_id, unit_id, one row per unit of a record; sources: unit_id.
    """
    units = scope.join(sources.select("unit_id").distinct().withColumn("resolved", F.lit(1)), "unit_id", "left")
    records = units.groupBy("key", "dataset", "record_id").agg(F.count("resolved").alias("units"))
    status = F.when(F.col("units").isNull(), "outside_context").when(F.col("units") == 0, "unresolved").otherwise("valid")
    return found.join(records, ["key", "dataset", "record_id"], "left").withColumn("status", status).drop("units")


def rewrite(found: DataFrame, mapping: DataFrame) -> DataFrame:
    """References with local record ids replaced by global ones (dataset, record_id, global_id), unmapped ones dropped, regrouped by MOST_IDS."""
    ids = found.join(mapping, ["dataset", "record_id"]).groupBy("key", "block", "dataset").agg(F.array_sort(F.collect_set("global_id")).alias("ids"))
    starts = F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / MOST_IDS).cast("int"))
    texts = ids.withColumn("groups", F.transform(starts, lambda i: F.concat(F.col("dataset"), F.lit(" ("), F.array_join(F.transform(F.slice("ids", i * MOST_IDS + 1, MOST_IDS), lambda x: x.cast("string")), ", "), F.lit(")"))))
    joined = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("dataset", "groups"))), lambda x: x["groups"])), "; ")
    return texts.groupBy("key", "block").agg(F.concat(F.lit("[Data: "), joined, F.lit("]")).alias("citation"))


def _answers(spark, sf_dir) -> DataFrame:
    """One answer per conversation, citing records by its turns."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("n"))
    id_ = F.col("conv_id").cast("string")
    answer = F.concat(
        F.lit("So it is [Data: Reports ("), id_, F.lit(", 7, +more); Sources (1, "), F.col("n").cast("string"), F.lit(")]. Also [Data: Entities ("),
        F.array_join(F.transform(F.sequence(F.lit(1), F.col("conv_id").cast("int") % 8 + 1), lambda x: x.cast("string")), ", "), F.lit("); Rumours (3)], and [Data: Claims (x)] [Data: Claims 4"),
    )
    return turns.select(F.col("conv_id").alias("key"), answer.alias("answer"))


def citation_parse(spark, sf_dir):
    return references(_answers(spark, sf_dir))


def citation_errors(spark, sf_dir):
    return parsed(_answers(spark, sf_dir)).where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))


def citation_audit(spark, sf_dir):
    found = references(_answers(spark, sf_dir))
    scope = found.where("record_id <> 7").distinct().select("key", "dataset", "record_id", ((F.col("key") * 31 + F.col("record_id")) % 500).alias("unit_id"))
    return audit(found, scope, table(spark, sf_dir, "embeddings").where("label < 8").select(F.col("vec_id").alias("unit_id")))


def citation_rewrite(spark, sf_dir):
    mapping = spark.range(0, 2000).selectExpr("explode(array('Reports', 'Sources', 'Entities')) AS dataset", "id AS record_id", "id * 10 + 1 AS global_id").where("record_id % 6 <> 0")
    return rewrite(references(_answers(spark, sf_dir)), mapping)


QUERIES = {f.__name__: f for f in (citation_parse, citation_errors, citation_audit, citation_rewrite)}

# the well-formed citations of _answers(), which the parser has to find in its text
_REFS = """
a AS (SELECT conv_id AS key, max(turn) AS n FROM conversations GROUP BY conv_id),
refs AS (
  SELECT key, 0::BIGINT AS block, 'Reports' AS dataset, key AS record_id FROM a UNION ALL SELECT key, 0, 'Reports', 7 FROM a
  UNION ALL SELECT key, 0, 'Sources', 1 FROM a UNION ALL SELECT key, 0, 'Sources', n FROM a
  UNION ALL SELECT key, 1, 'Entities', unnest(range(1, key % 8 + 2)) FROM a WHERE key % 8 < 5)"""

ORACLE_SQL = {
    "citation_parse": f"WITH {_REFS} SELECT * FROM refs",
    "citation_errors": "WITH a AS (SELECT DISTINCT conv_id AS key FROM conversations), e AS (SELECT 'malformed' AS error FROM a UNION ALL SELECT 'invalid_record' FROM a UNION ALL SELECT 'unknown_dataset' FROM a UNION ALL SELECT 'too_many_records' FROM a WHERE key % 8 >= 5) SELECT error, count(*) AS n FROM e GROUP BY error",
    "citation_audit": f"WITH {_REFS} SELECT key, dataset, record_id, block, CASE WHEN record_id = 7 THEN 'outside_context' WHEN (key * 31 + record_id) % 500 IN (SELECT vec_id FROM embeddings WHERE label < 8) THEN 'valid' ELSE 'unresolved' END AS status FROM refs",
    "citation_rewrite": f"""WITH {_REFS}, g AS (SELECT DISTINCT key, block, dataset, record_id * 10 + 1 AS gid FROM refs WHERE dataset IN ('Reports', 'Sources', 'Entities') AND record_id % 6 <> 0 AND record_id < 2000),
n AS (SELECT *, (row_number() OVER (PARTITION BY key, block, dataset ORDER BY gid) - 1) // 5 AS part FROM g),
t AS (SELECT key, block, dataset, part, dataset || ' (' || string_agg(gid::VARCHAR, ', ' ORDER BY gid) || ')' AS txt FROM n GROUP BY key, block, dataset, part)
SELECT key, block, '[Data: ' || string_agg(txt, '; ' ORDER BY dataset, part) || ']' AS citation FROM t GROUP BY key, block""",
}
