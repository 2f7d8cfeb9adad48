"""Strict decoding of model responses: ratings, branches, primers and reports, by the variant type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import table

REPORT_FIELDS = ["findings", "rating", "rating_explanation", "summary", "title"]


def _object(outputs: DataFrame) -> DataFrame:
    """Adds `v`: the one JSON object that the output is, else null. A sentinel after it shows what trails."""
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("output"), F.lit(",0]")))
    rows = outputs.withColumn("whole", whole)
    alone = (F.try_variant_get("whole", "$[1]", "long") == 0) & F.try_variant_get("whole", "$[2]", "variant").isNull()
    v = F.try_variant_get("whole", "$[0]", "variant")
    return rows.withColumn("v", F.when(alone & F.schema_of_variant(v).startswith("OBJECT"), v)).drop("whole")


def _kind(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("v", path, kind)


def _first_error(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that doesn't hold; null if all do."""
    return F.coalesce(*[F.when(~F.coalesce(holds, F.lit(False)), name) for holds, name in checks])


def _blank(text: Column) -> Column:
    return F.trim(text) == ""


def decode_ratings(outputs: DataFrame) -> DataFrame:
    """(key, rating, error) of outputs (key, output): an object with an integer rating; other fields are ignored."""
    rows = _object(outputs).withColumn("error", _first_error((F.col("v").isNotNull(), "json"), (_kind("$.rating") == "BIGINT", "rating")))
    return rows.select("key", F.when(F.col("error").isNull(), _get("$.rating", "long")).alias("rating"), "error")


def _decode_answers(outputs: DataFrame, answer: str, least: int, most: int | None) -> DataFrame:
    queries = F.coalesce(_get("$.follow_up_queries", "array<string>"), F.array().cast("array<string>"))
    rows = _object(outputs).withColumn("queries", F.transform(queries, lambda x: F.trim(x)))
    score = _get("$.score", "long")
    error = _first_error(
        (F.col("v").isNotNull(), "json"),
        ((_kind(f"$.{answer}") == "STRING") & ~_blank(_get(f"$.{answer}", "string")), "answer"),
        ((_kind("$.score") == "BIGINT") & score.between(0, 100), "score"),
        (_kind("$.follow_up_queries").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID"), "queries"),
        (F.size("queries") >= least, "too few queries"),
        (F.lit(True) if most is None else F.size("queries") <= most, "too many queries"),
        (~F.exists("queries", lambda x: x.isNull() | (x == "")), "blank query"),
    )
    good = F.col("error").isNull()
    rows = rows.withColumn("error", error)
    return rows.select("key", F.when(good, _get(f"$.{answer}", "string")).alias("answer"), F.when(good, score).alias("score"), F.when(good, F.col("queries")).alias("queries"), "error")


def decode_branches(outputs: DataFrame, most: int) -> DataFrame:
    """(key, answer, score, queries, error): a response, a score from 0 to 100 and up to `most` follow-up queries, none blank."""
    return _decode_answers(outputs, "response", 0, most)


def decode_primers(outputs: DataFrame) -> DataFrame:
    """As branches, for an intermediate_answer with one follow-up query at least."""
    return _decode_answers(outputs, "intermediate_answer", 1, None)


def decode_reports(outputs: DataFrame) -> DataFrame:
    """(key, report, error): exactly the five fields, all there, and findings with a summary and an explanation each."""
    findings = _get("$.findings", "array<struct<summary: string, explanation: string>>")
    keys = F.array_join(F.array_sort(F.json_object_keys(F.to_json("v"))), ",")
    error = _first_error(
        (F.col("v").isNotNull(), "json"),
        (keys == ",".join(REPORT_FIELDS), "fields"),
        (F.forall(F.array(*[_kind(f"$.{x}") for x in ("title", "summary", "rating_explanation")]), lambda x: x == "STRING"), "text"),
        (_kind("$.rating").rlike("^(BIGINT|DOUBLE|DECIMAL)"), "rating"),
        (_kind("$.findings").startswith("ARRAY") & findings.isNotNull(), "findings"),
        (F.forall(findings, lambda x: x["summary"].isNotNull() & x["explanation"].isNotNull()), "finding"),
    )
    rows = _object(outputs).withColumn("error", error)
    report = F.struct(*[_get(f"$.{x}", "string").alias(x) for x in ("title", "summary", "rating_explanation")], _get("$.rating", "double").alias("rating"), findings.alias("findings"))
    return rows.select("key", F.when(F.col("error").isNull(), report).alias("report"), "error")


def response_ratings(spark, sf_dir):
    """Events as ratings: purchases give text for the number, errors trail more."""
    number = F.floor("value").cast("long").cast("string")
    output = F.when(F.col("event_type") == "purchase", F.concat(F.lit('{"rating": "'), number, F.lit('"}'))).when(F.col("event_type") == "error", F.concat(F.lit('{"rating": '), number, F.lit("} {}"))).otherwise(F.concat(F.lit('{"why": null, "rating": '), number, F.lit("}")))
    return decode_ratings(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), output.alias("output"))).fillna({"rating": -1, "error": ""})


def _answers(spark, sf_dir, name: str):
    queries = F.transform(F.sequence(F.lit(1), F.col("event_id") % 4 + 1), lambda x: F.when((x == 3) & (F.col("user_id") % 5 == 0), " ").otherwise(F.concat(F.lit(" why "), x.cast("string"))))
    fields = F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).alias(name), F.floor("value").cast("long").alias("score"), F.when(F.col("event_type") != "click", queries).alias("follow_up_queries"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.to_json(fields).alias("output"))


def _told(df: DataFrame) -> DataFrame:
    return df.select("key", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("score", F.lit(-1)).alias("score"), F.coalesce(F.array_join("queries", "|"), F.lit("")).alias("queries"), F.coalesce("error", F.lit("")).alias("error"))


def response_branches(spark, sf_dir):
    return _told(decode_branches(_answers(spark, sf_dir, "response"), 3))


def response_primers(spark, sf_dir):
    return _told(decode_primers(_answers(spark, sf_dir, "intermediate_answer")))


def response_reports(spark, sf_dir):
    """Parts as reports; some have a field too many, a finding without its explanation, or text for the rating."""
    n = F.col("p_partkey")
    finding = F.struct(F.col("p_brand").alias("summary"), F.when(n % 5 != 0, F.col("p_type")).alias("explanation"))
    fields = [F.col("p_name").alias("title"), F.col("p_type").alias("summary"), F.lit("none").alias("rating_explanation"), F.array(finding).alias("findings")]
    good, more, text = (F.to_json(F.struct(*fields, *x)) for x in ([F.col("p_size").alias("rating")], [F.col("p_size").alias("rating"), F.lit(1).alias("more")], [F.col("p_brand").alias("rating")]))
    outputs = table(spark, sf_dir, "part").select(n.alias("key"), F.when(n % 7 == 0, more).when(n % 3 == 0, text).otherwise(good).alias("output"))
    found = decode_reports(outputs)
    return found.select("key", F.coalesce("report.title", F.lit("")).alias("title"), F.coalesce("report.rating", F.lit(-1.0)).alias("rating"), F.coalesce("error", F.lit("")).alias("error"))


QUERIES = {f.__name__: f for f in (response_ratings, response_branches, response_primers, response_reports)}

_ANSWERS = """a AS (SELECT event_id AS key, event_type, CAST(floor(value) AS BIGINT) AS score, CASE WHEN event_type = 'click' THEN []::VARCHAR[] ELSE list_transform(range(1, event_id % 4 + 2), lambda x: CASE WHEN x = 3 AND user_id % 5 = 0 THEN '' ELSE 'why ' || x END) END AS q FROM events),
b AS (SELECT key, event_type, score, q, CASE WHEN event_type = 'error' THEN 'answer' WHEN score NOT BETWEEN 0 AND 100 THEN 'score' {} WHEN list_contains(q, '') THEN 'blank query' ELSE '' END AS error FROM a)
SELECT key, CASE WHEN error = '' THEN event_type ELSE '' END AS answer, CASE WHEN error = '' THEN score ELSE -1 END AS score, CASE WHEN error = '' THEN array_to_string(q, '|') ELSE '' END AS queries, error FROM b"""

ORACLE_SQL = {
    "response_ratings": "SELECT event_id AS key, CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE CAST(floor(value) AS BIGINT) END AS rating, CASE event_type WHEN 'purchase' THEN 'rating' WHEN 'error' THEN 'json' ELSE '' END AS error FROM events",
    "response_branches": "WITH " + _ANSWERS.format("WHEN len(q) > 3 THEN 'too many queries'"),
    "response_primers": "WITH " + _ANSWERS.format("WHEN len(q) < 1 THEN 'too few queries'"),
    "response_reports": "WITH e AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'fields' WHEN p_partkey % 3 = 0 THEN 'rating' WHEN p_partkey % 5 = 0 THEN 'finding' ELSE '' END AS error FROM part) SELECT p_partkey AS key, CASE WHEN error = '' THEN p_name ELSE '' END AS title, CASE WHEN error = '' THEN p_size::DOUBLE ELSE -1.0::DOUBLE END AS rating, error FROM e",
}
