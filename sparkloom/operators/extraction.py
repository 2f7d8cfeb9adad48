"""From model output to knowledge: parsing of claims, graphs and map points, identity resolution, evidence and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import corpus
from sparkloom.session import table, written

# fixed values: the markers of claim tuples
RECORD, FIELD, COMPLETE = "##", "<|>", "<|COMPLETE|>"
CLAIM_FIELDS = ["subject", "object", "type", "status", "start_date", "end_date", "description", "source_text"]


def parse_claims(outputs: DataFrame) -> DataFrame:
    """(key, record_no, valid, fields...) of outputs (key, output): records of exactly eight fields are valid."""
    body = F.regexp_replace(F.trim("output"), r"<\|COMPLETE\|>\s*$", "")
    records = outputs.select("key", F.posexplode(F.split(body, RECORD)).alias("record_no", "record"))
    fields = records.where(F.trim("record") != "").withColumn("fields", F.transform(F.split(F.regexp_replace(F.trim("record"), r"^\(|\)$", ""), r"<\|>"), lambda x: F.trim(x)))
    valid = F.size("fields") == len(CLAIM_FIELDS)
    return fields.select("key", F.col("record_no").cast("long").alias("record_no"), valid.alias("valid"), *[F.when(valid, F.get("fields", F.lit(i))).alias(name) for i, name in enumerate(CLAIM_FIELDS)])


GRAPH_JSON = "entities array<struct<title: string, type: string, description: string>>, relations array<struct<source: string, target: string, description: string, weight: double>>"


def parse_graphs(outputs: DataFrame) -> DataFrame:
    """Strict JSON graphs: adds `graph` and `valid`; an output with unknown top-level fields, a missing list or an untitled entity is not valid."""
    parsed = F.from_json("output", GRAPH_JSON, {"mode": "PERMISSIVE"})
    keys = F.array_sort(F.json_object_keys("output"))
    rows = outputs.withColumn("graph", parsed).withColumn("keys", keys)
    sound = (F.array_join("keys", ",") == "entities,relations") & F.col("graph.entities").isNotNull() & F.col("graph.relations").isNotNull()
    titled = F.forall("graph.entities", lambda x: x["title"].isNotNull() & (F.trim(x["title"]) != "") & x["type"].isNotNull())
    return rows.withColumn("valid", F.coalesce(sound & titled, F.lit(False))).drop("keys")


POINTS_JSON = "points array<struct<description: string, score: string>>"


def parse_points(outputs: DataFrame) -> DataFrame:
    """(key, point, description, score, error) of map answers: scores are whole numbers from 0 to 100, descriptions not empty."""
    points = outputs.select("key", F.from_json("output", POINTS_JSON).alias("x"))
    each = points.select("key", F.posexplode_outer("x.points").alias("point", "p"))
    whole = F.regexp_like(F.coalesce(F.col("p.score"), F.lit("")), F.lit("^(0|[1-9][0-9]{0,2})$"))
    score = F.when(whole, F.col("p.score").cast("int"))
    error = F.when(F.col("p").isNull(), "no points").when(~whole | (score > 100), "score").when(F.coalesce(F.trim("p.description"), F.lit("")) == "", "description")
    return each.select("key", F.coalesce("point", F.lit(0)).cast("long").alias("point"), F.col("p.description").alias("description"), F.coalesce(score, F.lit(-1)).alias("score"), F.coalesce(error, F.lit("")).alias("error"))


def resolve_titles(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions (unit, title) with the one type that entities (unit, title, type) give the title in the unit: resolved, unknown or ambiguous."""
    types = entities.groupBy("unit", "title").agg(F.count_distinct("type").alias("types"), F.min("type").alias("type"))
    outcome = F.when(F.col("types").isNull(), "unknown").when(F.col("types") > 1, "ambiguous").otherwise("resolved")
    return mentions.join(types, ["unit", "title"], "left").select("unit", "title", outcome.alias("outcome"), F.when(F.col("types") == 1, F.col("type")).otherwise("").alias("type"))


def canonical_evidence(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_union(left, right)))


def encode_metadata(frequency: Column, evidence: Column) -> Column:
    return F.to_json(F.struct(frequency.alias("frequency"), evidence.alias("evidence")))


def decode_metadata(text: Column) -> Column:
    return F.from_json(text, "frequency long, evidence array<long>")


def relation_weights(deliveries: DataFrame) -> DataFrame:
    """A relation's weight is the sum over its sources, not a field of its row."""
    return deliveries.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("source_id")).alias("sources"))


def claim_records(claims: DataFrame) -> DataFrame:
    """Records (subject, source_id, record) concatenated per subject in the order of their sources, repeats included, numbered."""
    ordered = F.array_sort(F.collect_list(F.struct("source_id", "record")))
    return claims.groupBy("subject").agg(F.transform(ordered, lambda x: x["record"]).alias("records"))


def claim_evidence(records: DataFrame, index: int) -> DataFrame:
    """The record at a running index of each subject."""
    return records.select("subject", F.posexplode("records").alias("at", "record")).where(F.col("at") == index).select("subject", "record")


def missing_evidence(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """Evidence (unit_id, subject) whose text unit isn't in the corpus."""
    return evidence.join(spans.select("unit_id").distinct(), "unit_id", "left_anti")


def evidence_faults(evidence: DataFrame, spans: DataFrame, messages: DataFrame) -> DataFrame:
    """(zone_id, kind, source, unit, fault) of the evidence (zone_id, kind, source, unit) that can't be accepted, each once.

    spans: (zone_id, source, unit) of the zones' corpora; messages: (zone_id, source, unit), one row a message. Evidence of the kind `corpora` has to be a unit of that
    corpus in its own zone; of the kind `message` a message of its zone, with that very unit, and a message stands for one unit in all
    that is offered. Other kinds, and what lacks a zone, source or unit, aren't evidence.
    """
    offered = evidence.select("zone_id", "kind", "source", "unit").distinct()
    known = offered.where(F.col("zone_id").isNotNull() & F.col("source").isNotNull() & F.col("unit").isNotNull() & F.col("kind").isin("corpora", "message"))
    none = offered.where(F.coalesce(~F.col("kind").isin("corpora", "message"), F.lit(True)) | F.col("zone_id").isNull() | F.col("source").isNull() | F.col("unit").isNull()).withColumn("fault", F.lit("not evidence"))
    units = spans.select("zone_id", "source", "unit").distinct()
    lost = known.where("kind = 'corpora'").join(units, ["zone_id", "source", "unit"], "left_anti").withColumn("fault", F.lit("no such unit"))
    said = known.where("kind = 'message'")
    several = said.groupBy("zone_id", "source").agg((F.count("*") > 1).alias("several"))
    met = said.join(several, ["zone_id", "source"]).join(messages.select("zone_id", "source", F.col("unit").alias("own")), ["zone_id", "source"], "left")
    fault = F.when(F.col("several"), "message of several units").when(F.col("own").isNull(), "no such message").when(F.col("own") != F.col("unit"), "another unit of the message")
    columns = ["zone_id", "kind", "source", "unit", "fault"]
    return none.select(*columns).unionByName(lost.select(*columns)).unionByName(met.withColumn("fault", fault).where("fault IS NOT NULL").select(*columns))


def closure(matched: DataFrame, referenced: DataFrame) -> DataFrame:
    """Ids of both lists (pos, id), matched ones first, each where it is seen first, numbered densely."""
    both = matched.select(F.lit(0).alias("tier"), "pos", "id").unionByName(referenced.select(F.lit(1).alias("tier"), "pos", "id"))
    first = both.groupBy("id").agg(F.min(F.struct("tier", "pos")).alias("at"))
    return first.select("id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("at", "id")).cast("long").alias("place"))  # a query's evidence


def resume(units: DataFrame, done: int) -> DataFrame:
    """Units after the last processed one, in order."""
    return units.where(F.col("place") > done)


def not_contained(children: DataFrame) -> DataFrame:
    """Communities (part, members, parent_members) with members outside their parent."""
    return children.where(F.size(F.array_except("members", "parent_members")) > 0).select("part")


def subject_evidence(claims: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(claim, units): text units of the entity or relation that a claim is about."""
    subjects = entities.select(F.lit("entity").alias("kind"), "id", "unit").unionByName(relations.select(F.lit("relation").alias("kind"), "id", "unit"))
    return claims.join(subjects, ["kind", "id"]).groupBy("claim").agg(F.array_sort(F.collect_set("unit")).alias("units"))


def merge_generations(parent: DataFrame, children: DataFrame) -> DataFrame:
    """Parent units and accepted child units as one generation; a unit in several is taken from the parent, then the smallest child zone."""
    both = parent.select(F.lit(-1).cast("long").alias("zone_id"), "unit_id").unionByName(children.select("zone_id", "unit_id"))
    return both.groupBy("unit_id").agg(F.min("zone_id").alias("from_zone"))


def boundary_upsert(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Per child zone the greater boundary: it never goes back."""
    return stored.unionByName(offered).groupBy("zone_id").agg(F.max("boundary").alias("boundary"))


def _claims(spark, sf_dir) -> DataFrame:
    """One output per order: a claim tuple for each line; lines of returned goods lack a field."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), "l_linenumber",
        F.concat(F.lit("("), F.concat_ws(FIELD, F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit(" p"), F.col("l_partkey").cast("string"), F.lit(" ")), F.lit("DELIVERY"), "l_linestatus", F.lit("2024"), F.lit("2025"), F.lit("it was delivered"), F.when(F.col("l_returnflag") != "R", F.lit("text"))), F.lit(")")).alias("record"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "record")))
    return lines.groupBy("key").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["record"]), "\n##\n"), F.lit(COMPLETE)).alias("output"))


def extraction_claims(spark, sf_dir):
    return parse_claims(_claims(spark, sf_dir)).groupBy("valid", "status").agg(F.count("*").alias("n"), F.count_distinct("object").alias("objects")).fillna("", ["status"])


def extraction_graphs(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    entity = F.struct(F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_type")).alias("type"), F.col("p_brand").alias("description"))
    relation = F.struct(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.lit("made by").alias("description"), F.col("p_retailprice").alias("weight"))
    good = F.to_json(F.struct(F.array(entity).alias("entities"), F.array(relation).alias("relations")))
    odd = F.to_json(F.struct(F.array(entity).alias("entities"), F.array(relation).alias("relations"), F.lit(1).alias("more")))
    outputs = parts.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 7 == 0, odd).when(F.col("p_partkey") % 11 == 0, F.lit("not json")).otherwise(good).alias("output"))
    found = parse_graphs(outputs)
    return found.select("key", "valid", F.when(F.col("valid"), F.element_at("graph.entities", 1)["title"]).otherwise("").alias("title"), F.when(F.col("valid"), F.element_at("graph.relations", 1)["weight"]).otherwise(0.0).alias("weight"))


def extraction_points(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    point = F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" ").alias("description"), F.floor("value").cast("long").alias("score"))
    outputs = events.select(F.col("event_id").alias("key"), F.when(F.col("event_type") == "signup", F.lit('{"answer": 1}')).otherwise(F.to_json(F.struct(F.array(point).alias("points")))).alias("output"))
    return parse_points(outputs).select("key", "point", "score", "error")


def extraction_title_resolution(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    entities = parts.select(F.col("p_brand").alias("unit"), F.col("p_name").alias("title"), F.col("p_type").alias("type"))
    mentions = entities.select("unit", "title").distinct().unionByName(parts.select(F.col("p_brand").alias("unit"), F.concat(F.lit("no "), "p_type").alias("title")).distinct())
    return resolve_titles(mentions, entities)


def evidence_union(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    of = lambda type_, name: events.where(F.col("event_type") == type_).groupBy("user_id").agg(F.collect_list(F.floor("value").cast("long") % 20).alias(name))
    joined = of("view", "a").join(of("click", "b"), "user_id")
    return joined.select("user_id", F.array_join(F.transform(canonical_evidence(F.col("a"), F.col("b")), lambda x: x.cast("string")), ",").alias("evidence"))


def metadata_codec(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("frequency"), F.array_sort(F.collect_set(F.floor("value").cast("long") % 7)).alias("evidence"))
    decoded = rows.withColumn("x", decode_metadata(encode_metadata(F.col("frequency"), F.col("evidence"))))
    return decoded.select("user_id", "x.frequency", F.array_join(F.transform("x.evidence", lambda x: x.cast("string")), ",").alias("evidence"))


def provenance_relation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("source_id"))
    return relation_weights(lines).select("source", "target", "weight", F.size("sources").cast("long").alias("sources"))


def provenance_claim(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("record"))
    return claim_records(claims).select("subject", F.size("records").cast("long").alias("n"), F.sha2(F.array_join("records", ","), 256).alias("digest"))


def claim_evidence_index(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_id"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("record"))
    return claim_evidence(claim_records(claims), 7)


def evidence_missing(spark, sf_dir):
    units = corpus.token_windows(corpus.prepared_texts(table(spark, sf_dir, "documents"))).select(F.sha2("unit", 256).alias("unit_id"), F.col("doc_id").alias("subject"), "window_no")
    units = written(units)  # read twice
    return missing_evidence(units, units.where("window_no < 3").select("unit_id")).groupBy("subject").agg(F.count("*").alias("missing"))


def evidence_checked(spark, sf_dir):
    """Documents and turns as evidence for what is in the zones' corpora and logs, with wrong units, zones, messages and kinds among it; how many of each fault a zone has."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("unit"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("source"), F.sha2(F.concat_ws(":", "conv_id", "turn", F.coalesce("text", F.lit(""))), 256).alias("unit"))
    spans = documents.select((F.col("doc_id") % 4).alias("zone_id"), "source", "unit")
    log = turns.where("conv_id % 10 <> 7").select((F.col("conv_id") % 4).alias("zone_id"), "source", "unit")
    wrong = lambda id_, n: F.when(F.col(id_) % n == 0, F.concat(F.lit("x"), "unit")).otherwise(F.col("unit")).alias("unit")
    offered = documents.select((F.col("doc_id") % 4).alias("zone_id"), F.when(F.col("doc_id") % 13 == 0, F.lit("rumour")).otherwise(F.lit("corpora")).alias("kind"), "source", wrong("doc_id", 5))
    offered = offered.unionByName(turns.select((F.col("conv_id") % 4).alias("zone_id"), F.lit("message").alias("kind"), "source", wrong("conv_id", 3)))
    offered = offered.unionByName(turns.where("conv_id % 11 = 0").select((F.col("conv_id") % 4).alias("zone_id"), F.lit("message").alias("kind"), "source", F.lit("second").alias("unit")))
    return evidence_faults(offered, spans, log).groupBy("zone_id", "fault").agg(F.count("*").alias("n"))


def evidence_closure(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    matched = lines.where("l_suppkey % 3 = 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("id"))
    return closure(matched, lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("id")))


def community_containment(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    child = customers.where("c_custkey % 97 <> 5 OR c_nationkey > 3").groupBy(F.col("c_nationkey").alias("part")).agg(F.collect_list("c_custkey").alias("parent_members"))
    members = customers.groupBy(F.col("c_nationkey").alias("part")).agg(F.collect_list("c_custkey").alias("members"))
    return not_contained(members.join(child, "part"))


def claim_subject_units(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    entities = lines.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("unit"))
    relations = lines.select((F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("id"), F.col("l_orderkey").alias("unit"))
    claims = entities.select(F.lit("entity").alias("kind"), "id", F.concat(F.lit("e"), F.col("id").cast("string")).alias("claim")).unionByName(relations.select(F.lit("relation").alias("kind"), "id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("claim"))).distinct()
    return subject_evidence(claims, entities, relations).select("claim", F.array_join(F.transform("units", lambda x: x.cast("string")), ",").alias("units"))


def corpora_child_merge(spark, sf_dir):
    units = corpus.token_windows(corpus.prepared_texts(table(spark, sf_dir, "documents"))).select(F.sha2("unit", 256).alias("unit_id"), (F.col("doc_id") % 4).alias("zone_id"))
    return merge_generations(units.where("zone_id = 0"), units.where("zone_id > 0"))


def corpora_boundaries(spark, sf_dir):
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("zone_id"), F.col("event_id").alias("boundary"))
    return boundary_upsert(events.where("boundary % 3 = 0").groupBy("zone_id").agg(F.max("boundary").alias("boundary")), events.where("boundary % 3 = 1 AND zone_id < 7").groupBy("zone_id").agg(F.max("boundary").alias("boundary")))


def extraction_source_ids(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return resume(units.withColumn("place", F.col("doc_id")), 100).select("doc_id", F.concat(F.lit("source/extraction/"), T.deterministic_id(F.col("source"), F.col("doc_id").cast("string"))).alias("source_id"))


QUERIES = {
    f.__name__: f
    for f in (
        extraction_claims, extraction_graphs, extraction_points, extraction_title_resolution, evidence_union, metadata_codec, provenance_relation, provenance_claim, claim_evidence_index,
        evidence_missing, evidence_checked, evidence_closure, community_containment, claim_subject_units, corpora_child_merge, corpora_boundaries, extraction_source_ids,
    )
}

_UNITS_SQL = corpus._UNITS_SQL

ORACLE_SQL = {
    "extraction_claims": "SELECT l_returnflag <> 'R' AS valid, CASE WHEN l_returnflag <> 'R' THEN l_linestatus ELSE '' END AS status, count(*) AS n, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_partkey END) AS objects FROM lineitem GROUP BY ALL",
    "extraction_graphs": "SELECT p_partkey AS key, p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 10 <> 0 AS valid, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 10 <> 0 THEN p_name ELSE '' END AS title, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 10 <> 0 THEN p_retailprice ELSE 0.0 END AS weight FROM part",
    "extraction_points": "WITH e AS (SELECT event_id AS key, event_type, CAST(floor(value) AS INT) AS s FROM events) SELECT key, 0::BIGINT AS point, CASE WHEN event_type = 'signup' OR s > 999 THEN -1 ELSE s END AS score, CASE WHEN event_type = 'signup' THEN 'no points' WHEN s > 100 THEN 'score' WHEN event_type = 'error' THEN 'description' ELSE '' END AS error FROM e",
    "extraction_title_resolution": "WITH t AS (SELECT p_brand AS unit, p_name AS title, count(DISTINCT p_type) AS types, min(p_type) AS type FROM part GROUP BY ALL) SELECT unit, title, CASE WHEN types > 1 THEN 'ambiguous' ELSE 'resolved' END AS outcome, CASE WHEN types = 1 THEN type ELSE '' END AS type FROM t UNION ALL SELECT DISTINCT p_brand, 'no ' || p_type, 'unknown', '' FROM part",
    "evidence_union": "WITH e AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) % 20 AS v FROM events WHERE event_type IN ('view', 'click')), d AS (SELECT DISTINCT user_id, v FROM e), k AS (SELECT user_id FROM e GROUP BY user_id HAVING count(DISTINCT event_type) = 2) SELECT user_id, string_agg(v::VARCHAR, ',' ORDER BY v) AS evidence FROM d JOIN k USING (user_id) GROUP BY user_id",
    "metadata_codec": "WITH d AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 7 AS v, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, CAST(sum(n) AS BIGINT) AS frequency, string_agg(v::VARCHAR, ',' ORDER BY v) AS evidence FROM d GROUP BY user_id",
    "provenance_relation": "SELECT l_suppkey AS source, l_partkey AS target, sum(l_quantity) AS weight, count(DISTINCT l_orderkey) AS sources FROM lineitem GROUP BY ALL",
    "provenance_claim": "SELECT l_suppkey AS subject, count(*) AS n, sha256(string_agg(l_returnflag || '/' || l_linestatus, ',' ORDER BY l_orderkey * 10 + l_linenumber, l_returnflag, l_linestatus)) AS digest FROM lineitem GROUP BY l_suppkey",
    "claim_evidence_index": "SELECT l_suppkey AS subject, l_returnflag || '/' || l_linestatus AS record FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_returnflag, l_linestatus) = 8",
    "evidence_missing": f"WITH {_UNITS_SQL} SELECT doc_id AS subject, count(*) AS missing FROM units WHERE unit_id NOT IN (SELECT unit_id FROM units WHERE window_no < 3) GROUP BY doc_id",
    "evidence_checked": """WITH d AS (SELECT doc_id, doc_id % 4 AS zone_id, coalesce(lang, '') AS source, sha256(coalesce(text, '')) AS unit FROM documents),
t AS (SELECT conv_id, conv_id % 4 AS zone_id, conv_id || ':' || turn AS source, sha256(conv_id || ':' || turn || ':' || coalesce(text, '')) AS unit FROM conversations),
o AS (SELECT DISTINCT zone_id, CASE WHEN doc_id % 13 = 0 THEN 'rumour' ELSE 'corpora' END AS kind, source, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END || unit AS unit FROM d
  UNION SELECT zone_id, 'message', source, CASE WHEN conv_id % 3 = 0 THEN 'x' ELSE '' END || unit FROM t UNION SELECT zone_id, 'message', source, 'second' FROM t WHERE conv_id % 11 = 0),
f AS (
  SELECT zone_id, 'not evidence' AS fault FROM o WHERE kind = 'rumour'
  UNION ALL SELECT zone_id, 'no such unit' FROM o WHERE kind = 'corpora' AND NOT EXISTS (SELECT 1 FROM d WHERE d.zone_id = o.zone_id AND d.source = o.source AND d.unit = o.unit)
  UNION ALL SELECT o.zone_id, CASE WHEN conv_id % 11 = 0 THEN 'message of several units' WHEN conv_id % 10 = 7 THEN 'no such message' WHEN conv_id % 3 = 0 THEN 'another unit of the message' END FROM o JOIN t ON o.kind = 'message' AND o.source = t.source)
SELECT zone_id, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY zone_id, fault""",
    "evidence_closure": "WITH l AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS pos, l_suppkey % 3 = 0 AS m FROM lineitem), b AS (SELECT 0 AS tier, pos, id FROM l WHERE m UNION ALL SELECT 1, pos, id FROM l), f AS (SELECT id, min((tier, pos)) AS at_ FROM b GROUP BY id) SELECT id, row_number() OVER (ORDER BY at_, id) AS place FROM f",
    "community_containment": "SELECT DISTINCT c_nationkey AS part FROM customer WHERE c_custkey % 97 = 5 AND c_nationkey <= 3",
    "claim_subject_units": "WITH s AS (SELECT DISTINCT 'e' || l_partkey AS claim, l_orderkey AS u FROM lineitem UNION SELECT DISTINCT 'r' || (l_partkey * 1000 + l_suppkey), l_orderkey FROM lineitem) SELECT claim, string_agg(u::VARCHAR, ',' ORDER BY u) AS units FROM s GROUP BY claim",
    "corpora_child_merge": f"WITH {_UNITS_SQL} SELECT unit_id, min(CASE WHEN doc_id % 4 = 0 THEN -1 ELSE doc_id % 4 END) AS from_zone FROM units GROUP BY unit_id",
    "corpora_boundaries": "SELECT user_id % 10 AS zone_id, max(event_id) AS boundary FROM events WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND user_id % 10 < 7) GROUP BY 1",
    "extraction_source_ids": "SELECT doc_id, 'source/extraction/' || sha256(coalesce(source, '') || chr(0) || doc_id) AS source_id FROM documents WHERE doc_id > 100",
}
