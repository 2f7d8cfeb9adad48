"""Upkeep of knowledge, corpora and reports: tombstones, merge reviews and parent resolutions, completion barriers,
checks of manifests, evidence batches of reports, and what snapshots project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import graph, knowledge
from sparkloom.plans import domain
from sparkloom.plans.domain import VERSIONS_SQL
from sparkloom.session import checkpointed, table

# --- knowledge ------------------------------------------------------------------------------------


def identity(title: Column, type_: Column) -> Column:
    """Title and type without outer white space; null if either is empty then."""
    title, type_ = T.trim_unicode(title), T.trim_unicode(type_)
    return F.when((title != "") & (type_ != ""), F.struct(title.alias("title"), type_.alias("type")))


def vector_text(title: Column, description: Column) -> Column:
    """What is embedded for an entity."""
    return F.concat_ws(":", title, description)


def tombstones(expected: DataFrame, versions: DataFrame, used: DataFrame) -> DataFrame:
    """Deleting (id, base): `stale` if base isn't current, `deleted` before, `referenced` if an active relation uses it (used: id), else `appended`,
    a tombstone at the next version. (id, outcome, version)."""
    current = knowledge.latest(versions).select("id", "version", "deleted")
    joined = expected.join(current, "id", "left").join(used.select("id", F.lit(True).alias("is_used")).distinct(), "id", "left")
    outcome = F.when(~F.col("base").eqNullSafe(F.col("version")), "stale").when(F.col("deleted"), "deleted").when(F.col("is_used"), "referenced").otherwise("appended")
    return joined.select("id", outcome.alias("outcome"), F.when(outcome == "appended", F.col("version") + 1).otherwise(F.coalesce("version", F.lit(0))).cast("long").alias("version"))


def merge_reviews(child: DataFrame, assigned: DataFrame, parent: DataFrame) -> DataFrame:
    """A child's current version (id, base, content_hash) beside the parent's that a merge assigned it (id, parent_version): with the
    parent's current version and content, whether the parent has moved since, and whether the contents differ."""
    now = knowledge.latest(parent).select("id", F.col("version").alias("parent_now"), F.col("content_hash").alias("parent_hash"))
    joined = child.join(assigned, "id").join(now, "id", "left")
    return joined.select("id", "base", "parent_version", "parent_now", (~F.col("parent_version").eqNullSafe(F.col("parent_now"))).alias("moved"), (~F.col("content_hash").eqNullSafe(F.col("parent_hash"))).alias("differs"))


def resolve_with_parent(resolved: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Republishing a child's resolutions (id, content_hash) to the parent: `review` again where the parent has moved,
    `confirmed` where it has the content, else `republished` at its next version. (id, outcome, version)."""
    joined = resolved.join(reviewed, "id")
    outcome = F.when(F.col("moved"), "review").when(~F.col("differs"), "confirmed").otherwise("republished")
    return joined.select("id", outcome.alias("outcome"), (F.col("parent_now") + (outcome == "republished").cast("int")).alias("version"))


def merge_orders(zones: DataFrame, requests: DataFrame) -> DataFrame:
    """Merges (child, parent) of zones (zone, parent_zone): only into the direct parent. (child, parent, accepted)."""
    return requests.join(zones.select(F.col("zone").alias("child"), "parent_zone"), "child", "left").select("child", "parent", F.coalesce(F.col("parent") == F.col("parent_zone"), F.lit(False)).alias("accepted"))


def merge_source(child: Column, parent: Column, boundary: Column) -> Column:
    """The source id of a merge: SHA-256 over JSON with the fields in one order."""
    return F.sha2(F.to_json(F.struct(boundary.alias("boundary"), child.alias("child"), parent.alias("parent"))), 256)


def candidate_results(candidates: DataFrame) -> DataFrame:
    """What each source's submissions did: candidates it opened (it is the first of a content) and those it met again."""
    first = F.min("source_id").over(W.partitionBy("id", "version", "content_hash"))
    marked = candidates.withColumn("opens", F.col("source_id") == first)
    return marked.groupBy("source_id").agg(F.count_if("opens").alias("opened"), F.count_if(~F.col("opens")).alias("reused"))


def manifest_order_faults(references: DataFrame) -> DataFrame:
    """References (zone_id, pos, id) whose id doesn't come after the one before it in their manifest; pos tells a zone's references apart.

    They are numbered over range partitions and met with the one before by its number, so that a zone lies in many tasks."""
    placed = checkpointed(graph.numbered_within(references.select("zone_id", "pos", "id"), ["zone_id"], ["pos"]))
    before = placed.select("zone_id", (F.col("place") + 1).alias("place"), F.col("id").alias("before"))
    return placed.join(before, ["zone_id", "place"]).where("before >= id").select("zone_id", "pos", "id", "before")


# --- corpus ---------------------------------------------------------------------------------------


def vector_completion(spans: DataFrame, progress: DataFrame) -> DataFrame:
    """Per generation of spans (generation, unit): how many there are and have no vector yet (progress: unit, repeats don't count), and whether it is complete."""
    joined = spans.join(progress.select("unit", F.lit(True).alias("done")).distinct(), "unit", "left")
    counts = joined.groupBy("generation").agg(F.count("*").alias("spans"), F.count_if(F.col("done").isNull()).alias("incomplete"))
    return counts.withColumn("complete", (F.col("incomplete") == 0) & (F.col("spans") > 0))


def observed_graph(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Extracted rows as submissions: entities (title, type, unit) count 1 each, relations (source, target, weight, unit) their weight; evidence as
    a canonical set. (item_kind, key, frequency, evidence)."""
    named = entities.select(F.lit("entity").alias("item_kind"), T.canonical_key(F.col("title"), F.col("type")).alias("key"), F.lit(1.0).alias("frequency"), "unit")
    linked = relations.select(F.lit("relation").alias("item_kind"), T.canonical_key(F.col("source"), F.col("target")).alias("key"), F.col("weight").cast("double").alias("frequency"), "unit")
    return named.unionByName(linked).groupBy("item_kind", "key").agg(F.sum("frequency").alias("frequency"), F.array_sort(F.collect_set("unit")).alias("evidence"))


# --- reports --------------------------------------------------------------------------------------


def subtracted(batch: DataFrame, owned: DataFrame) -> DataFrame:
    """Evidence rows (part, kind, row) of a community that none of its children owns."""
    return batch.join(owned, ["part", "kind", "row"], "left_anti")


def merged_batches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two evidence batches as one: each row once, numbered in the order of kind and row within its community."""
    both = left.select("part", "kind", "row").unionByName(right.select("part", "kind", "row")).distinct()
    return graph.numbered_within(both, ["part"], ["kind", "row"]).select("part", "kind", "row", "place")


def report_projection(reports: DataFrame, tree: DataFrame) -> DataFrame:
    """Reports (part, title) with their parent and the children of their community (part, parent) in order."""
    children = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("part")).agg(F.array_sort(F.collect_list("part")).alias("children"))
    joined = reports.join(tree, "part").join(children, "part", "left")
    return joined.select("part", "title", "parent", F.coalesce(F.size("children"), F.lit(0)).cast("long").alias("n_children"), F.coalesce(F.array_join("children", ","), F.lit("")).alias("children"))


def report_sources(reports: DataFrame) -> DataFrame:
    """What is embedded for reports (part, title, summary, findings): the full content, and its digest; in the order of part when written."""
    content = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), "summary", F.array_join("findings", "\n"))
    return reports.select("part", content.alias("content"), F.sha2(content, 256).alias("digest"))


# --- activation -----------------------------------------------------------------------------------


def encoded_observations(observations: DataFrame) -> DataFrame:
    """(observation_id, input): the observation as JSON with its fields in one order."""
    return observations.select("observation_id", F.to_json(F.struct("grade", "observation_id", "subject")).alias("input"))


def decoded_observations(encoded: DataFrame) -> DataFrame:
    return encoded.select(F.from_json("input", "grade long, observation_id long, subject long").alias("x")).select("x.*")


def newest_states(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """An upsert of states (subject, ordinal, stability): the greater ordinal stays, the stored one of equal ones."""
    both = stored.withColumn("old", F.lit(1)).unionByName(offered.withColumn("old", F.lit(0)))
    return both.groupBy("subject").agg(F.max(F.struct("ordinal", "old", "stability")).alias("x")).select("subject", "x.ordinal", "x.stability")


# --- over the driver tables -------------------------------------------------------------------------


def identity_normalize(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", identity(F.concat(F.lit(" "), "p_name", F.lit("\t")), F.when(F.col("p_size") > 5, F.col("p_type")).otherwise(F.lit(" "))).alias("x"))
    return part.select("p_partkey", "x.title", "x.type")


def entity_vector_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", vector_text(F.col("p_name"), F.col("p_brand")).alias("text"))


def _expected(spark, sf_dir) -> DataFrame:
    """Every identity at its current version, or at the one before where its number is divisible by 3."""
    return knowledge.latest(domain.versions(spark, sf_dir)).selectExpr("id", "IF(substring(id, 2) % 3 = 0, version - 1, version) AS base", "content_hash")


def deletion_append(spark, sf_dir):
    used = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("id"))
    return tombstones(_expected(spark, sf_dir).select("id", "base"), domain.versions(spark, sf_dir), used)


def _reviews(spark, sf_dir) -> DataFrame:
    child = _expected(spark, sf_dir).selectExpr("id", "base", "IF(substring(id, 2) % 2 = 0, content_hash, 'other') AS content_hash")
    assigned = _expected(spark, sf_dir).selectExpr("id", "base AS parent_version")
    return merge_reviews(child, assigned, domain.versions(spark, sf_dir))


def zone_merge_review(spark, sf_dir):
    return _reviews(spark, sf_dir)


def zone_parent_resolution(spark, sf_dir):
    return resolve_with_parent(_expected(spark, sf_dir).select("id", "content_hash"), _reviews(spark, sf_dir))


def zone_merge_orders(spark, sf_dir):
    zones = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS zone", "n_regionkey AS parent_zone")
    requests = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS child", "s_suppkey % 5 AS parent").distinct()
    return merge_orders(zones, requests)


def zone_merge_sources(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", merge_source(F.concat(F.lit("z"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.col("s_suppkey")).alias("source_id"))


def candidate_partition(spark, sf_dir):
    return candidate_results(domain.versions(spark, sf_dir).where("candidate_number > 0"))


def manifest_order(spark, sf_dir):
    """Manifests in the order of events: those of users who come out of order are faults."""
    return manifest_order_faults(domain.versions(spark, sf_dir).where("candidate_number = 0").selectExpr("zone_id", "source_id AS pos", "id"))


def vector_completion_barrier(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").selectExpr("o_custkey AS generation", "o_orderkey AS unit")
    return vector_completion(spans, table(spark, sf_dir, "lineitem").where("l_quantity > 25").selectExpr("l_orderkey AS unit"))


def extraction_observed_graph(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").selectExpr("p_partkey AS l_partkey", "p_name", "p_type"), "l_partkey")
    entities = lines.selectExpr("p_name AS title", "p_type AS type", "l_orderkey AS unit")
    relations = lines.selectExpr("concat('s', l_suppkey) AS source", "concat('p', l_partkey) AS target", "CAST(l_quantity AS DOUBLE) AS weight", "l_orderkey AS unit")
    found = observed_graph(entities, relations)
    return found.select("item_kind", "key", F.round("frequency", 3).alias("frequency"), F.size("evidence").cast("long").alias("units"), F.sha2(F.array_join(F.col("evidence").cast("array<string>"), ","), 256).alias("evidence"))


def _evidence(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    suppliers = lines.selectExpr("concat('s', l_suppkey) AS part", "'unit' AS kind", "l_orderkey AS row").distinct()
    owned = lines.where("l_returnflag = 'R'").selectExpr("concat('s', l_suppkey) AS part", "'unit' AS kind", "l_orderkey AS row").distinct()
    return suppliers, owned


def report_batch_subtract(spark, sf_dir):
    return subtracted(*_evidence(spark, sf_dir))


def report_batch_merge(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").selectExpr("concat('s', l_suppkey) AS part", "'claim' AS kind", "l_partkey AS row")
    return merged_batches(_evidence(spark, sf_dir)[1], claims)


def report_projections(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS part", "concat('r', n_regionkey) AS parent", "n_name AS title")
    regions = table(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS part", "CAST(NULL AS STRING) AS parent", "r_name AS title")
    both = nations.unionByName(regions)
    return report_projection(both.select("part", "title"), both.select("part", "parent"))


def report_vector_source(spark, sf_dir):
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("part")).agg(F.concat(F.lit("Parts of "), F.first("p_brand")).alias("title"), F.concat(F.count("*").cast("string"), F.lit(" parts")).alias("summary"), F.array_sort(F.collect_set("p_type")).alias("findings"))
    return report_sources(brands).select("part", "content", "digest")


def activation_codec(spark, sf_dir):
    observed = table(spark, sf_dir, "events").selectExpr("event_id AS observation_id", "user_id AS subject", "1 + event_id % 4 AS grade")
    encoded = encoded_observations(observed)
    return encoded.join(decoded_observations(encoded), "observation_id").select("observation_id", "subject", "grade", "input")


def activation_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("user_id AS subject", "event_id AS ordinal", "event_id % 7 AS stability")
    return newest_states(events.where("ordinal % 2 = 0").groupBy("subject").agg(F.max("ordinal").alias("ordinal"), F.max_by("stability", "ordinal").alias("stability")), events.where("ordinal % 2 = 1"))


QUERIES = {
    f.__name__: f
    for f in (
        identity_normalize, entity_vector_text, deletion_append, zone_merge_review, zone_parent_resolution, zone_merge_orders, zone_merge_sources, candidate_partition, manifest_order,
        vector_completion_barrier, extraction_observed_graph, report_batch_subtract, report_batch_merge, report_projections, report_vector_source, activation_codec, activation_upsert,
    )
}

_LATEST = f"{VERSIONS_SQL}, latest AS (SELECT * FROM versions WHERE candidate_number = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1), e AS (SELECT id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 3 = 0 THEN version - 1 ELSE version END AS base, version, deleted, content_hash FROM latest)"
_REVIEWS = f"{_LATEST}, r AS (SELECT id, base, base AS parent_version, version AS parent_now, base <> version AS moved, CAST(substr(id, 2) AS BIGINT) % 2 <> 0 AS differs FROM e)"
_TREE = "t AS (SELECT 'n' || n_nationkey AS part, 'r' || n_regionkey AS parent, n_name AS title FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, r_name FROM region)"
_KEYED = "CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0} || CAST(octet_length(encode({1})) AS VARCHAR) || ':' || {1}"

ORACLE_SQL = {
    "identity_normalize": "SELECT p_partkey, CASE WHEN p_size > 5 THEN p_name END AS title, CASE WHEN p_size > 5 THEN p_type END AS type FROM part",
    "entity_vector_text": "SELECT p_partkey, p_name || ':' || p_brand AS text FROM part",
    "deletion_append": f"""WITH {_LATEST}, o AS (SELECT id, version, CASE WHEN base <> version THEN 'stale' WHEN deleted THEN 'deleted' WHEN id IN (SELECT 'u' || c_custkey FROM customer WHERE c_acctbal > 0) THEN 'referenced' ELSE 'appended' END AS outcome FROM e)
SELECT id, outcome, CASE WHEN outcome = 'appended' THEN version + 1 ELSE version END AS version FROM o""",
    "zone_merge_review": f"WITH {_REVIEWS} SELECT * FROM r",
    "zone_parent_resolution": f"WITH {_REVIEWS} SELECT id, CASE WHEN moved THEN 'review' WHEN differs THEN 'republished' ELSE 'confirmed' END AS outcome, CASE WHEN NOT moved AND differs THEN parent_now + 1 ELSE parent_now END AS version FROM r",
    "zone_merge_orders": "SELECT DISTINCT s_nationkey AS child, s_suppkey % 5 AS parent, s_suppkey % 5 = n_regionkey AS accepted FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "zone_merge_sources": """SELECT s_suppkey, sha256('{"boundary":' || s_suppkey || ',"child":"z' || s_suppkey || '","parent":"n' || s_nationkey || '"}') AS source_id FROM supplier""",
    "candidate_partition": f"WITH {VERSIONS_SQL}, m AS (SELECT source_id, source_id = min(source_id) OVER (PARTITION BY id, version, content_hash) AS opens FROM versions WHERE candidate_number > 0) SELECT source_id, count(*) FILTER (opens) AS opened, count(*) FILTER (NOT opens) AS reused FROM m GROUP BY source_id",
    "manifest_order": f"WITH {VERSIONS_SQL}, l AS (SELECT zone_id, source_id AS pos, id, lag(id) OVER (PARTITION BY zone_id ORDER BY source_id) AS before FROM versions WHERE candidate_number = 0) SELECT * FROM l WHERE before >= id",
    "vector_completion_barrier": "WITH c AS (SELECT o_custkey AS generation, count(*) AS spans, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)) AS incomplete FROM orders GROUP BY 1) SELECT *, incomplete = 0 AS complete FROM c",
    "extraction_observed_graph": f"""WITH b AS (SELECT 'entity' AS item_kind, {_KEYED.format("p_name", "p_type")} AS key, 1.0::DOUBLE AS w, l_orderkey AS unit FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'relation', {_KEYED.format("('s' || l_suppkey)", "('p' || l_partkey)")}, CAST(l_quantity AS DOUBLE), l_orderkey FROM lineitem),
u AS (SELECT item_kind, key, count(DISTINCT unit) AS units, sha256(string_agg(DISTINCT unit, ',' ORDER BY unit)) AS evidence FROM b GROUP BY ALL)
SELECT item_kind, key, round(sum(w), 3) AS frequency, any_value(units) AS units, any_value(evidence) AS evidence FROM b JOIN u USING (item_kind, key) GROUP BY ALL""",
    "report_batch_subtract": "SELECT DISTINCT 's' || l_suppkey AS part, 'unit' AS kind, l_orderkey AS row FROM lineitem WHERE (l_suppkey, l_orderkey) NOT IN (SELECT (l_suppkey, l_orderkey) FROM lineitem WHERE l_returnflag = 'R')",
    "report_batch_merge": "WITH b AS (SELECT 's' || l_suppkey AS part, 'unit' AS kind, l_orderkey AS row FROM lineitem WHERE l_returnflag = 'R' UNION SELECT 's' || l_suppkey, 'claim', l_partkey FROM lineitem) SELECT *, row_number() OVER (PARTITION BY part ORDER BY kind, row) - 1 AS place FROM b",
    "report_projections": f"WITH {_TREE}, c AS (SELECT parent AS part, count(*) AS n, string_agg(part, ',' ORDER BY part) AS list FROM t WHERE parent IS NOT NULL GROUP BY 1) SELECT t.part, title, parent, coalesce(n, 0) AS n_children, coalesce(list, '') AS children FROM t LEFT JOIN c USING (part)",
    "report_vector_source": "WITH c AS (SELECT p_brand AS part, '# Parts of ' || p_brand || chr(10) || chr(10) || count(*) || ' parts' || chr(10) || chr(10) || string_agg(DISTINCT p_type, chr(10) ORDER BY p_type) AS content FROM part GROUP BY p_brand) SELECT part, content, sha256(content) AS digest FROM c",
    "activation_codec": """SELECT event_id AS observation_id, user_id AS subject, 1 + event_id % 4 AS grade, '{"grade":' || (1 + event_id % 4) || ',"observation_id":' || event_id || ',"subject":' || user_id || '}' AS input FROM events""",
    "activation_upsert": "SELECT user_id AS subject, max(event_id) AS ordinal, max(event_id) % 7 AS stability FROM events GROUP BY user_id",
}
