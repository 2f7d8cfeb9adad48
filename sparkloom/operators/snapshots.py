"""Snapshots that reports and entity pages are written from, and the checks that their parts fit together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import graph, reports
from sparkloom.plans import domain
from sparkloom.session import table


def entity_rows(entities: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entities (node) with their degree and distinct text units; evidence: node, unit. An entity without either keeps zero and an empty list."""
    units = evidence.groupBy("node").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    rows = entities.join(graph.degrees(edges), "node", "left").join(units, "node", "left")
    return rows.withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))).withColumn("units", F.coalesce("units", F.array().cast("array<long>")))


def relation_rows(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Relations with weight, combined degree and distinct text units; evidence: source, target, unit."""
    units = evidence.groupBy("source", "target").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    return graph.combined_degrees(edges).join(units, ["source", "target"], "left")


def claim_rows(records: DataFrame) -> DataFrame:
    """One row for each evidence of each record of a claim: (claim, evidence_index, record, unit). records: claim, record_no,
    record, units (array). The index runs over all of a claim's records in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("record_no", "record", "units")))
    flat = F.flatten(F.transform(ordered, lambda r: F.transform(r["units"], lambda u: F.struct(r["record"].alias("record"), u.alias("unit")))))
    rows = records.groupBy("claim").agg(flat.alias("flat"))
    return rows.select("claim", F.posexplode("flat").alias("evidence_index", "x")).select("claim", F.col("evidence_index").cast("long").alias("evidence_index"), "x.record", "x.unit")


def entity_page(node: str, edges: DataFrame, claims: DataFrame, evidence: DataFrame, stored: DataFrame) -> DataFrame:
    """(kind, id, found): an entity's incident relations, neighbours, claims (claim, node) and text units; a unit that isn't stored (unit) has found = false."""
    incident = edges.where((F.col("source") == node) | (F.col("target") == node))
    neighbours = incident.select(F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("id")).distinct()
    units = evidence.where(F.col("node") == node).select("unit").distinct().join(stored.select("unit", F.lit(True).alias("found")).distinct(), "unit", "left")
    part = lambda df, kind, id_: df.select(F.lit(kind).alias("kind"), id_.cast("string").alias("id"), F.lit(True).alias("found"))
    rows = part(incident, "relation", F.concat_ws(">", "source", "target")).unionByName(part(neighbours, "neighbour", F.col("id"))).unionByName(part(claims.where(F.col("node") == node), "claim", F.col("claim")))
    return rows.unionByName(units.select(F.lit("unit").alias("kind"), F.col("unit").cast("string").alias("id"), F.coalesce("found", F.lit(False)).alias("found")))


def report_evidence(references: DataFrame, evidence: DataFrame) -> DataFrame:
    """(part, units): distinct text units of the entities that reports refer to; references: part, node, repeats allowed."""
    found = references.select("part", "node").distinct().join(evidence.select("node", "unit").distinct(), "node")
    return found.groupBy("part").agg(F.array_sort(F.collect_set("unit")).alias("units"))


def members_batch(members: DataFrame, entities: DataFrame, relations: DataFrame, claims: DataFrame) -> DataFrame:
    """(kind, id): of a batch, the member entities (node), the relations with both ends among them, and their claims.
    claims: claim, subject_kind, subject_id."""
    own = entities.join(members, "node", "left_semi")
    inside = graph.induced(relations, members).select("source", "target")
    subjects = own.select(F.lit("entity").alias("subject_kind"), F.col("node").alias("subject_id")).unionByName(inside.select(F.lit("relation").alias("subject_kind"), F.concat_ws(">", "source", "target").alias("subject_id")))
    kept = claims.join(subjects.distinct(), ["subject_kind", "subject_id"], "left_semi")
    return own.select(F.lit("entity").alias("kind"), F.col("node").alias("id")).unionByName(inside.select(F.lit("relation").alias("kind"), F.concat_ws(">", "source", "target").alias("id"))).unionByName(kept.select(F.lit("claim").alias("kind"), F.col("claim").alias("id")))


def input_faults(members: DataFrame, entities: DataFrame, relations: DataFrame, claims: DataFrame) -> DataFrame:
    """(fault, id) of what a report is to be written from: members that aren't entities, relations with an absent end,
    claims about an absent subject. None if all is well."""
    missing = members.join(entities, "node", "left_anti").select(F.lit("member").alias("fault"), F.col("node").alias("id"))
    ends = relations.select(F.concat_ws(">", "source", "target").alias("id"), F.explode(F.array("source", "target")).alias("node")).join(entities, "node", "left_anti").select(F.lit("relation").alias("fault"), "id").distinct()
    subjects = entities.select(F.lit("entity").alias("subject_kind"), F.col("node").alias("subject_id")).unionByName(relations.select(F.lit("relation").alias("subject_kind"), F.concat_ws(">", "source", "target").alias("subject_id")))
    orphans = claims.join(subjects, ["subject_kind", "subject_id"], "left_anti").select(F.lit("claim").alias("fault"), F.col("claim").alias("id"))
    return missing.unionByName(ends).unionByName(orphans)


def set_faults(communities: DataFrame, written: DataFrame, units: DataFrame) -> DataFrame:
    """(fault, part) of a set of reports: communities (part) without exactly one report, reports (part, units) of no community, and units outside the corpus (unit)."""
    counts = communities.join(written.groupBy("part").agg(F.count("*").alias("n")), "part", "left")
    number = counts.where(F.coalesce("n", F.lit(0)) != 1).select(F.lit("number").alias("fault"), "part")
    unknown = written.join(communities, "part", "left_anti").select(F.lit("community").alias("fault"), "part").distinct()
    outside = written.select("part", F.explode("units").alias("unit")).join(units, "unit", "left_anti").select(F.lit("unit").alias("fault"), "part").distinct()
    return number.unionByName(unknown).unionByName(outside)


def fetch(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """stored rows in the order in which they are wanted (place, key), with found = false where there is none."""
    return wanted.join(stored.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def community_set(communities: DataFrame, members: DataFrame) -> DataFrame:
    """Communities (part, level, parent) with their members (part, ordinal, node) in order and whether the ordinals are dense."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "node")))
    lists = members.groupBy("part").agg(F.transform(ordered, lambda x: x["node"]).alias("nodes"), F.transform(ordered, lambda x: x["ordinal"].cast("long")).alias("ordinals"))
    dense = F.col("ordinals") == F.transform("ordinals", lambda x, i: i.cast("long"))
    return communities.join(lists, "part", "left").withColumn("dense", F.coalesce(dense, F.lit(True))).drop("ordinals")


def readable_generations(spans: DataFrame, states: DataFrame) -> DataFrame:
    """Spans (zone_id, generation) of generations that may be read: up to the zone's current one, and the next once it is prepared.
    states: zone_id, current, state."""
    most = F.col("current") + (F.col("state") == "prepared").cast("int")
    return spans.join(states.select("zone_id", most.alias("most")), "zone_id").where(F.col("generation") <= F.col("most")).drop("most")


def _lines(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.col("l_orderkey").alias("unit"), "l_linenumber", "l_returnflag")


def _evidence(spark, sf_dir) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return lines.select(F.col("source").alias("node"), "unit").unionByName(lines.select(F.col("target").alias("node"), "unit"))


def _claims(spark, sf_dir) -> DataFrame:
    """A claim for each part and for each delivery, by its flag."""
    lines = _lines(spark, sf_dir)
    about = lines.select(F.lit("entity").alias("subject_kind"), F.col("target").alias("subject_id"), "l_returnflag").unionByName(lines.select(F.lit("relation").alias("subject_kind"), F.concat_ws(">", "source", "target").alias("subject_id"), "l_returnflag"))
    return about.select("subject_kind", "subject_id", F.concat_ws("/", "subject_id", "l_returnflag").alias("claim")).distinct()


def _digest(units: str):
    return F.sha2(F.array_join(F.transform(units, lambda x: x.cast("string")), ","), 256).alias("digest")


def snapshot_entities(spark, sf_dir):
    entities = reports._members(spark, sf_dir).select("node")
    found = entity_rows(entities, domain.relations(spark, sf_dir), _evidence(spark, sf_dir))
    return found.select("node", "degree", F.size("units").cast("long").alias("units"), _digest("units"))


def snapshot_relations(spark, sf_dir):
    found = relation_rows(domain.relations(spark, sf_dir), _lines(spark, sf_dir))
    return found.select("source", "target", "weight", "combined_degree", _digest("units"))


def snapshot_claims(spark, sf_dir):
    """A supplier's claims: a record for each order, its evidence the parts in it."""
    records = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("claim"), F.col("l_orderkey").alias("record_no")).agg(F.array_sort(F.collect_set("l_partkey")).alias("units")).withColumn("record", F.concat(F.lit("order "), F.col("record_no").cast("string")))
    return claim_rows(records)


def entity_detail(spark, sf_dir):
    claims = _claims(spark, sf_dir).where("subject_kind = 'entity'").select("claim", F.col("subject_id").alias("node"))
    stored = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("unit"))
    return entity_page("p7", domain.relations(spark, sf_dir), claims, _evidence(spark, sf_dir), stored)


def global_evidence(spark, sf_dir):
    """Reports on brands refer to their members, twice."""
    members = reports._members(spark, sf_dir)
    found = report_evidence(members.unionByName(members), _evidence(spark, sf_dir))
    return found.select("part", F.size("units").cast("long").alias("units"), _digest("units"))


def report_member_batch(spark, sf_dir):
    members = reports._members(spark, sf_dir)
    return members_batch(members.where("part = 'Brand#11'").select("node"), members.select("node"), domain.relations(spark, sf_dir), _claims(spark, sf_dir))


def report_input_faults(spark, sf_dir):
    """Discontinued parts (of size 1) are no longer entities."""
    members = reports._members(spark, sf_dir).select("node")
    gone = table(spark, sf_dir, "part").where("p_size = 1").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return input_faults(members, members.join(gone, "node", "left_anti"), domain.relations(spark, sf_dir), _claims(spark, sf_dir))


def report_set_faults(spark, sf_dir):
    """Nations as communities, customers' segments as their reports: one for each segment of a nation that orders urgently."""
    communities = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("part"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    written = orders.groupBy((F.col("c_nationkey").cast("long") * 2 % 27).alias("part"), F.col("c_mktsegment")).agg(F.collect_set("o_orderkey").alias("units"))
    written = written.where("c_mktsegment = 'BUILDING' OR part % 3 = 0")
    return set_faults(communities, written, table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("unit")))


def report_fetch(spark, sf_dir):
    """Reports on brands, wanted by the parts' sizes in falling order; brands of a wanted name with a digit more don't exist."""
    wanted = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 9 == 0, F.concat("p_brand", F.lit("0"))).otherwise(F.col("p_brand")).alias("part"), F.col("p_partkey").alias("place"))
    stored = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("part")).agg(F.max("p_size").cast("long").alias("rank"))
    return fetch(wanted, stored, "part").select("place", "part", "found", F.coalesce("rank", F.lit(-1)).alias("rank"))


def community_set_assembly(spark, sf_dir):
    """Nations with their customers by balance; ordinals skip those in debt."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("part"), F.lit(1).alias("level"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    place = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")) - 1
    members = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("part"), (place + (F.col("c_acctbal") < 0).cast("int")).alias("ordinal"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return community_set(nations, members).select("part", "level", "parent", F.array_join("nodes", ",").alias("nodes"), "dense")


def corpus_readable(spark, sf_dir):
    """Documents' sources as zones, languages as their states, text lengths as generations."""
    spans = table(spark, sf_dir, "documents").select("doc_id", (F.crc32("source") % 5).alias("zone_id"), (F.col("n_chars") % 6).alias("generation"))
    states = spark.createDataFrame([(i, i % 4 + 1, "prepared" if i % 2 else "building") for i in range(5)], "zone_id long, current int, state string")
    return readable_generations(spans, states).select("doc_id", "zone_id", "generation")


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_entities, snapshot_relations, snapshot_claims, entity_detail, global_evidence, report_member_batch, report_input_faults, report_set_faults, report_fetch, community_set_assembly, corpus_readable,
    )
}

_MEMBERS = reports._MEMBERS
_EVIDENCE = "evidence AS (SELECT 's' || l_suppkey AS node, l_orderkey AS unit FROM lineitem UNION SELECT 'p' || l_partkey, l_orderkey FROM lineitem)"
_CLAIMS = "claims AS (SELECT DISTINCT 'entity' AS kind, 'p' || l_partkey AS id, 'p' || l_partkey || '/' || l_returnflag AS claim FROM lineitem UNION SELECT DISTINCT 'relation', 's' || l_suppkey || '>p' || l_partkey, 's' || l_suppkey || '>p' || l_partkey || '/' || l_returnflag FROM lineitem)"

ORACLE_SQL = {
    "snapshot_entities": f"WITH {_MEMBERS}, {_EVIDENCE}, u AS (SELECT node, count(*) AS units, sha256(string_agg(unit::VARCHAR, ',' ORDER BY unit)) AS digest FROM evidence GROUP BY node) SELECT m.node, coalesce(degree, 0) AS degree, coalesce(units, 0) AS units, coalesce(digest, sha256('')) AS digest FROM members m LEFT JOIN deg ON m.node = deg.node LEFT JOIN u ON m.node = u.node",
    "snapshot_relations": f"WITH {graph._COMBINED}, l AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_orderkey AS unit FROM lineitem), u AS (SELECT source, target, sha256(string_agg(unit::VARCHAR, ',' ORDER BY unit)) AS digest FROM l GROUP BY ALL) SELECT source, target, weight, combined_degree, digest FROM combined JOIN u USING (source, target)",
    "snapshot_claims": "WITH l AS (SELECT DISTINCT l_suppkey AS claim, l_orderkey AS o, l_partkey AS unit FROM lineitem) SELECT claim, row_number() OVER (PARTITION BY claim ORDER BY o, unit) - 1 AS evidence_index, 'order ' || o AS record, unit FROM l",
    "entity_detail": f"WITH {domain.RELATIONS_SQL}, {_EVIDENCE}, {_CLAIMS} SELECT 'relation' AS kind, source || '>' || target AS id, true AS found FROM relations WHERE target = 'p7' UNION ALL SELECT 'neighbour', source, true FROM relations WHERE target = 'p7' UNION ALL SELECT 'claim', claim, true FROM claims WHERE id = 'p7' UNION ALL SELECT 'unit', unit::VARCHAR, unit IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') FROM evidence WHERE node = 'p7'",
    "global_evidence": f"WITH {_MEMBERS}, {_EVIDENCE}, d AS (SELECT DISTINCT part, unit FROM members JOIN evidence USING (node)) SELECT part, count(*) AS units, sha256(string_agg(unit::VARCHAR, ',' ORDER BY unit)) AS digest FROM d GROUP BY part",
    "report_member_batch": f"WITH {_MEMBERS}, {_CLAIMS}, own AS (SELECT node FROM members WHERE part = 'Brand#11'), r AS (SELECT source || '>' || target AS id FROM relations WHERE source IN (SELECT node FROM own) AND target IN (SELECT node FROM own)) SELECT 'entity' AS kind, node AS id FROM own UNION ALL SELECT 'relation', id FROM r UNION ALL SELECT 'claim', claim FROM claims WHERE id IN (SELECT node FROM own UNION ALL SELECT id FROM r)",
    "report_input_faults": f"WITH {domain.RELATIONS_SQL}, {_CLAIMS}, gone AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size = 1) SELECT 'member' AS fault, node AS id FROM gone UNION ALL SELECT 'relation', source || '>' || target FROM relations WHERE target IN (SELECT node FROM gone) UNION ALL SELECT 'claim', claim FROM claims WHERE kind = 'entity' AND id IN (SELECT node FROM gone)",
    "report_set_faults": """WITH w AS (SELECT DISTINCT c_nationkey::BIGINT * 2 % 27 AS part, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' OR c_nationkey::BIGINT * 2 % 27 % 3 = 0),
o AS (SELECT DISTINCT c_nationkey::BIGINT * 2 % 27 AS part FROM orders JOIN customer ON o_custkey = c_custkey WHERE (c_mktsegment = 'BUILDING' OR c_nationkey::BIGINT * 2 % 27 % 3 = 0) AND o_orderstatus = 'P')
SELECT 'number' AS fault, n_nationkey::BIGINT AS part FROM nation WHERE (SELECT count(*) FROM w WHERE w.part = n_nationkey) <> 1 UNION ALL SELECT DISTINCT 'community', part FROM w WHERE part NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'unit', part FROM o""",
    "report_fetch": "SELECT p_partkey AS place, CASE WHEN p_size % 9 = 0 THEN p_brand || '0' ELSE p_brand END AS part, s.rank IS NOT NULL AS found, coalesce(s.rank, -1) AS rank FROM part LEFT JOIN (SELECT p_brand AS b, CAST(max(p_size) AS BIGINT) AS rank FROM part GROUP BY p_brand) s ON s.b = CASE WHEN p_size % 9 = 0 THEN p_brand || '0' ELSE p_brand END",
    "community_set_assembly": "WITH m AS (SELECT 'n' || c_nationkey AS part, 'c' || c_custkey AS node, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS place, c_acctbal < 0 AS debt FROM customer), l AS (SELECT part, string_agg(node, ',' ORDER BY place) AS nodes, NOT bool_or(debt) AS dense FROM m GROUP BY part) SELECT 'n' || n_nationkey AS part, 1 AS level, 'r' || n_regionkey AS parent, nodes, coalesce(dense, true) AS dense FROM nation LEFT JOIN l ON part = 'n' || n_nationkey",
}
