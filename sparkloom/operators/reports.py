"""Community reports: evidence tables of a community, fragment plans under a budget, lineage and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import context, graph
from sparkloom.plans import domain
from sparkloom.session import table


def members_in_order(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, place, node, degree): a community's members by degree, then id."""
    placed = members.join(graph.degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return placed.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(F.col("degree").desc(), "node")).cast("long"))


def internal_relations(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations with both ends in one community, with it."""
    source, target = members.toDF("source", "part"), members.toDF("target", "target_part")
    return edges.join(source, "source").join(target, "target").where("part = target_part").drop("target_part")


def occurrence_weights(report_units: DataFrame) -> DataFrame:
    """(part, units, weight): distinct text units behind each community, and their part of the largest number."""
    counts = report_units.groupBy("part").agg(F.count_distinct("unit").alias("units"))
    most = counts.agg(F.max("units").alias("most"))
    return counts.join(F.broadcast(most), how="cross").select("part", "units", (F.col("units") / F.col("most")).alias("weight"))  # with a single row


def child_counts(hierarchy: DataFrame) -> DataFrame:
    """(part, children) for communities (part, parent)."""
    return hierarchy.where("parent IS NOT NULL").groupBy(F.col("parent").alias("part")).agg(F.count_distinct("part").alias("children"))


def fragment_plan(atoms: DataFrame, budget: int) -> DataFrame:
    """(part, place, tokens, fragment): a community's evidence rows (part, place, tokens) packed in order into fragments that fit the
    budget. A row over the budget is a fragment of its own. `fragments` plans along a tree of communities."""
    return context.packed(atoms, "part", "place", budget).withColumnRenamed("batch", "fragment")


def reduce_rounds(fragments: int, width: int) -> int:
    """How often groups of at most `width` neighbours merge until one is left."""
    rounds = 0
    while fragments > 1:
        fragments, rounds = -(-fragments // width), rounds + 1
    return rounds


def assemble(reports: DataFrame, lineage: DataFrame) -> DataFrame:
    """Reports (part, title) with their ordered lineage (part, ordinal, ref); `dense` tells if ordinals run from 0 without gaps."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "ref")))
    lists = lineage.groupBy("part").agg(F.array_join(F.transform(ordered, lambda x: x["ref"]), ",").alias("refs"), ((F.min("ordinal") == 0) & (F.max("ordinal") == F.count("*") - 1) & (F.count_distinct("ordinal") == F.count("*"))).alias("dense"))
    return reports.join(lists, "part", "left")


def markdown(title, summary, findings) -> F.Column:
    """# title, summary and ## findings as Markdown; findings: array<struct<summary, explanation>>."""
    parts = F.transform(findings, lambda x: F.concat(F.lit("## "), x["summary"], F.lit("\n\n"), x["explanation"]))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), summary, F.array_join(parts, "\n\n"))


def coverage_faults(fragments: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that the fragments miss or hold in excess."""
    columns = ["part", "place"]
    lost = rows.select(*columns).exceptAll(fragments.select(*columns)).withColumn("fault", F.lit("missing"))
    return lost.unionByName(fragments.select(*columns).exceptAll(rows.select(*columns)).withColumn("fault", F.lit("extra")))


def _members(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("part"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("part"))
    return parts.unionByName(suppliers)


def _atoms(spark, sf_dir) -> DataFrame:
    ranked = members_in_order(_members(spark, sf_dir), domain.relations(spark, sf_dir))
    return ranked.select("part", "place", (F.col("degree") % 17 + 3).alias("tokens"))


def report_members(spark, sf_dir):
    return members_in_order(_members(spark, sf_dir), domain.relations(spark, sf_dir))


def report_relations(spark, sf_dir):
    found = internal_relations(_members(spark, sf_dir), domain.relations(spark, sf_dir))
    return found.groupBy("part").agg(F.count("*").alias("relations"), F.sum("weight").alias("weight"))


def report_occurrence_weights(spark, sf_dir):
    units = domain.relations(spark, sf_dir).join(_members(spark, sf_dir).toDF("target", "part"), "target").select("part", (F.col("pos") % 1000).alias("unit"))
    return occurrence_weights(units).select("part", "units", F.round("weight", 6).alias("weight"))


def report_child_counts(spark, sf_dir):
    tree = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("part"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    return child_counts(tree)


def report_fragment_plan(spark, sf_dir):
    return fragment_plan(_atoms(spark, sf_dir), 100)


def report_fragment_coverage(spark, sf_dir):
    atoms = _atoms(spark, sf_dir)
    return coverage_faults(fragment_plan(atoms, 100).where("place % 50 <> 0"), atoms)


def report_assembly(spark, sf_dir):
    ranked = members_in_order(_members(spark, sf_dir), domain.relations(spark, sf_dir))
    reports = ranked.groupBy("part").agg(F.concat(F.lit("Report on "), F.first("part")).alias("title"))
    return assemble(reports, ranked.select("part", (F.col("place") - 1 + (F.col("part") == "Brand#7").cast("int")).alias("ordinal"), F.col("node").alias("ref")))


def report_markdown(spark, sf_dir):
    ranked = members_in_order(_members(spark, sf_dir), domain.relations(spark, sf_dir))
    findings = F.array_sort(F.collect_list(F.struct(F.col("node").alias("summary"), F.concat(F.lit("degree "), F.col("degree").cast("string")).alias("explanation"))))
    return ranked.groupBy("part").agg(markdown(F.first("part"), F.lit("Leading members."), findings).alias("text"))


QUERIES = {f.__name__: f for f in (report_members, report_relations, report_occurrence_weights, report_child_counts, report_fragment_plan, report_fragment_coverage, report_assembly, report_markdown)}

_MEMBERS = f"{domain.RELATIONS_SQL}, members AS (SELECT 'p' || p_partkey AS node, p_brand AS part FROM part UNION ALL SELECT 's' || s_suppkey, 'Brand#' || (s_suppkey % 25 + 1) FROM supplier), deg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM relations UNION ALL SELECT target FROM relations) GROUP BY node), ranked AS (SELECT m.part, m.node, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY m.part ORDER BY coalesce(degree, 0) DESC, m.node) AS place FROM members m LEFT JOIN deg ON m.node = deg.node)"

ORACLE_SQL = {
    "report_members": f"WITH {_MEMBERS} SELECT * FROM ranked",
    "report_relations": f"WITH {_MEMBERS} SELECT a.part, count(*) AS relations, sum(weight) AS weight FROM relations r JOIN members a ON r.source = a.node JOIN members b ON r.target = b.node WHERE a.part = b.part GROUP BY a.part",
    "report_occurrence_weights": f"WITH {_MEMBERS}, u AS (SELECT part, count(DISTINCT pos % 1000) AS units FROM relations JOIN members ON target = node GROUP BY part) SELECT part, units, round(units / max(units) OVER (), 6) AS weight FROM u",
    "report_child_counts": "SELECT 'r' || n_regionkey AS part, count(*) AS children FROM nation GROUP BY n_regionkey",
    "report_fragment_plan": f"WITH RECURSIVE {_MEMBERS},{context.packed_sql('pk', 'SELECT part, place, degree % 17 + 3 AS tokens FROM ranked', 'part', 'place', 0, 100)} SELECT part, place, tokens, batch AS fragment FROM pk",
    "report_fragment_coverage": f"WITH {_MEMBERS} SELECT part, place, 'missing' AS fault FROM ranked WHERE place % 50 = 0",
    "report_assembly": f"WITH {_MEMBERS} SELECT part, 'Report on ' || part AS title, string_agg(node, ',' ORDER BY place) AS refs, part <> 'Brand#7' AS dense FROM ranked GROUP BY part",
    "report_markdown": f"WITH {_MEMBERS} SELECT part, '# ' || part || chr(10) || chr(10) || 'Leading members.' || chr(10) || chr(10) || string_agg('## ' || node || chr(10) || chr(10) || 'degree ' || degree, chr(10) || chr(10) ORDER BY node) AS text FROM ranked GROUP BY part",
}
