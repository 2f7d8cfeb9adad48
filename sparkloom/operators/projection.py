"""The graph that communities are detected on: exactly the versions that a manifest names, with summed weights, and what keeps it from being one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.session import table, tasks_for


def _dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt to so many tasks by their keys; as Spark deals them if no number is given."""
    return rows.repartition(tasks, *keys) if tasks else rows


def _named(manifest: DataFrame, kind: str, versions: DataFrame, tasks: int | None) -> DataFrame:
    """The references of a kind, with `found` where their exact version is there, and how often their id is referred to."""
    references = _dealt(manifest.where((F.col("kind") == kind) & F.col("id").isNotNull()).select("id", "version"), tasks, "id")
    counted = references.withColumn("times", F.count("*").over(W.partitionBy("id")))
    return _dealt(counted, tasks, "id", "version").join(_dealt(versions.withColumn("found", F.lit(True)), tasks, "id", "version"), ["id", "version"], "left")


def _referred(of: DataFrame):
    return F.coalesce(F.when(~F.coalesce(of["version"] > 0, F.lit(False)), "version"), F.when(of["times"] > 1, "repeated"), F.when(of["found"].isNull(), "no such version"), F.when(of["deleted"], "deleted"))


def projection(manifest: DataFrame, entities: DataFrame, relations: DataFrame, weights: DataFrame, tasks: int | None = None) -> DataFrame:
    """(kind, id, version, source, target, weight, fault): a row for each reference of a manifest (kind `entity` or `relation`, id, version).

    entities: (id, version, deleted); relations: (id, version, deleted, source, target); weights: (id, version, source_id, weight), what each source adds to a relation's
    version, counted once a source. `fault` says why a reference is no part of the graph: its version isn't positive, its id is referred to twice, there is no such
    version, it is deleted, an end isn't one of the graph's entities, or the weight isn't finite or is negative. A relation without weights weighs 0.
    With `tasks` all rows are dealt to so many before they are counted, summed or joined.
    """
    nodes = _named(manifest, "entity", entities, tasks)
    nodes = nodes.select("id", "version", _referred(nodes).alias("fault"))
    sums = _dealt(weights, tasks, "id", "version").dropDuplicates(["id", "version", "source_id"]).groupBy("id", "version").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    links = _named(manifest, "relation", relations, tasks).join(sums, ["id", "version"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sound = nodes.where("fault IS NULL").select("id")
    for end in ("source", "target"):
        links = _dealt(links, tasks, end).join(sound.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    finite = ~F.isnan("weight") & (F.abs("weight") < float("inf")) & (F.col("weight") >= 0)
    fault = F.coalesce(_referred(links), F.when(F.col("has_source").isNull(), "source absent"), F.when(F.col("has_target").isNull(), "target absent"), F.when(~finite, "weight"))
    none = F.lit(None).cast("string")
    rows = links.select(F.lit("relation").alias("kind"), "id", "version", "source", "target", "weight", fault.alias("fault"))
    return nodes.select(F.lit("entity").alias("kind"), "id", "version", none.alias("source"), none.alias("target"), F.lit(None).cast("double").alias("weight"), "fault").unionByName(rows)


def edges_of(projected: DataFrame) -> DataFrame:
    """(source, target, weight) of a projection without faults; the first fault, by kind and id, is an error otherwise, and so is a graph without an entity."""
    wrong = projected.where("fault IS NOT NULL").orderBy("kind", "id").take(1)
    if wrong:
        raise ValueError(f"{wrong[0]['kind']} {wrong[0]['id']} version {wrong[0]['version']}: {wrong[0]['fault']}")
    if projected.where("kind = 'entity'").isEmpty():
        raise ValueError("a graph has an entity at least")
    return projected.where("kind = 'relation'").select("source", "target", "weight")


def graph_projection(spark, sf_dir):
    """Parts and suppliers at their first version, deliveries at the last of the versions that their line numbers make, some of which are deleted or not there."""
    part, supplier, lines = (table(spark, sf_dir, x) for x in ("part", "supplier", "lineitem"))
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    parts = part.select(name("p", "p_partkey").alias("id"), F.lit(1).alias("version"), (F.col("p_partkey") % 50 == 0).alias("deleted"))
    entities = parts.unionByName(supplier.select(name("s", "s_suppkey").alias("id"), F.lit(1).alias("version"), F.lit(False).alias("deleted")))
    pair = lines.select(F.concat_ws(">", name("s", "l_suppkey"), name("p", "l_partkey")).alias("id"), F.col("l_linenumber").cast("int").alias("version"), name("s", "l_suppkey").alias("source"), name("p", "l_partkey").alias("target"), F.col("l_orderkey").alias("source_id"), F.when(F.col("l_orderkey") % 97 == 0, F.lit(-1000)).otherwise(1).alias("weight"))
    tasks = 2 * tasks_for(lines)  # several sorts and sums in a task, over long ids
    relations = pair.select("id", "version", (F.col("version") == 7).alias("deleted"), "source", "target")
    relations = _dealt(relations, tasks, "id", "version").distinct()
    last = _dealt(pair.select("id", "version"), tasks, "id").groupBy("id").agg(F.max("version").alias("version"))
    manifest = entities.select(F.lit("entity").alias("kind"), "id", F.when(F.col("id").rlike("^s[0-9]*9$"), 2).otherwise(F.col("version")).alias("version")).unionByName(last.select(F.lit("relation").alias("kind"), "id", "version"))
    found = projection(manifest, entities, relations, pair.select("id", "version", "source_id", "weight"), tasks)
    return found.select("kind", "id", "version", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("fault", F.lit("")).alias("fault"))


QUERIES = {"graph_projection": graph_projection}

ORACLE_SQL = {
    "graph_projection": """WITH l AS (SELECT 's' || l_suppkey || '>p' || l_partkey AS id, l_suppkey AS s, l_partkey AS p, CAST(l_linenumber AS INT) AS version, l_orderkey FROM lineitem),
m AS (SELECT id, any_value(s) AS s, any_value(p) AS p, max(version) AS version FROM l GROUP BY id),
w AS (SELECT id, version, CAST(sum(CASE WHEN l_orderkey % 97 = 0 THEN -1000 ELSE 1 END) AS DOUBLE) AS weight FROM (SELECT DISTINCT id, version, l_orderkey FROM l) GROUP BY id, version)
SELECT 'entity' AS kind, 'p' || p_partkey AS id, CAST(1 AS INT) AS version, CAST(0 AS DOUBLE) AS weight, CASE WHEN p_partkey % 50 = 0 THEN 'deleted' ELSE '' END AS fault FROM part
UNION ALL SELECT 'entity', 's' || s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN 2 ELSE 1 END, 0, CASE WHEN s_suppkey % 10 = 9 THEN 'no such version' ELSE '' END FROM supplier
UNION ALL SELECT 'relation', m.id, m.version, weight, CASE WHEN m.version = 7 THEN 'deleted' WHEN s % 10 = 9 OR s NOT IN (SELECT s_suppkey FROM supplier) THEN 'source absent' WHEN p % 50 = 0 OR p NOT IN (SELECT p_partkey FROM part) THEN 'target absent' WHEN weight < 0 THEN 'weight' ELSE '' END
FROM m JOIN w ON m.id = w.id AND m.version = w.version""",
}
