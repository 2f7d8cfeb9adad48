"""Recall from memory: the entities of a title or the nearest ones, what is connected with them, claims about both, and the evidence for all of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import search, vectors
from sparkloom.plans import domain
from sparkloom.session import checkpointed, table


@dataclass(frozen=True)
class Limits:
    """Most items of a kind that are returned."""

    entities: int = 10
    relations: int = 20
    claims: int = 20
    evidence: int = 50


def _page(rows: DataFrame, order: list[str | Column], most: int) -> DataFrame:
    """The first `most` rows with their place from 1 and whether there are more: each task keeps most + 1 rows before they meet."""
    first = rows.orderBy(*order).limit(most + 1)
    placed = first.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))  # a page
    more = placed.withColumn("truncated", F.max("place").over(W.partitionBy(F.lit(0))) > most)
    return checkpointed(more.where(F.col("place") <= most))


def recall(entities: DataFrame, entity_vectors: DataFrame, relations: DataFrame, claims: DataFrame, evidence: DataFrame, title: str, type_: str = "", query: list[float] | None = None, fuzzy: bool = False, limits: Limits = Limits()) -> DataFrame:
    """(item_kind, place, item, score, reason, truncated) for a title, and a type if one is given.

    entities: (id, title, type), current ones; entity_vectors: (vec_id, id, embedding); relations: (id, source, target); claims: (id, subject_kind, subject); evidence:
    (kind, item, source, unit) by the kind and id of what it is evidence of. Entities of the title come first, with score 1 (`exact_title`, or `exact_identity` with a
    type); if there are none, or with fuzzy, the nearest to the query vector take their place (`semantic_match`). Then come relations with one end at least
    among them, claims about either, and the distinct evidence of all that is returned, each in the order of id (evidence: source and unit) up to its limit; `truncated`
    tells that there are more of a kind. Nothing is cut without it.
    """
    found = None
    if not fuzzy:
        exact = search.memory_exact(entities, title, type_, limits.entities)
        rows = exact.select("id", "type", F.lit(1.0).alias("score"), F.lit("exact_identity" if type_ else "exact_title").alias("reason"), F.col("more").alias("truncated"))
        found = checkpointed(rows.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("type", "id")).cast("long")))  # a page
    if (found is None or found.isEmpty()) and query is not None:
        active = entity_vectors.join(entities.select("id"), "id", "left_semi")
        near = vectors.top_k(active.select("vec_id", "embedding"), query, limits.entities + 1).join(active.select("vec_id", "id"), "vec_id")
        found = _page(near.select("id", "score", F.lit("semantic_match").alias("reason")), [F.col("score").desc(), "id"], limits.entities)
    if found is None:
        raise ValueError("a fuzzy recall needs a vector")
    ids = F.broadcast(found.select("id"))  # a page
    ends = relations.where(F.col("source").isNotNull() & F.col("target").isNotNull())
    touching = ends.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(ends.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_anti"))
    connected = _page(touching.select("id"), ["id"], limits.relations)
    subjects = found.select(F.lit("entity").alias("subject_kind"), F.col("id").alias("subject")).unionByName(connected.select(F.lit("relation").alias("subject_kind"), F.col("id").alias("subject")))
    said = _page(claims.join(F.broadcast(subjects), ["subject_kind", "subject"], "left_semi").select("id"), ["id"], limits.claims)
    items = subjects.toDF("kind", "item").unionByName(said.select(F.lit("claim").alias("kind"), F.col("id").alias("item")))
    units = _page(evidence.join(F.broadcast(items), ["kind", "item"], "left_semi").select("source", "unit").distinct(), ["source", "unit"], limits.evidence)
    shape = lambda rows, kind, item, score=None, reason="": rows.select(F.lit(kind).alias("item_kind"), "place", item.alias("item"), (F.lit(None).cast("double") if score is None else F.col(score)).alias("score"), (F.col("reason") if score else F.lit(reason)).alias("reason"), "truncated")
    out = shape(found, "entity", F.col("id"), "score").unionByName(shape(connected, "relation", F.col("id"), reason="connected_to_entity"))
    return out.unionByName(shape(said, "claim", F.col("id"), reason="about_subject")).unionByName(shape(units, "evidence", F.concat_ws("/", "source", "unit"), reason="evidence"))


# --- over the driver tables -------------------------------------------------------------------------


def memory_recall(spark, sf_dir):
    """A title that exists, the same with a type, one that doesn't exist, and a fuzzy one; parts are entities, deliveries relations, lines claims, orders evidence."""
    entities = search._entities(spark, sf_dir)
    relations = domain.relations(spark, sf_dir).select(F.concat_ws(">", "source", "target").alias("id"), "source", "target")
    lines = table(spark, sf_dir, "lineitem")
    relation = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(">p"), F.col("l_partkey").cast("string"))
    claim = F.concat(F.lit("c"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string"))
    subject = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).otherwise(relation)
    claims = lines.select(claim.alias("id"), F.when(F.col("l_linenumber") == 1, F.lit("entity")).otherwise(F.lit("relation")).alias("subject_kind"), subject.alias("subject")).distinct()
    of = lambda kind, item: lines.select(F.lit(kind).alias("kind"), item.alias("item"), F.concat(F.lit("corpus"), (F.col("l_orderkey") % 3).cast("string")).alias("source"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0").alias("unit"))
    evidence = of("relation", relation).unionByName(of("claim", claim))
    known = table(spark, sf_dir, "embeddings").where("vec_id > 0").select("vec_id", F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    query = search._query(spark, sf_dir)
    out = None
    for name, title, type_, fuzzy in [("title", "red widget", "", False), ("identity", "red widget", "ECONOMY", False), ("unknown", "no such title", "", False), ("fuzzy", "red widget", "", True)]:
        rows = recall(entities, known, relations, claims, evidence, title, type_, query, fuzzy).withColumn("asked", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 5))


QUERIES = {"memory_recall": memory_recall}

_ASKED = """
a(asked, title, type_, fuzzy) AS (VALUES ('title', 'red widget', '', false), ('identity', 'red widget', 'ECONOMY', false), ('unknown', 'no such title', '', false), ('fuzzy', 'red widget', '', true))"""

ORACLE_SQL = {
    "memory_recall": f"""WITH {domain.RELATIONS_SQL.strip()}, {_ASKED.strip()},
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
ex AS (SELECT asked, 'p' || p_partkey AS id, 1.0 AS score, CASE WHEN type_ = '' THEN 'exact_title' ELSE 'exact_identity' END AS reason, row_number() OVER (PARTITION BY asked ORDER BY p_type, 'p' || p_partkey) AS place, count(*) OVER (PARTITION BY asked) > 10 AS truncated
  FROM a JOIN part ON p_name = title AND (type_ = '' OR p_type = type_) WHERE NOT fuzzy),
ne AS (SELECT 'p' || vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, 'p' || vec_id) AS place, count(*) OVER () > 10 AS truncated FROM embeddings, q WHERE vec_id > 0 AND 'p' || vec_id IN (SELECT 'p' || p_partkey FROM part)),
en AS (SELECT asked, id, score, reason, place, truncated FROM ex WHERE place <= 10 UNION ALL SELECT asked, id, score, 'semantic_match', place, truncated FROM a, ne WHERE place <= 10 AND asked NOT IN (SELECT asked FROM ex)),
rl AS (SELECT DISTINCT asked, source || '>' || target AS id FROM en JOIN relations r ON en.id = r.source OR en.id = r.target),
re AS (SELECT asked, id, row_number() OVER (PARTITION BY asked ORDER BY id) AS place, count(*) OVER (PARTITION BY asked) > 20 AS truncated FROM rl QUALIFY place <= 20),
su AS (SELECT asked, 'entity' AS kind, id FROM en UNION ALL SELECT asked, 'relation', id FROM re),
li AS (SELECT 'c' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || l_linenumber AS claim, 's' || l_suppkey || '>p' || l_partkey AS relation, CASE WHEN l_linenumber = 1 THEN 'entity' ELSE 'relation' END AS kind,
  CASE WHEN l_linenumber = 1 THEN 'p' || l_partkey ELSE 's' || l_suppkey || '>p' || l_partkey END AS subject, 'corpus' || l_orderkey % 3 || '/' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS unit FROM lineitem),
cl AS (SELECT DISTINCT asked, claim AS id FROM su JOIN li ON li.kind = su.kind AND li.subject = su.id),
ce AS (SELECT asked, id, row_number() OVER (PARTITION BY asked ORDER BY id) AS place, count(*) OVER (PARTITION BY asked) > 20 AS truncated FROM cl QUALIFY place <= 20),
ev AS (SELECT asked, unit AS id FROM re JOIN li ON re.id = relation UNION SELECT asked, unit FROM ce JOIN li ON ce.id = claim),
ee AS (SELECT asked, id, row_number() OVER (PARTITION BY asked ORDER BY id) AS place, count(*) OVER (PARTITION BY asked) > 50 AS truncated FROM ev QUALIFY place <= 50)
SELECT 'entity' AS item_kind, place, id AS item, round(score, 5) AS score, reason, truncated, asked FROM en
UNION ALL SELECT 'relation', place, id, 0.0, 'connected_to_entity', truncated, asked FROM re UNION ALL SELECT 'claim', place, id, 0.0, 'about_subject', truncated, asked FROM ce UNION ALL SELECT 'evidence', place, id, 0.0, 'evidence', truncated, asked FROM ee""",
}
