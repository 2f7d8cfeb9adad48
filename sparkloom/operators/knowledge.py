"""Versioned knowledge: immutable formal versions, conflict candidates, tombstones, provenance and manifests.

Versions are rows (zone_id, id, version, candidate_number, deleted, content_hash, ...). What is current is derived:
the greatest formal version first, and only then are tombstones dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.plans import domain
from sparkloom.plans.domain import VERSIONS_SQL

KEY = ["zone_id", "id"]


def latest(versions: DataFrame) -> DataFrame:
    """The greatest formal version of every id, tombstones included; an aggregate, so it combines before the shuffle."""
    rest = [c for c in versions.columns if c not in KEY]
    formal = versions.where("candidate_number = 0").withColumn("_row", F.struct("version", *[c for c in rest if c != "version"]))
    return formal.groupBy(*KEY).agg(F.max_by("_row", "version").alias("_row")).select(*KEY, *[F.col(f"_row.{c}").alias(c) for c in rest])


def active(versions: DataFrame) -> DataFrame:
    return latest(versions).where("NOT deleted")


def history_page(versions: DataFrame, after: str, most: int) -> DataFrame:
    """Formal versions of the ids after a cursor, a page of `most` ids; `has_more` tells of further ones."""
    ids = versions.where((F.col("candidate_number") == 0) & (F.col("id") > after)).select("id").distinct().orderBy("id").limit(most + 1)
    place = ids.withColumn("place", F.row_number().over(W.orderBy("id"))).withColumn("has_more", F.max("place").over(W.partitionBy(F.lit(0))) > most)  # a page
    return versions.where("candidate_number = 0").join(place.where(F.col("place") <= most), "id").select("id", "version", "deleted", "has_more")


def exact_versions(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """The formal versions of wanted (ordinal, id, version), with `found` false where there is none."""
    have = versions.where("candidate_number = 0").select("id", "version", "content_hash")
    return wanted.join(have, ["id", "version"], "left").withColumn("found", F.col("content_hash").isNotNull())


def conflict_view(versions: DataFrame) -> DataFrame:
    """Per id with candidates at its current version: how many, and their distinct contents other than the current one."""
    current = latest(versions).select(*KEY, "version", F.col("content_hash").alias("current_hash"))
    candidates = versions.where("candidate_number > 0").join(current, [*KEY, "version"])
    return candidates.groupBy(*KEY, "version").agg(
        F.count("*").alias("candidates"), F.count_distinct(F.when(F.col("content_hash") != F.col("current_hash"), F.col("content_hash"))).alias("contents"), F.max("candidate_number").alias("last_number")
    )


def submission(offered: DataFrame, versions: DataFrame) -> DataFrame:
    """What submitting (id, content_hash) does to each: create, confirm (same content), reuse (an open candidate has it) or candidate.

    A tombstone is not revived: what is offered for it becomes a candidate at its version.
    New candidates are numbered on from the last one of their base version.
    """
    current = latest(versions).select("id", F.col("version").alias("base"), F.col("content_hash").alias("current_hash"), "deleted")
    open_ = versions.where("candidate_number > 0").groupBy("id", F.col("version").alias("base"), "content_hash").agg(F.min("candidate_number").alias("open_number"))
    last = versions.groupBy("id", F.col("version").alias("base")).agg(F.max("candidate_number").alias("last_number"))
    joined = offered.join(current, "id", "left").join(open_, ["id", "base", "content_hash"], "left").join(last, ["id", "base"], "left")
    outcome = (
        F.when(F.col("base").isNull(), "create")
        .when((F.col("content_hash") == F.col("current_hash")) & ~F.col("deleted"), "confirm")
        .when(F.col("open_number").isNotNull(), "reuse")
        .otherwise("candidate")
    )
    order = F.row_number().over(W.partitionBy("id", "outcome").orderBy("content_hash"))
    number = F.when(F.col("outcome") == "reuse", F.col("open_number")).when(F.col("outcome") == "candidate", F.col("last_number") + F.col("order")).when(F.col("outcome") == "create", F.col("order") - 1).otherwise(0)
    return joined.withColumn("outcome", outcome).withColumn("order", order).select("id", "content_hash", "outcome", F.coalesce("base", F.lit(1)).cast("long").alias("version"), number.cast("long").alias("number"))


def resolve(expected: DataFrame, candidates: DataFrame, versions: DataFrame) -> DataFrame:
    """Optimistic resolution of expected (id, base, content_hash) that was decided in view of candidates (id, content_hash, source_id): `stale`
    (version 0) if the base or the set of open candidates, contents and sources, is no longer the same, `appended` a next version if the content differs or the
    current one is a tombstone, else `confirmed`."""
    current = latest(versions).select("id", "version", F.col("content_hash").alias("current_hash"), "deleted")
    columns = ["id", "version", "content_hash", "source_id"]
    bases = expected.select("id", F.col("base").alias("version"))
    seen = candidates.join(bases, "id").select(*columns).distinct().withColumn("seen", F.lit(1))
    open_ = versions.where("candidate_number > 0").join(bases, ["id", "version"], "left_semi").select(*columns).distinct().withColumn("open", F.lit(1))
    same = [F.col(f"seen_.{x}").eqNullSafe(F.col(f"open_.{x}")) for x in columns]
    both = seen.alias("seen_").join(open_.alias("open_"), same, "full")
    moved = both.where("seen IS NULL OR open IS NULL").select(F.coalesce("seen_.id", "open_.id").alias("id")).distinct().withColumn("moved", F.lit(True))
    joined = expected.join(current, "id", "left").join(moved, "id", "left")
    fresh = F.col("base").eqNullSafe(F.col("version")) & F.col("moved").isNull()
    changed = F.col("deleted") | (F.col("content_hash") != F.col("current_hash"))
    outcome = F.when(~fresh, "stale").when(changed, "appended").otherwise("confirmed")
    return joined.select("id", outcome.alias("outcome"), F.when(fresh, F.col("version") + changed.cast("int")).otherwise(0).cast("long").alias("version"))


def deletable(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities that no active relation refers to."""
    used = relations.select(F.explode(F.array("source", "target")).alias("id"))
    return entities.join(used, "id", "left_anti")


def provenance(versions: DataFrame) -> DataFrame:
    """Per id and formal version: confirmations' frequencies summed, evidence as a canonical set.

    The confirmations of version N are its own source and those of accepted candidates: candidates at N - 1 with N's content.
    """
    formal = versions.where("candidate_number = 0").select("id", "version", "content_hash", "source_id", "frequency")
    accepted = versions.where("candidate_number > 0").select("id", (F.col("version") + 1).alias("version"), "content_hash", "source_id", "frequency")
    accepted = accepted.join(formal.select("id", "version", "content_hash"), ["id", "version", "content_hash"])
    confirmed = formal.unionByName(accepted).select("id", "version", "source_id", "frequency").distinct()
    return confirmed.groupBy("id", "version").agg(F.sum("frequency").alias("frequency"), F.array_sort(F.collect_set("source_id")).alias("sources"))


def manifest(versions: DataFrame) -> DataFrame:
    """Per zone the active references, their number and the SHA-256 over id@version in order of id."""
    refs = active(versions).select("zone_id", T.reference(F.col("id"), F.col("version")).alias("ref"))
    return refs.groupBy("zone_id").agg(F.count("*").alias("refs"), T.set_digest(F.array_sort(F.collect_list("ref"))).alias("digest"))


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: ids added, removed and re-versioned between two manifests (id, version)."""
    both = before.select("id", F.col("version").alias("old")).join(after.select("id", F.col("version").alias("new")), "id", "full_outer")
    return both.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old") != F.col("new")).alias("changed"))


def merge_zones(child: DataFrame, parent: DataFrame) -> DataFrame:
    """How a child's active versions meet the parent's by natural identity: new (parent_version 0), equal (supported) or conflict (opened in the child)."""
    theirs = parent.select("id", F.col("version").alias("parent_version"), F.col("content_hash").alias("parent_hash"))
    outcome = F.when(F.col("parent_hash").isNull(), "new").when(F.col("parent_hash") == F.col("content_hash"), "equal").otherwise("conflict")
    return child.join(theirs, "id", "left").select("id", "version", F.coalesce("parent_version", F.lit(0)).alias("parent_version"), outcome.alias("outcome"))


def replay_guard(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Submissions by source: `replayed` if the same content is stored under the source, `conflict` if another, else `new`."""
    old = stored.select("source_id", F.col("content_hash").alias("stored_hash"))
    outcome = F.when(F.col("stored_hash").isNull(), "new").when(F.col("stored_hash") == F.col("content_hash"), "replayed").otherwise("conflict")
    return offered.join(old, "source_id", "left").select("source_id", outcome.alias("outcome"))


def normalized_submission(items: DataFrame) -> DataFrame:
    """items: id, content_hash, frequency, source_id. One row per identity and content, variants in the order of their content."""
    grouped = items.groupBy("id", "content_hash").agg(F.sum("frequency").alias("frequency"), F.array_sort(F.collect_set("source_id")).alias("evidence"))
    return grouped.withColumn("variant", F.row_number().over(W.partitionBy("id").orderBy("content_hash")).cast("long"))


def _v(spark, sf_dir):
    return domain.versions(spark, sf_dir)


def _offered(versions: DataFrame) -> DataFrame:
    """Every content, offered for its own identity, for a new one, and for another with a changed content."""
    some = versions.select("id", "content_hash")
    new = some.select(F.concat(F.lit("new-"), "id").alias("id"), "content_hash")
    other = some.select("id", F.sha2(F.concat("content_hash", F.lit("?")), 256).alias("content_hash"))
    return some.unionByName(new).unionByName(other).distinct()


_OFFERED_SQL = "some_ AS (SELECT id, content_hash FROM versions), offered AS (SELECT * FROM some_ UNION SELECT 'new-' || id, content_hash FROM some_ UNION SELECT id, sha256(content_hash || '?') FROM some_)"
_LATEST_SQL = f"{VERSIONS_SQL}, latest AS (SELECT * FROM versions WHERE candidate_number = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1)"


def entity_latest(spark, sf_dir):
    return latest(_v(spark, sf_dir)).select("zone_id", "id", "version", "deleted", "content_hash")


def entity_active_refs(spark, sf_dir):
    return active(_v(spark, sf_dir)).select("zone_id", T.reference(F.col("id"), F.col("version")).alias("ref"))


def entity_history(spark, sf_dir):
    return history_page(_v(spark, sf_dir), "u2", 20)


def entity_exact_versions(spark, sf_dir):
    versions = _v(spark, sf_dir)
    wanted = latest(versions).select(F.col("zone_id").alias("ordinal"), "id", F.explode(F.array(F.col("version") - 1, F.col("version") + 1)).alias("version"))
    return exact_versions(versions, wanted).select("id", "version", "found")


def pending_conflicts(spark, sf_dir):
    return conflict_view(_v(spark, sf_dir))


def candidate_numbering(spark, sf_dir):
    return _v(spark, sf_dir).groupBy("id", "version").agg((F.max("candidate_number") + 1).alias("next_number"))


def submission_classify(spark, sf_dir):
    versions = _v(spark, sf_dir)
    return submission(_offered(versions), versions)


def submission_normalize(spark, sf_dir):
    return normalized_submission(_v(spark, sf_dir)).select("id", "content_hash", "frequency", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"), "variant")


def conflict_resolve(spark, sf_dir):
    """Every conflict is resolved with its first candidate; where the user's number is divisible by 5, one more candidate was seen than is open."""
    versions = _v(spark, sf_dir)
    view = conflict_view(versions)
    content = versions.where("candidate_number = 1").select("id", "version", "content_hash")
    expected = view.join(content, ["id", "version"]).select("id", F.col("version").alias("base"), "content_hash")
    seen = versions.where("candidate_number > 0").join(view.select("id", "version"), ["id", "version"], "left_semi").select("id", "content_hash", "source_id")
    more = expected.where(F.substring("id", 2, 9).cast("int") % 5 == 0).select("id", F.lit("another").alias("content_hash"), F.lit(0).cast("long").alias("source_id"))
    return resolve(expected, seen.unionByName(more), versions)


def provenance_entity(spark, sf_dir):
    return provenance(_v(spark, sf_dir)).select("id", "version", "frequency", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


def manifest_digest(spark, sf_dir):
    return manifest(_v(spark, sf_dir))


def manifest_changes(spark, sf_dir):
    versions = _v(spark, sf_dir)
    return manifest_diff(active(versions.where("source_id % 1000 < 700")), active(versions))


def deletion_guard(spark, sf_dir):
    parts = domain.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return deletable(parts, domain.relations(spark, sf_dir).where("weight > 45"))


def zone_merge_classify(spark, sf_dir):
    versions = active(_v(spark, sf_dir))
    child = versions.where("zone_id <> 0").select(F.concat(F.lit("e"), (F.substring("id", 2, 9).cast("int") % 40).cast("string")).alias("id"), "version", "content_hash", "source_id")
    child = child.groupBy("id").agg(F.max_by(F.struct("version", "content_hash"), "source_id").alias("x")).select("id", "x.version", "x.content_hash")
    parent = versions.where("zone_id = 0").select(F.concat(F.lit("e"), (F.substring("id", 2, 9).cast("int") % 40).cast("string")).alias("id"), "version", "content_hash")
    return merge_zones(child, parent.groupBy("id").agg(F.max("version").alias("version"), F.max("content_hash").alias("content_hash")))


def source_replay(spark, sf_dir):
    versions = _v(spark, sf_dir).select("source_id", "content_hash")
    offered = versions.select((F.col("source_id") + (F.col("source_id") % 3)).alias("source_id"), "content_hash").groupBy("source_id").agg(F.min("content_hash").alias("content_hash"))
    return replay_guard(versions, offered)


QUERIES = {
    f.__name__: f
    for f in (
        entity_latest, entity_active_refs, entity_history, entity_exact_versions, pending_conflicts, candidate_numbering, submission_classify, submission_normalize,
        conflict_resolve, provenance_entity, manifest_digest, manifest_changes, deletion_guard, zone_merge_classify, source_replay,
    )
}

_VIEW_SQL = "view_ AS (SELECT v.zone_id, v.id, v.version, count(*) AS candidates, count(DISTINCT v.content_hash) FILTER (v.content_hash <> l.content_hash) AS contents, max(v.candidate_number) AS last_number FROM versions v JOIN latest l ON v.id = l.id AND v.version = l.version WHERE v.candidate_number > 0 GROUP BY ALL)"

ORACLE_SQL = {
    "entity_latest": f"WITH {_LATEST_SQL} SELECT zone_id, id, version, deleted, content_hash FROM latest",
    "entity_active_refs": f"WITH {_LATEST_SQL} SELECT zone_id, id || '@' || version AS ref FROM latest WHERE NOT deleted",
    "entity_history": f"WITH {VERSIONS_SQL}, ids AS (SELECT id, row_number() OVER (ORDER BY id) AS place, count(*) OVER () > 20 AS has_more FROM (SELECT DISTINCT id FROM versions WHERE candidate_number = 0 AND id > 'u2')) SELECT id, version, deleted, has_more FROM versions JOIN ids USING (id) WHERE candidate_number = 0 AND place <= 20",
    "entity_exact_versions": f"WITH {_LATEST_SQL}, wanted AS (SELECT id, version + unnest([-1, 1]) AS version FROM latest) SELECT w.id, w.version, v.id IS NOT NULL AS found FROM wanted w LEFT JOIN versions v ON v.id = w.id AND v.version = w.version AND candidate_number = 0",
    "pending_conflicts": f"WITH {_LATEST_SQL}, {_VIEW_SQL} SELECT * FROM view_",
    "candidate_numbering": f"WITH {VERSIONS_SQL} SELECT id, version, max(candidate_number) + 1 AS next_number FROM versions GROUP BY ALL",
    "submission_classify": f"""WITH {_LATEST_SQL}, {_OFFERED_SQL},
j AS (SELECT o.id, o.content_hash, l.version AS base, l.content_hash AS current_hash, l.deleted,
  (SELECT min(candidate_number) FROM versions v WHERE v.id = o.id AND v.version = l.version AND v.content_hash = o.content_hash AND candidate_number > 0) AS open_number,
  (SELECT max(candidate_number) FROM versions v WHERE v.id = o.id AND v.version = l.version) AS last_number FROM offered o LEFT JOIN latest l ON o.id = l.id),
k AS (SELECT *, CASE WHEN base IS NULL THEN 'create' WHEN content_hash = current_hash AND NOT deleted THEN 'confirm' WHEN open_number IS NOT NULL THEN 'reuse' ELSE 'candidate' END AS outcome FROM j),
n AS (SELECT *, row_number() OVER (PARTITION BY id, outcome ORDER BY content_hash) AS order_ FROM k)
SELECT id, content_hash, outcome, coalesce(base, 1) AS version, CASE outcome WHEN 'reuse' THEN open_number WHEN 'candidate' THEN last_number + order_ WHEN 'create' THEN order_ - 1 ELSE 0 END AS number FROM n""",
    "submission_normalize": f"WITH {VERSIONS_SQL}, g AS (SELECT id, content_hash, CAST(sum(frequency) AS BIGINT) AS frequency, string_agg(source_id::VARCHAR, ',' ORDER BY source_id) AS evidence FROM versions GROUP BY id, content_hash) SELECT *, row_number() OVER (PARTITION BY id ORDER BY content_hash) AS variant FROM g",
    "conflict_resolve": f"""WITH {_LATEST_SQL}, {_VIEW_SQL},
e AS (SELECT w.id, w.version AS base, w.candidates AS open, w.candidates + CAST(substr(w.id, 2)::INT % 5 = 0 AS INT) AS candidates, v.content_hash FROM view_ w JOIN versions v ON v.id = w.id AND v.version = w.version AND v.candidate_number = 1)
SELECT e.id, CASE WHEN e.open <> e.candidates THEN 'stale' WHEN l.deleted OR e.content_hash <> l.content_hash THEN 'appended' ELSE 'confirmed' END AS outcome,
  CASE WHEN e.open = e.candidates THEN l.version + CAST(l.deleted OR e.content_hash <> l.content_hash AS INT) ELSE 0 END AS version FROM e JOIN latest l ON e.id = l.id""",
    "provenance_entity": f"WITH {VERSIONS_SQL}, f AS (SELECT * FROM versions WHERE candidate_number = 0), c AS (SELECT id, version, source_id, frequency FROM f UNION SELECT f.id, f.version, a.source_id, a.frequency FROM versions a JOIN f ON a.id = f.id AND a.version + 1 = f.version AND a.content_hash = f.content_hash WHERE a.candidate_number > 0) SELECT id, version, CAST(sum(frequency) AS BIGINT) AS frequency, string_agg(source_id::VARCHAR, ',' ORDER BY source_id) AS sources FROM c GROUP BY id, version",
    "manifest_digest": f"WITH {_LATEST_SQL} SELECT zone_id, count(*) AS refs, sha256(string_agg(id || '@' || version || chr(0), '' ORDER BY id || '@' || version)) AS digest FROM latest WHERE NOT deleted GROUP BY zone_id",
    "manifest_changes": f"""WITH {VERSIONS_SQL},
b AS (SELECT * FROM (SELECT * FROM versions WHERE candidate_number = 0 AND source_id % 1000 < 700 QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) WHERE NOT deleted),
a AS (SELECT * FROM (SELECT * FROM versions WHERE candidate_number = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) WHERE NOT deleted)
SELECT count(*) FILTER (b.id IS NULL) AS added, count(*) FILTER (a.id IS NULL) AS removed, count(*) FILTER (a.version <> b.version) AS changed FROM a FULL OUTER JOIN b ON a.id = b.id""",
    "deletion_guard": f"WITH {domain.RELATIONS_SQL} SELECT 'p' || p_partkey AS id FROM part WHERE 'p' || p_partkey NOT IN (SELECT target FROM relations WHERE weight > 45)",
    "zone_merge_classify": f"""WITH {_LATEST_SQL}, act AS (SELECT *, 'e' || (substr(id, 2)::INT % 40) AS e FROM latest WHERE NOT deleted),
child AS (SELECT e AS id, max_by(version, source_id) AS version, max_by(content_hash, source_id) AS content_hash FROM act WHERE zone_id <> 0 GROUP BY e),
parent AS (SELECT e AS id, max(version) AS version, max(content_hash) AS content_hash FROM act WHERE zone_id = 0 GROUP BY e)
SELECT c.id, c.version, coalesce(p.version, 0) AS parent_version, CASE WHEN p.id IS NULL THEN 'new' WHEN p.content_hash = c.content_hash THEN 'equal' ELSE 'conflict' END AS outcome FROM child c LEFT JOIN parent p ON c.id = p.id""",
    "source_replay": f"WITH {VERSIONS_SQL}, o AS (SELECT source_id + source_id % 3 AS source_id, min(content_hash) AS content_hash FROM versions GROUP BY 1) SELECT o.source_id, CASE WHEN v.source_id IS NULL THEN 'new' WHEN v.content_hash = o.content_hash THEN 'replayed' ELSE 'conflict' END AS outcome FROM o LEFT JOIN versions v ON o.source_id = v.source_id",
}
