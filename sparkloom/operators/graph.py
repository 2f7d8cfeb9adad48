"""Property graphs as node and edge tables: degrees, neighbourhoods, components, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.plans import domain
from sparkloom.plans.domain import REGION_EDGES_SQL, RELATIONS_SQL
from sparkloom.session import checkpointed, dropped, table, tasks_for, written


def undirected(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per pair of nodes, ends in order; of parallel edges the last by position stays, weights aren't added. With `tasks` the edges are dealt to so many by their first end."""
    ordered = edges.select("pos", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight")
    ordered = ordered.repartition(tasks, "source") if tasks else ordered
    return ordered.groupBy("source", "target").agg(F.max_by("weight", "pos").alias("weight"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Number of edge ends at each node, of those in `nodes` (node) if they are given; a loop counts twice."""
    if nodes is not None:
        ends = [edges.select(F.col(x).alias("node")).join(nodes, "node", "left_semi") for x in ("source", "target")]
        return ends[0].unionByName(ends[1]).groupBy("node").agg(F.count("*").alias("degree"))
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def combined_degrees(edges: DataFrame, degree: DataFrame | None = None) -> DataFrame:
    """Each edge with the sum of its ends' degrees (node, degree), those among the edges if none are given."""
    degree = degrees(edges) if degree is None else degree
    source, target = degree.toDF("source", "source_degree"), degree.toDF("target", "target_degree")
    return edges.join(source, "source").join(target, "target").withColumn("combined_degree", F.col("source_degree") + F.col("target_degree"))


def top_entities(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.orderBy(F.col("degree").desc(), "node").limit(most)


def top_relations(edges: DataFrame, most: int) -> DataFrame:
    """The first edges by combined degree, weight and ends."""
    return combined_degrees(edges).orderBy(F.col("combined_degree").desc(), F.col("weight").desc(), "source", "target").limit(most)


def neighborhood(edges: DataFrame, center: str, most: int) -> DataFrame:
    """The centre's first edges in relation order, and the neighbours they lead to, with degrees; the centre is place 0."""
    near = edges.where((F.col("source") == center) | (F.col("target") == center)).orderBy(F.col("weight").desc(), "source", "target").limit(most)
    ends = near.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    order = W.orderBy(F.col("node") != center, F.col("degree").desc(), "node")  # at most 2 * most rows
    return ends.join(degrees(edges), "node").withColumn("place", F.row_number().over(order).cast("long") - 1)


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among nodes (node): a semi-join on either end, without an OR join."""
    named = nodes.select("node").distinct()
    by_source = edges.join(named.withColumnRenamed("node", "source"), "source", "left_semi")
    by_target = edges.join(named.withColumnRenamed("node", "target"), "target", "left_semi").join(named.withColumnRenamed("node", "source"), "source", "left_anti")
    return by_source.unionByName(by_target)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return edges


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no node."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(nodes, "node", "left_anti")


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
    least = both.groupBy("u").agg(F.min("v").alias("w")).selectExpr("u", "least(u, w) AS m")
    large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v")
    return small.unionByName(least.selectExpr("u", "m AS v")).distinct()


def star_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the least node it is connected with.

    Rows with a null end, loops and repeated edges do nothing. Each round replaces an edge by edges to the
    least neighbour, until all are stars; rounds are logarithmic in practice, and each is written to the
    shared folder. Nodes that many edges meet are aggregated before the shuffle and split in the joins.
    """
    now = written(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    mark = None
    for number in range(most_rounds):
        was, mark = mark, now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark or not mark[0]:
            break
        now, before = (written if number % 3 == 2 else checkpointed)(_star_round(now)), now  # estimates multiply through checkpoints, not through tables
        dropped(before)
    else:
        raise RuntimeError("the components have not settled")
    return now.selectExpr("u AS node", "v AS root").unionByName(now.selectExpr("v AS node", "v AS root").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every end of the edges (source, target)."""
    roots = star_components(edges.selectExpr("source AS u", "target AS v"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).where("node IS NOT NULL").distinct()
    return ends.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds `place`, numbers from 0 in the order of columns that tell all rows apart, without bringing all rows to one task.

    Range partitions are counted, and only their counts, a row per partition, are put in line.
    """
    parts = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    base = parts.groupBy("_part").count().select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_base"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_within", within).join(base, "_part").withColumn("place", F.col("_base") + F.col("_within") - 1).drop("_part", "_within", "_base")


def numbered_within(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds `place`, numbers from 0 within each key in an order that tells its rows apart; the rows of a key lie in many partitions."""
    placed = numbered(rows, *keys, *order)
    first = placed.groupBy(*keys).agg(F.min("place").alias("_first"))
    return placed.join(first, keys).withColumn("place", F.col("place") - F.col("_first")).drop("_first")


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the largest component; of equally large ones, that of the node met first (sources in edge order, then targets)."""
    labels = connected_components(edges)
    met = edges.select(F.lit(0).alias("end"), "pos", F.col("source").alias("node")).unionByName(edges.select(F.lit(1).alias("end"), "pos", F.col("target").alias("node")))
    sized = met.join(labels, "node").groupBy("component").agg(F.count_distinct("node").alias("size"), F.min(F.struct("end", "pos")).alias("first"))
    best = sized.orderBy(F.col("size").desc(), "first").limit(1).select("component")
    return labels.join(best, "component", "left_semi").select("node", "component")


def _between(edges: DataFrame, parts: DataFrame, tasks: int | None) -> DataFrame:
    """(source_part, target_part, weight): the weight of all edges between two parts, in one pass over the edges. With `tasks` they are dealt to so many at either end."""
    placed = edges
    for end in ("source", "target"):
        placed = (placed.repartition(tasks, end) if tasks else placed).join(parts.toDF(end, f"{end}_part"), end)
    return checkpointed(placed.groupBy("source_part", "target_part").agg(F.sum("weight").alias("weight")))


def _inside():
    return F.sum(F.when(F.col("source_part") == F.col("target_part"), F.col("weight")).otherwise(0.0)).alias("inside")


def modularity(edges: DataFrame, parts: DataFrame, gamma: float = 1.0, tasks: int | None = None) -> DataFrame:
    """One row: Newman modularity of a partition (node, part) of an undirected weighted graph (source, target, weight)."""
    between = _between(edges, parts, tasks)
    inside = between.agg(_inside(), F.sum("weight").alias("m"))
    mass = between.select(F.explode(F.array("source_part", "target_part")).alias("part"), "weight").groupBy("part").agg(F.sum("weight").alias("mass"))
    squares = mass.agg(F.sum(F.col("mass") * F.col("mass")).alias("squares"))
    return inside.join(squares, how="cross").select((F.col("inside") / F.col("m") - gamma * F.col("squares") / (4 * F.col("m") * F.col("m"))).alias("modularity"))  # two single rows


def cpm_quality(edges: DataFrame, parts: DataFrame, gamma: float, tasks: int | None = None) -> DataFrame:
    """One row: weight inside the parts minus gamma / 2 times the squares of their sizes."""
    inside = _between(edges, parts, tasks).agg(_inside())
    squares = parts.groupBy("part").count().agg(F.sum(F.col("count") * F.col("count")).alias("squares"))
    return inside.join(squares, how="cross").select((F.col("inside") - gamma / 2 * F.col("squares")).alias("quality"))  # two single rows


def community_ids(members: DataFrame) -> DataFrame:
    """(part, size, community_id): SHA-256 over the sorted members, each with its length as eight bytes before it."""
    ordered = F.array_sort(F.collect_list("node"))
    joined = F.aggregate(ordered, F.unhex(F.lit("")), lambda acc, x: F.concat(acc, T.length_prefixed(x)))
    return members.groupBy("part").agg(F.count("*").alias("size"), F.sha2(joined, 256).alias("community_id"))


def _relations(spark, sf_dir):
    return domain.relations(spark, sf_dir)


def _parts_by_brand(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("part"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("part"))
    return parts.unionByName(suppliers)


def graph_edge_normalize(spark, sf_dir):
    edges = _relations(spark, sf_dir)
    back = edges.select((F.col("pos") + 1_000_000_000).alias("pos"), F.col("target").alias("source"), F.col("source").alias("target"), (F.col("weight") + 1).alias("weight")).where("weight > 30")
    return undirected(edges.unionByName(back))


def graph_degree(spark, sf_dir):
    return degrees(_relations(spark, sf_dir))


def graph_combined_degree(spark, sf_dir):
    return combined_degrees(_relations(spark, sf_dir)).select("source", "target", "weight", "combined_degree")


def graph_entity_browse(spark, sf_dir):
    named = table(spark, sf_dir, "part").where(F.lower("p_name").contains("widget")).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_name").alias("title"))
    return top_entities(degrees(_relations(spark, sf_dir)).join(named, "node"), 50)


def graph_relation_rank(spark, sf_dir):
    return top_relations(_relations(spark, sf_dir), 100).select("source", "target", "weight", "combined_degree")


def graph_neighborhood(spark, sf_dir):
    return neighborhood(_relations(spark, sf_dir), "s1", 25)


def graph_touching(spark, sf_dir):
    edges = _relations(spark, sf_dir)
    return touching(edges, edges.select(F.explode(F.array("source", "target")).alias("node")).where("node IN ('s1', 's2', 'p10', 'p11')")).select("source", "target", "weight")


def graph_induced(spark, sf_dir):
    edges = _relations(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).where("substring(node, 2) % 7 = 0")
    return induced(edges, nodes).select("source", "target", "weight")


def graph_dangling(spark, sf_dir):
    return dangling(_relations(spark, sf_dir), _parts_by_brand(spark, sf_dir).where("part <> 'Brand#3'").select("node"))


def graph_components(spark, sf_dir):
    return connected_components(domain.region_edges(spark, sf_dir))


def graph_largest_component(spark, sf_dir):
    return largest_component(domain.region_edges(spark, sf_dir))


def graph_modularity(spark, sf_dir):
    tasks = tasks_for(table(spark, sf_dir, "lineitem"))
    return modularity(undirected(_relations(spark, sf_dir), tasks), _parts_by_brand(spark, sf_dir), tasks=tasks).select(F.round("modularity", 6).alias("modularity"))


def graph_cpm_quality(spark, sf_dir):
    tasks = tasks_for(table(spark, sf_dir, "lineitem"))
    return cpm_quality(undirected(_relations(spark, sf_dir), tasks), _parts_by_brand(spark, sf_dir), 0.05, tasks).select(F.round("quality", 3).alias("quality"))


def graph_community_identity(spark, sf_dir):
    return community_ids(_parts_by_brand(spark, sf_dir))


def graph_partition_stats(spark, sf_dir):
    sizes = _parts_by_brand(spark, sf_dir).groupBy("part").count()
    return sizes.agg(F.count("*").alias("parts"), F.min("count").alias("least"), F.max("count").alias("most"), F.sum("count").alias("nodes"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_edge_normalize, graph_degree, graph_combined_degree, graph_entity_browse, graph_relation_rank, graph_neighborhood, graph_touching, graph_induced, graph_dangling, graph_components,
        graph_largest_component, graph_modularity, graph_cpm_quality, graph_community_identity, graph_partition_stats,
    )
}

_DEGREES = f"{RELATIONS_SQL}, ends AS (SELECT source AS node FROM relations UNION ALL SELECT target FROM relations), degrees AS (SELECT node, count(*) AS degree FROM ends GROUP BY node)"
_COMBINED = f"{_DEGREES}, combined AS (SELECT r.source, r.target, r.weight, a.degree + b.degree AS combined_degree FROM relations r JOIN degrees a ON r.source = a.node JOIN degrees b ON r.target = b.node)"
_PARTS = "parts AS (SELECT 'p' || p_partkey AS node, p_brand AS part FROM part UNION ALL SELECT 's' || s_suppkey, 'Brand#' || (s_suppkey % 25 + 1) FROM supplier)"
_PLACED = f"{RELATIONS_SQL}, {_PARTS}, placed AS (SELECT r.weight, a.part AS a, b.part AS b FROM relations r JOIN parts a ON r.source = a.node JOIN parts b ON r.target = b.node)"
_COMPONENTS = f"WITH RECURSIVE {REGION_EDGES_SQL}, both_ AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), reach AS (SELECT source AS node, source AS label FROM both_ UNION SELECT b.target, r.label FROM reach r JOIN both_ b ON b.source = r.node), labels AS (SELECT node, min(label) AS component FROM reach GROUP BY node)"

ORACLE_SQL = {
    "graph_community_identity": f"WITH {_PARTS} SELECT part, count(*) AS size, sha256(unhex(string_agg(printf('%016x', octet_length(encode(node))) || hex(encode(node)), '' ORDER BY node))) AS community_id FROM parts GROUP BY part",
    "graph_edge_normalize": f"WITH {RELATIONS_SQL}, both_ AS (SELECT * FROM relations UNION ALL SELECT pos + 1000000000, target, source, weight + 1 FROM relations WHERE weight + 1 > 30) SELECT least(source, target) AS source, greatest(source, target) AS target, max_by(weight, pos) AS weight FROM both_ GROUP BY 1, 2",
    "graph_degree": f"WITH {_DEGREES} SELECT * FROM degrees",
    "graph_combined_degree": f"WITH {_COMBINED} SELECT * FROM combined",
    "graph_entity_browse": f"WITH {_DEGREES} SELECT node, degree, p_name AS title FROM degrees JOIN part ON node = 'p' || p_partkey WHERE contains(lower(p_name), 'widget') ORDER BY degree DESC, node LIMIT 50",
    "graph_relation_rank": f"WITH {_COMBINED} SELECT * FROM combined ORDER BY combined_degree DESC, weight DESC, source, target LIMIT 100",
    "graph_neighborhood": f"WITH {_DEGREES}, near AS (SELECT * FROM relations WHERE source = 's1' OR target = 's1' ORDER BY weight DESC, source, target LIMIT 25), n AS (SELECT source AS node FROM near UNION SELECT target FROM near) SELECT node, degree, row_number() OVER (ORDER BY node <> 's1', degree DESC, node) - 1 AS place FROM n JOIN degrees USING (node)",
    "graph_touching": f"WITH {RELATIONS_SQL} SELECT source, target, weight FROM relations WHERE source IN ('s1', 's2') OR target IN ('p10', 'p11')",
    "graph_induced": f"WITH {RELATIONS_SQL} SELECT source, target, weight FROM relations WHERE substr(source, 2)::INT % 7 = 0 AND substr(target, 2)::INT % 7 = 0",
    "graph_dangling": f"WITH {RELATIONS_SQL}, {_PARTS} SELECT node FROM (SELECT source AS node FROM relations UNION SELECT target FROM relations) WHERE node NOT IN (SELECT node FROM parts WHERE part <> 'Brand#3')",
    "graph_components": f"{_COMPONENTS} SELECT node, component FROM labels",
    "graph_largest_component": f"{_COMPONENTS}, met AS (SELECT 0 AS e, pos, source AS node FROM edges UNION ALL SELECT 1, pos, target FROM edges), best AS (SELECT component FROM met JOIN labels USING (node) GROUP BY component ORDER BY count(DISTINCT node) DESC, min((e, pos)) LIMIT 1) SELECT node, component FROM labels WHERE component IN (SELECT component FROM best)",
    "graph_modularity": f"WITH {_PLACED}, m AS (SELECT sum(weight) AS m, sum(weight) FILTER (a = b) AS inside FROM placed), k AS (SELECT sum(mass * mass) AS squares FROM (SELECT sum(weight) AS mass FROM (SELECT a AS part, weight FROM placed UNION ALL SELECT b, weight FROM placed) GROUP BY part)) SELECT round(inside / m - squares / (4 * m * m), 6) AS modularity FROM m, k",
    "graph_cpm_quality": f"WITH {_PLACED}, i AS (SELECT sum(weight) FILTER (a = b) AS inside FROM placed), q AS (SELECT sum(n * n) AS squares FROM (SELECT count(*) AS n FROM parts GROUP BY part)) SELECT round(inside - 0.025 * squares, 3) AS quality FROM i, q",
    "graph_partition_stats": f"WITH {_PARTS}, s AS (SELECT count(*) AS n FROM parts GROUP BY part) SELECT count(*) AS parts, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS nodes FROM s",
}
