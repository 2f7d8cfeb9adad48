"""Communities of a weighted graph by Leiden, as rounds of joins over node and edge tables.

All groups of a call are clustered at once. A level settles nodes into parts by rounds of moves in which a hash
of node and round lets three in four nodes move, so that neighbours don't swap for ever. Refinement then starts
from single nodes inside each part and merges well-connected ones into well-connected refined parts, drawn
with probability proportional to exp(gain / theta). The refined parts are the nodes of the next level,
which starts from the parts they lie in. Levels end when no node wants to move.
"""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.plans import domain
from sparkloom.session import checkpointed, dropped, table, written

#: Rounds end once PATIENCE of them in a row have not raised the quality by this part of the graph's weight; the best round counts.
TOLERANCE, PATIENCE = 1e-5, 3
#: A refinement ends when fewer than this part of the nodes could still merge: the others stay nodes of their own on the next level.
LEFT_SINGLE = 0.05
#: Once no more than this part of the nodes wants to move, rounds go on in the parts that their moves would touch.
FEW = 1 / 16
THETA = 0.001
#: A checkpoint is the cheaper cut, but plans' size estimates multiply through it; every so many rounds a table is written, whose size is known.
ROUNDS_A_TABLE = 6


def _cut(df: DataFrame, number: int) -> DataFrame:
    return written(df) if number % ROUNDS_A_TABLE == 0 else checkpointed(df)


def _coin(node: str, turn: Column) -> Column:
    return F.pmod(F.xxhash64(node, turn), F.lit(4)) > 0


def _wishes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes: u, mass, resolution, part, turn; edges: u, v, w, both ways, without loops.

    A node wants the neighbouring part of most gain, w(u, part) - resolution * mass(u) * mass(part without u), if that
    exceeds its own. Adds to, the best other part, and rise, by how much it is better than its own (null: there is none); waits, whether the node and `to`
    are both single nodes of which the other one should move; and worth, the node's share of the quality.
    """
    masses = nodes.groupBy("part").agg(F.sum("mass").alias("part_mass"), (F.count("*") == 1).alias("alone"))
    placed = nodes.join(masses, "part")
    ends = placed.select(F.col("u").alias("v"), F.col("part").alias("to"), F.col("part_mass").alias("to_mass"), F.col("alone").alias("to_alone"))
    near = edges.join(ends, "v").groupBy("u", "to").agg(F.sum("w").alias("w"), F.first("to_mass").alias("to_mass"), F.first("to_alone").alias("to_alone"))
    own = F.col("to") == F.col("part")
    gain = F.round(F.col("w") - F.col("resolution") * F.col("mass") * F.col("to_mass"), 9).alias("gain")
    best = placed.join(near, "u", "left").groupBy("u").agg(
        *(F.first(x).alias(x) for x in ("mass", "resolution", "part", "turn", "part_mass", "alone")),  # the same in all rows of a node, so that the join's order serves
        F.coalesce(F.max(F.when(own, F.col("w"))), F.lit(0.0)).alias("w_own"),
        F.max(F.when(~own, F.struct(gain, F.xxhash64("to").alias("tie"), "to", "to_alone"))).alias("best"),
    )
    stay = F.round(F.col("w_own") - F.col("resolution") * F.col("mass") * (F.col("part_mass") - F.col("mass")), 9)
    return best.select(
        "u", "mass", "resolution", "part", "turn",
        F.col("best.to").alias("to"),
        (F.col("best.gain") - stay).alias("rise"),
        (F.col("alone") & F.col("best.to_alone") & (F.xxhash64("part") > F.col("best.tie"))).alias("waits"),
        (F.col("w_own") - F.col("resolution") * F.col("mass") * F.col("part_mass")).alias("worth"),
    )


def _moves(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round: nodes that want to move do so if their coin says so. Adds ends, the parts that a node wants to leave and to join (null: it wants to stay), and worth, its share of the quality before the round."""
    wants = F.coalesce(F.col("rise") > 0, F.lit(False))
    goes = wants & ~F.coalesce("waits", F.lit(False)) & _coin("u", F.col("turn"))
    moved = F.when(goes, F.col("to")).otherwise(F.col("part")).alias("part")
    return _wishes(edges, nodes).select("u", "mass", "resolution", moved, (F.col("turn") + 1).alias("turn"), F.when(wants, F.array("part", "to")).alias("ends"), "worth")


def _apart(wishes: DataFrame) -> DataFrame:
    """(u, to) of those wishes to move (u, part, to, turn) that a hash puts first at both of their parts: no two touch the same part, so that each gains all it expects."""
    ends = wishes.select("u", "to", F.explode(F.array("part", "to")).alias("at"), F.struct(F.xxhash64("u", "turn"), "u").alias("rank"))
    first = ends.groupBy("at").agg(F.min_by("u", "rank").alias("u"))
    return ends.join(first, ["at", "u"]).groupBy("u").agg(F.first("to").alias("to"), F.count("*").alias("n")).where("n = 2").select("u", "to")


def _rounds(edges: DataFrame, nodes: DataFrame, tolerance: float, weight: float, few: float = 0.0) -> tuple[DataFrame, bool, float, DataFrame | None]:
    """Rounds until no node wants to move, at most `few` of the nodes do or the quality stands still: the best state, whether it differs from the first, how much better it is, and the parts that moves
    would touch now (None: no node wants to move)."""
    states, best, first, quality = [nodes], 0, None, None
    while True:
        after = _cut(_moves(edges, states[-1]), len(states))
        seen = after.agg(F.sum("worth").alias("quality"), F.count("ends").alias("wants"), F.count("*").alias("n")).first()
        if quality is None or not seen["wants"] or (seen["quality"] or 0.0) > quality + tolerance * weight:
            best, quality = len(states) - 1, seen["quality"] or 0.0
            first = quality if first is None else first
        states.append(after)
        behind = len(states) - 2 - best
        if seen["wants"] and behind < PATIENCE and (behind or seen["wants"] > few * seen["n"]):
            if best > 1:  # only the best state and those after it are still needed
                dropped(*(x for x in states[1:best] if x is not None))
                states[1:best] = [None] * (best - 1)
            continue
        touched = written(states[best + 1].select(F.explode("ends").alias("part")).distinct()) if seen["wants"] else None
        dropped(*(x for i, x in enumerate(states) if i not in (0, best) and x is not None))
        return states[best].select("u", "mass", "resolution", "part", "turn"), best > 0, quality - first, touched


def _apart_rounds(edges: DataFrame, nodes: DataFrame, tolerance: float, weight: float) -> tuple[DataFrame, float]:
    """Rounds of moves that keep apart, so that each raises the quality, until no node wants to move or they no longer raise it by much; the state, and how much better it is."""
    total, idle = 0.0, 0
    for number in itertools.count(1):
        wished = checkpointed(_wishes(edges, nodes).where("rise > 0").select("u", "part", "to", "turn", "rise"))
        going = checkpointed(_apart(wished))
        rise = wished.join(going, "u").agg(F.sum("rise")).first()[0]
        if rise is None:
            return nodes, total
        total, idle = total + 2 * rise, idle + 1 if 2 * rise <= tolerance * weight else 0
        moved = nodes.join(going, "u", "left").select("u", "mass", "resolution", F.coalesce("to", "part").alias("part"), (F.col("turn") + 1).alias("turn"))
        nodes, before = _cut(moved, number), nodes
        dropped(wished, going, *([before] if number > 1 else []))
        if idle == PATIENCE:
            return nodes, total


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return written(edges.join(nodes.select("u"), "u", "left_semi").join(nodes.select(F.col("u").alias("v")), "v", "left_semi").select("u", "v", "w"))


def _narrowed(edges: DataFrame, nodes: DataFrame, tolerance: float, parts: DataFrame) -> tuple[DataFrame, float, float]:
    """Rounds in parts that moves would touch, with the edges among them, then in those of them that moves would still touch, and so on while these get few; last, rounds of moves that
    keep apart. The state of all nodes, how much better it is, and the weight of the first parts' edges."""
    rest, made, total, weight, n = [], [], 0.0, None, nodes.count()
    while True:
        region = written(nodes.join(parts, "part", "left_semi").select(nodes.columns))
        rest.append(written(nodes.join(parts, "part", "left_anti").select(nodes.columns)))
        n, before = region.count(), n
        inner = _among(edges, region)
        size = inner.agg(F.sum("w")).first()[0] or 0.0
        weight = size if weight is None else weight
        made += [region, inner, parts]
        nodes, _, rise, parts = _rounds(inner, region, tolerance, size, FEW if 2 * n <= before else 0.0)
        made.append(nodes)
        edges, total = inner, total + rise
        if parts is None or 2 * n > before:
            break
    if parts is not None:
        made.append(parts)
        nodes, rise = _apart_rounds(edges, nodes, tolerance, size)
        made.append(nodes)
        total += rise
    out = written(functools.reduce(DataFrame.unionByName, rest, nodes))
    dropped(*rest, *made)
    return out, total, weight


def _finished(edges: DataFrame, nodes: DataFrame, tolerance: float, parts: DataFrame) -> tuple[DataFrame, bool]:
    """What is left to move once few nodes want to or the whole graph stands still, and whether anything did: only the parts that a move would touch. The tolerance is a part of
    their own weight, not of the graph's: light parts go on until no node of theirs wants to move."""
    any_moved = False
    while True:
        after, total, weight = _narrowed(edges, nodes, tolerance, parts)
        if not total:
            dropped(after)
            return nodes, any_moved
        dropped(*([nodes] if any_moved else []))
        any_moved, nodes = True, after
        if total <= tolerance * weight:
            return nodes, True
        parts = written(_wishes(edges, nodes).where("rise > 0").select(F.explode(F.array("part", "to")).alias("part")).distinct())
        if parts.isEmpty():
            return nodes, True


def _settle(edges: DataFrame, nodes: DataFrame, weight: float, tolerance: float) -> tuple[DataFrame, bool]:
    """Rounds of the whole graph, and then what is left to move; the state, and whether it differs from the first."""
    nodes, moved, _, left = _rounds(edges, nodes, tolerance, weight, FEW)
    if left is None:
        return nodes, moved
    nodes, more = _finished(edges, nodes, tolerance, left)
    return nodes, moved or more


def _pendants(level: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, into): nodes with a single neighbour, and that neighbour; of two that only have each other the greater goes into the lesser. Its part can only gain by such a node
    under modularity with gamma up to 1, so it lies with its neighbour in some best partition and need not move by itself."""
    single = level.groupBy("u").agg(F.count("*").alias("n"), F.first("v").alias("into"), F.min("w").alias("w")).where("n = 1 AND w > 0").select("u", "into")
    other = single.select(F.col("u").alias("into"), F.lit(True).alias("both"))
    return single.join(other, "into", "left").where("both IS NULL OR u > into").select("u", "into").join(nodes.where("mass > 0").select("u"), "u", "left_semi")


def _merges(inner: DataFrame, nodes: DataFrame, theta: float) -> DataFrame:
    """One round of refinement. nodes: u (a refined part), mass, resolution, part_mass, single, turn; inner: the edges between refined parts of one part.

    Single, well-connected nodes whose coin says so join a well-connected refined part of more than one node, or
    of one whose coin keeps it in place. A row (u, to) for each node with any part to join; to is null if it does not do so now.
    """
    outward = inner.groupBy("u").agg(F.sum("w").alias("outward"))
    well = nodes.join(outward, "u").where(F.col("outward") >= F.col("resolution") * F.col("mass") * (F.col("part_mass") - F.col("mass")) - 1e-9)
    stays = F.col("single") & _coin("u", F.col("turn"))
    into = well.select(F.col("u").alias("v"), F.col("mass").alias("to_mass"), (~stays).alias("to_stays"))
    options = inner.join(into, "v").join(well.where("single").select("u", "mass", "resolution", "turn"), "u")
    gain = F.round(F.col("w") - F.col("resolution") * F.col("mass") * F.col("to_mass"), 9)
    draw = (F.pmod(F.xxhash64("u", "v", "turn"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    free = _coin("u", F.col("turn")) & F.col("to_stays")
    options = options.withColumn("gain", gain).where("gain > 0").withColumn("place", F.col("gain") / theta - F.log(-F.log(draw)))
    return options.groupBy("u").agg(F.max(F.when(free, F.struct("place", "v"))).alias("pick")).select("u", F.col("pick.v").alias("to"))


def _refine(edges: DataFrame, nodes: DataFrame, theta: float, left_single: float) -> DataFrame:
    """nodes with `ref`, the refined part of each: connected, and inside one part. Nodes that joined are one node of the next round, so that rounds get smaller; as only
    single nodes move, and none that is joined, each moves once at most."""
    side = nodes.select("u", "part")
    inner = edges.join(side, "u").join(side.toDF("v", "part_v"), "v").where("part = part_v").select("u", "v", "w")
    inner = written(inner)
    masses = nodes.groupBy("part").agg(F.sum("mass").alias("part_mass"))
    now = written(nodes.join(masses, "part").select("u", "mass", "resolution", "part_mass", F.lit(True).alias("single"), "turn"))
    n, moves = now.count(), []
    for number in itertools.count(1):
        wished = checkpointed(_merges(inner, now, theta))
        seen = wished.agg(F.count("*").alias("wants"), F.count("to").alias("moved")).first()
        if seen["moved"]:
            moves.append(written(wished.where("to IS NOT NULL")))
        if seen["wants"] <= left_single * n:
            break
        if seen["moved"]:
            name = lambda end: moves[-1].toDF(end, f"{end}_to")
            ends = [F.coalesce(f"{end}_to", end).alias(end) for end in "uv"]
            joined = inner.join(name("u"), "u", "left").join(name("v"), "v", "left").select(*ends, "w").where("u <> v").groupBy("u", "v").agg(F.sum("w").alias("w"))
            inner, before = written(joined), [inner, now]
            kept = [F.first(x).alias(x) for x in ("resolution", "part_mass")]
            now = now.join(name("u"), "u", "left").groupBy(ends[0]).agg(F.sum("mass").alias("mass"), *kept, ((F.count("*") == 1) & F.first("single")).alias("single"), (F.max("turn") + 1).alias("turn"))
            now = written(now)
            dropped(*before)
        else:
            now = now.withColumn("turn", F.col("turn") + 1)
    out = nodes.select("u", "mass", "resolution", "part", (F.col("turn") + number).alias("turn"))
    to = functools.reduce(DataFrame.unionByName, moves, nodes.limit(0).select("u", F.col("u").alias("to")))
    out = written(out.join(to, "u", "left").select(*out.columns, F.coalesce("to", "u").alias("ref")))
    dropped(inner, now, *moves)
    return out


def cluster(edges: DataFrame, groups: DataFrame, gamma: float = 1.0, seed: int = 42, modular: bool = True, theta: float = THETA, tolerance: float = TOLERANCE, left_single: float = LEFT_SINGLE) -> list[DataFrame]:
    """Leiden inside each group (node, grp), all groups at once; edges: source, target, weight. Parallel edges add up, loops don't count.

    Nodes are numbered in the order of their names, so that rounds join numbers. Returns a table (node, part) for every level, finest first: the parts of a level are unions of parts of the one before
    but for nodes that a later level moves with their refined part. The last is the result; its parts are connected and named by their least
    member. For modularity a node's mass is its degree, the resolution gamma over the group's total degree; for the constant
    Potts model (modular=False) mass 1, resolution gamma. With tolerance 0 rounds go on while the quality rises at all (and PATIENCE rounds
    more), with left_single 0 a refinement until no node could merge.
    """
    ids = written(graph.numbered(groups.where("node IS NOT NULL"), "node").withColumnRenamed("place", "u"))
    side = lambda end, u: ids.select(F.col("node").alias(end), F.col("grp").alias(f"{end}_grp"), F.col("u").alias(u))
    inside = edges.where("source <> target").join(side("source", "u"), "source").join(side("target", "v"), "target").where("source_grp = target_grp")
    inside = inside.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("weight").cast("double").alias("w")).groupBy("u", "v").agg(F.sum("w").alias("w"))
    level = written(inside.select(F.explode(F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))).alias("way")).select("way.*"))
    if modular:
        degree = level.groupBy("u").agg(F.sum("w").alias("mass"))
        nodes = ids.join(degree, "u", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))
        total = nodes.groupBy("grp").agg(F.sum("mass").alias("total"))
        nodes = nodes.join(total, "grp").withColumn("resolution", F.when(F.col("total") > 0, gamma / F.col("total")).otherwise(0.0))
    else:
        nodes = ids.withColumn("mass", F.lit(1.0)).withColumn("resolution", F.lit(float(gamma)))
    nodes = written(nodes.select("u", "mass", "resolution", F.col("u").alias("part"), F.lit(seed * 1000).alias("turn")))
    weight = level.agg(F.sum("w")).first()[0] or 0.0
    of = ids.select("node", "u")
    names = ids.select(F.col("node").alias("name"), F.col("u").alias("part"))
    if modular and gamma <= 1:
        into = written(_pendants(level, nodes))
        name = lambda u: F.coalesce("into", u)
        of = written(of.join(into, "u", "left").select("node", name("u").alias("u")))
        nodes = nodes.join(into, "u", "left").groupBy(name("u").alias("u")).agg(F.sum("mass").alias("mass"), F.first("resolution").alias("resolution"), F.max("turn").alias("turn"))
        nodes = written(nodes.select("u", "mass", "resolution", F.col("u").alias("part"), "turn"))
        # what is left of the edges: those without a pendant end
        level = written(level.join(into.select("u"), "u", "left_anti").join(into.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v", "w"))
    levels = []
    while True:
        nodes, moved = _settle(level, nodes, weight, tolerance)
        levels.append(of.join(nodes.select("u", "part"), "u").join(names, "part").select("node", F.col("name").alias("part")))
        if not moved:
            break
        refined = _refine(level, nodes, theta, left_single)
        name = refined.select("u", "ref")
        of = written(of.join(name, "u").select("node", F.col("ref").alias("u")))
        nodes = refined.groupBy("ref").agg(F.sum("mass").alias("mass"), F.first("resolution").alias("resolution"), F.first("part").alias("part"), F.max("turn").alias("turn"))
        nodes = written(nodes.withColumnRenamed("ref", "u"))
        level = level.join(name, "u").join(name.toDF("v", "ref_v"), "v").where("ref <> ref_v")
        level = written(level.groupBy(F.col("ref").alias("u"), F.col("ref_v").alias("v")).agg(F.sum("w").alias("w")))
    levels[-1] = _connected(level, nodes, of)
    return levels


def _connected(level: DataFrame, nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The result's parts, each split into its components and named by its least member: a level's nodes are connected, so only links between them count."""
    side = nodes.select("u", "part")
    within = level.where("u < v").join(side, "u").join(side.toDF("v", "part_v"), "v").where("part = part_v").select("u", "v")
    roots = graph.star_components(within).select(F.col("node").alias("u"), "root")
    placed = of.join(roots, "u", "left").select("node", F.coalesce("root", "u").alias("root"))
    names = placed.groupBy("root").agg(F.min("node").alias("part"))
    return placed.join(names, "root").select("node", "part")


def communities(edges: DataFrame, gamma: float = 1.0, seed: int = 42, modular: bool = True) -> DataFrame:
    """(node, part) of a whole graph; part is the least member's name. The same edges and seed give the same parts."""
    edges = _stored(edges)
    return cluster(edges, written(_everyone(edges)), gamma, seed, modular)[-1]


def coarsened(edges: DataFrame, gamma: float = 1.0, seed: int = 42, modular: bool = True) -> DataFrame:
    """(level, node, part): the partition of every level from the finest, 0, to the result."""
    edges = _stored(edges)
    found = [x.select(F.lit(number).alias("level"), "node", "part") for number, x in enumerate(cluster(edges, written(_everyone(edges)), gamma, seed, modular))]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _stored(edges: DataFrame) -> DataFrame:
    """The edges as a table, as they are read more than once."""
    return written(edges.select("source", "target", "weight"))


def _everyone(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("grp", F.lit(""))


def relabel(parts: DataFrame) -> DataFrame:
    """(node, part, number): parts numbered from 0 by their least node."""
    least = parts.groupBy("part").agg(F.min("node").alias("least"))
    return parts.join(graph.numbered(least, "least").select("part", F.col("place").alias("number")), "part")


def merged(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Clustering (part, into) of the parts of another (node, part), as (node, part): each node in what its part went into."""
    return fine.join(coarse, "part").select("node", F.col("into").alias("part"))


def hierarchical_communities(edges: DataFrame, largest: int = 10, gamma: float = 1.0, seed: int = 42, most_levels: int | None = None) -> DataFrame:
    """(level, part, parent, node, final): communities of `largest` nodes or more are clustered again, all of a level at once, until they no longer split or, if it is given, most_levels is met."""
    label = lambda parent: F.concat_ws("/", parent, F.col("part"))
    edges = _stored(edges)
    now = cluster(edges, written(_everyone(edges)), gamma, seed)[-1].select(F.lit("-1").alias("parent"), F.col("part"), "node")
    now, out = written(now), None
    for level in itertools.count():
        large = now.groupBy("part").agg(F.count("*").alias("n")).where((F.col("n") >= largest) & (F.col("n") > 1))
        groups = written(now.join(large, "part").select("node", F.col("part").alias("grp")))
        deeper = groups.limit(0).select("node", F.col("grp").alias("parent"), F.col("grp").alias("part"))
        if (most_levels is None or level + 1 < most_levels) and not groups.isEmpty():
            found = cluster(edges, groups, gamma, seed + level + 1)[-1].join(groups, "node").select("node", F.col("grp").alias("parent"), "part")
            split = found.groupBy("parent").agg(F.count_distinct("part").alias("n")).where("n > 1")
            deeper = written(found.join(split, "parent", "left_semi").select("node", "parent", label(F.col("parent")).alias("part")))
        parents = deeper.select(F.col("parent").alias("part")).distinct().withColumn("has_children", F.lit(True))
        rows = now.join(parents, "part", "left").select(F.lit(level).alias("level"), "part", "parent", "node", F.col("has_children").isNull().alias("final"))
        out = rows if out is None else out.unionByName(rows)
        if deeper.isEmpty():
            break
        now = deeper.select("parent", "part", "node")
    return out


def detected(edges: DataFrame, largest: int = 10, seed: int = 42, largest_component: bool = True) -> DataFrame:
    """The hierarchy of communities of a graph of relations (pos, source, target, weight), of its largest component only or of all of it."""
    if largest_component:
        kept = written(graph.largest_component(edges).select("node"))
        edges = edges.join(kept.withColumnRenamed("node", "source"), "source", "left_semi").join(kept.withColumnRenamed("node", "target"), "target", "left_semi")
    return hierarchical_communities(edges, largest, seed=seed)


def hierarchy_faults(rows: DataFrame) -> DataFrame:
    """Breaches of a hierarchy's rules (level, part, parent, node, final): members outside the parent, roots with a parent, nodes final twice."""
    child = rows.where("parent <> '-1'").select("part", "parent", "node")
    inside = rows.select(F.col("part").alias("parent"), "node")
    outside = child.join(inside, ["parent", "node"], "left_anti").select(F.lit("outside parent").alias("fault"), "part", "node")
    roots = rows.where("(level = 0) <> (parent = '-1')").select(F.lit("root").alias("fault"), "part", "node")
    finals = rows.where("final").groupBy("node").count().where("count <> 1").select(F.lit("final").alias("fault"), F.lit("").alias("part"), "node")
    return outside.unionByName(roots).unionByName(finals)


def _community_edges(spark, sf_dir) -> DataFrame:
    """All customers and their nations, each link once."""
    return graph.undirected(domain.region_edges(spark, sf_dir).withColumn("weight", F.lit(1.0)))


def graph_leiden(spark, sf_dir):
    return communities(_community_edges(spark, sf_dir))


def graph_hierarchical_leiden(spark, sf_dir):
    return hierarchical_communities(_community_edges(spark, sf_dir))


def _linked_cliques(spark, sf_dir) -> DataFrame:
    """Customers in cliques of five; four cliques make a ring, but in every third group of twenty customers two and two make a pair."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), F.floor(F.col("c_custkey") / 5).alias("clique"), (F.floor(F.col("c_custkey") / 20) % 3 != 0).alias("ring"))
    other = customers.select(F.col("n").alias("m"), F.col("clique").alias("clique_m"))
    within = customers.join(other, (F.col("clique") == F.col("clique_m")) & (F.col("n") < F.col("m")))  # ten pairs of a clique
    next_ = customers.where((F.col("n") % 5 == 4) & (F.col("n") % F.when(F.col("ring"), 20).otherwise(10) < F.when(F.col("ring"), 19).otherwise(9))).join(other, F.col("m") == F.col("n") + 1)
    closing = customers.where("ring AND n % 20 = 0").join(other, F.col("m") == F.col("n") + 19)
    links = [x.select("n", "m") for x in (within, next_, closing)]
    name = lambda x: F.concat(F.lit("c"), F.col(x).cast("string"))
    return links[0].unionByName(links[1]).unionByName(links[2]).select(name("n").alias("source"), name("m").alias("target"), F.lit(1.0).alias("weight"))


def graph_leiden_cliques(spark, sf_dir):
    """Constant Potts model over linked cliques: each clique is a community, though it is linked with others."""
    return communities(_linked_cliques(spark, sf_dir), 0.5, modular=False)


def graph_hierarchical_split(spark, sf_dir):
    """Linked cliques under modularity: rings and pairs first, which split into their cliques, also those of exactly ten nodes."""
    return hierarchical_communities(_linked_cliques(spark, sf_dir), 10, 0.5)


def graph_hierarchy_faults(spark, sf_dir):
    """Regions, nations and customers as a hierarchy with faults: some customers lie in a nation of another region, some end twice, one region has a parent."""
    nations = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "concat('r', n_regionkey) AS region")
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('c', c_custkey) AS node", "c_nationkey").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    roots = customers.selectExpr("0 AS level", "region AS part", "IF(region = 'r4', 'r0', '-1') AS parent", "node", "c_custkey % 31 = 0 AS final")
    leaves = customers.selectExpr("1 AS level", "concat('n', c_nationkey) AS part", "IF(c_custkey % 17 = 0, 'r0', region) AS parent", "node", "true AS final")
    return hierarchy_faults(roots.unionByName(leaves))


QUERIES = {f.__name__: f for f in (graph_leiden, graph_hierarchical_leiden, graph_leiden_cliques, graph_hierarchical_split, graph_hierarchy_faults)}

#: Parting a star never raises the modularity, so each nation with its customers is one community.
_STARS = "stars AS (SELECT n.node, 'n' || c_nationkey AS star FROM customer c, LATERAL (SELECT unnest(['c' || c.c_custkey, 'n' || c.c_nationkey]) AS node) n), named AS (SELECT DISTINCT node, min(node) OVER (PARTITION BY star) AS part FROM stars)"
_FAULTY = """
c AS (SELECT c_custkey, 'c' || c_custkey AS node, 'n' || c_nationkey AS nation, 'r' || n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT 0 AS level, region AS part, CASE WHEN region = 'r4' THEN 'r0' ELSE '-1' END AS parent, node, c_custkey % 31 = 0 AS final FROM c
  UNION ALL SELECT 1, nation, CASE WHEN c_custkey % 17 = 0 THEN 'r0' ELSE region END, node, true FROM c)"""

_CLIQUES = """
k AS (SELECT 'c' || c_custkey AS node, c_custkey // 5 AS clique, CASE WHEN c_custkey // 20 % 3 = 0 THEN -(c_custkey // 10) - 1 ELSE c_custkey // 20 END AS ring FROM customer),
l AS (SELECT node, min(node) OVER (PARTITION BY clique) AS clique, min(node) OVER (PARTITION BY ring) AS ring, count(*) OVER (PARTITION BY ring) AS n FROM k)"""

ORACLE_SQL = {
    "graph_leiden_cliques": f"WITH {_CLIQUES.strip()} SELECT node, clique AS part FROM l",
    "graph_hierarchical_split": f"WITH {_CLIQUES.strip()} SELECT 0 AS level, ring AS part, '-1' AS parent, node, n < 10 AS final FROM l UNION ALL SELECT 1, ring || '/' || clique, ring, node, true FROM l WHERE n >= 10",
    "graph_leiden": f"WITH {_STARS} SELECT node, part FROM named",
    "graph_hierarchical_leiden": f"WITH {_STARS} SELECT 0 AS level, part, '-1' AS parent, node, true AS final FROM named",
    "graph_hierarchy_faults": f"""WITH {_FAULTY}
SELECT 'outside parent' AS fault, part, node FROM h WHERE parent <> '-1' AND NOT EXISTS (SELECT 1 FROM h p WHERE p.part = h.parent AND p.node = h.node)
UNION ALL SELECT 'root', part, node FROM h WHERE (level = 0) <> (parent = '-1')
UNION ALL SELECT 'final', '', node FROM h WHERE final GROUP BY node HAVING count(*) <> 1""",
}
