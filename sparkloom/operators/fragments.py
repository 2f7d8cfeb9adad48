"""Reports of communities whose evidence is over the budget: fragment plans along the tree of communities, and their reduction.

Evidence is entities, relations and claims. A row belongs to the deepest community that holds all of it: an entity to
its own, a relation to the last one that its ends' paths share, a claim to its subject's. So the evidence of a community is what
belongs to it or below, totals go up the tree by one aggregation over paths, and where a region fits the
budget it stays whole in the plans of all communities above. Those above it, all over the budget, share the units (whole
regions, and packs of what belongs to none) and differ only in which neighbours are combined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import context, graph, search
from sparkloom.session import checkpointed, table, written

#: Sorts what is packed from a community's own rows behind its children.
_LAST = (1 << 63) - 1


def community_paths(tree: DataFrame) -> DataFrame:
    """(part, path, numbers) of communities (part, parent, number): all communities from the root to it, and their numbers among
    siblings. One join a level; a community whose parent isn't there has no path."""
    named = tree.select("part", "parent", F.col("number").cast("long").alias("number"))
    level = written(named.where("parent IS NULL").select("part", F.array("part").alias("path"), F.array("number").alias("numbers")))
    found = level
    while not level.isEmpty():
        above = level.select(F.col("part").alias("parent"), "path", "numbers")
        level = written(named.join(above, "parent").select("part", F.concat("path", F.array("part")).alias("path"), F.concat("numbers", F.array("number")).alias("numbers")))
        found = found.unionByName(level)
    return found


def evidence_rows(paths: DataFrame, members: DataFrame, entities: DataFrame, relations: DataFrame, claims: DataFrame) -> DataFrame:
    """(kind, id, part, path, numbers, place, tokens): each row of evidence and the deepest community that holds all of it.

    members: (node, part), an entity's deepest community; entities: (id, place, tokens); relations: (id, source, target, place,
    tokens); claims: (id, subject_kind, subject, place, tokens). `place` orders the rows of one kind. In the result it is an array: entities, then relations,
    each followed by its claims. Rows that no community holds are left out. Ids and places
    tell the rows of a kind apart.
    """
    homes = members.join(paths.select("part"), "part", "left_semi").select("node", "part")
    columns = ["kind", "id", "part", "place", "tokens"]
    place = lambda group, at, claim: F.array(*[F.lit(x).cast("long") if isinstance(x, int) else F.col(x).cast("long") for x in (group, at, *claim)])
    own = entities.join(homes.withColumnRenamed("node", "id"), "id").select(F.lit("entity").alias("kind"), "id", "part", place(0, "place", (0, 0)).alias("place"), F.col("tokens").cast("long"))
    # rows carry the community only; its path is looked up where it is needed
    between = relations.join(homes.toDF("source", "one"), "source").join(homes.toDF("target", "two"), "target").select("id", "one", "two", "place", F.col("tokens").cast("long").alias("tokens"))
    between = between.join(paths.select(F.col("part").alias("one"), "path"), "one").join(paths.select(F.col("part").alias("two"), F.col("path").alias("other")), "two")
    # paths of a tree that agree at a place agree before it
    shared = F.size(F.filter("path", lambda x, i: F.get("other", i) == x))
    between = between.withColumn("shared", shared).where("shared > 0").withColumn("part", F.get("path", F.col("shared") - 1))
    between = between.select(F.lit("relation").alias("kind"), "id", "part", place(1, "place", (0, 0)).alias("place"), "tokens")
    subjects = own.select(*columns).unionByName(between.select(*columns))
    of = subjects.select(F.col("kind").alias("subject_kind"), F.col("id").alias("subject"), "part", F.col("place").alias("at"))
    said = claims.withColumn("claim", F.col("place").cast("long")).join(of, ["subject_kind", "subject"])
    said = said.select(F.lit("claim").alias("kind"), "id", "part", F.concat(F.slice("at", 1, 2), F.array(F.lit(1).cast("long"), "claim")).alias("place"), F.col("tokens").cast("long"))
    rows = subjects.unionByName(said.select(*columns))
    return rows.join(paths.select("part", "path", "numbers"), "part").select("kind", "id", "part", "path", "numbers", "place", "tokens")


def fragment_plans(paths: DataFrame, rows: DataFrame, budget: int, header: int = 0) -> DataFrame:
    """(part, fragment, kind, id, fault): for each community over the budget the fragment that each row of its evidence goes to.

    rows: as evidence_rows gives them. A prompt has `header` tokens and those of its rows. In a community's plan a region below that fits the budget stays whole;
    of one that doesn't fit, first its children follow, by number, then the rows that belong to none of them, in order, as many at a
    time as fit. At last neighbours that fit together are combined, from the front. Communities within the budget need no
    plan and have no rows here. A community with a row that doesn't fit on its own has no plan: its rows here are those, with the fault `too large`.

    All of it is joins, aggregations and packing over range partitions; no community is gathered in one task.
    """
    rows = checkpointed(rows.select("kind", "id", "part", "place", "tokens"))  # what else a row says its community says too
    own = rows.groupBy("part").agg(F.sum("tokens").alias("own"))
    below = own.join(paths, "part").select(F.explode("path").alias("part"), "own").groupBy("part").agg(F.sum("own").alias("total"))
    sized = checkpointed(paths.join(below, "part", "left").select("part", "path", "numbers", (F.coalesce("total", F.lit(0)) + header <= budget).alias("whole"), F.coalesce("total", F.lit(0)).alias("total")))
    # where on a community's path the first region is that fits; all below it fit too
    steps = sized.select("part", F.posexplode("path").alias("i", "on")).join(sized.where("whole").select(F.col("part").alias("on")), "on")
    cuts = sized.select("part", "path", "numbers").join(steps.groupBy("part").agg((F.min("i") + 1).alias("cut")), "part", "left")
    cuts = written(cuts.where("cut IS NULL OR cut > 1").withColumn("above", F.when(F.col("cut").isNull(), F.col("path")).otherwise(F.slice("path", 1, F.coalesce("cut", F.lit(2)) - 1))))
    placed = rows.join(cuts.select("part", "cut", F.element_at("path", F.col("cut")).alias("region")), "part")
    loose = placed.where("cut IS NULL").select("part", "place", "tokens", "kind", "id")
    packs = context.packed(loose, "part", "place", budget, header, carry=("kind", "id"))
    # a unit: the region, or the pack of a region's own rows; `order` is that of a walk through the tree, children first
    region = placed.where("cut IS NOT NULL").select("kind", "id", "tokens", F.col("region").alias("unit"), F.lit(0).cast("long").alias("pack"), F.lit(False).alias("loose"))
    rest = packs.select("kind", "id", "tokens", F.col("part").alias("unit"), F.col("batch").alias("pack"), F.lit(True).alias("loose"))
    units = checkpointed(region.unionByName(rest))
    sums = units.groupBy("unit", "pack", "loose").agg(F.sum("tokens").alias("tokens")).join(paths.select(F.col("part").alias("unit"), "path", "numbers"), "unit")
    above = F.when(F.col("loose"), F.col("path")).otherwise(F.slice("path", 1, F.size("path") - 1))
    order = F.when(F.col("loose"), F.concat("numbers", F.array(F.lit(_LAST), "pack"))).otherwise(F.col("numbers"))
    sums = sums.select("unit", "pack", "tokens", above.alias("above"), order.alias("order"))
    numbered = checkpointed(graph.numbered(sums.withColumn("_order", F.col("order")), "order").drop("_order", "order"))
    large = written(rows.where(F.col("tokens") + header > budget).join(cuts.select("part", "above"), "part").select("kind", "id", F.explode("above").alias("part")))
    unplanned = large.select("part").distinct()
    shared = numbered.select("unit", "pack", "place", "tokens", F.explode("above").alias("part")).join(unplanned, "part", "left_anti")
    combined = context.packed(shared, "part", "place", budget, header).withColumnRenamed("batch", "fragment")
    where_ = combined.join(numbered.select("place", "unit", "pack"), "place").select("part", "fragment", "unit", "pack")
    planned = units.select("kind", "id", "unit", "pack").join(where_, ["unit", "pack"]).select("part", "fragment", "kind", "id", F.lit(None).cast("string").alias("fault"))
    return planned.unionByName(large.select("part", F.lit(None).cast("long").alias("fragment"), "kind", "id", F.lit("too large").alias("fault")))


def reduce_fragments(fragments: DataFrame, budget: int, merge_header: int, final_header: int, model: Callable[[str], str] = search.stub_model, final_model: Callable[[str], str] = search.stub_model, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """(part, text, fragments, rounds, fault): the report of each part from its fragments' texts (part, place, text).

    A part is done when the final prompt (final_header tokens and the texts) fits the budget. Until then, round by round, the widest runs of neighbours
    that fit the merge prompt are answered by the model, one call each; a single one stays as it is. `fragments` and
    `rounds` tell with how many texts and after how many rounds a part came to its end. What can't be done is a row with a fault and no text, while the
    other parts go on: `final prompt` where one text is left that doesn't fit, `no pair` where no two neighbours fit a merge prompt, else what the model said.
    """
    count = tokens or (lambda x: F.size(F.split(x, " ")).cast("long"))
    now = checkpointed(fragments.select("part", F.col("place").cast("long").alias("place"), "text").withColumn("tokens", count(F.col("text"))))
    ends, rounds = None, 0
    while not now.isEmpty():
        sizes = now.groupBy("part").agg(F.sum("tokens").alias("total"), F.count("*").alias("n"))
        open_ = checkpointed(sizes.withColumn("fits", F.col("total") + final_header <= budget))
        going = now.join(open_.where("NOT fits AND n > 1").select("part"), "part", "left_semi")
        runs = context.packed(going, "part", "place", budget, merge_header).select("part", "place", "batch")
        lines = going.join(runs, ["part", "place"]).groupBy("part", "batch").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("lines"))  # within the budget, or one
        lines = checkpointed(lines)
        merges = lines.groupBy("part").agg(F.max(F.size("lines")).alias("widest"))
        done = now.join(open_.where("fits").select("part"), "part", "left_semi").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("lines"))  # within the budget
        final = _answers(done.select("part", F.lit(0).cast("long").alias("batch"), "lines"), final_model)
        final = final.select("part", "text", F.size("lines").cast("long").alias("fragments"), "fault")
        stuck = open_.where("NOT fits AND n = 1").select("part", F.lit("final prompt").alias("fault"), F.col("n").alias("fragments"))
        stuck = stuck.unionByName(merges.where("widest = 1").join(open_, "part").select("part", F.lit("no pair").alias("fault"), F.col("n").alias("fragments")))
        asked = lines.join(merges.where("widest > 1").select("part"), "part", "left_semi")
        answers = checkpointed(_answers(asked.where(F.size("lines") > 1), model))
        broken = answers.where("fault IS NOT NULL").groupBy("part").agg(F.min_by("fault", "batch").alias("fault")).join(open_.select("part", F.col("n").alias("fragments")), "part")
        over = final.unionByName(stuck.unionByName(broken.select("part", "fault", "fragments")).select("part", F.lit(None).cast("string").alias("text"), "fragments", "fault"))
        over = checkpointed(over.withColumn("rounds", F.lit(rounds)))
        ends = over if ends is None else ends.unionByName(over)
        kept = asked.where(F.size("lines") == 1).select("part", "batch", F.element_at("lines", 1)["text"].alias("text")).unionByName(answers.select("part", "batch", "text"))
        now = checkpointed(kept.join(broken.select("part"), "part", "left_anti").select("part", F.col("batch").alias("place"), "text").withColumn("tokens", count(F.col("text"))))
        rounds += 1
    columns = ["part", "text", "fragments", "rounds", "fault"]
    if ends is None:
        return now.select("part", "text", F.lit(0).cast("long").alias("fragments"), F.lit(0).alias("rounds"), F.lit(None).cast("string").alias("fault"))
    return ends.select(*columns)


def _answers(lines: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """Adds text and fault: what the model answers to the lines of each (part, batch), or what went wrong."""
    keyed = graph.numbered(lines, "part", "batch").withColumnRenamed("place", "key")
    prompts = keyed.select("key", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("prompt"))
    told = search.ask_outcomes(prompts, model)
    return keyed.join(told, "key").select("part", "batch", "lines", F.col("answer").alias("text"), F.when(F.col("outcome") != "succeeded", F.col("reason")).alias("fault"))


# --- over the driver tables -------------------------------------------------------------------------

BUDGET, HEADER = 1500, 40


def _tree(spark, sf_dir) -> DataFrame:
    """The world, its regions, their nations, and the market segments of a nation."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    segments = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "n_name", "c_mktsegment").alias("part"), F.col("n_name").alias("parent"), F.ascii("c_mktsegment").alias("number")).distinct()
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("part"), F.lit("world").alias("parent"), F.col("r_regionkey").alias("number"))
    nations = nation.select(F.col("n_name").alias("part"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_nationkey").alias("number"))
    world = spark.createDataFrame([("world", None, 0)], "part string, parent string, number long")
    return world.unionByName(regions).unionByName(nations).unionByName(segments)


def _evidence(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Paths and evidence: customers, some of them in a nation but no segment; orders as relations between customers, lines as claims on orders and on customers."""
    customer, orders, lines = (table(spark, sf_dir, x) for x in ("customer", "orders", "lineitem"))
    paths = written(community_paths(_tree(spark, sf_dir)))
    of = customer.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    members = of.select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 10 == 0, F.col("n_name")).otherwise(F.concat_ws("/", "n_name", "c_mktsegment")).alias("part"))
    entities = customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("place"), (F.col("c_custkey") % 7 + 4).alias("tokens"))
    relations = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), (F.col("o_custkey") + F.col("o_orderkey") % 40).alias("target"), F.col("o_orderkey").alias("place"), (F.col("o_orderkey") % 11 + 5).alias("tokens"))
    said = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = F.col("l_linenumber") == 1
    claims = said.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.when(first, F.lit("entity")).otherwise(F.lit("relation")).alias("subject_kind"), F.when(first, F.col("o_custkey")).otherwise(F.col("l_orderkey")).alias("subject"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), (F.col("l_linenumber") + 2).alias("tokens")).distinct()
    return paths, evidence_rows(paths, members, entities, relations, claims)


def report_region_plan(spark, sf_dir):
    paths, rows = _evidence(spark, sf_dir)
    return fragment_plans(paths, rows, BUDGET, HEADER)


def report_fragment_reduce(spark, sf_dir):
    """Brands' fragments, the parts that they make: brands end after several rounds, and one whose text is too long has a fault."""
    part = table(spark, sf_dir, "part")
    name = F.when((F.col("p_brand") == "Brand#7") & (F.col("p_partkey") % 5 == 0), F.repeat(F.concat(F.col("p_name"), F.lit(" ")), 30)).otherwise(F.col("p_name"))
    texts = part.select(F.col("p_brand").alias("part"), F.col("p_partkey").alias("place"), name.alias("text"))
    return reduce_fragments(texts, 40, 4, 22)


QUERIES = {f.__name__: f for f in (report_region_plan, report_fragment_reduce)}


def _rounds_sql(rounds: int, budget: int, merge: int, final: int) -> str:
    """CTEs t0, t1, ... of the texts before each round; a text is an answer after it was merged."""
    steps = []
    for r in range(rounds):
        steps.append(f"z{r} AS (SELECT part, sum(len(string_split(text, ' '))) AS total, count(*) AS n FROM t{r} GROUP BY part)")
        going = f"SELECT t.part, t.place, t.text, len(string_split(t.text, ' ')) AS tokens FROM t{r} t JOIN z{r} z ON t.part = z.part WHERE z.total + {final} > {budget} AND z.n > 1"
        steps.append(context.packed_sql(f"b{r}", going, "part", "place", merge, budget).strip())
        steps.append(f"g{r} AS (SELECT part, batch, count(*) AS n, string_agg(text, chr(10) ORDER BY place) AS text FROM b{r} GROUP BY part, batch)")
        steps.append(f"t{r + 1} AS (SELECT part, batch AS place, CASE WHEN n = 1 THEN text ELSE 'answer ' || substr(sha256(text), 1, 12) END AS text FROM g{r} WHERE part IN (SELECT part FROM g{r} WHERE n > 1))")
    done = [
        f"SELECT z.part, 'answer ' || substr(sha256(string_agg(text, chr(10) ORDER BY place)), 1, 12) AS text, z.n AS fragments, {r} AS rounds, NULL AS fault FROM z{r} z JOIN t{r} t ON z.part = t.part WHERE z.total + {final} <= {budget} GROUP BY z.part, z.n "
        f"UNION ALL SELECT part, NULL, n, {r}, CASE WHEN n = 1 THEN 'final prompt' ELSE 'no pair' END FROM z{r} WHERE total + {final} > {budget} AND part NOT IN (SELECT part FROM t{r + 1})"
        for r in range(rounds)
    ]
    return ",\n".join(steps) + "\n" + " UNION ALL ".join(done)


ORACLE_SQL = {
    "report_region_plan": f"""WITH RECURSIVE tree AS (
  SELECT 'world' AS part, NULL AS parent, CAST(0 AS BIGINT) AS number UNION ALL SELECT 'r' || r_regionkey, 'world', r_regionkey FROM region UNION ALL SELECT n_name, 'r' || n_regionkey, n_nationkey FROM nation
  UNION ALL SELECT DISTINCT n_name || '/' || c_mktsegment, n_name, ascii(c_mktsegment) FROM customer JOIN nation ON c_nationkey = n_nationkey),
paths AS (SELECT part, [part] AS path, [number] AS numbers FROM tree WHERE parent IS NULL UNION ALL SELECT t.part, list_append(p.path, t.part), list_append(p.numbers, t.number) FROM tree t JOIN paths p ON t.parent = p.part),
h AS (SELECT c_custkey AS node, path, numbers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN paths ON part = CASE WHEN c_custkey % 10 = 0 THEN n_name ELSE n_name || '/' || c_mktsegment END),
ent AS (SELECT 'entity' AS kind, node AS id, path, numbers, [0, node, 0, 0] AS place, node % 7 + 4 AS tokens FROM h),
rel AS (
  SELECT 'relation' AS kind, o_orderkey AS id, a.path, a.numbers, len(list_filter(range(1, len(a.path) + 1), lambda x: a.path[x] = b.path[x])) AS k, [1, o_orderkey, 0, 0] AS place, o_orderkey % 11 + 5 AS tokens
  FROM orders JOIN h a ON a.node = o_custkey JOIN h b ON b.node = o_custkey + o_orderkey % 40),
sub AS (SELECT * FROM ent UNION ALL SELECT kind, id, path[1 : k], numbers[1 : k], place, tokens FROM rel),
cl AS (
  SELECT DISTINCT 'claim' AS kind, l_orderkey * 8 + l_linenumber AS id, s.path, s.numbers, [s.place[1], s.place[2], 1, l_orderkey * 8 + l_linenumber] AS place, l_linenumber + 2 AS tokens
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN sub s ON s.kind = CASE WHEN l_linenumber = 1 THEN 'entity' ELSE 'relation' END AND s.id = CASE WHEN l_linenumber = 1 THEN o_custkey ELSE l_orderkey END),
ev AS (SELECT *, path[-1] AS part FROM (SELECT * FROM sub UNION ALL SELECT * FROM cl)),
tot AS (SELECT part, sum(tokens) AS total FROM (SELECT unnest(path) AS part, tokens FROM ev) GROUP BY part),
steps AS (SELECT part, unnest(path) AS region, generate_subscripts(path, 1) AS i FROM paths),
cuts AS (SELECT s.part, min(s.i) AS cut FROM steps s LEFT JOIN tot t ON t.part = s.region WHERE coalesce(t.total, 0) + {HEADER} <= {BUDGET} GROUP BY s.part),
pl AS (SELECT ev.*, cut FROM ev LEFT JOIN cuts USING (part) WHERE cut IS NULL OR cut > 1),{context.packed_sql("pk", "SELECT part, place, kind, id, path, numbers, tokens FROM pl WHERE cut IS NULL", "part", "place", HEADER, BUDGET)},
un AS (
  SELECT kind, id, tokens, path[1 : cut - 1] AS above, path[cut] AS unit, 0 AS pack, numbers[1 : cut] AS ord FROM pl WHERE cut IS NOT NULL
  UNION ALL SELECT kind, id, tokens, path, part, batch, list_concat(numbers, [{_LAST}, batch]) FROM pk),
su AS (SELECT unit, pack, sum(tokens) AS tokens, any_value(above) AS above, any_value(ord) AS ord FROM un GROUP BY unit, pack),
large AS (SELECT unnest(CASE WHEN cut IS NULL THEN path ELSE path[1 : cut - 1] END) AS part, kind, id FROM pl WHERE tokens + {HEADER} > {BUDGET}),
sh AS (SELECT unnest(above) AS part, unit, pack, ord, tokens FROM su),{context.packed_sql("co", "SELECT * FROM sh WHERE part NOT IN (SELECT part FROM large)", "part", "ord", HEADER, BUDGET)}
SELECT co.part, co.batch AS fragment, un.kind, un.id, NULL AS fault FROM co JOIN un ON co.unit = un.unit AND co.pack = un.pack UNION ALL SELECT part, NULL, kind, id, 'too large' FROM large""",
    "report_fragment_reduce": f"""WITH RECURSIVE t0 AS (SELECT p_brand AS part, p_partkey AS place, CASE WHEN p_brand = 'Brand#7' AND p_partkey % 5 = 0 THEN repeat(p_name || ' ', 30) ELSE p_name END AS text FROM part),
{_rounds_sql(5, 40, 4, 22)}""",
}
