"""Query strategies from end to end: local context tables, global map and reduce, the reduce step of branching answers, memory search.

The parts (which rows are evidence, in which order) are those of `search`; here they become whole plans. Of a table no
more rows than its budget has tokens can be used, so each is cut to so many before it is put in one order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.operators import context, extraction, graph, knowledge, messages, search, vectors
from sparkloom.plans import domain
from sparkloom.session import checkpointed, table, written

Order = list[Column | str]


def _one():
    """All rows of a page that is bounded."""
    return W.partitionBy(F.lit(0))


def words(text: str | Column) -> Column:
    """Tokens of a rendered row: its parts between single spaces."""
    return F.size(F.split(text, " ")).cast("long")


def _page(rows: DataFrame, order: Order, most: int) -> DataFrame:
    """The first rows in an order, with their place from 1: each task keeps `most` rows before they meet."""
    return rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(_one().orderBy(*order)).cast("long"))


def assemble(tables: list[tuple[str, str, DataFrame, Order]], budgets: dict[str, int]) -> DataFrame:
    """The rows of a context. tables: (dataset, share, rows with item and text, order). Tables of one share follow each other
    under its budget, and end with the first row that doesn't fit. (share, dataset, place, item, tokens, used)."""
    out = None
    for number, (dataset, share, rows, order) in enumerate(tables):
        page = _page(rows, order, budgets[share]).select(F.lit(share).alias("share"), F.lit(dataset).alias("dataset"), F.lit(number).alias("number"), "place", "item", words("text").alias("tokens"))
        out = page if out is None else out.unionByName(page)
    used = F.sum("tokens").over(W.partitionBy("share").orderBy("number", "place").rowsBetween(W.unboundedPreceding, W.currentRow))  # at most a budget's rows of every table
    fits = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])
    return out.withColumn("used", used).where(F.col("used") <= F.element_at(fits, F.col("share"))).drop("number")


def local_tables(near: DataFrame, entities: DataFrame, edges: DataFrame, members: DataFrame, reports: DataFrame, claims: DataFrame, units: DataFrame, per_entity: int, budget: int) -> DataFrame:
    """The context of a local search from its nearest entities (node, score): reports of their communities, the entities, their relations and claims, and the
    text units (unit, subject_id, text) that speak of most of these relations."""
    selected = near.select("node")
    relations = written(search.select_relationships(edges, selected, per_entity))
    named = F.concat_ws(">", "source", "target")
    links = units.join(relations.select(named.alias("subject_id")), "subject_id").groupBy("unit").agg(F.count_distinct("subject_id").alias("links"), F.min("text").alias("text"))
    item = lambda column: F.col(column).cast("string").alias("item")
    tables = [
        ("reports", "reports", search.select_reports(members, reports, selected).select("place", item("part"), "text").withColumnRenamed("place", "first"), ["first"]),
        ("entities", "graph", entities.join(near, "node").select("score", "node", item("node"), "text"), [F.col("score").desc(), "node"]),
        ("relations", "graph", relations.select("tier", "links", "combined_degree", "weight", "source", "target", named.alias("item"), F.concat_ws(" ", "source", "target", F.col("weight").cast("long")).alias("text")), ["tier", F.col("links").desc(), F.col("combined_degree").desc(), F.col("weight").desc(), "source", "target"]),
        ("claims", "graph", search.claims_for(claims, selected, relations).select("claim", item("claim"), F.concat_ws(" ", "subject_id", "claim").alias("text")), ["claim"]),
        ("sources", "sources", links.select("links", "unit", item("unit"), "text"), [F.col("links").desc(), "unit"]),
    ]
    return assemble(tables, search.local_budgets(budget))


# --- global ---------------------------------------------------------------------------------------


def point_model(prompt: str) -> str:
    """An offline map model: one point that names the rows it has seen, scored by their number."""
    rows = prompt.split("\n")[1:]
    return json.dumps({"points": [{"description": hashlib.sha256("\n".join(rows).encode()).hexdigest()[:12], "score": str(len(rows) * 7 % 101)}]})


def global_points(reports: DataFrame, question: str, level: int, least_rank: float, batch_tokens: int, budget: int, seed: int = 86, model: Callable[[str], str] = point_model) -> DataFrame:
    """Map: selected reports (part, level, rank, text) in a seeded order are packed into batches, each is asked for points, valid points are
    ranked and kept while they fit the budget. (place, batch, description, score, used)."""
    chosen = search.global_reports(reports, level, least_rank).select("part", "text", words("text").alias("tokens"), F.md5(F.concat_ws(":", F.lit(seed), "part")).alias("order_key"))
    batches = context.packed(chosen.withColumn("question", F.lit(0)), "question", "order_key", batch_tokens).select("order_key", "batch")
    lines = chosen.join(batches, "order_key").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("order_key", "text"))).alias("lines"))  # under batch_tokens
    prompts = lines.select(F.col("batch").alias("key"), F.concat_ws("\n", F.lit(question), F.transform("lines", lambda x: x["text"])).alias("prompt"))
    points = extraction.parse_points(search.ask(prompts, model).withColumnRenamed("answer", "output")).where("error = ''")
    points = points.select(F.lit(0).alias("question"), F.col("key").alias("batch"), "point", "description", F.col("score").cast("long").alias("score"), words("description").alias("tokens"))
    first = points.where("score > 0").orderBy(F.col("score").desc(), "batch", "point").limit(budget)  # each has a token at least
    return context.ranked_points(first, budget).select("place", "batch", "description", "score", "used")


def reduced(points: DataFrame, question: str, model: Callable[[str], str] = search.stub_model) -> DataFrame:
    """Reduce: the answer to the question from points in order; points fit a budget, so they are one prompt."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "description")))
    prompt = points.agg(F.concat_ws("\n", F.lit(question), F.transform(ordered, lambda x: x["description"])).alias("prompt"))
    return search.ask(prompt.withColumn("key", F.lit(0).cast("long")), model).select("answer")


# --- branching ------------------------------------------------------------------------------------


def branch_context(answers: DataFrame, budget: int) -> DataFrame:
    """What a question's answers (question, answer_id, score, text, refs) give to the reduce step: best first while their tokens fit, the
    first cut to the budget if it alone doesn't; refs are numbered over the question as they are first met. (question, place, answer_id, tokens, used, cites)."""
    order = W.partitionBy("question").orderBy(F.col("score").desc(), "answer_id")
    ranked = answers.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= budget)  # each has a token at least
    ranked = ranked.withColumn("tokens", F.when(F.col("place") == 1, F.least(words("text"), F.lit(budget))).otherwise(words("text")))
    kept = ranked.withColumn("used", F.sum("tokens").over(W.partitionBy("question").orderBy("place"))).where(F.col("used") <= budget)
    cited = kept.select("question", "place", F.posexplode("refs").alias("pos", "ref"))
    first = cited.groupBy("question", "ref").agg(F.min(F.struct("place", "pos")).alias("first"))
    ledger = first.select("question", "ref", F.row_number().over(W.partitionBy("question").orderBy("first")).cast("long").alias("number"))
    cites = cited.join(ledger, ["question", "ref"]).groupBy("question", "place").agg(F.array_join(F.array_sort(F.collect_set("number")), ",").alias("cites"))
    return kept.join(cites, ["question", "place"], "left").select("question", "place", "answer_id", "tokens", "used", F.coalesce("cites", F.lit("")).alias("cites"))


# --- reports --------------------------------------------------------------------------------------


def reduce_tree(fragments: DataFrame, budget: int, model: Callable[[str], str] = search.stub_model) -> DataFrame:
    """One answer for each part from its fragments (part, place, text): neighbours that fit the budget are joined and answered together, round by
    round, until each part has one. (part, text, rounds). Parts of one fragment keep it; an answer that can't be joined with any other is an error."""
    now = checkpointed(fragments.select("part", F.col("place").cast("long").alias("place"), "text", F.lit(0).alias("rounds")))
    while True:
        sizes = now.groupBy("part").agg(F.count("*").alias("n"))
        several = now.join(sizes.where("n > 1").select("part"), "part", "left_semi").withColumn("tokens", words("text"))
        if several.isEmpty():
            return now.select("part", "text", "rounds")
        batches = context.packed(several, "part", "place", budget).select("part", "place", "batch")
        lines = several.join(batches, ["part", "place"]).groupBy("part", "batch").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("lines"), F.max("rounds").alias("rounds"))
        joined = graph.numbered(lines, "part", "batch").withColumnRenamed("place", "key")
        shrinks = joined.groupBy("part").agg((F.count("*") < F.sum(F.size("lines"))).alias("shrinks")).where("NOT shrinks")
        if not shrinks.isEmpty():
            raise ValueError("a budget must hold two answers")
        prompts = joined.select("key", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("prompt"))
        answers = joined.join(search.ask(prompts, model), "key").select("part", F.col("batch").alias("place"), F.col("answer").alias("text"), (F.col("rounds") + 1).alias("rounds"))
        now = checkpointed(now.join(sizes.where("n = 1").select("part"), "part", "left_semi").unionByName(answers))


# --- memory ---------------------------------------------------------------------------------------


def memory_search(entities: DataFrame, entity_vectors: DataFrame, edges: DataFrame, title: str, query: list[float], most: int = 10, most_relations: int = 20) -> DataFrame:
    """Entities of the title, else the nearest to the query; each one's first relations by their ends. `truncated` tells that there are more.
    entity_vectors: (vec_id, id, embedding). (item_kind, entity, item, place, truncated)."""
    exact = search.memory_exact(entities, title, most=most).select("id", "more")
    found = checkpointed(exact)
    if found.isEmpty():
        near = vectors.top_k(entity_vectors.select("vec_id", "embedding"), query, most).join(entity_vectors.select("vec_id", "id"), "vec_id")
        found = checkpointed(near.select("id", F.lit(False).alias("more")))
    hits = found.withColumn("place", F.row_number().over(_one().orderBy("id")).cast("long"))  # a page
    either = edges.withColumn("entity", F.explode(F.array("source", "target"))).join(F.broadcast(found.select(F.col("id").alias("entity"))), "entity")  # at most `most` ids
    by_ends = W.partitionBy("entity").orderBy("source", "target")
    page = either.withColumn("place", F.row_number().over(by_ends).cast("long")).where(F.col("place") <= most_relations + 1)
    page = page.withColumn("truncated", F.max("place").over(W.partitionBy("entity")) > most_relations).where(F.col("place") <= most_relations)
    relations = page.select(F.lit("relation").alias("item_kind"), "entity", F.concat_ws(">", "source", "target").alias("item"), "place", "truncated")
    return hits.select(F.lit("entity").alias("item_kind"), F.col("id").alias("entity"), F.col("id").alias("item"), "place", F.col("more").alias("truncated")).unionByName(relations)


def memory_add(log: DataFrame, offered: DataFrame, items: DataFrame, versions: DataFrame) -> DataFrame:
    """Recording memories: messages (conv_id, turn, role, text) are appended and what they are evidence of (conv_id, id, content_hash) is submitted, for
    conversations none of whose messages conflicts with the log. (conv_id, appended, repeated, rejected, created, confirmed, candidates)."""
    taken = messages.append_conflicts(log, offered)
    checked = offered.select("conv_id", "turn").join(taken, ["conv_id", "turn"], "left").groupBy("conv_id").agg(F.count_if(F.col("same").isNull()).alias("new"), F.count_if("same").alias("repeated"), F.count_if(~F.col("same")).alias("rejected"))
    sound = checked.where("rejected = 0").select("conv_id")
    accepted = items.join(sound, "conv_id", "left_semi").distinct()
    outcomes = accepted.join(knowledge.submission(accepted.select("id", "content_hash").distinct(), versions), ["id", "content_hash"]).groupBy("conv_id").agg(
        F.count_if(F.col("outcome") == "create").alias("created"), F.count_if(F.col("outcome") == "confirm").alias("confirmed"), F.count_if(F.col("outcome").isin("candidate", "reuse")).alias("candidates")
    )
    none = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return checked.join(outcomes, "conv_id", "left").select("conv_id", F.when(F.col("rejected") == 0, F.col("new")).otherwise(0).alias("appended"), "repeated", "rejected", none("created"), none("confirmed"), none("candidates"))


# --- over the driver tables -------------------------------------------------------------------------


def local_context(spark, sf_dir):
    near = vectors.top_k(table(spark, sf_dir, "embeddings").where("vec_id > 0"), search._query(spark, sf_dir), 10)
    near = checkpointed(near.select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("node"), "score"))
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    entities = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    reports = part.groupBy(F.col("p_brand").alias("part")).agg(F.max("p_size").cast("long").alias("rank")).withColumn("text", F.concat_ws(" ", "part", "rank"))
    subject = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(">p"), F.col("l_partkey").cast("string"))
    claims = lines.select(F.lit("relation").alias("subject_kind"), subject.alias("subject_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"))
    units = lines.select(F.col("l_orderkey").alias("unit"), subject.alias("subject_id"), F.concat_ws(" ", F.lit("order"), F.col("l_orderkey").cast("string")).alias("text"))
    return local_tables(near, entities, domain.relations(spark, sf_dir), search._members(spark, sf_dir), reports, claims, units, 5, 400)


def _question_points(spark, sf_dir) -> DataFrame:
    reports = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("part"), (F.col("p_size") % 3).cast("long").alias("level"), F.col("p_retailprice").cast("double").alias("rank"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return global_points(reports, "What is made?", 1, 905.0, 60, 20)


def global_search_points(spark, sf_dir):
    return _question_points(spark, sf_dir)


def global_search_answer(spark, sf_dir):
    return reduced(_question_points(spark, sf_dir), "What is made?")


def drift_reduce(spark, sf_dir):
    """Customers' questions, their orders as answers, the suppliers of an order as what it cites."""
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("refs"))
    orders = table(spark, sf_dir, "orders").join(refs, "o_orderkey", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<bigint>")))
    answers = orders.select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("answer_id"), F.col("o_totalprice").alias("score"), F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("text"), "refs")
    return branch_context(answers, 24)


def memory_record(spark, sf_dir):
    """Conversations offered again: with a changed text where the number is divisible by 4, with one more turn elsewhere; each speaks of a user."""
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    changed = log.withColumn("text", F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    more = log.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("user").alias("role"), F.lit("more").alias("text"))
    versions = domain.versions(spark, sf_dir)
    current = knowledge.latest(versions).select("id", "content_hash")
    of = log.select("conv_id").distinct().withColumn("id", F.concat(F.lit("u"), (F.col("conv_id") % 2000).cast("string")))
    items = of.join(current, "id", "left").select("conv_id", "id", F.when(F.col("conv_id") % 3 == 0, F.lit("other")).otherwise(F.coalesce("content_hash", F.lit("first"))).alias("content_hash"))
    return memory_add(log, changed.unionByName(more), items, versions)


def report_reduce(spark, sf_dir):
    """Brands' reports from their parts, 40 tokens at a time."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("part"), F.col("p_partkey").alias("place"), F.col("p_name").alias("text"))
    return reduce_tree(parts, 40)


def memory_search_all(spark, sf_dir):
    """A title that exists and one that doesn't."""
    entities, edges = search._entities(spark, sf_dir), domain.relations(spark, sf_dir)
    known = table(spark, sf_dir, "embeddings").where("vec_id > 0").withColumn("id", F.concat(F.lit("p"), F.col("vec_id").cast("string")))
    query = search._query(spark, sf_dir)
    found = [memory_search(entities, known, edges, title, query).withColumn("title", F.lit(title)) for title in ("red widget", "no such title")]
    return found[0].unionByName(found[1])


QUERIES = {f.__name__: f for f in (local_context, global_search_points, global_search_answer, drift_reduce, memory_record, report_reduce, memory_search_all)}

_SUBJECT = "'s' || l_suppkey || '>p' || l_partkey"
_POINTS = """
chosen AS (SELECT CAST(p_partkey AS VARCHAR) AS part, p_name || ' ' || p_brand AS text, md5('86:' || p_partkey) AS k FROM part WHERE p_size % 3 <= 1 AND p_retailprice >= 905),
n AS (SELECT *, len(string_split(text, ' ')) AS tokens, row_number() OVER (ORDER BY k) AS i FROM chosen),
f AS (SELECT i, text, 0 AS batch, tokens AS used FROM n WHERE i = 1
  UNION ALL SELECT n.i, n.text, CASE WHEN f.used + n.tokens > 60 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + n.tokens > 60 THEN n.tokens ELSE f.used + n.tokens END FROM f JOIN n ON n.i = f.i + 1),
p AS (SELECT CAST(batch AS BIGINT) AS batch, substr(sha256(string_agg(text, chr(10) ORDER BY i)), 1, 12) AS description, count(*) * 7 % 101 AS score FROM f GROUP BY batch),
r AS (SELECT row_number() OVER (ORDER BY score DESC, batch) AS place, batch, description, score FROM p WHERE score > 0),
points AS (SELECT place, batch, description, score, place AS used FROM r WHERE place <= 20)"""

ORACLE_SQL = {
    "local_context": f"""WITH {graph._COMBINED}, {search._NEAR},
picked AS (SELECT t.*, l.links, row_number() OVER (ORDER BY links DESC, combined_degree DESC, weight DESC, t.source, t.target) AS place
  FROM combined t JOIN (SELECT source, count(DISTINCT target) AS links FROM combined WHERE target IN (SELECT node FROM sel) GROUP BY source) l ON t.source = l.source WHERE target IN (SELECT node FROM sel) QUALIFY place <= 50),
m AS (SELECT p_brand AS part, count(*) AS matches FROM part JOIN near ON vec_id = p_partkey GROUP BY p_brand),
reports AS (SELECT part, rank, row_number() OVER (ORDER BY matches DESC, rank DESC, part) AS place FROM (SELECT p_brand AS part, max(p_size) AS rank FROM part GROUP BY p_brand) JOIN m USING (part)),
u AS (SELECT l_orderkey AS unit, count(DISTINCT {_SUBJECT}) AS links FROM lineitem WHERE {_SUBJECT} IN (SELECT source || '>' || target FROM picked) GROUP BY 1),
rows_ AS (
  SELECT 'reports' AS share, 'reports' AS dataset, 0 AS number, place, part AS item, part || ' ' || rank AS text FROM reports
  UNION ALL SELECT 'graph', 'entities', 1, row_number() OVER (ORDER BY score DESC, 'p' || vec_id), 'p' || vec_id, p_name || ' ' || p_brand FROM near JOIN part ON p_partkey = vec_id
  UNION ALL SELECT 'graph', 'relations', 2, place, source || '>' || target, source || ' ' || target || ' w' FROM picked
  UNION ALL SELECT 'graph', 'claims', 3, row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber), CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 's c' FROM lineitem WHERE {_SUBJECT} IN (SELECT source || '>' || target FROM picked)
  UNION ALL SELECT 'sources', 'sources', 4, row_number() OVER (ORDER BY links DESC, unit), CAST(unit AS VARCHAR), 'order ' || unit FROM u),
t AS (SELECT share, dataset, place, item, len(string_split(text, ' ')) AS tokens, CAST(sum(len(string_split(text, ' '))) OVER (PARTITION BY share ORDER BY number, place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM rows_)
SELECT * FROM t WHERE used <= CASE share WHEN 'reports' THEN 60 WHEN 'sources' THEN 200 ELSE 140 END""",
    "global_search_points": f"WITH RECURSIVE {_POINTS} SELECT * FROM points",
    "global_search_answer": f"WITH RECURSIVE {_POINTS} SELECT 'answer ' || substr(sha256('What is made?' || coalesce(chr(10) || string_agg(description, chr(10) ORDER BY place), '')), 1, 12) AS answer FROM points",
    "drift_reduce": """WITH a AS (SELECT o_custkey AS question, o_orderkey AS answer_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, len(string_split('order ' || o_orderkey || ' ' || o_orderstatus || ' ' || o_orderpriority, ' ')) AS tokens FROM orders),
k AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY question ORDER BY place) AS BIGINT) AS used FROM a QUALIFY used <= 24),
c AS (SELECT DISTINCT question, place, l_suppkey AS ref FROM k JOIN lineitem ON l_orderkey = answer_id),
l AS (SELECT question, ref, row_number() OVER (PARTITION BY question ORDER BY place, ref) AS number FROM (SELECT question, ref, min(place) AS place FROM c GROUP BY ALL)),
s AS (SELECT question, place, string_agg(number, ',' ORDER BY number) AS cites FROM c JOIN l USING (question, ref) GROUP BY ALL)
SELECT question, place, answer_id, tokens, used, coalesce(cites, '') AS cites FROM k LEFT JOIN s USING (question, place)""",
    "memory_record": f"""WITH {domain.VERSIONS_SQL}, latest AS (SELECT * FROM versions WHERE candidate_number = 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1),
c AS (SELECT conv_id, count(*) AS n, CAST(count(*) FILTER (conv_id % 4 = 0 AND turn = 0) AS BIGINT) AS rejected, 'u' || conv_id % 2000 AS id FROM conversations GROUP BY conv_id),
i AS (SELECT c.*, l.deleted, l.id IS NULL AS fresh, CASE WHEN conv_id % 3 = 0 THEN 'other' ELSE coalesce(l.content_hash, 'first') END = l.content_hash AS same FROM c LEFT JOIN latest l ON c.id = l.id)
SELECT conv_id, CASE WHEN rejected = 0 THEN 1 ELSE 0 END::BIGINT AS appended, n - rejected AS repeated, rejected,
  CAST(rejected = 0 AND fresh AS BIGINT) AS created, CAST(rejected = 0 AND NOT fresh AND same AND NOT deleted AS BIGINT) AS confirmed,
  CAST(rejected = 0 AND NOT fresh AND NOT (same AND NOT deleted) AS BIGINT) AS candidates FROM i""",
    "memory_search_all": f"""WITH {domain.RELATIONS_SQL}, {search._NEAR},
exact_ AS (SELECT 'p' || p_partkey AS id, row_number() OVER (ORDER BY p_type, 'p' || p_partkey) AS i, count(*) OVER () > 10 AS more FROM part WHERE p_name = 'red widget'),
found AS (SELECT 'red widget' AS title, id, more FROM exact_ WHERE i <= 10 UNION ALL SELECT 'no such title', node, false FROM sel),
rel AS (SELECT title, id, source || '>' || target AS item, row_number() OVER (PARTITION BY title, id ORDER BY source, target) AS place, count(*) OVER (PARTITION BY title, id) > 20 AS truncated FROM found JOIN relations ON target = id)
SELECT 'entity' AS item_kind, id AS entity, id AS item, row_number() OVER (PARTITION BY title ORDER BY id) AS place, more AS truncated, title FROM found
UNION ALL SELECT 'relation', id, item, place, truncated, title FROM rel WHERE place <= 20""",
}
