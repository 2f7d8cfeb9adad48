"""Query strategies as retrieval plans: basic, local, global, branching, and memory search.

Everything around the language model is relational: which rows are evidence, in which order, and
how much of them fits. Models come in as callables (text -> text); the defaults answer deterministically.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import context, corpus, graph, vectors
from sparkloom.plans import domain
from sparkloom.session import checkpointed, table, written

Model = Callable[[str], str]


def stub_model(prompt: str) -> str:
    """A deterministic answer for tests and offline runs."""
    return f"answer {hashlib.sha256(prompt.encode()).hexdigest()[:12]}"


def ask(prompts: DataFrame, model: Model = stub_model) -> DataFrame:
    """(key, answer) for prompts (key, prompt): the model is called in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "answer": [model(x) for x in batch["prompt"]]})

    return prompts.select("key", "prompt").mapInPandas(run, "key long, answer string")


OUTCOMES = "key long, answer string, outcome string, reason string, calls int"
Check = Callable[[str], str | None]
Corrector = Callable[[str, str, str], str]


def ask_outcomes(prompts: DataFrame, model: Model = stub_model, check: Check | None = None, corrector: Corrector | None = None) -> DataFrame:
    """(key, answer, outcome, reason, calls) for prompts (key, prompt): what became of each, whatever the model does.

    check gives the reason why an answer isn't valid, or None. An invalid answer is corrected once: corrector gets the prompt, the rejected answer and the reason,
    and what it says is checked again. outcome is `succeeded`, `model failure` (the model or its corrector raised; reason says what) or `invalid response` (reason is that of the last
    check); only the first has an answer. A failing call costs its row, not the job.
    """

    def outcome(prompt: str) -> tuple[str | None, str, str | None, int]:
        calls, answer, reason = 0, None, None
        for call in (lambda: model(prompt), lambda: corrector(prompt, answer, reason)):
            if calls and corrector is None:
                break
            calls += 1
            try:
                answer = call()
            except Exception as e:  # a user's model may raise anything
                return None, "model failure", f"{type(e).__name__}: {e}", calls
            reason = check(answer) if check else None
            if reason is None:
                return answer, "succeeded", None, calls
        return None, "invalid response", reason, calls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [outcome(x) for x in batch["prompt"]]
            yield pd.DataFrame({"key": batch["key"], **{name: [x[i] for x in found] for i, name in enumerate(("answer", "outcome", "reason", "calls"))}})

    return prompts.select("key", "prompt").mapInPandas(run, OUTCOMES)


class Corrected:
    """A corrector as a model whose prompts carry its three texts as JSON (prompt, output, error)."""

    def __init__(self, corrector: Corrector):
        self.corrector = corrector

    def __call__(self, prompt: str) -> str:
        parts = json.loads(prompt)
        return self.corrector(parts["prompt"], parts["output"], parts["error"])


# --- basic --------------------------------------------------------------------------------------


def window_numbers(texts: DataFrame, size: int = corpus.SIZE, overlap: int = corpus.OVERLAP) -> DataFrame:
    """(doc_id, first, windows): how many windows each text (doc_id, text) has, and the number of its first one in corpus order. Texts are read once, only
    to count their tokens; sums run over range partitions of the counts."""
    n = T.token_count(F.col("text"))
    windows = F.when(n > 0, F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap))).cast("long") + 1).otherwise(0)
    counts = checkpointed(texts.select("doc_id", windows.alias("windows")))  # before the range partitions, which read their rows twice
    dealt = checkpointed(counts.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("windows").alias("n"))
    before = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    within = F.sum("windows").over(W.partitionBy("part").orderBy("doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("windows")
    return dealt.withColumn("within", within).join(before, "part").select("doc_id", (F.col("before") + F.col("within")).alias("first"), "windows")


def basic_context(texts: DataFrame, unit_vectors: DataFrame, query: list[float], k: int = 10, budget: int = 12_000) -> DataFrame:
    """The k nearest units of texts (doc_id, text) in corpus order, as many as the budget holds. Vector v is that of unit number v in corpus order, over all
    windows of all texts; only texts with one of the k are cut."""
    near = checkpointed(vectors.top_k(unit_vectors, query, k))
    numbers = window_numbers(texts).join(F.broadcast(near), (F.col("vec_id") >= F.col("first")) & (F.col("vec_id") < F.col("first") + F.col("windows")))  # k rows
    chosen = checkpointed(numbers.select("doc_id", (F.col("vec_id") - F.col("first")).alias("window_no"), "score", "vec_id"))
    few = texts.where(F.col("doc_id").isin([x["doc_id"] for x in chosen.select("doc_id").distinct().collect()]))  # at most k, and the scan can leave out the others
    rows = corpus.token_windows(few).join(F.broadcast(chosen), ["doc_id", "window_no"]).withColumn("one", F.lit(0)).withColumn("tokens", F.col("token_count"))
    ordered = rows.withColumn("place", F.row_number().over(W.partitionBy("one").orderBy("doc_id", "window_no")))  # k rows
    return context.budget_prefix(ordered, "one", "place", budget, 2).drop("one", "tokens")


# --- local --------------------------------------------------------------------------------------


def select_relationships(edges: DataFrame, selected: DataFrame, per_entity: int) -> DataFrame:
    """Relations of selected entities (node): those among them all come first; of the others, those whose outside end
    has most links to the selection, then by combined degree and weight, up to per_entity times the selection."""
    chosen = written(selected.select("node").distinct())
    near = written(graph.touching(edges, chosen))  # few rows: only their ends' degrees are counted
    ends = written(near.select(F.explode(F.array("source", "target")).alias("node")).distinct())
    ranked = written(graph.combined_degrees(near, graph.degrees(edges, ends)))
    inside = graph.induced(ranked, selected).withColumn("tier", F.lit(0)).withColumn("links", F.lit(0).cast("long"))
    outside = ranked.join(inside.select("source", "target"), ["source", "target"], "left_anti")
    chosen = selected.select(F.col("node").alias("source"), F.lit(True).alias("source_chosen")).distinct()
    outside = outside.join(chosen, "source", "left").withColumn("outer", F.when(F.col("source_chosen"), F.col("target")).otherwise(F.col("source"))).withColumn("inner", F.when(F.col("source_chosen"), F.col("source")).otherwise(F.col("target")))
    links = outside.groupBy("outer").agg(F.count_distinct("inner").alias("links"))
    most = selected.distinct().count() * per_entity
    outside = outside.join(links, "outer").orderBy(F.col("links").desc(), F.col("combined_degree").desc(), F.col("weight").desc(), "source", "target").limit(most)
    columns = ["source", "target", "weight", "combined_degree", "links", "tier"]
    return inside.select(*columns).unionByName(outside.withColumn("tier", F.lit(1)).select(*columns))


def select_reports(members: DataFrame, reports: DataFrame, selected: DataFrame) -> DataFrame:
    """Reports (part, rank) of communities with selected members, by matches, rank and name; communities without a match are dropped."""
    matches = members.join(selected.select("node").distinct(), "node").groupBy("part").agg(F.count("*").alias("matches"))
    ranked = reports.join(matches, "part").withColumns({"_fewer": -F.col("matches"), "_lower": -F.col("rank")})
    return graph.numbered(ranked, "_fewer", "_lower", "part").withColumn("place", F.col("place") + 1).drop("_fewer", "_lower")


def claims_for(claims: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Claims whose subject (subject_kind, subject_id) is a selected entity or relation."""
    subjects = entities.select(F.lit("entity").alias("subject_kind"), F.col("node").alias("subject_id")).unionByName(relations.select(F.lit("relation").alias("subject_kind"), F.concat_ws(">", "source", "target").alias("subject_id")))
    return claims.join(subjects.distinct(), ["subject_kind", "subject_id"], "left_semi")


def local_budgets(total: int, report_share: float = 0.15, source_share: float = 0.5) -> dict[str, int]:
    """Tokens for each part: reports and sources get whole tokens of their shares, the graph what is left."""
    reports, sources = int(total * report_share), int(total * source_share)
    return {"reports": reports, "sources": sources, "graph": total - reports - sources}


# --- global and branching -------------------------------------------------------------------------


def global_reports(reports: DataFrame, level: int, least_rank: float) -> DataFrame:
    """Reports down to a level with at least a rank."""
    return reports.where((F.col("level") <= level) & (F.col("rank") >= least_rank))


def dynamic_selection(tree: DataFrame, ratings: DataFrame, threshold: int, keep_parent: bool = False, fallback_levels: int = 2) -> DataFrame:
    """Walks a community tree (part, parent) from its roots: communities rated at least `threshold` are kept, and
    their children are rated in turn; a kept parent of kept children goes unless keep_parent. Where no community of a level
    is kept, the whole next level is tried, down to fallback_levels. One step of joins per level, until none is kept."""
    level = tree.where("parent IS NULL").select("part")
    kept = None
    for number in range(fallback_levels + 1):
        if number:
            level = checkpointed(tree.join(level.withColumnRenamed("part", "parent"), "parent").select("part"))
        frontier = level
        while not (good := checkpointed(frontier.join(ratings, "part").where(F.col("rating") >= threshold).select("part"))).isEmpty():
            kept = good if kept is None else kept.unionByName(good)
            frontier = tree.join(good.withColumnRenamed("part", "parent"), "parent").select("part")
        if kept is not None:
            break
    if kept is None:
        return level.limit(0)
    if keep_parent:
        return kept
    replaced = tree.join(kept, "part").select(F.col("parent").alias("part")).where("part IS NOT NULL").distinct()
    return kept.join(replaced, "part", "left_anti")


def map_reduce(reports: DataFrame, question: str, budget: int, model: Model = stub_model) -> DataFrame:
    """Map step of the global strategy: reports (place, text, tokens) in order in batches under the budget, one answer per batch."""
    batches = context.packed(reports.withColumn("question", F.lit(0)), "question", "place", budget).select("place", "batch")
    ordered = F.array_sort(F.collect_list(F.struct("place", "text")))
    prompts = reports.join(batches, "place").groupBy("batch").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("rows"))
    return ask(prompts.select(F.col("batch").alias("key"), F.concat(F.lit(question + "\n"), "rows").alias("prompt")), model)


def branch(roots: DataFrame, follow_ups: DataFrame, depth: int = 3, most: int = 60) -> DataFrame:
    """Breadth-first branching over questions: follow_ups (question, next). (question, depth), each question once, where it
    is met first; at most `most` in the order of depth and question."""
    seen = checkpointed(roots.select("question").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        near = follow_ups.join(frontier, "question").select(F.col("next").alias("question")).distinct()
        frontier = checkpointed(near.join(seen, "question", "left_anti").withColumn("depth", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "question").limit(most)


class RequestBudget:
    """Calls and tokens that a branching search may use; what is reserved is settled with what was used."""

    def __init__(self, calls: int = 80, prompt: int = 1_000_000, output: int = 160_000):
        self.left = {"calls": calls, "prompt": prompt, "output": output}

    def reserve(self, prompt: int, output: int) -> bool:
        need = {"calls": 1, "prompt": prompt, "output": output}
        if any(self.left[k] < n for k, n in need.items()):
            return False
        for k, n in need.items():
            self.left[k] -= n
        return True

    def settle(self, reserved: tuple[int, int], used: tuple[int, int]) -> None:
        for k, held, n in zip(("prompt", "output"), reserved, used, strict=True):
            self.left[k] += held - n


# --- memory -------------------------------------------------------------------------------------


def memory_exact(entities: DataFrame, title: str, type_: str = "", most: int = 10) -> DataFrame:
    """Entities of a title, of a type if one is given, in order; `more` tells that there are further ones."""
    found = entities.where((F.col("title") == title) & ((F.lit(type_) == "") | (F.col("type") == type_)))
    page = found.orderBy("type", "id").limit(most + 1)
    place = page.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("type", "id")))  # a page
    return place.withColumn("more", F.max("place").over(W.partitionBy(F.lit(0))) > most).where(F.col("place") <= most).drop("place")


def text_filter(entities: DataFrame, query: str, type_: str | None = None) -> DataFrame:
    """Substring in title, description or any alias, whatever the case; an empty query matches all."""
    q = query.lower()
    hit = F.lower("title").contains(q) | F.lower("description").contains(q) | F.exists("aliases", lambda x: F.lower(x).contains(q))
    found = entities if not q else entities.where(hit)
    return found if type_ is None else found.where(F.col("type") == type_)


def memory_relations(edges: DataFrame, node: str, most: int) -> DataFrame:
    """Relations of an entity, the first by their ends."""
    return edges.where((F.col("source") == node) | (F.col("target") == node)).orderBy("source", "target").limit(most)


# --- over the driver tables -----------------------------------------------------------------------


def _query(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def _entities(spark, sf_dir) -> DataFrame:
    """Parts as entities, each with the vector of its number."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("type"), F.array(F.lower("p_brand"), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("aliases"), F.concat_ws(" ", "p_name", "p_brand").alias("description"))


def _selected(spark, sf_dir) -> DataFrame:
    near = vectors.top_k(table(spark, sf_dir, "embeddings").where("vec_id > 0"), _query(spark, sf_dir), 10)
    return near.select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("node"))


def _members(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("part"))


def basic_search(spark, sf_dir):
    """Vector v of the table stands for the v-th window of all documents."""
    texts = corpus.prepared_texts(table(spark, sf_dir, "documents"))
    found = basic_context(texts, table(spark, sf_dir, "embeddings").where("vec_id > 0"), _query(spark, sf_dir), 10, 500)
    return found.select("doc_id", "window_no", "token_count", F.round("score", 5).alias("score"), "used", F.sha2("unit", 256).alias("digest"))


def local_select_relationships(spark, sf_dir):
    return select_relationships(domain.relations(spark, sf_dir), _selected(spark, sf_dir), 5)


def local_select_reports(spark, sf_dir):
    reports = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("part")).agg(F.max("p_size").cast("long").alias("rank"))
    return select_reports(_members(spark, sf_dir), reports, _selected(spark, sf_dir))


def local_claims(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").select(F.lit("relation").alias("subject_kind"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(">p"), F.col("l_partkey").cast("string")).alias("subject_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"))
    claims = claims.unionByName(table(spark, sf_dir, "part").select(F.lit("entity").alias("subject_kind"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("subject_id"), (-F.col("p_partkey")).alias("claim")))
    selected = _selected(spark, sf_dir)
    return claims_for(claims, selected, graph.touching(domain.relations(spark, sf_dir), selected))


def global_selection(spark, sf_dir):
    reports = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("part")).agg((F.max("p_size") % 3).cast("long").alias("level"), F.round(F.avg("p_retailprice"), 4).alias("rank"))
    return global_reports(reports, 1, 950.0)


def _tree(spark, sf_dir) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("part"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("part"), F.lit(None).cast("string").alias("parent"))
    customers = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("part"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"))
    return regions.unionByName(nations).unionByName(customers)


def global_dynamic_selection(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    ratings = tree.select("part", (F.pmod(F.substring("part", 2, 9).cast("int") * 7, F.lit(5))).alias("rating"))
    return dynamic_selection(tree, ratings, 2)


def global_map(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.col("p_name").alias("text"), F.size(F.split("p_name", " ")).cast("long").alias("tokens"))
    return map_reduce(rows, "What is made?", 1000)


def drift_branches(spark, sf_dir):
    edges = domain.relations(spark, sf_dir)
    follow = edges.select(F.col("source").alias("question"), F.col("target").alias("next")).unionByName(edges.select(F.col("target").alias("question"), F.col("source").alias("next")))
    return branch(spark.createDataFrame([("s1",), ("s2",)], "question string"), follow)


def memory_search_exact(spark, sf_dir):
    return memory_exact(_entities(spark, sf_dir), "red widget").select("id", "title", "type", "more")


def memory_search_text(spark, sf_dir):
    return text_filter(_entities(spark, sf_dir), "BRAND#2", "ECONOMY").select("id", "title")


def memory_search_relations(spark, sf_dir):
    return memory_relations(domain.relations(spark, sf_dir), "p7", 20).select("source", "target", "weight")


def alias_normalize(spark, sf_dir):
    entities = _entities(spark, sf_dir)
    return entities.select("id", F.array_join(T.normalize_aliases(F.concat("aliases", F.array(F.col("title"), F.lit(" "), F.lower("type"))), F.col("title")), "|").alias("aliases"))


QUERIES = {
    f.__name__: f
    for f in (basic_search, local_select_relationships, local_select_reports, local_claims, global_selection, global_dynamic_selection, global_map, drift_branches, memory_search_exact, memory_search_text, memory_search_relations, alias_normalize)
}

_NEAR = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), near AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q WHERE vec_id > 0 ORDER BY score DESC, vec_id LIMIT 10), sel AS (SELECT 'p' || vec_id AS node FROM near)"
_COMBINED = graph._COMBINED

ORACLE_SQL = {
    "basic_search": f"WITH {corpus._UNITS_SQL}, {_NEAR}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id, window_no) - 1 AS number FROM units), r AS (SELECT doc_id, window_no, token_count, round(score, 5) AS score, CAST(sum(token_count) OVER (ORDER BY doc_id, window_no) AS BIGINT) + 2 AS used, unit_id AS digest FROM n JOIN near ON vec_id = number) SELECT * FROM r WHERE used <= 500",
    "local_select_relationships": f"""WITH {_COMBINED}, {_NEAR}, t AS (SELECT * FROM combined WHERE target IN (SELECT node FROM sel)), l AS (SELECT source, count(DISTINCT target) AS links FROM t GROUP BY source)
SELECT t.source, t.target, t.weight, t.combined_degree, l.links, 1 AS tier FROM t JOIN l ON t.source = l.source ORDER BY links DESC, combined_degree DESC, weight DESC, t.source, t.target LIMIT 50""",
    "local_select_reports": f"WITH {_NEAR}, m AS (SELECT p_brand AS part, count(*) AS matches FROM part JOIN near ON vec_id = p_partkey GROUP BY p_brand), r AS (SELECT p_brand AS part, CAST(max(p_size) AS BIGINT) AS rank FROM part GROUP BY p_brand) SELECT part, rank, matches, row_number() OVER (ORDER BY matches DESC, rank DESC, part) AS place FROM r JOIN m USING (part)",
    "local_claims": f"WITH {_NEAR} SELECT 'relation' AS subject_kind, 's' || l_suppkey || '>p' || l_partkey AS subject_id, l_orderkey * 10 + l_linenumber AS claim FROM lineitem WHERE l_partkey IN (SELECT vec_id FROM near) UNION ALL SELECT 'entity', 'p' || p_partkey, -p_partkey FROM part WHERE p_partkey IN (SELECT vec_id FROM near)",
    "global_selection": "WITH r AS (SELECT p_brand AS part, CAST(max(p_size) % 3 AS BIGINT) AS level, round(avg(p_retailprice), 4) AS rank FROM part GROUP BY p_brand) SELECT * FROM r WHERE level <= 1 AND rank >= 950.0",
    "global_dynamic_selection": """WITH RECURSIVE tree AS (SELECT 'r' || r_regionkey AS part, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
good AS (SELECT part, parent FROM tree WHERE CAST(substr(part, 2) AS INT) * 7 % 5 >= 2), kept AS (SELECT part, parent FROM good WHERE parent IS NULL UNION ALL SELECT g.part, g.parent FROM good g JOIN kept k ON g.parent = k.part)
SELECT part FROM kept WHERE part NOT IN (SELECT parent FROM kept WHERE parent IS NOT NULL)""",
    "global_map": """WITH RECURSIVE n AS (SELECT p_name AS text, len(string_split(p_name, ' ')) AS tokens, row_number() OVER (ORDER BY p_partkey) AS i FROM part),
f AS (SELECT i, text, 0 AS batch, tokens AS used FROM n WHERE i = 1 UNION ALL SELECT n.i, n.text, CASE WHEN f.used + n.tokens > 1000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + n.tokens > 1000 THEN n.tokens ELSE f.used + n.tokens END FROM f JOIN n ON n.i = f.i + 1)
SELECT CAST(batch AS BIGINT) AS key, 'answer ' || substr(sha256('What is made?' || chr(10) || string_agg(text, chr(10) ORDER BY i)), 1, 12) AS answer FROM f GROUP BY batch""",
    "drift_branches": f"""WITH RECURSIVE {domain.RELATIONS_SQL}, e AS (SELECT source AS a, target AS b FROM relations UNION SELECT target, source FROM relations),
w AS (SELECT unnest(['s1', 's2']) AS question, 0 AS depth UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON w.question = e.a WHERE w.depth < 3) SELECT question, min(depth) AS depth FROM w GROUP BY question ORDER BY depth, question LIMIT 60""",
    "memory_search_exact": "WITH f AS (SELECT 'p' || p_partkey AS id, p_name AS title, p_type AS type, row_number() OVER (ORDER BY p_type, 'p' || p_partkey) AS place, count(*) OVER () > 10 AS more FROM part WHERE p_name = 'red widget') SELECT id, title, type, more FROM f WHERE place <= 10",
    "memory_search_text": "SELECT 'p' || p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'brand#2') AND p_type = 'ECONOMY'",
    "memory_search_relations": f"WITH {domain.RELATIONS_SQL} SELECT source, target, weight FROM relations WHERE target = 'p7' ORDER BY source, target LIMIT 20",
    "alias_normalize": "SELECT 'p' || p_partkey AS id, array_to_string(list_sort(list_distinct([upper(p_brand), 'SIZE ' || p_size, upper(p_type)])), '|') AS aliases FROM part",
}
