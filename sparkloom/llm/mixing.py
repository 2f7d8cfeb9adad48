"""Mixing sources to target weights: budgets flow down a domain-language-source tree.

Every node has a weight among its siblings and a capacity, the tokens of its documents times
the epochs allowed. A node's budget is shared among its children by weight; a child that cannot
use its share gives the rest to its siblings, and only what the whole subtree cannot use goes up
to the siblings of an ancestor. With capacities summed upwards first, that is one water-filling
per node from the root down: share = min(capacity, level * weight).

A leaf's budget is taken from its epochs, each a permutation of all its documents seeded by
(seed, epoch): whole epochs first, then the token-prefix of the next one. The cut in that last
epoch is found from token sums of SLOTS ranges of the permutation's keys, and only the range
with the cut is put in order, so the largest leaf is never sorted or gathered as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, checkpointed, read, text_of

LEVELS = ["domain", "lang", "source"]
#: Hexadecimal digits of a permutation key that name its slot: 16^3 slots in a leaf.
SLOT_DIGITS = 3
#: A plan of leaves up to this size is broadcast to its documents; a larger one meets them in a shuffle.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Mix:
    """Target weights by name at each level (names not listed weigh `default_weight`); budget as a share of all tokens."""

    domain: dict[str, float] = field(default_factory=dict)
    lang: dict[str, float] = field(default_factory=dict)
    source: dict[str, float] = field(default_factory=dict)
    default_weight: float = 1.0
    budget_share: float = 0.8
    max_epochs: int = 2
    seed: int = 42

    def weight(self, level: str) -> Column:
        weights = getattr(self, level)
        if not weights:
            return F.lit(self.default_weight)
        pairs = [F.lit(x) for name, weight in weights.items() for x in (name, float(weight))]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col(level)), F.lit(self.default_weight))


#: Weights of the registered query and of the pipeline's stage.
PRODUCTION = Mix(domain={"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, lang={"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}, source={"src0": 2.0})


def domain_of(source: Column) -> Column:
    """The domain that a source is filed under where no table says so: one of four, by the first digit of its MD5."""
    return F.concat(F.lit("d"), ((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(source), 1, 1)) - 1) % 4).cast("string"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the leaf of each document; null lang or source is the name ''."""
    named = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("n_tokens"))
    return named.withColumn("domain", domain_of(F.col("source")))


def epoch_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def water_fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Shares `budget` of the parents among nodes (capacity, weight) by weight; adds `share`."""
    within = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    ordered = within.orderBy("ratio", name)
    ranked = nodes.withColumn("ratio", ratio).withColumn("before", F.coalesce(F.sum("capacity").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("weights_left", F.sum("weight").over(ordered.rowsBetween(W.currentRow, W.unboundedFollowing)))
    ranked = ranked.withColumn("level", F.when(F.col("weights_left") > 0, (F.col("budget") - F.col("before")) / F.col("weights_left")).otherwise(F.lit(0.0)))
    ranked = ranked.withColumn("full", F.col("ratio") <= F.col("level"))
    ranked = ranked.withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(within))
    share = F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.greatest(F.lit(0.0), F.col("weight") * F.col("water")))
    return ranked.withColumn("share", share).drop("ratio", "before", "weights_left", "level", "full", "water", "budget")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: domain, lang, source, tokens. Adds `target`, the whole tokens that each leaf gives."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    shared = None
    for depth, level in enumerate(LEVELS):
        parents = LEVELS[:depth]
        nodes = leaves.groupBy(*parents, level).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens")).withColumn("weight", mix.weight(level))
        total = F.sum("tokens").over(W.partitionBy(F.lit(0))) * mix.budget_share  # of all domains
        nodes = nodes.join(shared, parents) if parents else nodes.withColumn("budget", total)
        shared = water_fill(nodes, parents, level).select(*LEVELS[: depth + 1], F.col("share").alias("budget"))
    return leaves.join(shared, LEVELS).select(*LEVELS, "tokens", F.least(F.floor(F.col("budget") + 1e-6), "capacity").cast("long").alias("target"))


def mix_plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """From placed rows: per leaf its tokens, target, whole epochs, and the key and tokens of its cut (null: none)."""
    leaves = checkpointed(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    plan = leaf_budgets(leaves, mix)
    plan = plan.where("tokens > 0").withColumn("epochs", F.floor(F.col("target") / F.col("tokens")).cast("int"))
    plan = checkpointed(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("tokens")))
    keyed = rows.join(plan.where("rest > 0").select(*LEVELS, "epochs", "rest"), LEVELS)
    keyed = keyed.withColumn("key", epoch_key(mix.seed, F.col("epochs"))).withColumn("slot", F.substring("key", 1, SLOT_DIGITS))
    slots = keyed.groupBy(*LEVELS, "slot").agg(F.sum("n_tokens").alias("in_slot"), F.first("rest").alias("rest"))
    up_to = F.sum("in_slot").over(W.partitionBy(*LEVELS).orderBy("slot"))
    cut = slots.withColumn("before", up_to - F.col("in_slot")).where("before < rest AND rest <= before + in_slot")
    near = keyed.drop("rest").join(cut, [*LEVELS, "slot"]).groupBy(*LEVELS, "slot", "key").agg(F.sum("n_tokens").alias("n_tokens"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    start = F.col("before") + F.sum("n_tokens").over(W.partitionBy(*LEVELS, "slot").orderBy("key")) - F.col("n_tokens")
    last = near.withColumn("start", start).where("start < rest AND rest <= start + n_tokens")
    last = last.select(*LEVELS, F.col("key").alias("cut_key"), (F.col("rest") - F.col("start")).alias("cut_tokens"))
    return plan.join(last, LEVELS, "left").select(*LEVELS, "tokens", "target", "epochs", "cut_key", "cut_tokens")


def _sized(plan: DataFrame) -> DataFrame:
    """A plan (checkpointed), marked for broadcast if its rows are measured to fit; so whole texts needn't be shuffled by leaf."""
    size = plan.agg(F.sum(sum((F.octet_length(x) for x in LEVELS), F.lit(128)))).first()[0] or 0
    return F.broadcast(plan) if size <= BROADCAST_BYTES else plan


def _chosen(rows: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """rows times the epochs that take them: adds epoch and tokens_taken."""
    key = epoch_key(mix.seed, F.col("epochs"))
    joined = rows.join(_sized(plan.select(*LEVELS, "epochs", "cut_key", "cut_tokens")), LEVELS).withColumn("key", key)
    last = F.coalesce((F.col("key") <= F.col("cut_key")).cast("int"), F.lit(0))
    taken = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") + last)))
    taken = taken.where(F.col("epoch") < F.col("epochs") + last)
    cut = (F.col("epoch") == F.col("epochs")) & (F.col("key") == F.col("cut_key"))
    return taken.withColumn("tokens_taken", F.when(cut, F.least("cut_tokens", "n_tokens")).otherwise(F.col("n_tokens"))).drop("epochs", "cut_key", "cut_tokens", "key")


def mix_sources(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """Selects documents so that the tree's leaves give tokens by target weights.

    docs: doc_id, text, lang, source; a token is a word of the text. Other columns are ignored.
    Returns one row per document and epoch that takes it: domain, lang, source, epoch, doc_id,
    n_tokens, tokens_taken (less than n_tokens only for the document that a leaf's token-prefix ends in).
    Null text has no tokens, null lang or source is a leaf of the name ''; a leaf without tokens
    gives nothing. Rows that repeat a doc_id share its place in every permutation and are taken
    together. A weight of 0 gives a node nothing. An empty table gives no rows.
    """
    rows = checkpointed(placed(docs))
    plan = checkpointed(mix_plan(rows, mix))
    return _chosen(rows, plan, mix).select(*LEVELS, "epoch", "doc_id", "n_tokens", "tokens_taken")


def mixed_documents(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """The documents as mix_sources takes them, once per epoch, with all their columns, whatever their names.

    The document that a leaf's token-prefix ends in has the text of its tokens taken, joined by one space; all other texts are whole.
    Nulls, repeated rows, ties and empty tables are as in mix_sources; a document of no tokens is taken with the epochs it lies in.
    """
    rows = checkpointed(placed(docs))
    plan = checkpointed(mix_plan(rows, mix))
    packed = docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("d"))
    leaf = packed.select("d", F.col("d.doc_id").alias("doc_id"), F.coalesce("d.lang", F.lit("")).alias("lang"), F.coalesce("d.source", F.lit("")).alias("source")).withColumn("domain", domain_of(F.col("source")))
    joined = leaf.join(_sized(plan.select(*LEVELS, "epochs", "cut_key", "cut_tokens")), LEVELS).withColumn("key", epoch_key(mix.seed, F.col("epochs")))
    times = F.col("epochs") + F.coalesce((F.col("key") <= F.col("cut_key")).cast("int"), F.lit(0))
    taken = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), times))).where(F.col("epoch") < times)
    ends = (F.col("epoch") == F.col("epochs")) & (F.col("key") == F.col("cut_key"))
    words = F.regexp_extract_all(F.coalesce("d.text", F.lit("")), F.lit(WORD), F.lit(0))
    cut = F.when(ends & (F.size(words) > F.col("cut_tokens")), F.array_join(F.slice(words, F.lit(1), F.col("cut_tokens").cast("int")), " ")).otherwise(F.col("d.text"))
    return taken.select(*[cut.alias("text") if x == "text" else F.col("d")[x].alias(x) for x in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


QUERIES = {"op1_mix_sources": op1_mix_sources}


def _fill_sql(out: str, source: str, parents: list[str], name: str) -> str:
    """The same water-filling as water_fill(), over (parents, name, capacity, weight, budget)."""
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    keys = ", ".join([*parents, name])
    return f"""
{out}_r AS (SELECT *, CASE WHEN weight > 0 THEN capacity / weight ELSE 'inf'::DOUBLE END AS ratio FROM {source}),
{out}_s AS (SELECT *, coalesce(sum(capacity) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
  sum(weight) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM {out}_r),
{out}_l AS (SELECT *, CASE WHEN left_ > 0 THEN (budget - before_) / left_ ELSE 0.0 END AS level_ FROM {out}_s),
{out}_w AS (SELECT *, max(CASE WHEN NOT ratio <= level_ THEN level_ END) OVER ({part}) AS water FROM {out}_l),
{out} AS (SELECT {keys}, CASE WHEN ratio <= level_ THEN capacity::DOUBLE ELSE greatest(0.0, weight * water) END AS budget FROM {out}_w)"""


def _case_sql(level: str, mix: Mix) -> str:
    cases = "".join(f" WHEN '{name}' THEN {float(weight)}" for name, weight in getattr(mix, level).items())
    return f"(CASE {level}{cases} ELSE {mix.default_weight} END)::DOUBLE" if cases else f"{mix.default_weight}::DOUBLE"


def _oracle(mix: Mix) -> str:
    return rf"""
WITH rows_ AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         'd' || CAST((strpos('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 4 AS VARCHAR) AS domain
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {mix.max_epochs} AS capacity FROM rows_ GROUP BY ALL),
n1 AS (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, {_case_sql("domain", mix)} AS weight,
  (SELECT CAST(sum(tokens) AS BIGINT) * {mix.budget_share}::DOUBLE FROM leaves) AS budget FROM leaves GROUP BY domain),
{_fill_sql("b1", "n1", [], "domain")},
n2 AS (SELECT l.domain, l.lang, CAST(sum(capacity) AS BIGINT) AS capacity, {_case_sql("lang", mix)} AS weight, any_value(b1.budget) AS budget
  FROM leaves l JOIN b1 ON l.domain = b1.domain GROUP BY l.domain, l.lang),
{_fill_sql("b2", "n2", ["domain"], "lang")},
n3 AS (SELECT l.domain, l.lang, l.source, l.capacity, {_case_sql("source", mix)} AS weight, b2.budget
  FROM leaves l JOIN b2 ON l.domain = b2.domain AND l.lang = b2.lang),
{_fill_sql("b3", "n3", ["domain", "lang"], "source")},
plan AS (
  SELECT l.domain, l.lang, l.source, tokens, least(CAST(floor(budget + 1e-6) AS BIGINT), capacity) AS target,
         CAST(least(CAST(floor(budget + 1e-6) AS BIGINT), capacity) // tokens AS INTEGER) AS epochs
  FROM leaves l JOIN b3 ON l.domain = b3.domain AND l.lang = b3.lang AND l.source = b3.source WHERE tokens > 0),
spread AS (
  SELECT r.*, p.epochs, p.target - p.epochs * p.tokens AS rest, e.epoch
  FROM rows_ r JOIN plan p ON r.domain = p.domain AND r.lang = p.lang AND r.source = p.source
  CROSS JOIN (SELECT CAST(unnest(range({mix.max_epochs + 1})) AS INTEGER) AS epoch) e WHERE e.epoch <= p.epochs),
placed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch
    ORDER BY md5('{mix.seed}:' || epoch || ':' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_
  FROM spread)
SELECT domain, lang, source, epoch, doc_id, n_tokens,
  CAST(CASE WHEN epoch < epochs THEN n_tokens ELSE least(n_tokens, rest - start_) END AS BIGINT) AS tokens_taken
FROM placed WHERE epoch < epochs OR start_ < rest
"""


ORACLE_SQL = {"op1_mix_sources": _oracle(PRODUCTION)}
