"""Branching search: a primer over the nearest reports, then a walk over follow-up questions under a budget of requests.

All of it runs for many searches at once. A search's state is the rows of its branches, at most a few dozen; each round takes the
next pending ones of every search, gathers the evidence for all their questions in one plan, asks the model in the tasks and
reads its answers strictly. What a search has used is summed from its rows, and what the next requests may use is reserved in
their order before they are made.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import context, graph, responses, search
from sparkloom.plans import domain
from sparkloom.session import checkpointed, dropped, table, written

Model = Callable[[str], str]
#: Gets (key, question) and gives (key, vector), or (key, context) in one row for a key at most.
Embedder = Callable[[DataFrame], DataFrame]
Evidence = Callable[[DataFrame], DataFrame]
#: Vectors in a block; each block of queries meets each block of items in some task.
QUERY_BLOCK = 4096


@dataclass(frozen=True)
class Limits:
    """What one search may use, and the shape of its walk."""

    calls: int = 80
    prompt_tokens: int = 1_000_000
    output_tokens: int = 160_000
    #: Tokens of a single answer; so many are reserved for it.
    answer_tokens: int = 2_000
    #: Tokens of a single prompt of the primer.
    primer_tokens: int = 12_000
    reports: int = 10
    folds: int = 5
    batch: int = 20
    branches: int = 60
    depth: int = 3
    follow_ups: int = 4


def tokens(text: str | Column) -> Column:
    return F.size(F.split(text, " ")).cast("long")


def nearest_to_each(queries: DataFrame, items: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(key, item, score, place): the k items (item, vector) nearest to each query (key, vector) by cosine, ties to the smaller item.

    Queries and items are packed into blocks of `block` vectors, and every pair of blocks meets in a task; a pair keeps k items for a query before they are ranked. Nothing
    of them goes through the driver. Rows without a valid vector, and items of another length than the query, take no part.
    """
    kind = dict(items.dtypes)["item"]
    asked = _blocks(queries.select(F.col("key").cast("long").alias("key"), "vector"), "key", "long", block).toDF("size", "keys", "asked")
    held = _blocks(items, "item", kind, block)
    pairs = held.join(asked.hint("shuffle_replicate_nl"), "size")
    found = pairs.mapInArrow(_near(k), f"key long, item {kind}, score double")
    best = W.partitionBy("key").orderBy(F.col("score").desc(), "item")
    return found.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= k)


def _blocks(rows: DataFrame, name: str, kind: str, block: int) -> DataFrame:
    """(size, names, vectors): valid vectors of one length, scaled to length 1, as rows of at most `block` of them; vectors are the bytes of their doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(x) for x in batch.column("vector").to_pylist()]
            for size in sorted({len(x) for x in vectors}):
                of = [i for i, x in enumerate(vectors) if len(x) == size]
                for begin in range(0, len(of), block):
                    part = of[begin : begin + block]
                    matrix = np.stack([vectors[i] for i in part])
                    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
                    names = batch.column(name).take(pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([names.to_pylist()], pa.list_(names.type)), pa.array([matrix.tobytes()], pa.binary())], names=["size", "names", "vectors"])

    valid = rows.where(T.valid_vector(F.col("vector"))).select(name, F.col("vector").cast("array<double>").alias("vector"))
    return checkpointed(valid.mapInArrow(run, f"size int, names array<{kind}>, vectors binary"))


#: Queries of a block scored at a time: 512 x 4,096 doubles are 16 MB.
SCORED = 512


def _near(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column("size")[i].as_py()
                items, keys = batch.column("names")[i].values, batch.column("keys")[i].values.to_numpy()
                matrix, asked = (np.frombuffer(batch.column(x)[i].as_buffer(), np.float64).reshape(-1, size) for x in ("vectors", "asked"))
                for begin in range(0, len(asked), SCORED):
                    scores = np.clip(asked[begin : begin + SCORED] @ matrix.T, -1.0, 1.0)
                    least = np.partition(scores, -k, axis=1)[:, -k][:, None] if k < len(items) else np.full((len(scores), 1), -2.0)
                    row, column = np.nonzero(scores >= least)  # ties at the border go on
                    yield pa.RecordBatch.from_arrays([pa.array(keys[begin + row]), items.take(pa.array(column)), pa.array(scores[row, column])], names=["key", "item", "score"])

    return run


def embedded(model: Callable[[str], list[float]]) -> Embedder:
    """An embedder that calls a model of single texts in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [model(x) for x in batch.column("question").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(vectors, pa.list_(pa.float64()))], names=["key", "vector"])

    return lambda questions: questions.select("key", "question").mapInArrow(run, "key long, vector array<double>")


def local_evidence(embed: Embedder, entity_vectors: DataFrame, entities: DataFrame, edges: DataFrame, k: int, budget: int) -> Evidence:
    """Evidence for questions: the texts of the k nearest entities in order, then the relations that touch them, each entity's by combined
    degree and weight; a line each, as many as fit the budget. entities: (node, text); entity_vectors: (item, vector) by node. The degrees are
    written once, not found anew for every round of questions."""

    ranked = written(graph.combined_degrees(edges))

    def gather(questions: DataFrame) -> DataFrame:
        near = checkpointed(nearest_to_each(embed(questions), entity_vectors, k))
        named = near.join(entities, F.col("item") == F.col("node")).select("key", F.array(F.lit(0).cast("long"), "place").alias("group"), F.lit(0.0).alias("less"), F.lit(0.0).alias("lighter"), F.col("node").alias("line"), "text")
        ends = ranked.withColumn("item", F.explode(F.array_distinct(F.array("source", "target")))).join(near, "item")
        text = F.concat_ws(" ", "source", "target")
        touched = ends.select("key", F.array(F.lit(1).cast("long"), "place").alias("group"), (-F.col("combined_degree")).cast("double").alias("less"), (-F.col("weight")).cast("double").alias("lighter"), text.alias("line"), text.alias("text"))
        rows = named.unionByName(touched).withColumn("tokens", tokens("text"))
        order = W.partitionBy("key").orderBy("group", "less", "lighter", "line")
        first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget)  # each has a token at least
        used = F.sum("tokens").over(W.partitionBy("key").orderBy("place"))
        kept = first.withColumn("used", used).where(F.col("used") <= budget)
        return kept.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("context"))

    return gather


# --- requests ---------------------------------------------------------------------------------------


def _reserved(requests: DataFrame, limits: Limits) -> DataFrame:
    """The requests (search, no, prompt_tokens; used_calls, used_prompt, used_output of their search) that can be reserved: of each search the first ones, in order, for
    which calls, prompts and the most that their answers may take stay within the limits."""
    so_far = W.partitionBy("search").orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow)
    place, prompt = F.count("*").over(so_far), F.sum("prompt_tokens").over(so_far)
    fits = (F.col("used_calls") + place <= limits.calls) & (F.col("used_prompt") + prompt <= limits.prompt_tokens) & (F.col("used_output") + place * limits.answer_tokens <= limits.output_tokens)
    return requests.withColumn("_fits", fits).where("_fits").drop("_fits")


_ANSWERED = ["answer", "score", "queries", "calls", "output_tokens", "reason"]


def _asked(requests: DataFrame, model: Model, decode: Callable[[DataFrame], DataFrame], limits: Limits, corrector: search.Corrector | None) -> DataFrame:
    """Reserved requests (search, no, prompt, prompt_tokens, used_*) with what came of them: answer, score and queries, or a reason; calls,
    prompt_tokens and output_tokens as used.

    An answer that isn't valid is corrected once, if that can be reserved after all first answers are settled; the corrector gets the prompt, the answer and the reason.
    """
    keyed = checkpointed(graph.numbered(requests, "search", "no").withColumnRenamed("place", "key"))
    first = checkpointed(search.ask_outcomes(keyed.select("key", "prompt"), model).withColumnRenamed("answer", "output"))
    read = decode(first.select("key", F.coalesce("output", F.lit("")).alias("output")))
    rows = keyed.join(first.select("key", "output", "outcome", F.col("reason").alias("failure")), "key").join(read, "key")
    rows = rows.withColumn("output_tokens", F.when(F.col("outcome") == "succeeded", tokens("output")).otherwise(F.lit(0)).cast("long"))
    long = F.col("output_tokens") > limits.answer_tokens
    reason = F.when(F.col("outcome") != "succeeded", F.concat(F.lit("model failure: "), F.coalesce("failure", F.lit("")))).when(long, F.lit("too long")).otherwise(F.col("error"))
    rows = checkpointed(rows.withColumn("reason", reason).withColumn("calls", F.lit(1).cast("long")))
    settled = rows.select(*keyed.columns, *_ANSWERED)
    only_good = {x: F.when(F.col("reason").isNull(), F.col(x)) for x in ("answer", "score", "queries")}
    wrong = rows.where("outcome = 'succeeded' AND error IS NOT NULL").where(~long)
    if corrector is None or wrong.isEmpty():
        return settled.withColumns(only_good).drop("key")
    used = rows.groupBy("search").agg(F.count("*").alias("calls_now"), F.sum("prompt_tokens").alias("prompt_now"), F.sum("output_tokens").alias("output_now"))
    again = wrong.join(used, "search").withColumns({"used_calls": F.col("used_calls") + F.col("calls_now"), "used_prompt": F.col("used_prompt") + F.col("prompt_now"), "used_output": F.col("used_output") + F.col("output_now")})
    again = again.withColumn("first_prompt", F.col("prompt_tokens")).withColumn("prompt_tokens", F.col("prompt_tokens") + F.col("output_tokens") + tokens("error"))
    again = checkpointed(_reserved(again, limits).select("key", "prompt", "output", "error", F.col("prompt_tokens").alias("more_prompt")))
    # the correction's prompt carries three texts; the corrector gets them apart
    told = again.select("key", F.to_json(F.struct("prompt", "output", "error")).alias("prompt"))
    second = checkpointed(search.ask_outcomes(told, search.Corrected(corrector)).withColumnRenamed("answer", "output"))
    fixed = decode(second.select("key", F.coalesce("output", F.lit("")).alias("output"))).join(second.select("key", "output", "outcome", F.col("reason").alias("failure")), "key")
    fixed = fixed.withColumn("more_output", F.when(F.col("outcome") == "succeeded", tokens("output")).otherwise(F.lit(0)).cast("long"))
    failed = F.when(F.col("outcome") != "succeeded", F.concat(F.lit("model failure: "), F.coalesce("failure", F.lit("")))).when(F.col("more_output") > limits.answer_tokens, F.lit("too long")).otherwise(F.col("error"))
    fixed = fixed.select("key", *[F.col(x).alias(f"new_{x}") for x in ("answer", "score", "queries")], "more_output", failed.alias("new_reason")).join(again.select("key", "more_prompt"), "key")
    both = settled.join(fixed, "key", "left")
    retried = F.col("more_prompt").isNotNull()
    for name in ("answer", "score", "queries", "reason"):
        both = both.withColumn(name, F.when(retried, F.col(f"new_{name}")).otherwise(F.col(name)))
    both = both.withColumns({"calls": F.col("calls") + retried.cast("long"), "prompt_tokens": F.col("prompt_tokens") + F.coalesce("more_prompt", F.lit(0)), "output_tokens": F.col("output_tokens") + F.coalesce("more_output", F.lit(0))})
    return both.withColumns(only_good).select(*[x for x in settled.columns if x != "key"])


# --- primer -----------------------------------------------------------------------------------------

def primed(searches: DataFrame, reports: DataFrame, report_vectors: DataFrame, embed: Embedder, hypothetical_model: Model, model: Model, limits: Limits, corrector: search.Corrector | None = None) -> DataFrame:
    """The start of each search (search, question): a hypothetical answer, the reports nearest to it, and what the model makes of them fold by fold.

    reports: (item, text), those that may be used; report_vectors: (item, vector), of which only these take part, before the limit. The first report's text
    is the template of the hypothetical answer, cut to the prompt's tokens; a blank one is replaced by the question. The reports, in order, make
    contiguous folds; each is a prompt with as many of its reports as fit. Folds are reserved in order until the budget is used up. Returns (search, question,
    hypothetical, answer, score, queries, calls, prompt_tokens, output_tokens, fault): answers joined by a blank line, the mean of the scores,
    and all follow-ups in order. A search whose model fails, or that has no report or no room for one fold, has a fault and no answer.
    """
    questions = checkpointed(searches.select("search", F.trim("question").alias("question")))
    template = reports.agg(F.min_by("text", "item").alias("template")).select(F.coalesce("template", F.lit("")).alias("template"))
    room = F.greatest(F.lit(0), F.lit(limits.primer_tokens) - tokens("question"))
    opening = questions.join(F.broadcast(template), how="cross")  # a single row
    opening = opening.select(F.col("search").alias("key"), F.concat_ws(" ", "question", F.array_join(F.slice(F.split("template", " "), 1, room), " ")).alias("prompt"))
    told = checkpointed(search.ask_outcomes(opening, hypothetical_model).join(opening.select("key", tokens("prompt").alias("prompt_tokens")), "key").withColumnRenamed("key", "search"))
    output = F.when(F.col("outcome") == "succeeded", tokens("answer")).otherwise(F.lit(0)).cast("long")
    told = told.withColumn("output_tokens", output)
    fault = F.when(F.col("outcome") != "succeeded", F.concat(F.lit("model failure: "), "reason")).when(F.col("output_tokens") > limits.answer_tokens, F.lit("too long"))
    start = questions.join(told.select("search", "answer", "prompt_tokens", "output_tokens", fault.alias("fault")), "search")
    start = checkpointed(start.withColumn("hypothetical", F.when(F.trim("answer") == "", F.col("question")).otherwise(F.col("answer"))).drop("answer"))
    eligible = report_vectors.join(reports.select("item"), "item", "left_semi")
    asked = start.where("fault IS NULL").select("search", F.col("hypothetical").alias("asked"))
    keyed = checkpointed(graph.numbered(asked.select("asked").distinct(), "asked").withColumnRenamed("place", "key"))
    nearest = nearest_to_each(embed(keyed.select("key", F.col("asked").alias("question"))), eligible, limits.reports)
    near = checkpointed(asked.join(keyed, "asked").join(nearest, "key").select(F.col("search").alias("question"), "item", "score", "place"))
    folds = context.folds(near, limits.folds).withColumnRenamed("question", "search").join(reports, "item")
    folds = folds.join(start.select("search", "question"), "search").withColumn("tokens", tokens("text"))
    used = F.sum("tokens").over(W.partitionBy("search", "fold").orderBy("place")) + tokens("question")
    lines = folds.withColumn("used", used).where(F.col("used") <= limits.primer_tokens).groupBy("search", "fold", "question").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("lines"))
    prompts = lines.select("search", F.col("fold").alias("no"), F.concat_ws("\n", "question", F.transform("lines", lambda x: x["text"])).alias("prompt"))
    prompts = prompts.join(start.select("search", F.lit(1).alias("used_calls"), F.col("prompt_tokens").alias("used_prompt"), F.col("output_tokens").alias("used_output")), "search").withColumn("prompt_tokens", tokens(F.regexp_replace("prompt", "\n", " ")))
    done = checkpointed(_asked(_reserved(prompts, limits), model, responses.decode_primers, limits, corrector))
    joined = F.array_sort(F.collect_list(F.struct("no", "answer", "queries")))
    sums = done.groupBy("search").agg(
        F.array_join(F.transform(joined, lambda x: x["answer"]), "\n\n").alias("answer"), F.avg("score").alias("score"), F.flatten(F.transform(joined, lambda x: x["queries"])).alias("queries"),
        F.sum("calls").alias("calls"), F.sum("prompt_tokens").alias("fold_prompt"), F.sum("output_tokens").alias("fold_output"), F.min_by("reason", "no").alias("first_reason"), F.min("reason").alias("any_reason"),
    )
    rows = start.join(sums, "search", "left")
    reason = F.coalesce("fault", F.when(F.col("calls").isNull(), F.lit("no fold")), "first_reason", "any_reason")
    rows = rows.withColumn("fault", reason)
    good = F.col("fault").isNull()
    return rows.select(
        "search", "question", "hypothetical", F.when(good, F.col("answer")).alias("answer"), F.when(good, F.col("score")).alias("score"), F.when(good, F.col("queries")).alias("queries"),
        (F.coalesce("calls", F.lit(0)) + 1).alias("calls"), (F.col("prompt_tokens") + F.coalesce("fold_prompt", F.lit(0))).alias("prompt_tokens"), (F.col("output_tokens") + F.coalesce("fold_output", F.lit(0))).alias("output_tokens"), "fault",
    )


# --- traversal --------------------------------------------------------------------------------------


def _questions(found: DataFrame, seen: DataFrame, start: DataFrame) -> DataFrame:
    """New pending branches from answers (search, from_no, depth, queries): each question once in its search, numbered on in the order in which they are met."""
    asked = found.select("search", "from_no", "depth", F.posexplode("queries").alias("pos", "question"))
    asked = asked.withColumn("question", F.trim("question")).where("question <> ''")
    fresh = asked.groupBy("search", "question").agg(F.min(F.struct("from_no", "pos", "depth")).alias("first")).join(seen, ["search", "question"], "left_anti")
    place = F.row_number().over(W.partitionBy("search").orderBy("first"))
    return fresh.withColumn("place", place).join(start, "search", "left").select("search", (F.coalesce("last", F.lit(-1)) + F.col("place")).cast("long").alias("no"), "question", (F.col("first.depth") + 1).alias("depth"))


def explored(primers: DataFrame, evidence: Evidence, model: Model, limits: Limits, corrector: search.Corrector | None = None) -> DataFrame:
    """The walk of each search from its primer (search, question, queries, calls, prompt_tokens, output_tokens, ...; those with a fault have none).

    Questions are met breadth first, each once in a search, in the order of the answers that ask them, down to limits.depth. A round takes the first limits.batch pending
    ones, or as many as calls and answers are left for, up to limits.branches in all; requests are reserved in order, and the walk of a search ends where one
    can't be. Returns (search, no, question, depth, status, answer, score, queries, calls, prompt_tokens, output_tokens, reason): status `succeeded`, or `failed` with
    a reason and no follow-ups, which ends no other branch; pending branches were met but stay open.
    """
    start = checkpointed(primers.where("fault IS NULL").select("search", F.col("question").alias("root"), "queries", *[F.col(x).cast("long").alias(f"primer_{x}") for x in ("calls", "prompt_tokens", "output_tokens")]))
    roots = start.select("search", F.col("root").alias("question"))
    none = start.select("search", F.lit(-1).cast("long").alias("last"))
    pending = _questions(start.select("search", F.lit(-1).cast("long").alias("from_no"), F.lit(0).alias("depth"), "queries"), roots, none)
    kinds = {"answer": "string", "score": "long", "queries": "array<string>", "calls": "long", "prompt_tokens": "long", "output_tokens": "long", "reason": "string"}
    state = written(pending.select("search", "no", "question", "depth", F.lit("pending").alias("status"), *[F.lit(0).cast(k).alias(c) if k == "long" and c != "score" else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]))
    while True:
        used = state.groupBy("search").agg(F.sum("calls").alias("c"), F.sum("prompt_tokens").alias("p"), F.sum("output_tokens").alias("o"), F.count_if(F.col("status") != "pending").alias("taken"), F.max("no").alias("last"))
        used = start.join(used, "search").select("search", "root", "taken", "last", (F.col("primer_calls") + F.col("c")).alias("used_calls"), (F.col("primer_prompt_tokens") + F.col("p")).alias("used_prompt"), (F.col("primer_output_tokens") + F.col("o")).alias("used_output"))
        left = F.floor((F.lit(limits.output_tokens) - F.col("used_output")) / limits.answer_tokens)
        room = F.least(F.lit(limits.batch), limits.branches - F.col("taken"), limits.calls - F.col("used_calls"), left)
        used = checkpointed(used.withColumn("room", F.when(F.col("used_prompt") >= limits.prompt_tokens, F.lit(0)).otherwise(room)))
        place = F.row_number().over(W.partitionBy("search").orderBy("no"))
        chosen = checkpointed(state.where("status = 'pending'").select("search", "no", "question", "depth").withColumn("place", place).join(used, "search").where(F.col("place") <= F.col("room")))
        if chosen.isEmpty():
            return state
        keyed = checkpointed(graph.numbered(chosen.select("question").distinct(), "question").withColumnRenamed("place", "key"))  # evidence for a question once, whoever asks it
        gathered = chosen.select("search", "no", "question").join(keyed.join(evidence(keyed.select("key", "question")), "key", "left").select("question", "context"), "question", "left").select("search", "no", F.coalesce("context", F.lit("")).alias("context"))
        prompt = F.concat_ws("\n", "root", "question", F.when(F.col("context") != "", F.col("context")))
        requests = chosen.join(gathered, ["search", "no"]).withColumn("prompt", prompt).withColumn("prompt_tokens", tokens(F.regexp_replace("prompt", "\n", " ")))
        reserved = checkpointed(_reserved(requests.select("search", "no", "prompt", "prompt_tokens", "used_calls", "used_prompt", "used_output"), limits))
        if reserved.isEmpty():
            return state
        done = checkpointed(_asked(reserved, model, lambda x: responses.decode_branches(x, limits.follow_ups), limits, corrector))
        answered = done.join(chosen.select("search", "no", "question", "depth"), ["search", "no"]).withColumn("status", F.when(F.col("reason").isNull(), F.lit("succeeded")).otherwise(F.lit("failed")))
        more = answered.where((F.col("status") == "succeeded") & (F.col("depth") < limits.depth)).select("search", F.col("no").alias("from_no"), "depth", "queries")
        fresh = _questions(more, state.select("search", "question").unionByName(roots), used.select("search", "last"))
        fresh = fresh.select("search", "no", "question", "depth", F.lit("pending").alias("status"), *[F.lit(0).cast(k).alias(c) if k == "long" and c != "score" else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
        following = written(state.join(done.select("search", "no"), ["search", "no"], "left_anti").unionByName(answered.select(*state.columns)).unionByName(fresh))
        dropped(state)
        state = following


def edges_of(primers: DataFrame, branches: DataFrame, depth: int) -> DataFrame:
    """(search, parent, child): every follow-up of the primer and of the answers above the depth, repeated ones included, whose branch was taken."""
    taken = branches.where("status <> 'pending'").select("search", F.col("question").alias("child"))
    asked = primers.where("fault IS NULL").select("search", F.col("question").alias("parent"), F.explode("queries").alias("child"))
    asked = asked.unionByName(branches.where((F.col("status") == "succeeded") & (F.col("depth") < depth)).select("search", F.col("question").alias("parent"), F.explode("queries").alias("child")))
    roots = primers.select("search", F.col("question").alias("child"))
    return asked.withColumn("child", F.trim("child")).join(taken.unionByName(roots), ["search", "child"], "left_semi").select("search", "parent", "child")


# --- over the driver tables -------------------------------------------------------------------------

WALK = Limits(calls=16, answer_tokens=60, reports=7, folds=3, batch=5, branches=18, primer_tokens=40)
#: Tokens of the evidence for a question, and entities that it comes from.
EVIDENCE, NEAREST = 24, 3


def _number(name: str) -> int:
    return int("".join(x for x in name if x.isdigit()) or 0)


def _answer(prompt: str, field: str, lines: list[str], score: int) -> str:
    """An answer that names the entities which begin the lines as follow-ups, the first four."""
    names = [f"p{_number(x.split(' ')[0])}" for x in lines]
    return json.dumps({field: search.stub_model(prompt), "score": score, "follow_up_queries": list(dict.fromkeys(names))[:4]})


def primer_model(prompt: str) -> str:
    lines = prompt.split("\n")[1:]
    return _answer(prompt, "intermediate_answer", lines, 10 * len(lines))


def branch_model(prompt: str) -> str:
    """An offline model that fails for some questions and gives no JSON for others."""
    _, question, *lines = prompt.split("\n")
    if _number(question) % 13 == 0:
        raise RuntimeError("no answer")
    if _number(question) % 7 == 0:
        return "not json"
    return _answer(prompt, "response", [x for x in lines if x.startswith("p") and not x.startswith(f"{question} ")], 7 * len(lines) % 101)


def branch_corrector(prompt: str, rejected: str, reason: str) -> str:
    return json.dumps({"response": f"corrected {reason}", "score": 1, "follow_up_queries": ["p1"]})


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("item"), F.col("embedding").alias("vector"))


def _embedder(spark, sf_dir) -> Embedder:
    """The vector of the entity that a question names."""
    known = _vectors(spark, sf_dir)
    return lambda questions: questions.join(known, F.col("question") == F.col("item")).select("key", "vector")


def _searches(spark, sf_dir) -> DataFrame:
    """A search for each supplier, which asks for the part of its number."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("search"), F.concat(F.lit(" p"), (F.col("s_suppkey") % 450 + 1).cast("string")).alias("question"))


def _primers(spark, sf_dir) -> DataFrame:
    """Reports are brands with the vector of their number; those of a few are not to be used."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").alias("size"), F.count("*").alias("n"))
    number = F.regexp_extract("p_brand", "[0-9]+", 0)
    reports = brands.where(number.cast("int") % 6 != 0).select(F.concat(F.lit("p"), number).alias("item"), F.concat_ws(" ", "p_brand", "size", "n").alias("text"))
    return primed(_searches(spark, sf_dir), reports, _vectors(spark, sf_dir), _embedder(spark, sf_dir), lambda x: x.split(" ")[0], primer_model, WALK)


def _walk(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    primers = checkpointed(_primers(spark, sf_dir))
    entities = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node")).withColumn("text", F.concat(F.col("node"), F.lit(" entity")))
    evidence = local_evidence(_embedder(spark, sf_dir), _vectors(spark, sf_dir), entities, domain.relations(spark, sf_dir), NEAREST, EVIDENCE)
    return primers, explored(primers, evidence, branch_model, WALK, branch_corrector)


def drift_primer(spark, sf_dir):
    return _primers(spark, sf_dir).withColumn("queries", F.array_join("queries", ","))


def drift_walk(spark, sf_dir):
    return _walk(spark, sf_dir)[1].withColumns({"queries": F.array_join("queries", ","), "score": F.coalesce("score", F.lit(-1))})


def drift_edges(spark, sf_dir):
    primers, branches = _walk(spark, sf_dir)
    return edges_of(primers, branches, WALK.depth)


QUERIES = {f.__name__: f for f in (drift_primer, drift_walk, drift_edges)}

_STUB = "'answer ' || substr(sha256({}), 1, 12)"
_PRIMER_SQL = f"""
v AS (SELECT 'p' || vec_id AS node, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT s_suppkey AS search, 'p' || (s_suppkey % 450 + 1) AS question FROM supplier),
rep AS (SELECT 'p' || regexp_extract(p_brand, '[0-9]+') AS item, p_brand || ' ' || max(p_size) || ' ' || count(*) AS text FROM part WHERE CAST(regexp_extract(p_brand, '[0-9]+') AS INT) % 6 <> 0 GROUP BY p_brand),
rn AS (
  SELECT search, question, item, text, row_number() OVER (PARTITION BY search ORDER BY list_cosine_similarity(a.e, b.e) DESC, item) AS place
  FROM s JOIN v a ON a.node = question CROSS JOIN rep JOIN v b ON b.node = item QUALIFY place <= {WALK.reports}),
fo AS (SELECT *, ntile({WALK.folds}) OVER (PARTITION BY search ORDER BY place) AS fold FROM rn),
fp AS (SELECT search, question, fold, question || chr(10) || string_agg(text, chr(10) ORDER BY place) AS prompt, count(*) AS n, list(item ORDER BY place) AS queries FROM fo GROUP BY search, question, fold),
primers AS (
  SELECT search, question, question AS hypothetical, string_agg({_STUB.format("prompt")}, chr(10) || chr(10) ORDER BY fold) AS answer, CAST(avg(10 * n) AS DOUBLE) AS score, flatten(list(queries ORDER BY fold)) AS queries,
    count(*) + 1 AS calls, CAST(4 + sum(1 + 3 * n) AS BIGINT) AS prompt_tokens, CAST(1 + sum(6 + n) AS BIGINT) AS output_tokens, NULL AS fault
  FROM fp GROUP BY search, question)"""

_WALK_SQL = f"""{graph._COMBINED}, {_PRIMER_SQL},
near AS (SELECT a.node AS question, b.node AS item, row_number() OVER (PARTITION BY a.node ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.node) AS place FROM v a, v b QUALIFY place <= {NEAREST}),
li AS (
  SELECT question, 0 AS g, place, 0 AS less, CAST(0 AS DOUBLE) AS lighter, item AS line, item || ' entity' AS text FROM near JOIN part ON item = 'p' || p_partkey
  UNION ALL SELECT question, 1, place, -combined_degree, -weight, source || ' ' || target, source || ' ' || target FROM near JOIN combined ON item = target),
lo AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY g, place, less, lighter, line) AS i FROM li QUALIFY 2 * i <= {EVIDENCE}),
f AS (
  SELECT node AS question, CAST(substr(node, 2) AS INT) AS number, coalesce(n, 0) AS n, coalesce(chr(10) || ctx, '') AS ctx, coalesce(names, []) AS names
  FROM v LEFT JOIN (SELECT question, count(*) AS n, string_agg(text, chr(10) ORDER BY i) AS ctx, list(line ORDER BY i) FILTER (g = 0 AND line <> question) AS names FROM lo GROUP BY question) ON node = question),
w AS (
  SELECT search, question AS root, list_filter(queries, lambda x, i: x <> question AND NOT list_contains(queries[1 : i - 1], x)) AS queue, list_transform(list_filter(queries, lambda x, i: x <> question AND NOT list_contains(queries[1 : i - 1], x)), lambda x: 1) AS depths,
    CAST(0 AS BIGINT) AS pos_, CAST(0 AS BIGINT) AS left_, calls AS c, false AS corrected FROM primers
  UNION ALL
  SELECT search, root, list_concat(queue, fresh), list_concat(depths, list_transform(fresh, lambda x: depths[pos_ + 1] + 1)), pos_ + 1, n - 1, c2 + CAST(fixed AS INT), fixed
  FROM (
    SELECT y.*, CASE WHEN y.depths[y.pos_ + 1] < {WALK.depth} AND number % 13 <> 0 AND (number % 7 <> 0 OR fixed) THEN list_filter(CASE WHEN fixed THEN ['p1'] ELSE names END, lambda q: NOT list_contains(y.queue, q) AND q <> y.root) ELSE [] END AS fresh
    FROM (
      SELECT x.*, f.number, f.names, f.number % 13 <> 0 AND f.number % 7 = 0 AND x.c2 + 1 <= {WALK.calls} AS fixed
      FROM (SELECT *, CASE WHEN left_ = 0 THEN least({WALK.batch}, {WALK.branches} - pos_, {WALK.calls} - c, len(queue) - pos_) ELSE left_ END AS n, CASE WHEN left_ = 0 THEN c + least({WALK.batch}, {WALK.branches} - pos_, {WALK.calls} - c, len(queue) - pos_) ELSE c END AS c2 FROM w) x
      JOIN f ON f.question = x.queue[x.pos_ + 1] WHERE x.n > 0) y)),
final_ AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY search ORDER BY pos_ DESC) = 1),
taken AS (SELECT w.search, w.root, w.pos_ - 1 AS no, e.queue[w.pos_] AS question, e.depths[w.pos_] AS depth, w.corrected FROM w JOIN final_ e ON w.search = e.search WHERE w.pos_ > 0),
br AS (
  SELECT search, no, t.question, depth, CASE WHEN number % 13 = 0 OR (number % 7 = 0 AND NOT corrected) THEN 'failed' ELSE 'succeeded' END AS status,
    CASE WHEN number % 13 = 0 THEN NULL WHEN corrected THEN 'corrected json' WHEN number % 7 = 0 THEN NULL ELSE {_STUB.format("root || chr(10) || t.question || ctx")} END AS answer,
    CASE WHEN number % 13 = 0 THEN NULL WHEN corrected THEN 1 WHEN number % 7 = 0 THEN NULL ELSE 7 * n % 101 END AS score,
    CASE WHEN number % 13 = 0 THEN NULL WHEN corrected THEN ['p1'] WHEN number % 7 = 0 THEN NULL ELSE names END AS queries,
    CASE WHEN corrected THEN 2 ELSE 1 END AS calls, CASE WHEN corrected THEN 2 * (2 + 2 * n) + 3 ELSE 2 + 2 * n END AS prompt_tokens,
    CASE WHEN number % 13 = 0 THEN 0 WHEN corrected THEN 9 WHEN number % 7 = 0 THEN 2 ELSE 6 + greatest(1, len(names)) END AS output_tokens,
    CASE WHEN number % 13 = 0 THEN 'model failure: RuntimeError: no answer' WHEN number % 7 = 0 AND NOT corrected THEN 'json' END AS reason
  FROM taken t JOIN f ON t.question = f.question)"""

ORACLE_SQL = {
    "drift_primer": f"WITH {_PRIMER_SQL.strip()} SELECT * REPLACE (array_to_string(queries, ',') AS queries) FROM primers",
    "drift_walk": f"""WITH RECURSIVE {_WALK_SQL}
SELECT search, no, question, CAST(depth AS INT) AS depth, status, answer, CAST(coalesce(score, -1) AS BIGINT) AS score, array_to_string(queries, ',') AS queries, CAST(calls AS BIGINT) AS calls, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, reason FROM br
UNION ALL SELECT search, pos_ + i - 1, queue[pos_ + i], CAST(depths[pos_ + i] AS INT), 'pending', NULL, -1, NULL, 0, 0, 0, NULL FROM (SELECT *, unnest(range(1, len(queue) - pos_ + 1)) AS i FROM final_)""",
    "drift_edges": f"""WITH RECURSIVE {_WALK_SQL}, asked AS (SELECT search, question AS parent, unnest(queries) AS child FROM primers UNION ALL SELECT search, question, unnest(queries) FROM br WHERE status = 'succeeded' AND depth < {WALK.depth})
SELECT search, parent, child FROM asked SEMI JOIN (SELECT search, question AS child FROM br UNION ALL SELECT search, question FROM primers) t USING (search, child)""",
}
