"""The branching search against a plain walk of one search at a time, with models that fail, answer wrongly and answer too long."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import branching
from sparkloom.operators.branching import Limits


def draw(*parts):
    return random.Random(hashlib.sha256(repr(parts).encode()).hexdigest())


def model(prompt):
    rng = draw("model", prompt)
    kind = rng.randrange(9)
    if kind == 0:
        raise RuntimeError("down")
    if kind == 1:
        return "not json at all"
    if kind == 2:
        return json.dumps({"response": "long " * 40, "score": 1, "follow_up_queries": []})
    return json.dumps({"response": f"on {prompt[-9:]}", "score": rng.randrange(101), "follow_up_queries": [f" q{rng.randrange(40)}" for _ in range(rng.randrange(5))]})


def corrector(prompt, rejected, reason):
    assert (rejected, reason) == ("not json at all", "json")
    rng = draw("corrector", prompt)
    if rng.randrange(3) == 0:
        raise OSError("gone")
    return rng.choice(["no json again", json.dumps({"response": "mended", "score": 3, "follow_up_queries": ["q1", "q2"]})])


def read(answer):
    try:
        found = json.loads(answer)
        return found["response"], found["score"], [x.strip() for x in found["follow_up_queries"]]
    except ValueError:
        return None


def count(text):
    return len(text.replace("\n", " ").split(" "))


def walk(root, queries, used, limits, contexts, fix):
    """The branches of one search as [question, depth, status, answer, score, queries, calls, prompt, output, reason]."""
    branches, calls, prompt_used, output_used = [], *used

    def met(questions, depth):
        for q in questions:
            if q.strip() and q.strip() != root and q.strip() not in {b[0] for b in branches}:
                branches.append([q.strip(), depth, "pending", None, None, None, 0, 0, 0, None])

    met(queries, 1)
    while True:
        taken = sum(b[2] != "pending" for b in branches)
        room = min(limits.batch, limits.branches - taken, limits.calls - calls, (limits.output_tokens - output_used) // limits.answer_tokens)
        chosen = [b for b in branches if b[2] == "pending"][: max(0, room)]
        if prompt_used >= limits.prompt_tokens or not chosen:
            return branches
        reserved = []
        for b in chosen:
            prompt = "\n".join(x for x in (root, b[0], contexts.get(b[0])) if x)
            if prompt_used + count(prompt) > limits.prompt_tokens:
                break
            prompt_used += count(prompt)
            calls += 1
            reserved.append((b, prompt))
        if not reserved:
            return branches
        wrong = []
        for b, prompt in reserved:
            b[6], b[7] = 1, count(prompt)
            try:
                answer = model(prompt)
            except RuntimeError as e:
                b[2], b[9] = "failed", f"model failure: RuntimeError: {e}"
                continue
            b[8] = len(answer.split(" "))
            output_used += b[8]
            if b[8] > limits.answer_tokens:
                b[2], b[9] = "failed", "too long"
            elif (found := read(answer)) is None:
                b[2], b[9] = "failed", "json"
                wrong.append((b, prompt, answer))
            else:
                b[2], (b[3], b[4], b[5]) = "succeeded", found
        open_output = output_used
        for b, prompt, answer in wrong if fix else []:
            more = b[7] + b[8] + 1
            if calls + 1 > limits.calls or prompt_used + more > limits.prompt_tokens or open_output + limits.answer_tokens > limits.output_tokens:
                break
            calls, prompt_used, open_output = calls + 1, prompt_used + more, open_output + limits.answer_tokens
            b[6], b[7] = 2, b[7] + more
            try:
                answer = corrector(prompt, answer, "json")
            except OSError as e:
                b[9] = f"model failure: OSError: {e}"
                continue
            b[8] += len(answer.split(" "))
            output_used += len(answer.split(" "))
            if (found := read(answer)) is not None:
                b[2], (b[3], b[4], b[5]), b[9] = "succeeded", found, None
        for b, _ in reserved:
            if b[2] == "succeeded" and b[1] < limits.depth:
                met(b[5], b[1] + 1)


@pytest.mark.parametrize(
    ("limits", "fix"),
    [
        (Limits(answer_tokens=30, batch=3, branches=12, depth=3, follow_ups=5), True),
        (Limits(answer_tokens=30, batch=20, branches=60, depth=4, follow_ups=5, calls=11), True),
        (Limits(answer_tokens=30, batch=6, branches=40, depth=9, follow_ups=5, prompt_tokens=90), True),
        (Limits(answer_tokens=30, batch=4, branches=60, depth=3, follow_ups=5, output_tokens=170), False),
    ],
)
def test_walk_against_one_search_at_a_time(spark, limits, fix):
    rng = random.Random(2)
    primers = [(i, f"root {i}", [f"q{rng.randrange(40)}" for _ in range(rng.randrange(6))] + [f"root {i}", " "], rng.randrange(3), rng.randrange(20), rng.randrange(20), None) for i in range(14)]
    primers.append((99, "lost", ["q1"], 1, 1, 1, "no fold"))
    contexts = {f"q{i}": "\n".join(["some lines"] * (i % 4)) for i in range(36)}
    frame = spark.createDataFrame(primers, "search long, question string, queries array<string>, calls long, prompt_tokens long, output_tokens long, fault string")
    known = spark.createDataFrame(list(contexts.items()), "question string, context string")
    got = branching.explored(frame, lambda x: x.join(known, "question").select("key", "context"), model, limits, corrector if fix else None).orderBy("search", "no").collect()
    columns = ["question", "depth", "status", "answer", "score", "queries", "calls", "prompt_tokens", "output_tokens", "reason"]
    want = {i: walk(root, queries, used, limits, contexts, fix) for i, root, queries, *used, fault in primers if fault is None}
    for i, rows in want.items():
        assert [[x[c] for c in columns] for x in got if x.search == i] == rows
    assert {x.search for x in got} == {i for i, rows in want.items() if rows}
    assert {x.status for x in got} == {"pending", "failed", "succeeded"}
    edges = sorted(tuple(x) for x in branching.edges_of(frame, spark.createDataFrame(got), limits.depth).collect())
    by_hand = []
    for i, root, queries, *_ in primers[:-1]:
        taken = {root} | {b[0] for b in want[i] if b[2] != "pending"}
        asked = [(root, q.strip()) for q in queries] + [(b[0], q) for b in want[i] if b[2] == "succeeded" and b[1] < limits.depth for q in b[5]]
        by_hand += [(i, parent, q) for parent, q in asked if q in taken]
    assert edges == sorted(by_hand)


def test_nearest_to_each_against_brute_force(spark):
    rng = np.random.default_rng(4)
    items = [(i, rng.normal(size=5).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(9)] + [(200, [0.0] * 5), (201, None), (202, [float("nan")] * 5), (203, [1.0, 2.0])]
    queries = [(i, rng.normal(size=5).tolist()) for i in range(11)] + [(50, [2.0, 0.0, 0.0, 0.0, 0.0]), (51, [0.0] * 5), (52, None), (53, [3.0, 1.0]), (54, [])]
    frames = spark.createDataFrame(queries, "key long, vector array<double>"), spark.createDataFrame(items, "item long, vector array<double>").repartition(4)

    def near(query):
        scored = [(round(float(np.dot(query, v) / np.linalg.norm(query) / np.linalg.norm(v)), 9), i) for i, v in items if v and len(v) == len(query) and np.isfinite(v).all() and any(v)]
        return [i for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:4]]

    for block in (3, 4096):
        got = branching.nearest_to_each(*frames, 4, block).orderBy("key", "place").collect()
        want = {key: near(np.array(query)) for key, query in queries if query and any(query)}
        assert {k: [x.item for x in got if x.key == k] for k in {x.key for x in got}} == {k: v for k, v in want.items() if v}
        assert all(x.place == i for k in want for i, x in enumerate((x for x in got if x.key == k), 1))
    assert branching.nearest_to_each(frames[0].limit(0), frames[1], 4).count() == 0


def test_primer_of_each_search(spark):
    """Eligible reports only, contiguous folds, faults for a failing model, for no report and for no room."""
    vectors = {"a": [1.0, 0.0], "b": [0.9, 0.1], "c": [0.0, 1.0], "d": [0.1, 0.9], "hidden": [1.0, 0.0]}
    reports = spark.createDataFrame([(k, f"report {k}") for k in "abcd"], "item string, text string")
    stored = spark.createDataFrame(list(vectors.items()), "item string, vector array<double>")
    searches = spark.createDataFrame([(1, " x "), (2, "y"), (3, "raise"), (4, "blank"), (5, "nowhere"), (6, "broken fold")], "search long, question string")

    def hypothetical(prompt):
        if prompt.startswith("raise"):
            raise RuntimeError("down")
        return " " if prompt.startswith("blank") else prompt.split(" ")[0]

    def answers(prompt):
        question, *lines = prompt.split("\n")
        if question == "broken fold" and "report a" in lines:
            return "?"
        return json.dumps({"intermediate_answer": " & ".join(lines), "score": 10 * len(lines), "follow_up_queries": [f"{x} more" for x in lines]})

    places = {"x": [1.0, 0.0], "y": [0.0, 1.0], "blank": [1.0, 0.0], "broken": [1.0, 0.0], "nowhere": []}
    embed = branching.embedded(lambda x: places[x])
    limits = Limits(reports=3, folds=2)
    got = {x.search: x for x in branching.primed(searches, reports, stored, embed, hypothetical, answers, limits).collect()}
    assert got[1].question == "x" and got[1].answer == "report a & report b\n\nreport d" and got[1].score == 15.0 and got[1].queries == ["report a more", "report b more", "report d more"]
    assert got[2].answer == "report c & report d\n\nreport b" and got[2].calls == 3
    assert got[1].prompt_tokens == 3 + 5 + 3 and got[1].fault is None
    assert (got[3].fault, got[3].answer, got[3].calls) == ("model failure: RuntimeError: down", None, 1)
    assert got[4].hypothetical == "blank" and got[4].answer == got[1].answer
    assert got[5].fault == "no fold" and got[6].fault == "json" and got[6].score is None
    few = {x.search: x for x in branching.primed(searches.where("search < 3"), reports, stored, embed, hypothetical, answers, Limits(reports=3, folds=2, calls=2)).collect()}
    assert few[1].answer == "report a & report b" and few[1].calls == 2
    assert branching.primed(searches.where(F.lit(False)), reports, stored, embed, hypothetical, answers, limits).count() == 0


def test_vectors_of_questions_stay_off_the_driver(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("rows sent to the driver")

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "key long, vector array<double>")
    monkeypatch.setattr(type(vectors), "toArrow", refused)
    got = branching.nearest_to_each(vectors, vectors.withColumnRenamed("key", "item"), 1).collect()
    assert sorted((x.key, x.item, x.place) for x in got) == [(1, 1, 1), (2, 2, 1)]
