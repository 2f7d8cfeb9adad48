"""Batches of the map step: each rule of a sound answer, one correction, and failures that stay rows."""

import json

from sparkloom.operators import mapping

ANSWERS = {
    "good": {"points": [{"description": "a [Data: Reports (1, 2, 1)] b [Data: Reports (3)]", "score": "9"}, {"description": "", "score": "0"}, {"description": "quiet", "score": "0"}]},
    "blank": {"points": [{"description": " ", "score": "5"}]},
    "uncited": {"points": [{"description": "fine [Data: Reports (1)]", "score": "5"}, {"description": "no source", "score": "5"}]},
    "outside": {"points": [{"description": "x [Data: Reports (4)]", "score": "5"}]},
    "sources": {"points": [{"description": "x [Data: Sources (1)]", "score": "5"}]},
    "malformed": {"points": [{"description": "x [Data: Reports (1)", "score": "5"}]},
    "score": {"points": [{"description": "x [Data: Reports (1)]", "score": "101"}]},
    "empty": {"nothing": 1},
}
REASONS = {
    "blank": "description", "uncited": "cites no report", "outside": "cites a report outside the batch", "sources": "cites other than reports",
    "malformed": "malformed", "score": "score", "empty": "no points", "text": "no points", "raise": "RuntimeError: down",
}


def model(prompt):
    if prompt == "raise":
        raise RuntimeError("down")
    return json.dumps(ANSWERS[prompt]) if prompt in ANSWERS else "only words"


def test_outcomes_of_batches(spark):
    names = [*ANSWERS, "text", "raise"]
    batches = spark.createDataFrame(list(enumerate(names)), "batch long, prompt string").repartition(3)
    scope = spark.createDataFrame([(i, r) for i in range(len(names)) for r in (1, 2, 3)], "batch long, report long")
    got = mapping.map_points(batches, scope, model).collect()
    by = {n: sorted((x for x in got if x.batch == i), key=lambda x: x.point) for i, n in enumerate(names)}
    assert [(x.status, x.score, x.reports, x.calls) for x in by["good"]] == [("succeeded", 9, [1, 2, 3], 1), ("succeeded", 0, [], 1), ("succeeded", 0, [], 1)]
    for name, reason in REASONS.items():
        status = "model failure" if name == "raise" else "invalid response"
        assert [(x.status, x.reason, x.score, x.reports, x.point) for x in by[name]] == [(status, reason, 0, [], 0)]

    def corrector(prompt, rejected, reason):
        assert reason == REASONS[prompt] and rejected == model(prompt)
        if prompt == "score":
            raise OSError("gone")
        return json.dumps(ANSWERS["outside" if prompt == "blank" else "good"])

    got = mapping.map_points(batches, scope, model, corrector).collect()
    by = {n: sorted((x for x in got if x.batch == i), key=lambda x: x.point) for i, n in enumerate(names)}
    assert len(by["uncited"]) == 3 and {(x.status, x.calls, x.reason) for x in by["uncited"]} == {("succeeded", 2, None)}
    assert [(x.status, x.reason, x.calls) for x in by["blank"]] == [("invalid response", "cites a report outside the batch", 2)]
    assert [(x.status, x.reason, x.calls) for x in by["score"]] == [("model failure", "OSError: gone", 2)]
    assert [(x.status, x.calls) for x in by["raise"]] == [("model failure", 1)] and len(by["good"]) == 3
    assert mapping.map_points(batches.limit(0), scope, model, corrector).count() == 0
