"""Hand-worked cases of strict responses and of snapshots."""

from sparkloom.operators import responses, snapshots


def by_key(df):
    return {x["key"]: x for x in df.collect()}


def test_ratings_are_strict(spark):
    rows = [(1, '{"rating": 3, "reason": "x"}'), (2, '{"rating": "3"}'), (3, '{"rating": 3.5}'), (4, '{"rating": 3} {}'), (5, "[3]"), (6, "no"), (7, None), (8, "{}"), (9, ' {"rating": -1} ')]
    got = by_key(responses.decode_ratings(spark.createDataFrame(rows, "key int, output string")))
    assert {k: x["rating"] for k, x in got.items() if x["error"] is None} == {1: 3, 9: -1}
    assert [got[k]["error"] for k in (2, 3, 4, 5, 6, 7, 8)] == ["rating", "rating", "json", "json", "json", "json", "rating"]


def test_branches_and_primers(spark):
    rows = [(1, '{"response": "a", "score": 5}'), (2, '{"response": "a", "score": 5, "follow_up_queries": [" b ", "c"]}'), (3, '{"response": " ", "score": 5}'), (4, '{"response": "a", "score": 101}'), (5, '{"response": "a", "score": 5, "follow_up_queries": ["a", "b", "c"]}'), (6, '{"response": "a", "score": 5, "follow_up_queries": [""]}')]
    got = by_key(responses.decode_branches(spark.createDataFrame(rows, "key int, output string"), 2))
    assert [got[k]["error"] for k in range(1, 7)] == [None, None, "answer", "score", "too many queries", "blank query"]
    assert got[1]["queries"] == [] and got[2]["queries"] == ["b", "c"]
    primers = [(1, '{"intermediate_answer": "a", "score": 0, "follow_up_queries": ["b"]}'), (2, '{"intermediate_answer": "a", "score": 0}')]
    got = by_key(responses.decode_primers(spark.createDataFrame(primers, "key int, output string")))
    assert [got[k]["error"] for k in (1, 2)] == [None, "too few queries"]


def test_reports_need_all_five_fields(spark):
    good = '{"title": "t", "summary": "s", "rating": 7.5, "rating_explanation": "r", "findings": [{"summary": "a", "explanation": "b"}]}'
    rows = [(1, good), (2, good.replace('"title": "t", ', "")), (3, good.replace('"title"', '"name": 1, "title"')), (4, good.replace(', "explanation": "b"', "")), (5, good.replace("7.5", '"7.5"'))]
    got = by_key(responses.decode_reports(spark.createDataFrame(rows, "key int, output string")))
    assert [got[k]["error"] for k in range(1, 6)] == [None, "fields", "fields", "finding", "rating"]
    assert got[1]["report"]["rating"] == 7.5


def test_claim_evidence_runs_over_records(spark):
    records = spark.createDataFrame([("c", 2, "y", [9]), ("c", 1, "x", [4, 3]), ("d", 1, "z", [])], "claim string, record_no int, record string, units array<long>")
    assert sorted(map(tuple, snapshots.claim_rows(records).collect())) == [("c", 0, "x", 4), ("c", 1, "x", 3), ("c", 2, "y", 9)]


def test_report_set_faults(spark):
    communities = spark.createDataFrame([(1,), (2,), (3,)], "part long")
    written = spark.createDataFrame([(1, [10]), (2, [10]), (2, [11]), (4, [10])], "part long, units array<long>")
    got = snapshots.set_faults(communities, written, spark.createDataFrame([(10,)], "unit long"))
    assert sorted(map(tuple, got.collect())) == [("community", 4), ("number", 2), ("number", 3), ("unit", 2)]


def test_readable_generations(spark):
    spans = spark.createDataFrame([(z, g) for z in (1, 2) for g in (1, 2, 3)], "zone_id long, generation long")
    states = spark.createDataFrame([(1, 1, "prepared"), (2, 1, "building")], "zone_id long, current int, state string")
    assert sorted(map(tuple, snapshots.readable_generations(spans, states).collect())) == [(1, 1), (1, 2), (2, 1)]


def test_empty_tables(spark):
    edges = spark.createDataFrame([], "pos long, source string, target string, weight double")
    entities = spark.createDataFrame([("a",)], "node string")
    evidence = spark.createDataFrame([], "node string, unit long")
    assert [(x["node"], x["degree"], x["units"]) for x in snapshots.entity_rows(entities, edges, evidence).collect()] == [("a", 0, [])]
