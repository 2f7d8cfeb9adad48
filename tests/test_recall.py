"""Recall: which entities are taken, and limits with their flags for every kind."""

import pytest

from sparkloom.operators.recall import Limits, recall


@pytest.fixture(scope="module")
def world(spark):
    entities = spark.createDataFrame([("a", "T", "x"), ("b", "T", "y"), ("c", "U", "x"), ("d", "V", "x")], "id string, title string, type string")
    vectors = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "c", [0.9, 0.1]), (4, "gone", [1.0, 0.0])], "vec_id long, id string, embedding array<double>")
    relations = spark.createDataFrame([("r3", "a", "c"), ("r1", "c", "a"), ("r2", "d", "d"), ("r4", "a", "b"), ("r5", "a", "a")], "id string, source string, target string")
    claims = spark.createDataFrame([("k2", "entity", "a"), ("k1", "relation", "r1"), ("k3", "entity", "d"), ("k4", "relation", "r2"), ("k5", "entity", "b")], "id string, subject_kind string, subject string")
    evidence = spark.createDataFrame([("entity", "a", "m", "u2"), ("relation", "r1", "m", "u1"), ("claim", "k1", "c", "u9"), ("claim", "k3", "c", "u0"), ("claim", "k2", "m", "u2")], "kind string, item string, source string, unit string")
    return entities, vectors, relations, claims, evidence


def told(rows):
    out = {}
    for x in sorted(rows.collect(), key=lambda x: (x.item_kind, x.place)):
        out.setdefault(x.item_kind, []).append(x.item)
    return out


def test_exact_title_and_identity(world):
    both = recall(*world, "T")
    assert told(both) == {"entity": ["a", "b"], "relation": ["r1", "r3", "r4", "r5"], "claim": ["k1", "k2", "k5"], "evidence": ["c/u9", "m/u1", "m/u2"]}
    assert {(x.reason, x.score) for x in both.where("item_kind = 'entity'").collect()} == {("exact_title", 1.0)} and both.where("truncated").isEmpty()
    one = recall(*world, "T", "y")
    assert told(one) == {"entity": ["b"], "relation": ["r4"], "claim": ["k5"]} and one.where("reason = 'exact_identity'").count() == 1


def test_the_nearest_instead(world):
    near = recall(*world, "unknown", query=[1.0, 0.0], limits=Limits(entities=2))
    assert told(near)["entity"] == ["a", "c"] and {x.truncated for x in near.where("item_kind = 'entity'").collect()} == {True}
    assert told(recall(*world, "T", query=[0.0, 1.0], fuzzy=True, limits=Limits(entities=1)))["entity"] == ["b"]
    assert told(recall(*world, "unknown")) == {}
    with pytest.raises(ValueError):
        recall(*world, "T", fuzzy=True)


def test_limits_of_each_kind(world):
    few = recall(*world, "T", limits=Limits(entities=1, relations=2, claims=1, evidence=1))
    assert told(few) == {"entity": ["a"], "relation": ["r1", "r3"], "claim": ["k1"], "evidence": ["c/u9"]}
    assert {(x.item_kind, x.truncated) for x in few.collect()} == {(x, True) for x in ("entity", "relation", "claim", "evidence")}
