"""The detection graph: exact versions, summed weights, and every fault."""

import re

import pytest

from sparkloom import session
from sparkloom.operators import projection as P


def frames(spark, manifest, weights):
    entities = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("c", 1, True)], "id string, version int, deleted boolean")
    relations = spark.createDataFrame([("r", 1, False, "a", "b"), ("r", 2, False, "b", "a"), ("t", 1, False, "a", "c"), ("u", 1, False, "z", "b"), ("v", 3, True, "a", "b")], "id string, version int, deleted boolean, source string, target string")
    return spark.createDataFrame(manifest, "kind string, id string, version int"), entities, relations, spark.createDataFrame(weights, "id string, version int, source_id long, weight double")


def test_projection(spark):
    manifest = [("entity", "a", 2), ("entity", "b", 1), ("relation", "r", 2)]
    weights = [("r", 2, 1, 0.5), ("r", 2, 1, 0.5), ("r", 2, 2, 2.0), ("r", 1, 3, 9.0)]
    found = P.projection(*frames(spark, manifest, weights))
    assert [tuple(x) for x in P.edges_of(found).collect()] == [("b", "a", 2.5)]
    assert found.where("kind = 'entity' AND fault IS NULL").count() == 2


@pytest.mark.parametrize(
    ("more", "weights", "fault"),
    [
        (("entity", "c", 1), [], "deleted"), (("entity", "c", 2), [], "no such version"), (("entity", "b", 1), [], "repeated"), (("entity", "c", 0), [], "version"), (("relation", "v", 3), [], "deleted"),
        (("relation", "t", 1), [], "target absent"), (("relation", "u", 1), [], "source absent"), (("relation", "r", 1), [("r", 1, 1, float("nan"))], "weight"), (("relation", "r", 1), [("r", 1, 1, -1.0)], "weight"),
        (("relation", "r", 1), [("r", 1, 1, float("inf"))], "weight"), (("relation", "r", 1), [], None),
    ],
)
def test_faults(spark, more, weights, fault):
    found = P.projection(*frames(spark, [("entity", "a", 2), ("entity", "b", 1), more], weights))
    assert {x.fault for x in found.where(f"kind = '{more[0]}' AND id = '{more[1]}'").collect()} == {fault}
    if fault is None:
        assert P.edges_of(found).first()["weight"] == 0.0
    else:
        with pytest.raises(ValueError, match=fault):
            P.edges_of(found)


def test_no_entity(spark):
    with pytest.raises(ValueError, match="an entity"):
        P.edges_of(P.projection(*frames(spark, [], [])))


def test_tasks_do_not_take_more_as_lines_grow(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 1000)
    found = P.graph_projection(spark, "/root/testdata/sf0.001")
    shuffles = re.findall(r"RepartitionByExpression \[.*\], (\d+)", found._jdf.queryExecution().optimizedPlan().toString())
    tasks = 2 * session.tasks_for(session.table(spark, "/root/testdata/sf0.001", "lineitem"))
    assert tasks > 10 and len(shuffles) >= 8 and set(shuffles) == {str(tasks)}
