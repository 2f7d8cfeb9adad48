"""Evidence that can't be accepted, and why."""

from sparkloom.operators import extraction

EVIDENCE = "zone_id long, kind string, source string, unit string"


def test_faults(spark):
    offered = [
        (0, "corpora", "c1", "u1"), (0, "corpora", "c1", "u1"), (0, "corpora", "c2", "u1"), (1, "corpora", "c1", "u1"), (0, "corpora", "c1", "u9"), (0, "message", "m1", "u2"), (0, "message", "m2", "u2"),
        (1, "message", "m1", "u2"), (0, "message", "m3", "u3"), (0, "message", "m3", "u4"), (1, "message", "m3", "u3"), (0, "rumour", "m1", "u2"), (None, "message", "m1", "u2"), (0, None, "m1", "u2"), (0, "corpora", "c1", None),
    ]
    spans = spark.createDataFrame([(0, "c1", "u1"), (0, "c1", "u1"), (1, "c2", "u1")], "zone_id long, source string, unit string")
    messages = spark.createDataFrame([(0, "m1", "u2"), (0, "m2", "u5"), (0, "m3", "u3"), (1, "m3", "u3")], "zone_id long, source string, unit string")
    got = extraction.evidence_faults(spark.createDataFrame(offered, EVIDENCE), spans, messages).collect()
    assert sorted(((x.zone_id, x.kind, x.source, x.unit), x.fault) for x in got if x.fault != "not evidence") == [
        ((0, "corpora", "c1", "u9"), "no such unit"), ((0, "corpora", "c2", "u1"), "no such unit"), ((0, "message", "m2", "u2"), "another unit of the message"),
        ((0, "message", "m3", "u3"), "message of several units"), ((0, "message", "m3", "u4"), "message of several units"), ((1, "corpora", "c1", "u1"), "no such unit"), ((1, "message", "m1", "u2"), "no such message"),
    ]
    assert {(x.zone_id, x.kind, x.unit) for x in got if x.fault == "not evidence"} == {(0, "rumour", "u2"), (None, "message", "u2"), (0, None, "u2"), (0, "corpora", None)}
    empty = spark.createDataFrame([], EVIDENCE)
    assert extraction.evidence_faults(empty, spans, messages).count() == 0
