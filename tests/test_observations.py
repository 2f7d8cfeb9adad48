"""Each rule of an observation, broken on its own, and what normalising changes."""

import copy
import datetime as dt

from sparkloom.operators import observations as O

AT = lambda minute: dt.datetime(2024, 5, 1, 12, minute)
SCHEMA = f"name string, id string, actor string, evaluator string, protocol string, subject string, version long, occurred_at timestamp, evidence {O.EVIDENCE}, status string, grade int, reason_code string, rationale string, refs array<string>"


def item(ref, speaker="me", kind="message", source=None, role=None, text=None, at=None, recalls=False, coverage=None, context=None):
    return {"ref": ref, "speaker": speaker, "kind": kind, "source": source or f"m-{ref}", "role": role, "text": text, "completed_at": at, "recalls": recalls, "coverage": coverage, "context": context}


def sound():
    evidence = [item("q", "host", at=AT(0)), item("note", "host", "inline", "h1", "tool", "said"), item("r1", at=AT(1), recalls=True, coverage="complete", context=["note", "q", "q"]), item("r2", at=AT(2), recalls=True, coverage="complete", context=[])]
    return {"id": "o", "actor": "me", "evaluator": "judge", "protocol": "p", "subject": "e1", "version": 1, "occurred_at": AT(2), "evidence": evidence, "status": "graded", "grade": 3, "reason_code": "", "rationale": "fine", "refs": ["r2", "r1", "r2"]}


def change(**fields):
    return lambda x: x.update(fields)


def evidence(n, **fields):
    return lambda x: x["evidence"][n].update(fields)


BROKEN = [
    ("identity or protocol", change(id=" ")), ("identity or protocol", change(protocol=None)), ("identity or protocol", change(actor="a\0")), ("version or time", change(version=0)), ("version or time", change(occurred_at=None)),
    ("no evidence", change(evidence=[])), ("reference or speaker", evidence(0, ref="")), ("reference or speaker", evidence(1, speaker=None)), ("repeated reference", evidence(1, ref="q")),
    ("source", evidence(0, kind="other")), ("source", evidence(0, source=" ")), ("source", evidence(1, text=None)), ("repeated source", evidence(3, source="m-r1")),
    ("recall of another or without time", evidence(2, speaker="host")), ("recall of another or without time", evidence(3, completed_at=None)), ("recalls out of order", evidence(2, completed_at=AT(3))),
    ("coverage", evidence(2, coverage="some")), ("coverage", evidence(2, coverage=None)), ("context not before the recall", evidence(2, context=["r1"])), ("context not before the recall", evidence(2, context=["r2"])),
    ("context not before the recall", evidence(2, context=["nowhere"])), ("context completed after the recall", evidence(0, completed_at=AT(9))), ("rationale", change(rationale="")), ("no references", change(refs=None)),
    ("unknown reference", change(refs=["r1", "zz"])), ("status", change(status="odd")), ("status", change(status=None)), ("graded with a reason or without a grade", change(grade=None)),
    ("graded with a reason or without a grade", change(reason_code="no_recall")), ("grade", change(grade=5)), ("grade", change(grade=0)), ("graded without complete recall", evidence(3, coverage="unknown")),
    ("graded without complete recall", lambda x: [y.update(recalls=False) for y in x["evidence"]]), ("unscorable with a grade or without a reason", change(status="unscorable")),
    ("unscorable with a grade or without a reason", change(status="unscorable", grade=None, reason_code="other")), ("time is not that of the last recall", change(occurred_at=AT(1))),
]
SOUND = [
    lambda x: None, change(status="unscorable", grade=None, reason_code="interrupted"),
    lambda x: x.update(status="unscorable", grade=None, reason_code="no_recall", occurred_at=AT(7), evidence=[item("r1", at=None), item("r2", at=None)]),
    lambda x: (x.update(status="unscorable", grade=None, reason_code="exposure_unknown"), x["evidence"][2].update(coverage="partial")), evidence(2, completed_at=AT(2)), evidence(0, completed_at=None),
]


def test_rules(spark):
    rows = []
    for n, (reason, breaks) in enumerate([*BROKEN, *((None, x) for x in SOUND)]):
        x = copy.deepcopy(sound())
        breaks(x)
        rows.append({"name": f"{n}|{reason}", **x})
    got = O.checked(spark.createDataFrame(rows, SCHEMA)).select("name", "fault").collect()
    assert len(got) == len(rows)
    for x in got:
        assert str(x.fault) == x.name.split("|")[1], x
    assert {reason for reason, _ in BROKEN} == {x.fault for x in got} - {None}


def test_normalised(spark):
    x = O.normalised(spark.createDataFrame([{"name": "n", **sound()}], SCHEMA)).first()
    assert x.refs == ["r1", "r2"] and [y.ref for y in x.evidence] == ["q", "note", "r1", "r2"]
    assert x.evidence[2].context == ["note", "q"] and x.evidence[0].context is None and x.evidence[3].context == []
