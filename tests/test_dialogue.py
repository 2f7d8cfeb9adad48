"""Dialogues about units: what is said in which order, what is rejected, and runs that go on from earlier ones."""

from sparkloom.operators import dialogue as D

GOOD = "(" + "<|>".join("abcdefgh") + ")"
BAD = "(a<|>b)"
UNITS = "unit_id string, text string"


def scripted(scripts):
    """A model that says what is written for a unit, in order; None is a failure."""

    def model(messages):
        text = messages[0][1].split("\n")[1]
        said = sum(role == "assistant" for role, _ in messages)
        answer = scripts[text][said]
        if answer is None:
            raise RuntimeError("down")
        return answer

    return model


def test_dialogues(spark):
    scripts = {
        "plain": [GOOD + "<|COMPLETE|>", GOOD, "N"], "stops": [GOOD, "", " Y\n", GOOD, "N"], "decides": [GOOD, GOOD, "well", "N"], "undecided": [GOOD, GOOD, "well", "yes"],
        "mended": [BAD, "", "N", GOOD], "never": [GOOD, f"{GOOD}##{BAD}", "N", BAD], "falls": [GOOD, None], "falls late": [BAD, "", "N", None], "": ["", "", "N"], "all": [GOOD, GOOD, "Y", GOOD, "Y", GOOD],
    }
    frame = spark.createDataFrame([(x or "none", x or None) for x in scripts], UNITS).repartition(3)
    got = {x.unit_id: tuple(x)[1:] for x in D.extract(frame, scripted(scripts), gleanings=3).collect()}
    assert got == {
        "plain": ("succeeded", f"{GOOD}##{GOOD}", None, 3, 1), "stops": ("succeeded", f"{GOOD}##{GOOD}", None, 5, 2), "decides": ("succeeded", f"{GOOD}##{GOOD}", None, 4, 1),
        "undecided": ("invalid response", None, "not Y or N after correction", 4, 1), "mended": ("succeeded", GOOD, None, 4, 1), "never": ("invalid response", None, "2 fields instead of 8", 4, 1),
        "falls": ("model failure", None, "RuntimeError: down", 2, 1), "falls late": ("model failure", None, "RuntimeError: down", 4, 1), "none": ("succeeded", "", None, 3, 1), "all": ("succeeded", "##".join([GOOD] * 4), None, 6, 3),
    }
    once = {x.unit_id: (x.calls, x.gleanings) for x in D.extract(frame, scripted(scripts), gleanings=0, check=lambda x: None).collect()}
    assert set(once.values()) == {(1, 0)}
    assert D.extract(frame.limit(0), scripted(scripts)).count() == 0


def test_correction_names_part_and_reason():
    told = []

    def model(messages):
        told.append(messages)
        return [BAD, "", GOOD][len(messages) // 2]

    assert D.Dialogue(model, D.Prompts(), 1, D.claim_fault).result("text") == GOOD
    assert [role for role, _ in told[-1]] == ["user", "assistant"] * 2 + ["user"]
    assert BAD in told[-1][-1][1] and "2 fields instead of 8" in told[-1][-1][1]


def test_runs_go_on(spark, tmp_path):
    units = spark.createDataFrame([("1", "one"), ("2", "two"), ("3", "three")], UNITS)
    folder = str(tmp_path / "progress")
    assert D.progress(units, folder).count() == 0
    first = D.extract_all(units, folder, 0, scripted({"one": [GOOD, ""], "two": [None], "three": [BAD, "", BAD]}))
    assert {x.unit_id: x.status for x in first.collect()} == {"1": "succeeded", "2": "model failure", "3": "invalid response"}
    # a run whose writer was lost: its rows aren't read
    D.extract(units, scripted({x: ["lost", ""] for x in ("one", "two", "three")}), check=lambda x: None).selectExpr("*", "1L AS run").write.parquet(f"{folder}/run-1")
    (tmp_path / "progress" / "run-1" / "_SUCCESS").unlink()
    (tmp_path / "progress" / "run-1" / "._SUCCESS.crc").unlink(missing_ok=True)
    second = {x.unit_id: x for x in D.extract_all(units, folder, 1, scripted({"two": [GOOD, GOOD], "three": [None]})).collect()}
    assert {k: (x.status, x.run) for k, x in second.items()} == {"1": ("succeeded", 0), "2": ("succeeded", 1), "3": ("model failure", 1)}
    assert second["2"].result == f"{GOOD}##{GOOD}"
