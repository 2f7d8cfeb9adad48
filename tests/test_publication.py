"""Publication: names that come into being once, writers that are lost or come second, and what readers see in between."""

import pytest

from sparkloom.operators import epochs, publication as P


def test_files_that_come_into_being_once(spark, tmp_path):
    path = f"{tmp_path}/a/b/name"
    assert P.read_once(spark, path) is None
    assert P.create_once(spark, path, {"x": 1, "text": "é\n"}) and not P.create_once(spark, path, {"x": 2})
    assert P.read_once(spark, path) == {"x": 1, "text": "é\n"}
    assert [x.name for x in (tmp_path / "a/b").iterdir() if not x.name.endswith(".crc")] == ["name"]  # nothing is left beside it


def test_two_phases(spark, tmp_path):
    folder, calls = str(tmp_path), []

    def build(text):
        def run():
            calls.append(text)
            return {"reports": spark.createDataFrame([("p", text)], "part string, text string")}

        return run

    with pytest.raises(ValueError, match="was not prepared"):
        P.complete(spark, folder, "s", lambda known: spark.range(1))
    with pytest.raises(ValueError, match="not sound"):
        P.prepare(spark, folder, "s", 1, build("bad"), lambda tables: tables["reports"])
    assert P.load(spark, folder, "s") is None and not [x for x in (tmp_path / "structures" / "s").iterdir() if x.name.startswith("staged")]

    def lost():
        raise RuntimeError("the writer is gone")

    with pytest.raises(RuntimeError):
        P.prepare(spark, folder, "s", 1, lost)
    first = P.prepare(spark, folder, "s", 1, build("first"), lambda tables: tables["reports"].where("text IS NULL"))
    assert first.vectors is None
    # the next one goes on from what is there, and doesn't build
    assert P.prepare(spark, folder, "s", 1, build("second")) == first and calls == ["bad", "first"]
    with pytest.raises(P.Conflict):
        P.prepare(spark, folder, "s", 2, build("third"))
    with pytest.raises(RuntimeError):
        P.complete(spark, folder, "s", lambda known: lost())
    assert P.load(spark, folder, "s").vectors is None
    ready = P.complete(spark, folder, "s", lambda known: spark.read.parquet(f"{known.path}/reports").selectExpr("part", "length(text) AS v"))
    assert spark.read.parquet(ready.vectors).first()["v"] == 5
    assert P.complete(spark, folder, "s", lambda known: spark.range(9)) == ready == P.load(spark, folder, "s")


def test_a_writer_that_prepares_meanwhile(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([("p",)], "part string")
    winner = []

    def slow():
        winner.append(P.prepare(spark, folder, "s", 1, lambda: {"reports": rows}))
        return {"reports": rows.limit(0)}

    assert P.prepare(spark, folder, "s", 1, slow) == winner[0]
    assert len([x for x in (tmp_path / "structures" / "s").iterdir() if x.name.startswith("staged")]) == 1


def test_epochs_of_a_zone(spark, tmp_path):
    folder = str(tmp_path)
    assert P.current_epoch(spark, folder, "z") == (0, None)
    assert P.publish_epoch(spark, folder, "z", 0, {"structure": "a"}) == 1 and P.publish_epoch(spark, folder, "z", 1, {"structure": "b"}) == 2
    for expected in (0, 1, 3):
        with pytest.raises(P.Conflict):
            P.publish_epoch(spark, folder, "z", expected, {"structure": "c"})
    assert P.current_epoch(spark, folder, "z") == (2, {"structure": "b"}) and P.current_epoch(spark, folder, "other")[0] == 0


def test_two_writers_with_other_numbers(spark, tmp_path, monkeypatch):
    """Both see epoch 0 as current and write different ones: one moves the pointer, the other's data go."""
    folder, rows = f"{tmp_path}/epochs", spark.range(2)
    seen = epochs.current
    monkeypatch.setattr(epochs, "current", lambda *_: 0)
    assert epochs.publish(rows, folder, 5, 0) == 5
    monkeypatch.setattr(epochs, "current", lambda *x: 0 if not getattr(epochs, "asked", None) and not setattr(epochs, "asked", True) else seen(*x))
    with pytest.raises(P.Conflict, match="epoch 5"):
        epochs.publish(rows.limit(1), folder, 7, 0)
    monkeypatch.setattr(epochs, "current", seen)
    assert epochs.current(spark, folder) == 5 and epochs.read_epoch(spark, folder).count() == 2
    assert not (tmp_path / "epochs" / "epoch=7").exists()
    assert epochs.publish(rows, folder, 6, 5) == 6 == epochs.current(spark, folder)
