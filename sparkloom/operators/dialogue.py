"""Extraction of knowledge from text units by a dialogue with a model: gleanings, one correction, and progress that a later run goes on from."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.extraction import CLAIM_FIELDS, COMPLETE, FIELD, RECORD
from sparkloom.session import shared_folder, table

#: Gets the messages so far, (role, content) each, and gives the next answer.
Model = Callable[[list[tuple[str, str]]], str]
#: Gives the part of a result that can't be accepted and the reason, or None.
Check = Callable[[str], tuple[str, str] | None]

FOUND = "unit_id string, status string, result string, reason string, calls int, gleanings int"


@dataclass(frozen=True)
class Prompts:
    """What is said to the model. `extract` comes before the unit's text."""

    extract: str = "Extract all claims from the text.\n"
    more: str = "Many were missed. Add them in the same form."
    again: str = "Answer Y if there are still some to add, else N."
    decide: str = "Return Y or N only."
    correct: str = "Return the complete corrected result in the required form only."


class _Invalid(Exception):
    """An answer that is not what was asked for, after its correction."""


def claim_fault(result: str) -> tuple[str, str] | None:
    """The first record that isn't a tuple of the eight fields of a claim. An empty result is sound."""
    for record in filter(str.strip, result.split(RECORD)):
        fields = record.strip().removeprefix("(").removesuffix(")").split(FIELD)
        if len(fields) != len(CLAIM_FIELDS):
            return record.strip(), f"{len(fields)} fields instead of {len(CLAIM_FIELDS)}"
    return None


def records(answer: str) -> str:
    """The records of an answer, without the mark of its end."""
    return re.sub(re.escape(COMPLETE) + r"\s*$", "", answer.strip()).strip()


class Dialogue:
    """What is said about one unit."""

    def __init__(self, model: Model, prompts: Prompts, gleanings: int, check: Check):
        self.model, self.prompts, self.most, self.check = model, prompts, gleanings, check
        self.messages: list[tuple[str, str]] = []
        self.calls = self.gleanings = 0

    def _say(self, text: str) -> str:
        self.messages.append(("user", text))
        self.calls += 1
        answer = self.model(list(self.messages))
        self.messages.append(("assistant", answer))
        return answer

    def _rejected(self, part: str, reason: str, demand: str) -> str:
        return self._say(f"Your result was rejected.\nRejected part:\n{part}\nReason:\n{reason}\n{demand}")

    def _goes_on(self) -> bool:
        """Whether the model wants to add more; an answer other than Y or N is corrected once."""
        answer = self._say(self.prompts.again)
        if answer.strip() not in ("Y", "N"):
            answer = self._rejected(answer, "not Y or N", self.prompts.decide)
        if answer.strip() not in ("Y", "N"):
            raise _Invalid("not Y or N after correction")
        return answer.strip() == "Y"

    def result(self, text: str) -> str:
        found = [records(self._say(self.prompts.extract + text))]
        while self.gleanings < self.most:
            self.gleanings += 1
            found.append(records(self._say(self.prompts.more)))
            if self.gleanings < self.most and not self._goes_on():
                break
        result = RECORD.join(x for x in found if x)
        if (fault := self.check(result)) is not None:
            result = records(self._rejected(*fault, self.prompts.correct))
            if (fault := self.check(result)) is not None:
                raise _Invalid(fault[1])
        return result


def extract(units: DataFrame, model: Model, prompts: Prompts = Prompts(), gleanings: int = 1, check: Check = claim_fault) -> DataFrame:
    """(unit_id, status, result, reason, calls, gleanings) of units (unit_id, text): what a dialogue about each ended with.

    After the first answer the model is asked up to `gleanings` times for what it missed; between two gleanings it may say that there is no more. A
    result that the check rejects is corrected once, with the rejected part and the reason. status is `succeeded`, `invalid response` or `model
    failure` (the model raised); only the first has a result. Null text is empty. Units are independent, a failure costs its row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for unit_id, text in zip(batch["unit_id"], batch["text"], strict=True):
                talk = Dialogue(model, prompts, gleanings, check)
                try:
                    outcome = "succeeded", talk.result(text or ""), None
                except _Invalid as e:
                    outcome = "invalid response", None, str(e)
                except Exception as e:  # a user's model may raise anything
                    outcome = "model failure", None, f"{type(e).__name__}: {e}"
                rows.append((unit_id, *outcome, talk.calls, talk.gleanings))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in FOUND.split(", ")])

    return units.select("unit_id", "text").mapInPandas(run, FOUND)


def progress(units: DataFrame, folder: str) -> DataFrame:
    """What runs have written so far for units, one row each: the success if there is one, else what the last run says."""
    spark = units.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run-*/_SUCCESS")  # a run that was lost has none, and what it may have left isn't read
    ended = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path) or []
    sound = [x.getPath().getParent().toString() for x in ended]
    if not sound:
        return spark.createDataFrame([], f"{FOUND}, run long")
    rows = spark.read.schema(f"{FOUND}, run long").parquet(*sound)
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col("status") == "succeeded", "run"))
    return rows.groupBy("unit_id").agg(best.alias("x")).select("x.*")


def extract_all(units: DataFrame, folder: str, run: int, model: Model, prompts: Prompts = Prompts(), gleanings: int = 1, check: Check = claim_fault) -> DataFrame:
    """Extracts the units that have not succeeded in earlier runs, writes what comes of them below the folder, and returns the progress of all.

    A run is written as one table, whole or not at all, so a run that was lost is simply made again; runs are numbered by the caller.
    """
    before = progress(units, folder).where("status = 'succeeded'").select("unit_id")
    found = extract(units.join(before, "unit_id", "left_anti"), model, prompts, gleanings, check)
    found.withColumn("run", F.lit(run).cast("long")).write.mode("overwrite").parquet(f"{folder}/run-{run}")
    return progress(units, folder)


# --- over the driver tables -------------------------------------------------------------------------


def _record(subject: str, fields: int = 8) -> str:
    return "(" + FIELD.join([subject, "NONE", "STATE", "TRUE", "NONE", "NONE", "said", "text"][:fields]) + ")"


def _stub(run: int) -> Model:
    """An offline model of units `number name`: what it does depends on the number; some calls fail in the first run."""

    def answer(messages: list[tuple[str, str]]) -> str:
        number, name = messages[0][1].split("\n")[1].split(" ", 1)
        last, n = messages[-1][1], int(number)
        if n % 13 == 0 and run == 0:
            raise RuntimeError("overloaded")
        if last.startswith("Your result"):
            if "Y or N only" in last:
                return "N"
            return _record(name, 7 if n % 11 == 0 else 8)
        if last.startswith("Extract"):
            return _record(name, 7 if n % 7 == 0 or n % 11 == 0 else 8) + COMPLETE
        if last.startswith("Many"):
            return _record(f"{name} {len(messages)}") if n % 3 == 0 else ""
        return "perhaps" if n % 5 == 0 else "Y" if n % 2 == 0 else "N"

    return answer


def extraction_dialogue(spark, sf_dir):
    """All parts as units, in two runs of which the second goes on from the first; three gleanings at most."""
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("unit_id"), F.concat_ws(" ", "p_partkey", "p_name").alias("text"))
    folder = f"{shared_folder(spark)}/extraction-{uuid.uuid4().hex}"
    extract_all(units, folder, 0, _stub(0), gleanings=3)
    found = extract_all(units, folder, 1, _stub(1), gleanings=3)
    return found.select("unit_id", "status", F.coalesce("result", F.lit("")).alias("result"), F.coalesce("reason", F.lit("")).alias("reason"), "calls", "gleanings", "run")


QUERIES = {"extraction_dialogue": extraction_dialogue}

_TAIL = "<|>NONE<|>STATE<|>TRUE<|>NONE<|>NONE<|>said<|>text)"

ORACLE_SQL = {
    "extraction_dialogue": f"""WITH u AS (SELECT p_partkey AS n, p_name AS name, p_partkey % 11 = 0 AS hopeless, p_partkey % 7 = 0 OR p_partkey % 11 = 0 AS faulty,
  CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN 3 ELSE 1 END AS g, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS odd FROM part),
c AS (SELECT *, 1 + g + CASE WHEN g = 3 THEN 2 ELSE 1 END + odd - CASE WHEN odd = 2 THEN 1 ELSE 0 END AS calls FROM u)
SELECT CAST(n AS VARCHAR) AS unit_id, CASE WHEN hopeless THEN 'invalid response' ELSE 'succeeded' END AS status,
  CASE WHEN hopeless THEN '' WHEN faulty THEN '(' || name || '{_TAIL}'
    ELSE '(' || name || '{_TAIL}' || CASE WHEN n % 3 <> 0 THEN '' WHEN g = 1 THEN '##(' || name || ' 3{_TAIL}' ELSE '##(' || name || ' 3{_TAIL}##(' || name || ' 7{_TAIL}##(' || name || ' 11{_TAIL}' END END AS result,
  CASE WHEN hopeless THEN '7 fields instead of 8' ELSE '' END AS reason, CAST(calls + CAST(faulty AS INT) AS INT) AS calls, CAST(g AS INT) AS gleanings, CAST(CASE WHEN n % 13 = 0 OR hopeless THEN 1 ELSE 0 END AS BIGINT) AS run FROM c""",
}
