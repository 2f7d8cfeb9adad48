"""Memory activation: a per-subject ordered fold of graded recalls into stability and difficulty (FSRS-6 formulas)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.session import table

# fixed values: the published default parameters of FSRS-6
PARAMETERS = [0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542]
LEAST_STABILITY = 0.001
AGAIN, HARD, GOOD, EASY = 1, 2, 3, 4


@dataclass(frozen=True)
class Model:
    """The formulas for one set of parameters; grades are 1 (again) to 4 (easy)."""

    w: tuple[float, ...] = tuple(PARAMETERS)

    def __post_init__(self):
        if len(self.w) != 21 or not all(math.isfinite(x) for x in self.w):
            raise ValueError("21 finite parameters are needed")

    @property
    def factor(self) -> float:
        """Chosen so that recall is 0.9 after as many days as the stability says."""
        return 0.9 ** (-1 / self.w[20]) - 1

    def recall(self, stability: float, days: float) -> float:
        return (1 + self.factor * days / stability) ** -self.w[20]

    def first_difficulty(self, grade: int) -> float:
        return self.w[4] - math.exp(self.w[5] * (grade - 1)) + 1

    def step(self, state: tuple[float, float] | None, grade: int, days: int) -> tuple[float, float]:
        """(stability, difficulty) after a recall of this grade, `days` whole days after the last one."""
        w = self.w
        if state is None:
            return self._bounded(w[grade - 1], self.first_difficulty(grade))
        s, d = state
        if days < 1:
            growth = math.exp(w[17] * (grade - 3 + w[18])) * s ** -w[19]
            new = s * (growth if grade == AGAIN else max(1.0, growth))
        else:
            lapse = 1 - self.recall(s, days)
            if grade == AGAIN:
                new = min(w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp(w[14] * lapse), s / math.exp(w[17] * w[18]))
            else:
                bonus = {HARD: w[15], EASY: w[16]}.get(grade, 1.0)
                new = s * (1 + math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp(w[10] * lapse) - 1) * bonus)
        drift = d - w[6] * (grade - 3) * (10 - d) / 9
        # it reverts towards the difficulty of a first easy recall before that is bounded
        return self._bounded(new, w[7] * self.first_difficulty(EASY) + (1 - w[7]) * drift)

    @staticmethod
    def _bounded(stability: float, difficulty: float) -> tuple[float, float]:
        return max(LEAST_STABILITY, stability), min(10.0, max(1.0, difficulty))


def activation(stability: Column, last: Column, now: Column, model: Model | None = None) -> Column:
    """Recall at a time; 1 at or before the last review, 0 without a state."""
    model = model or Model()
    value = F.pow(1 + model.factor * T.whole_days(last, now) / stability, F.lit(-model.w[20]))
    return F.coalesce(value, F.lit(0.0))


_STATES = "subject long, sequence long, observation_id long, occurred_at timestamp_ntz, stability double, difficulty double, accepted boolean"


def states(observations: DataFrame, model: Model | None = None) -> DataFrame:
    """Every observation (subject, observation_id, occurred_at, grade, submitted) with the state after it, in order of submission.

    A repeated observation_id is ignored, one earlier than the last accepted is rejected (accepted false, state unchanged);
    equal times are fine. A subject's observations are folded in order by one task; subjects are dealt over tasks.
    """
    model = model or Model()

    def fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("submitted").drop_duplicates("observation_id")
        state, last, number, rows = None, None, 0, []
        for row in group.itertuples(index=False):
            accepted = last is None or row.occurred_at >= last
            if accepted:
                days = 0 if last is None else int((row.occurred_at - last).total_seconds() // 86400)
                state, last, number = model.step(state, int(row.grade), days), row.occurred_at, number + 1
            rows.append((key[0], number, row.observation_id, row.occurred_at, *state, accepted))
        return pd.DataFrame(rows, columns=["subject", "sequence", "observation_id", "occurred_at", "stability", "difficulty", "accepted"])

    return observations.groupBy("subject").applyInPandas(fold, _STATES)


def current_states(history: DataFrame) -> DataFrame:
    """The last state of each subject."""
    last = F.max_by(F.struct("stability", "difficulty", F.col("occurred_at").alias("last_review")), "sequence")
    return history.where("accepted").groupBy("subject").agg(last.alias("x"), F.max("sequence").alias("reviews")).select("subject", "reviews", "x.*")


def verify(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """Subjects whose stored state isn't exactly what a replay gives; none if all is well."""
    both = stored.select("subject", F.struct("stability", "difficulty", "last_review").alias("stored")).join(replayed.select("subject", F.struct("stability", "difficulty", "last_review").alias("replayed")), "subject", "full_outer")
    return both.where(~F.col("stored").eqNullSafe(F.col("replayed"))).select("subject")


def observations(spark, sf_dir) -> DataFrame:
    """Events as graded recalls: subject is the user, the grade comes from the value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("observation_id"), F.col("ts").alias("occurred_at"), (F.floor(F.col("value") * 100).cast("long") % 4 + 1).alias("grade"), F.col("event_id").alias("submitted"))


def fsrs_state(spark, sf_dir):
    found = current_states(states(observations(spark, sf_dir)))
    return found.select("subject", "reviews", F.round("stability", 4).alias("stability"), F.round("difficulty", 4).alias("difficulty"))


def fsrs_activation(spark, sf_dir):
    found = current_states(states(observations(spark, sf_dir)))
    return found.select("subject", F.round(activation(F.col("stability"), F.col("last_review"), F.expr("TIMESTAMP_NTZ'2024-03-01 00:00:00'")), 5).alias("activation"))


def fsrs_replay_verify(spark, sf_dir):
    history = states(observations(spark, sf_dir))
    stored = current_states(history)
    tampered = stored.withColumn("stability", F.when(F.col("subject") % 10 == 0, F.col("stability") + 1).otherwise(F.col("stability")))
    return verify(tampered, stored)


def fsrs_order_check(spark, sf_dir):
    """Observations submitted out of order: how many are rejected per subject."""
    late = observations(spark, sf_dir).withColumn("submitted", F.col("submitted") + F.when(F.col("observation_id") % 5 == 0, 3000).otherwise(0))
    return states(late).groupBy("subject").agg(F.count("*").alias("n"), F.count_if(~F.col("accepted")).alias("rejected"))


QUERIES = {f.__name__: f for f in (fsrs_state, fsrs_activation, fsrs_replay_verify, fsrs_order_check)}

_W = PARAMETERS
_FACTOR = f"(pow(0.9::DOUBLE, {-1 / _W[20]}::DOUBLE) - 1)"
_LAPSE = f"(1 - pow(1 + {_FACTOR} * days / s, {-_W[20]}::DOUBLE))"
_EASY = _W[4] - math.exp(_W[5] * 3) + 1
_NEXT_S = f"""CASE WHEN days < 1 THEN s * CASE WHEN grade = 1 THEN exp({_W[17]}::DOUBLE * (grade - 3 + {_W[18]}::DOUBLE)) * pow(s, {-_W[19]}::DOUBLE) ELSE greatest(1.0::DOUBLE, exp({_W[17]}::DOUBLE * (grade - 3 + {_W[18]}::DOUBLE)) * pow(s, {-_W[19]}::DOUBLE)) END
 WHEN grade = 1 THEN least({_W[11]}::DOUBLE * pow(d, {-_W[12]}::DOUBLE) * (pow(s + 1, {_W[13]}::DOUBLE) - 1) * exp({_W[14]}::DOUBLE * {_LAPSE}), s / exp({_W[17] * _W[18]}::DOUBLE))
 ELSE s * (1 + exp({_W[8]}::DOUBLE) * (11 - d) * pow(s, {-_W[9]}::DOUBLE) * (exp({_W[10]}::DOUBLE * {_LAPSE}) - 1) * CASE grade WHEN 2 THEN {_W[15]}::DOUBLE WHEN 4 THEN {_W[16]}::DOUBLE ELSE 1.0::DOUBLE END) END"""
_FOLD = f"""WITH RECURSIVE o AS (SELECT user_id AS subject, ts, CAST(floor(value * 100) AS BIGINT) % 4 + 1 AS grade, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (
  SELECT subject, i, ts, greatest({LEAST_STABILITY}::DOUBLE, ([{", ".join(map(str, _W[:4]))}]::DOUBLE[])[grade]) AS s, least(10.0::DOUBLE, greatest(1.0::DOUBLE, {_W[4]}::DOUBLE - exp({_W[5]}::DOUBLE * (grade - 1)) + 1)) AS d FROM o WHERE i = 1
  UNION ALL
  SELECT subject, i, ts, greatest({LEAST_STABILITY}::DOUBLE, {_NEXT_S}), least(10.0::DOUBLE, greatest(1.0::DOUBLE, {_W[7]}::DOUBLE * {_EASY}::DOUBLE + {1 - _W[7]}::DOUBLE * (d - {_W[6]}::DOUBLE * (grade - 3) * (10 - d) / 9)))
  FROM (SELECT o.subject, o.i, o.ts, o.grade, f.s, f.d, greatest(0, (epoch_us(o.ts) - epoch_us(f.ts)) // 86400000000) AS days FROM f JOIN o ON o.subject = f.subject AND o.i = f.i + 1)),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY subject ORDER BY i DESC) = 1)"""

ORACLE_SQL = {
    "fsrs_state": f"{_FOLD} SELECT subject, i AS reviews, round(s, 4) AS stability, round(d, 4) AS difficulty FROM l",
    "fsrs_activation": f"{_FOLD} SELECT subject, round(pow(1 + {_FACTOR} * ((epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(ts)) // 86400000000) / s, {-_W[20]}::DOUBLE), 5) AS activation FROM l",
    "fsrs_replay_verify": "SELECT DISTINCT user_id AS subject FROM events WHERE user_id % 10 = 0",
    "fsrs_order_check": "WITH o AS (SELECT user_id AS subject, ts, event_id + CASE WHEN event_id % 5 = 0 THEN 3000 ELSE 0 END AS submitted FROM events), m AS (SELECT *, max(ts) OVER (PARTITION BY subject ORDER BY submitted ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM o) SELECT subject, count(*) AS n, count(*) FILTER (ts < before_) AS rejected FROM m GROUP BY subject",
}
