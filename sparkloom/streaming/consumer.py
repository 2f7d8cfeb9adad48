"""Journal consumers and memory states as Structured Streaming queries with bounded pulls."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators import activation
from sparkloom.session import checkpointed

Handler = Callable[[DataFrame, int], None]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which the processors here need; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def consume(events: DataFrame, handler: Handler, checkpoint: str) -> None:
    """Hands every event that has arrived since the last pull to the handler, then stops: a pull up to a fixed boundary.

    events: a streaming DataFrame. The checkpoint is the consumer's position; a pull that fails is repeated with the same
    events, so a handler has to be idempotent by (batch) or by event_id.
    """
    with keyed_state(events.sparkSession):
        query = events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


#: A batch of a pull is bounded by its files' bytes, not by their number, which grows with the tasks that write them.
BATCH_BYTES = 256 * 1024 * 1024


def journal_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The journal's files as a stream; a file is an append."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(path)


_OUT = "subject long, observation_id long, stability double, difficulty double, accepted boolean, submitted long"


#: Ids of a run of applied observations, and runs of a subject before they are merged.
RUN, MOST_RUNS = 4096, 64


class Memory(StatefulProcessor):
    """Folds a subject's new observations, in order of submission, into its state; earlier ones than the last accepted are rejected.

    What was applied is kept as sorted runs of ids with their least and greatest, of which a pull reads only those that its own rows can lie in and writes one run:
    an observation that comes again, in this pull or a later one, changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = activation.Model()
        self.state = handle.getValueState("state", "stability double, difficulty double, last long, lows array<long>, highs array<long>")
        self.runs = handle.getMapState("runs", "number long", "ids binary")

    def _run(self, number: int) -> np.ndarray:
        return np.frombuffer(self.runs.getValue((number,))[0], np.int64)

    def _applied(self, ids: np.ndarray, lows: list[int], highs: list[int]) -> set[int]:
        """Those of the ids that were applied in earlier pulls."""
        found: set[int] = set()
        for number, (low, high) in enumerate(zip(lows, highs)):
            near = ids[(ids >= low) & (ids <= high)]
            if len(near):
                found.update(near[np.isin(near, self._run(number))].tolist())
        return found

    def _keep(self, ids: list[int], lows: list[int], highs: list[int]) -> None:
        ids = np.sort(np.array(ids, np.int64))
        if len(lows) >= MOST_RUNS and len(lows) % MOST_RUNS == 0:
            ids = np.sort(np.concatenate([ids, *(self._run(i) for i in range(len(lows)))]))
            for i in range(-(-len(ids) // RUN), len(lows)):
                self.runs.removeKey((i,))
            lows.clear(), highs.clear()
        for begin in range(0, len(ids), RUN):
            part = ids[begin : begin + RUN]
            self.runs.updateValue((len(lows),), (part.tobytes(),))
            lows.append(int(part[0]))
            highs.append(int(part[-1]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stability, difficulty, last, lows, highs = self.state.get() if self.state.exists() else (None, None, None, [], [])
        lows, highs = list(lows), list(highs)
        out, ids = [], []
        new = pd.concat(list(rows)).sort_values("submitted").drop_duplicates("observation_id")
        applied = self._applied(new["observation_id"].to_numpy(np.int64), lows, highs)
        for row in new.itertuples(index=False):
            if int(row.observation_id) in applied:
                continue
            at = pd.Timestamp(row.occurred_at).value // 1000
            accepted = last is None or at >= last
            if accepted:
                days = 0 if last is None else (at - last) // 86_400_000_000
                stability, difficulty = self.model.step(None if last is None else (stability, difficulty), int(row.grade), days)
                last = at
            ids.append(int(row.observation_id))
            out.append((key[0], row.observation_id, stability, difficulty, accepted, int(row.submitted)))
        if ids:
            self._keep(ids, lows, highs)
            self.state.update((stability, difficulty, last, lows, highs))
        yield pd.DataFrame(out, columns=["subject", "observation_id", "stability", "difficulty", "accepted", "submitted"])

    def close(self) -> None:
        pass


def memory_states(observations: DataFrame) -> DataFrame:
    """A stream of observations (subject, observation_id, occurred_at, grade, submitted) as a stream of states after each."""
    return observations.groupBy("subject").transformWithStateInPandas(Memory(), _OUT, "Append", "None")


def _split_journal(spark, sf_dir) -> tuple[str, str, object]:
    """The driver's events, dealt into files by event_id as appends, in the shared folder."""
    checkpointed(spark.range(1))
    folder = f"{spark.sparkContext.getCheckpointDir()}/journal-{uuid.uuid4().hex}"
    rows = activation.observations(spark, sf_dir)
    rows.repartitionByRange(4, "submitted").write.parquet(f"{folder}/events")
    return folder, f"{folder}/events", rows.schema


def stream_consumer(spark, sf_dir):
    """Two pulls of a consumer that counts grades by subject: the second one, without new events, adds nothing."""
    folder, path, schema = _split_journal(spark, sf_dir)

    def handle(batch: DataFrame, number: int) -> None:
        batch.groupBy("subject", "grade").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    for _ in range(2):
        consume(journal_stream(spark, path, schema), handle, f"{folder}/position")
    found = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/*")
    return found.groupBy("subject", "grade").agg(F.sum("n").alias("n"))


def stream_memory_states(spark, sf_dir):
    """The states that a streaming fold over all observations ends with."""
    folder, path, schema = _split_journal(spark, sf_dir)
    ordered = spark.readStream.schema(schema).parquet(path)
    consume(memory_states(ordered), lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}"), f"{folder}/position")
    found = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/*").where("accepted")
    last = found.groupBy("subject").agg(F.max_by(F.struct("stability", "difficulty"), "submitted").alias("x"), F.count("*").alias("reviews"))
    return last.select("subject", "reviews", F.round("x.stability", 4).alias("stability"), F.round("x.difficulty", 4).alias("difficulty"))


QUERIES = {f.__name__: f for f in (stream_consumer, stream_memory_states)}

ORACLE_SQL = {
    "stream_consumer": "SELECT user_id AS subject, CAST(floor(value * 100) AS BIGINT) % 4 + 1 AS grade, count(*) AS n FROM events GROUP BY ALL",
    "stream_memory_states": activation.ORACLE_SQL["fsrs_state"],
}
