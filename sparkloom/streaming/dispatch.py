"""Stateful consumers of the journal: dispatch in order of position with causal continuation, and events that wait for each other.

Both are Structured Streaming queries whose state lives in their checkpoint, so that a pull goes on where the last one ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators import journal
from sparkloom.plans import domain
from sparkloom.session import shared_folder, written
from sparkloom.streaming import consumer

#: Gets an event as a dictionary and how often it has failed before; an exception is a failure.
Handler = Callable[[dict, int], None]


# --- dispatch ---------------------------------------------------------------------------------------

_HANDLED = "zone_id long, step long, event_id long, event_type string, via string, outcome string, reason string"
#: Rows of a piece of a zone's state: what waits is kept as Arrow tables, so that an event costs no request to the state store of its own.
PIECE = 50_000
_WAITING = pa.schema(
    [("event_type", pa.string()), ("event_sequence", pa.int64()), ("event_id", pa.int64()), ("stream_id", pa.int64()), ("stream_sequence", pa.int64()), ("causation_id", pa.int64()), ("occurred_at", pa.timestamp("us")), ("body", pa.large_string())]
)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


class Dispatch(StatefulProcessor):
    """One zone of one consumer.

    There is a position for each event type. Events wait, by type and sequence, until all before them have come and been handled; what lies before the position
    or waits already is a repeat and ignored. After an event its stream's next one follows at once if the event is its cause
    and the consumer takes its type; it is remembered until its type's position reaches it, and not handled again. An event whose handler
    fails stays where it is: the zone takes in events, but handles none until the next pull that brings it any.

    Rows that let nothing go on are only put behind what waits. Else all that waits is read at once, and the followers are found by sorting.
    """

    def __init__(self, types: list[str], handler: Handler):
        self.types, self.handler = types, handler

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "piece long", "rows binary")
        self.ahead = handle.getMapState("ahead", "piece long", "event_ids binary")
        self.positions = handle.getMapState("positions", "event_type string", "position long")
        self.failures = handle.getMapState("failures", "event_id long", "times long")
        #: The next step, the pieces [first, next) of what waits, those of what was handled before its position, and whether a failure holds the zone back.
        self.zone = handle.getValueState("zone", "step long, first long, next long, ahead long, held boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        step, first, next_, ahead, held = self.zone.get() if self.zone.exists() else (0, 0, 0, 0, False)
        positions = [int(self.positions.getValue((x,))[0]) if self.positions.containsKey((x,)) else 0 for x in self.types]
        fresh = [self._new(batch, positions) for batch in rows]
        fresh = pa.concat_tables([_WAITING.empty_table(), *fresh])
        code, sequence = self._places(fresh)
        if not held and not (sequence == np.array(positions, np.int64)[code]).any():
            self.zone.update((step, first, self._kept(fresh, next_), ahead, False))
            return
        pieces = [pa.ipc.open_stream(self.waiting.getValue((i,))[0]).read_all() for i in range(first, next_)]
        found = pa.concat_tables([*pieces, fresh]).combine_chunks()
        done_before = [np.frombuffer(self.ahead.getValue((i,))[0], np.int64) for i in range(ahead)]
        failures = {int(k[0]): int(v[0]) for k, v in self.failures.iterator()}
        state = _Zone(found, *self._places(found), positions, np.concatenate([np.empty(0, np.int64), *done_before]), dict(failures))
        out: list[tuple] = []
        for row in state.pending(self.types, self.handler):
            out.append((int(key[0]), int(step), *row))
            step += 1
            if len(out) >= 10_000:
                yield self._frame(out)
                out = []
        for name, was, now in zip(self.types, positions, state.positions):
            if now != was:
                self.positions.updateValue((name,), (now,))
        for event_id in failures.keys() | state.failures.keys():
            if event_id not in state.failures:
                self.failures.removeKey((event_id,))
            elif failures.get(event_id) != state.failures[event_id]:
                self.failures.updateValue((event_id,), (state.failures[event_id],))
        left = state.left()
        if 2 * len(left) <= found.num_rows or next_ - first > 8 + 2 * (len(left) // PIECE):
            for i in range(first, next_):
                self.waiting.removeKey((i,))
            first, next_ = next_, self._kept(found.take(pa.array(left)), next_)
        else:
            next_ = self._kept(fresh, next_)
        early = state.event_id[left[state.handled[left]]]
        for i in range(0, -(-len(early) // PIECE)):
            self.ahead.updateValue((i,), (early[i * PIECE : (i + 1) * PIECE].tobytes(),))
        for i in range(-(-len(early) // PIECE), ahead):
            self.ahead.removeKey((i,))
        self.zone.update((step, first, next_, -(-len(early) // PIECE), state.held))
        yield self._frame(out)

    def _new(self, batch: pd.DataFrame, positions: list[int]) -> pa.Table:
        """The rows of the consumer's types that don't lie before their position."""
        batch = batch[batch["event_type"].isin(self.types)]
        batch = batch[batch["event_sequence"] >= batch["event_type"].map(dict(zip(self.types, positions))).astype("int64")]
        columns = [pa.array(batch[x.name], from_pandas=True) for x in _WAITING]
        return pa.table([x if x.type == kind.type else x.cast(kind.type) for x, kind in zip(columns, _WAITING)], schema=_WAITING)

    def _places(self, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return pc.index_in(rows["event_type"], value_set=pa.array(self.types, pa.string())).to_numpy().astype(np.int64), rows["event_sequence"].to_numpy()

    def _kept(self, rows: pa.Table, next_: int) -> int:
        for begin in range(0, rows.num_rows, PIECE):
            self.waiting.updateValue((next_,), (_packed(rows.slice(begin, PIECE)),))
            next_ += 1
        return next_

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in _HANDLED.split(", ")])

    def close(self) -> None:
        pass


class _Zone:
    """What waits in a zone, as columns: of repeats the first is kept, the followers of all events come from one sort by their place in the stream."""

    def __init__(self, rows: pa.Table, code: np.ndarray, sequence: np.ndarray, positions: list[int], ahead: np.ndarray, failures: dict[int, int]):
        self.code, self.sequence, self.positions, self.failures, self.held = code, sequence, list(positions), failures, False
        self.event_id, self.stream_id, self.stream_sequence = (rows[x].to_numpy() for x in ("event_id", "stream_id", "stream_sequence"))
        self.rest = {x: rows[x].combine_chunks() for x in ("causation_id", "occurred_at", "body")}
        order = np.lexsort((sequence, code))  # stable: repeats in the order in which they came
        again = np.zeros(len(order), bool)
        again[1:] = (code[order][1:] == code[order][:-1]) & (sequence[order][1:] == sequence[order][:-1])
        order = order[~again & (sequence[order] >= np.array(positions, np.int64)[code[order]])]
        self.order, self.begins = order, np.searchsorted(code[order], np.arange(len(positions) + 1))
        self.handled = np.isin(self.event_id, ahead)
        self.following = self._followers()

    def _followers(self) -> np.ndarray:
        """By row: the row that is next in its stream if this one is its cause, else -1."""
        out = np.full(len(self.event_id), -1, np.int64)
        kept = np.sort(self.order)
        rows = kept[np.lexsort((self.stream_sequence[kept], self.stream_id[kept]))]
        if not len(rows):
            return out
        stream, place = self.stream_id[rows], self.stream_sequence[rows]
        ends = np.append((stream[1:] != stream[:-1]) | (place[1:] != place[:-1]), True)  # the last row of each place
        group = np.concatenate([[0], np.cumsum(ends)[:-1]])
        last = rows[ends]
        stream, place = self.stream_id[last], self.stream_sequence[last]
        after = np.full(len(last), -1, np.int64)
        after[:-1] = np.where((stream[1:] == stream[:-1]) & (place[1:] == place[:-1] + 1), last[1:], -1)
        found = after[group]
        caused = self.rest["causation_id"]
        cause, known = caused.fill_null(0).to_numpy(), caused.is_valid().to_numpy(zero_copy_only=False)
        out[rows] = np.where((found >= 0) & known[found] & (cause[found] == self.event_id[rows]), found, -1)
        return out

    def pending(self, types: list[str], handler: Handler) -> Iterator[tuple]:
        """Handles what can be, type by type, each from its position on; ends with the first failure."""
        for number in range(len(types)):
            for row in self.order[self.begins[number] : self.begins[number + 1]]:
                if self.sequence[row] != self.positions[number]:
                    break
                if not self.handled[row]:
                    for found in self._chain(int(row), types, handler):
                        yield found
                    if self.held:
                        return
                self.positions[number] += 1

    def _chain(self, row: int, types: list[str], handler: Handler) -> Iterator[tuple]:
        """An event, then those of its stream that it causes one after the other."""
        via = "position"
        while row >= 0 and not self.handled[row]:
            event_id, event_type = int(self.event_id[row]), types[self.code[row]]
            failed = self.failures.get(event_id, 0)
            event = {"event_id": event_id, "event_type": event_type, "event_sequence": int(self.sequence[row]), "stream_id": int(self.stream_id[row]), "stream_sequence": int(self.stream_sequence[row]), **{k: v[row].as_py() for k, v in self.rest.items()}}
            try:
                handler(event, failed)
            except Exception as e:  # a user's handler may raise anything
                self.failures[event_id], self.held = failed + 1, True
                yield event_id, event_type, via, "failed", f"{type(e).__name__}: {e}"
                return
            self.failures.pop(event_id, None)
            self.handled[row] = True
            yield event_id, event_type, via, "handled", None
            row, via = int(self.following[row]), "cause"

    def left(self) -> np.ndarray:
        """The rows that still wait, or were handled before their position, in the order in which they came."""
        return np.sort(self.order[self.sequence[self.order] >= np.array(self.positions, np.int64)[self.code[self.order]]])


def dispatched(events: DataFrame, types: list[str], handler: Handler) -> DataFrame:
    """What a consumer of these event types does with a stream of journal events: (zone_id, step, event_id, event_type, via, outcome, reason), steps from 0 in each zone.

    events: zone_id, event_id, event_type, event_sequence (dense in zone and type), stream_id, stream_sequence, causation_id, occurred_at, body, in any order and
    repeated or not. Zones go on independently; rows of other types wake a zone that a failure holds back. The state of a zone holds the events that
    can't be handled yet, and what was handled before its position; nothing else grows. A pull that lets a zone go on reads these into its task, about 100 bytes an event and its body.
    """
    columns = ["zone_id", "event_id", "event_type", "event_sequence", "stream_id", "stream_sequence", "causation_id", "occurred_at", "body"]
    return events.select(*columns).groupBy("zone_id").transformWithStateInPandas(Dispatch(types, handler), _HANDLED, "Append", "None")


# --- boundaries -------------------------------------------------------------------------------------


def matched(events: DataFrame, left_type: str, right_type: str, boundary: list[str], wait: str, delay: str) -> DataFrame:
    """Events of the left type, each once, as soon as an event of the right type with the same boundary columns has come too, be it before or after.

    events: a stream of event_id, event_type, occurred_at and the boundary's columns. The two may lie `wait` apart; rows that are more than `delay` behind the latest
    one seen are dropped as late, and repeats of an event count once. The watermark lets the state go of what can't be matched any more.
    """
    fresh = events.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_id"])
    of = lambda kind, side: fresh.where(F.col("event_type") == kind).select(*[F.col(x).alias(f"{side}_{x}") for x in [*boundary, "event_id", "occurred_at"]])
    left, right = of(left_type, "left"), of(right_type, "right")
    same = F.expr(f"left_occurred_at BETWEEN right_occurred_at - INTERVAL {wait} AND right_occurred_at + INTERVAL {wait}")
    for name in boundary:
        same = same & (F.col(f"left_{name}") == F.col(f"right_{name}"))
    pairs = left.join(right, same).select("left_event_id", "left_occurred_at", *[F.col(f"left_{x}").alias(x) for x in boundary])
    return pairs.dropDuplicatesWithinWatermark(["left_event_id"]).withColumnsRenamed({"left_event_id": "event_id", "left_occurred_at": "occurred_at"})


# --- over the driver tables -------------------------------------------------------------------------

TYPES = ["purchase", "signup"]


def _failing(event: dict, failed: int) -> None:
    """A handler that fails once at the tenth event of each type."""
    if event["event_sequence"] == 10 and not failed:
        raise RuntimeError("try again")


def _pulls(spark, sf_dir) -> tuple[str, list[DataFrame]]:
    """The journal in three appends that come out of order, the last one with repeats; then one row for each zone, four times, that only wakes it."""
    rows = written(journal.sequenced(domain.journal(spark, sf_dir)).withColumn("causation_id", F.when(F.col("event_id") % 2 == 0, F.lit(0))))
    before = rows.select("zone_id", "stream_id", (F.col("stream_sequence") + 1).alias("stream_sequence"), F.col("event_id").alias("before"))
    rows = rows.join(before, ["zone_id", "stream_id", "stream_sequence"], "left").withColumn("causation_id", F.when(F.col("causation_id").isNotNull(), F.col("before"))).drop("before")
    appends = [rows.where(F.col("event_id") % 3 == i) for i in range(3)]
    appends[2] = appends[2].unionByName(rows.where("event_id % 5 = 0"))
    return f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}", appends


def stream_dispatch(spark, sf_dir):
    """A consumer of two event types over seven pulls, whose handler fails twice in each zone: what was handled, how often, and where each type stands."""
    folder, appends = _pulls(spark, sf_dir)
    schema = appends[0].schema
    ticks = appends[0].groupBy("zone_id").agg(F.min("event_id").alias("event_id")).select(*[F.col(x.name) if x.name in ("zone_id", "event_id") else F.lit("tick" if x.name == "event_type" else None).cast(x.dataType).alias(x.name) for x in schema])
    for number, pull in enumerate([*appends, ticks, ticks, ticks, ticks]):
        pull.write.mode("append").parquet(f"{folder}/events")
        found = dispatched(consumer.journal_stream(spark, f"{folder}/events", schema), TYPES, _failing)
        consumer.consume(found, lambda batch, n, number=number: batch.write.mode("overwrite").parquet(f"{folder}/out/pull={number}/batch={n}"), f"{folder}/position")
    out = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/*/*")
    return out.groupBy("zone_id", "event_id", "event_type").agg(F.count_if(F.col("outcome") == "handled").alias("handled"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def stream_boundary_match(spark, sf_dir):
    """Sign-ups whose user has a purchase within 30 days, over three pulls that bring either side first, with repeats."""
    folder, appends = _pulls(spark, sf_dir)
    for number, pull in enumerate(appends):
        pull.write.mode("append").parquet(f"{folder}/events")
        found = matched(consumer.journal_stream(spark, f"{folder}/events", pull.schema), "signup", "purchase", ["zone_id", "stream_id"], "30 DAYS", "1000 DAYS")
        consumer.consume(found, lambda batch, n, number=number: batch.write.mode("overwrite").parquet(f"{folder}/out/pull={number}/batch={n}"), f"{folder}/position")
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/*/*").select("event_id", "zone_id", "stream_id")


QUERIES = {f.__name__: f for f in (stream_dispatch, stream_boundary_match)}

ORACLE_SQL = {
    "stream_dispatch": f"WITH {domain.JOURNAL_SQL}, j AS (SELECT *, row_number() OVER (PARTITION BY zone_id, event_type ORDER BY occurred_at, event_id) - 1 AS event_sequence FROM journal) SELECT zone_id, event_id, event_type, CAST(1 AS BIGINT) AS handled, CAST(CASE WHEN event_sequence = 10 THEN 1 ELSE 0 END AS BIGINT) AS failed FROM j WHERE event_type IN ('purchase', 'signup')",
    "stream_boundary_match": f"WITH {domain.JOURNAL_SQL} SELECT event_id, zone_id, stream_id FROM journal l WHERE event_type = 'signup' AND EXISTS (SELECT 1 FROM journal r WHERE r.event_type = 'purchase' AND r.zone_id = l.zone_id AND r.stream_id = l.stream_id AND r.occurred_at BETWEEN l.occurred_at - INTERVAL 30 DAYS AND l.occurred_at + INTERVAL 30 DAYS)",
}
