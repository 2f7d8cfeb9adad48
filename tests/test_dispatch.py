"""Stateful streams over several pulls: dispatch against a plain simulation, boundaries that come in any order."""

import datetime as dt
import random

import pandas as pd

from sparkloom.streaming import consumer, dispatch

EVENTS = "zone_id long, event_id long, event_type string, event_sequence long, stream_id long, stream_sequence long, causation_id long, occurred_at timestamp, body string"
TYPES = ["b", "a"]


def journal_rows(rng, n):
    types, streams, out = {}, {}, []
    for i in range(n):
        zone, stream, kind = rng.randrange(3), rng.randrange(5), rng.choice("aabbc")
        at = types[zone, kind] = types.get((zone, kind), -1) + 1
        place = streams[zone, stream] = streams.get((zone, stream), 0) + 1
        before = next((x[1] for x in out if x[0] == zone and x[4] == stream and x[5] == place - 1), None)
        out.append((zone, i, kind, at, stream, place, before if rng.random() < 0.7 else None, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), f"body {i}"))
    return out


def failing(event, failed):
    if event["event_id"] % 11 == 3 and failed < 2:
        raise RuntimeError(f"failure {failed}")


def simulate(pulls, zone):
    """What happens in a zone, pull by pull."""
    waiting, position, done, failures, out = {}, dict.fromkeys(TYPES, 0), set(), {}, []
    for pull in pulls:
        rows = [x for x in pull if x[0] == zone]
        for x in rows:
            if x[2] in TYPES and x[3] >= position[x[2]]:
                waiting.setdefault((x[2], x[3]), x)
        if not rows:
            continue
        stopped = False
        for kind in TYPES:
            while (kind, position[kind]) in waiting and not stopped:
                current, via = waiting[kind, position[kind]], "position"
                while current is not None and (current[1] not in done):
                    failed = failures.get(current[1], 0)
                    if current[1] % 11 == 3 and failed < 2:
                        failures[current[1]] = failed + 1
                        out.append((current[1], current[2], via, "failed", f"RuntimeError: failure {failed}"))
                        stopped = True
                        break
                    done.add(current[1])
                    out.append((current[1], current[2], via, "handled", None))
                    via = "cause"
                    following = [x for x in waiting.values() if x[4] == current[4] and x[5] == current[5] + 1 and x[6] == current[1]]
                    current = following[0] if following else None
                if not stopped:
                    del waiting[kind, position[kind]]
                    position[kind] += 1
            if stopped:
                break
    return [(zone, i, *x) for i, x in enumerate(out)]


def test_dispatch_against_a_simulation(spark, tmp_path):
    rng = random.Random(6)
    rows = journal_rows(rng, 150)
    pulls = [[], [], [], []]
    for row in rows:
        pulls[min(3, int(rng.expovariate(1.2)))].append(row)
    pulls[2] += rng.sample(rows, 30) + pulls[2][:5]  # repeats, some of them before their first time
    pulls += [[(z, 1000 + z, "c", 1000, 99, 1, None, dt.datetime(2025, 1, 1), "")] for z in range(3)] * 25  # these only wake a zone
    pulls = [*pulls[:4], *([x for p in pulls[4:7] for x in p] for _ in range(12))]
    out = []
    for pull in pulls:
        spark.createDataFrame(pull, EVENTS).repartition(2).write.mode("append").parquet(f"{tmp_path}/events")
        found = dispatch.dispatched(consumer.journal_stream(spark, f"{tmp_path}/events", EVENTS), TYPES, failing)
        consumer.consume(found, lambda batch, _: out.extend(tuple(x) for x in batch.collect()), f"{tmp_path}/position")
    for zone in range(3):
        assert sorted(x for x in out if x[0] == zone) == simulate(pulls, zone)
    handled = [x[2] for x in out if x[5] == "handled"]
    assert sorted(handled) == sorted(x[1] for x in rows if x[2] in TYPES)  # once each
    assert {x[4] for x in out} == {"position", "cause"} and {x[5] for x in out} == {"handled", "failed"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_boundaries_across_pulls(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    kind = "event_id long, event_type string, occurred_at timestamp, corpus string, digest string"
    pulls = [
        [(1, "left", day(0), "c", "x"), (2, "right", day(1), "c", "y"), (3, "left", day(2), "c", "z"), (4, "left", day(2), "d", "x")],
        [(5, "right", day(3), "c", "x"), (6, "left", day(3), "c", "y"), (6, "left", day(3), "c", "y"), (1, "left", day(0), "c", "x"), (7, "right", day(3), "c", "x")],
        [(8, "right", day(20), "c", "z"), (5, "right", day(3), "c", "x"), (9, "left", day(20), "c", None), (10, "right", day(20), "c", None)],
        [(11, "left", day(40), "e", "e"), (12, "right", day(19), "e", "e")],
        [(13, "right", day(24), "e", "e"), (14, "left", day(41), "f", "f"), (15, "right", day(35), "f", "f")],
    ]
    out = []
    for pull in pulls:
        spark.createDataFrame(pull, kind).repartition(2).write.mode("append").parquet(f"{tmp_path}/events")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/events")
        found = dispatch.matched(stream, "left", "right", ["corpus", "digest"], "10 DAYS", "15 DAYS")
        consumer.consume(found, lambda batch, _: out.extend((x.event_id, x.corpus, x.digest) for x in batch.collect()), f"{tmp_path}/position")
    # 3 and 8 lie too far apart, a null is no boundary, 4 has no partner, 13 comes too late
    assert sorted(out) == [(1, "c", "x"), (6, "c", "y"), (14, "f", "f")]


class Held:
    """A state variable in memory that counts its requests."""

    def __init__(self, requests):
        self.requests, self.held = requests, {}

    def __getattr__(self, name):
        def call(*given):
            self.requests.append(name)
            if name in ("exists", "containsKey"):
                return (given[0] if given else ()) in self.held
            if name in ("get", "getValue"):
                return self.held.get(given[0] if given else ())
            if name in ("update", "updateValue"):
                self.held[given[0] if len(given) > 1 else ()] = given[-1]
            elif name == "iterator":
                return iter(list(self.held.items()))
            elif name == "removeKey":
                self.held.pop(given[0], None)

        return call


class Handle:
    def __init__(self):
        self.requests = []

    def __getattr__(self, _):
        return lambda *_: Held(self.requests)


def test_a_zones_events_cost_no_state_requests_of_their_own():
    n, handle = 30_000, Handle()
    rows = pd.DataFrame({"zone_id": 1, "event_id": range(n), "event_type": ["a", "b"] * (n // 2), "event_sequence": [i // 2 for i in range(n)], "stream_id": [i % 100 for i in range(n)], "stream_sequence": [i // 100 for i in range(n)], "causation_id": [float(i - 100) if i >= 100 and i % 3 else None for i in range(n)], "occurred_at": pd.Timestamp("2024-01-01"), "body": "x"})
    processor = dispatch.Dispatch(TYPES, lambda event, failed: None)
    processor.init(handle)
    out = [x for part in (rows[1:], rows[:1]) for frame in processor.handleInputRows((1,), iter([part]), None) for x in frame.itertuples(index=False)]
    assert sorted(x.event_id for x in out) == list(range(n)) and [x.step for x in out] == list(range(n))
    assert len(handle.requests) < 100


def test_a_subjects_observations_cost_no_state_requests_of_their_own():
    n, handle = 5000, Handle()
    rows = pd.DataFrame({"subject": 1, "observation_id": range(n), "occurred_at": pd.Timestamp("2024-01-01"), "grade": 3, "submitted": range(n)})
    memory = consumer.Memory()
    memory.init(handle)
    seen = [x for part in (rows[:3000], rows[2000:4000], rows[::2], rows[1::2]) for frame in memory.handleInputRows((1,), iter([part]), None) for x in frame["observation_id"]]
    assert sorted(seen) == list(range(n))
    assert len(handle.requests) < 100


def test_a_pull_is_one_batch_however_many_files_it_has(spark, tmp_path):
    spark.range(100).repartition(25).write.parquet(f"{tmp_path}/events")
    numbers = []
    consumer.consume(consumer.journal_stream(spark, f"{tmp_path}/events", "id long"), lambda batch, number: numbers.append((number, batch.count())), f"{tmp_path}/position")
    assert numbers == [(0, 100)]
