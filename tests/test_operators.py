"""Operators on hand-worked cases."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import activation, citation, communities, context, corpus, epochs, graph, journal, knowledge, messages, reports, search, strategies, vectors
from sparkloom.sources import documents
from sparkloom.streaming import consumer


def rows(df, *columns):
    return sorted(tuple(x) for x in (df.select(*columns) if columns else df).collect())


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert value(spark, T.normalize_text(F.lit("  a\r\nb\rc 　"))) == "a\nb\nc"
    assert value(spark, T.normalize_text(F.lit(" \n"))) is None and value(spark, T.normalize_text(F.lit("a\0b"))) is None
    assert value(spark, T.normalize_title(F.lit("  a \t b "))) == "a b"
    assert value(spark, T.clean_field(F.lit(" a&amp;b\x07 "))) == "a&b"
    assert value(spark, T.canonical_key(F.lit("ab"), F.lit("é"))) == "2:ab2:é"
    assert value(spark, T.parse_reference(F.lit("x@12"))).asDict() == {"id": "x", "version": 12}
    assert value(spark, T.parse_reference(F.lit("x@012"))) is None
    assert value(spark, F.array_join(T.normalize_aliases(F.array(F.lit(" b"), F.lit("A"), F.lit("a"), F.lit("t"), F.lit("")), F.lit("T")), ",")) == "A,B"
    assert T.plain_float(3.0) == "3.0" and T.plain_float(0.1) == "0.1" and "e" not in T.plain_float(1e-7)
    import hashlib

    want = hashlib.sha256((1).to_bytes(8, "big") + (1).to_bytes(8, "big") + b"a" + (2).to_bytes(8, "big") + b"dd").hexdigest()
    assert value(spark, T.entity_hash(F.array(F.lit("a")), F.lit("dd"))) == want


def test_windows(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x"), (3, " . ")], "doc_id long, text string")
    assert rows(corpus.token_windows(texts, 4, 2), "doc_id", "window_no", "unit") == [(1, 0, "a b c d"), (1, 1, "c d e f"), (1, 2, "e f g h"), (2, 0, "x"), (3, 0, ".")]
    spans = corpus.span_windows(texts, 4, 2).join(texts, "doc_id").collect()
    assert all(x.text[x.start_char : x.end_char] == x.unit for x in spans)
    assert max(x.end_char for x in spans if x.doc_id == 1) == 15
    assert rows(corpus.sentence_spans(spark.createDataFrame([(1, "One two. Three!  Four")], "doc_id long, text string")))[1:] == [(1, 1, 9, 14), (1, 2, 17, 20)]
    with pytest.raises(ValueError):
        corpus.token_windows(texts, 4, 4)


def test_exchanges(spark):
    log = spark.createDataFrame([(1, 0, "assistant", "x"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "user", "d")], "conv_id long, turn long, role string, text string")
    assert rows(messages.exchanges(log), "turn", "exchange_no") == [(1, 1), (2, 1), (3, 2), (4, 3)]
    assert rows(messages.bounded_exchanges(log, 1, last=True), "turn") == [(4,)]
    assert rows(messages.bounded_exchanges(log, 1, last=False), "turn") == [(1,), (2,)]
    assert messages.recent_questions(log, 2).first()["questions"] == "d\nc"


VERSION = "zone_id long, id string, version long, candidate_number long, deleted boolean, content_hash string, source_id long, frequency long"


def versions(spark):
    return spark.createDataFrame(
        [(0, "a", 1, 0, False, "h1", 1, 2), (0, "a", 2, 0, True, "h1", 2, 1), (0, "b", 1, 0, False, "h2", 3, 5), (0, "b", 1, 1, False, "h3", 4, 1), (0, "b", 2, 0, False, "h3", 5, 1), (0, "c", 1, 0, False, "h4", 6, 1), (0, "c", 1, 1, False, "h5", 7, 1)], VERSION
    )


def test_tombstones_after_latest(spark):
    v = versions(spark)
    assert rows(knowledge.latest(v), "id", "version") == [("a", 2), ("b", 2), ("c", 1)]
    assert rows(knowledge.active(v), "id") == [("b",), ("c",)]  # a must not come back with version 1


def test_submission_outcomes(spark):
    offered = spark.createDataFrame([("a", "h1"), ("b", "h3"), ("c", "h5"), ("c", "h6"), ("d", "h1"), ("d", "h0")], "id string, content_hash string")
    got = rows(knowledge.submission(offered, versions(spark)))
    assert got == [("a", "h1", "candidate", 2, 1), ("b", "h3", "confirm", 2, 0), ("c", "h5", "reuse", 1, 1), ("c", "h6", "candidate", 1, 2), ("d", "h0", "create", 1, 0), ("d", "h1", "create", 1, 1)]


def test_provenance_counts_accepted_candidates(spark):
    got = {(x.id, x.version): (x.frequency, x.sources) for x in knowledge.provenance(versions(spark)).collect()}
    assert got["b", 2] == (2, [4, 5]) and got["b", 1] == (5, [3])


def test_resolution(spark):
    v = versions(spark)
    seen = [("c", x.content_hash, x.source_id) for x in v.where("id = 'c' AND candidate_number > 0").collect()]
    assert len(seen) == 1

    def outcome(content_hash, candidates, base=1):
        expected = spark.createDataFrame([("c", base, content_hash)], "id string, base long, content_hash string")
        return [tuple(x) for x in knowledge.resolve(expected, spark.createDataFrame(candidates, "id string, content_hash string, source_id long"), v).collect()]

    assert outcome("h5", seen) == [("c", "appended", 2)] and outcome("h4", seen) == [("c", "confirmed", 1)]
    assert outcome("h5", []) == outcome("h5", seen, 2) == [("c", "stale", 0)]
    # as many as are open, but one was resolved and another opened, or comes from another source
    assert outcome("h5", [("c", "h9", seen[0][2])]) == outcome("h5", [("c", seen[0][1], 99)]) == [("c", "stale", 0)]
    assert outcome("h5", [*seen, *seen]) == [("c", "appended", 2)]


def test_undirected_keeps_the_last(spark):
    edges = spark.createDataFrame([(0, "B", "A", 1.0), (1, "C", "D", 3.0), (2, "A", "B", 2.0)], "pos long, source string, target string, weight double")
    assert rows(graph.undirected(edges), "source", "target", "weight") == [("A", "B", 2.0), ("C", "D", 3.0)]
    loop = spark.createDataFrame([(0, "A", "A", 1.0)], edges.schema)
    assert rows(graph.degrees(loop)) == [("A", 2)]


def test_largest_component_tie(spark):
    edges = spark.createDataFrame([(0, "X", "Y", 1.0), (1, "A", "B", 1.0)], "pos long, source string, target string, weight double")
    assert rows(graph.largest_component(edges), "node") == [("X",), ("Y",)]
    chain = spark.createDataFrame([(i, f"n{i:03}", f"n{i + 1:03}", 1.0) for i in range(100)], edges.schema)
    assert {x.component for x in graph.connected_components(chain).collect()} == {"n000"}


def planted(blocks, size, p_in, p_out, seed):
    rng = random.Random(seed)
    n = blocks * size
    return [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if rng.random() < (p_in if a // size == b // size else p_out)]


def adjusted_rand(a, b):
    pairs = lambda counts: sum(math.comb(c, 2) for c in counts)
    both, left, right = (pd.Series(x).value_counts() for x in (list(zip(a, b, strict=True)), a, b))
    index, x, y, total = pairs(both), pairs(left), pairs(right), math.comb(len(a), 2)
    return (index - x * y / total) / ((x + y) / 2 - x * y / total)


def edge_frame(spark, edges):
    return spark.createDataFrame([(i, f"v{a:03}", f"v{b:03}", w) for i, (a, b, w) in enumerate(edges)], "pos long, source string, target string, weight double")


def found_parts(frame):
    return [x.part for x in frame.orderBy("node").collect()]


def test_communities_find_planted_partitions(spark):
    edges = edge_frame(spark, planted(4, 40, 0.6, 0.02, 1))
    truth = [i // 40 for i in range(160)]
    assert adjusted_rand(found_parts(communities.communities(edges)), truth) >= 0.9
    assert adjusted_rand(found_parts(communities.communities(edges, gamma=0.05, modular=False)), truth) >= 0.9


def test_communities_are_deterministic_connected_and_nested(spark):
    raw = planted(3, 20, 0.5, 0.02, 5)
    edges = edge_frame(spark, raw)
    first = communities.communities(edges, seed=3)
    parts = {x.node: x.part for x in first.collect()}
    assert parts == {x.node: x.part for x in communities.communities(edges, seed=3).collect()}
    assert graph.modularity(edges, first).first()["modularity"] > 0.4
    for part in set(parts.values()):
        members = {int(n[1:]) for n, c in parts.items() if c == part}
        reached, todo = set(), [min(members)]
        while todo:
            v = todo.pop()
            if v not in reached:
                reached.add(v)
                todo += [b if a == v else a for a, b, _ in raw if v in (a, b) and {a, b} <= members]
        assert reached == members
    tree = communities.hierarchical_communities(edges, largest=8, most_levels=2)
    assert communities.hierarchy_faults(tree).isEmpty()
    assert tree.where("level = 0").count() == len(parts)


def test_nodes_with_one_neighbour_lie_with_it_however_little_it_adds(spark):
    stars = spark.createDataFrame([(f"s{c}", f"{c}-{i}", 1.0) for c in range(3) for i in range(300)], "source string, target string, weight double")
    last = communities.cluster(stars, communities._everyone(stars), tolerance=10.0)[-1].collect()
    assert {x.node: x.part for x in last} == {f"{c}-{i}": f"{c}-0" for c in range(3) for i in range(300)} | {f"s{c}": f"{c}-0" for c in range(3)}


def test_communities_of_exactly_the_limit_are_split(spark):
    """Two cliques of five with one link, among many others: one community of ten, which is split at a limit of ten, not of eleven."""
    clique = lambda name: [(f"{name}{a}", f"{name}{b}", 1.0) for a in range(5) for b in range(a + 1, 5)]
    raw = [*clique("x"), *clique("y"), ("x4", "y0", 1.0), *(e for i in range(30) for e in clique(f"z{i:02}"))]
    edges = spark.createDataFrame([(i, *x) for i, x in enumerate(raw)], "pos long, source string, target string, weight double")
    both = {f"{c}{i}" for c in "xy" for i in range(5)}
    for limit, children in ((10, {"x0/x0", "x0/y0"}), (11, set())):
        tree = communities.detected(edges, limit, largest_component=False).collect()
        assert {x.node for x in tree if x.part == "x0"} == both
        assert {x.part for x in tree if x.level == 1} == children
        assert all(x.final != (x.level == 0 and x.node in both and limit == 10) for x in tree)
    assert {x.node for x in communities.detected(edges).collect()} == both


def test_coarsened_levels_and_relabelling(spark):
    levels = communities.coarsened(edge_frame(spark, planted(3, 8, 0.9, 0.02, 4)))
    last = levels.where(F.col("level") == levels.agg(F.max("level")).first()[0])
    assert levels.groupBy("level").count().where("count <> 24").isEmpty()
    numbers = {x.part: x.number for x in communities.relabel(last).select("part", "number").distinct().collect()}
    assert sorted(numbers, key=numbers.get) == sorted(numbers) and sorted(numbers.values()) == list(range(len(numbers)))
    fine = spark.createDataFrame([("a", "x"), ("b", "y")], "node string, part string")
    assert rows(communities.merged(spark.createDataFrame([("x", "all"), ("y", "all")], "part string, into string"), fine)) == [("a", "all"), ("b", "all")]


def test_neighborhood_and_semi_joins(spark):
    edges = spark.createDataFrame([(0, "a", "b", 3.0), (1, "c", "a", 2.0), (2, "b", "c", 1.0), (3, "d", "e", 1.0)], "pos long, source string, target string, weight double")
    assert rows(graph.neighborhood(edges, "a", 1), "place", "node") == [(0, "a"), (1, "b")]
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    assert rows(graph.touching(edges, nodes), "pos") == [(0,), (1,), (2,)]
    assert rows(graph.induced(edges, nodes), "pos") == [(0,)]
    assert rows(graph.dangling(edges, nodes)) == [("c",), ("d",), ("e",)]


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [2.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [], 1)], kind)
    assert [x.vec_id for x in vectors.top_k(v, [1.0, 0.0], 2).collect()] == [1, 3]
    assert rows(vectors.top_k_then_filter(v, [1.0, 0.0], 2, v.where("label = 1")), "vec_id") == [(3,)]
    assert rows(vectors.include_exclude(v, [1.0, 0.0], 2, [2], [1]), "vec_id") == [(2,), (3,)]
    assert rows(vectors.add(v.where("vec_id = 1"), v.unionByName(v)), "vec_id") == [(2,), (3,)]
    inputs = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 5, 9, 1])], "stream string, place long, tokens long")
    assert [x.batch for x in vectors.request_batches(inputs, 2, 10).orderBy("place").collect()] == [0, 0, 1, 2, 2]


def test_packing_over_partitions(spark):
    rng = random.Random(8)
    data = [(None if k == 2 else f"k{k}", i, rng.choice([0, 0, 1, 3, 7, 30])) for k in range(5) for i in range(700 if k == 1 else 9)]

    def fold(budget, header, most):
        want, state = {}, {}
        for k, i, n in data:
            batch, items, used = state.get(k, (0, 0, header))
            if items and (used + n > budget or items >= most):
                batch, items, used = batch + 1, 0, header
            state[k], want[k, i] = (batch, items + 1, used + n), batch
        return want

    r = spark.createDataFrame(data, "key string, pos long, tokens long").repartition(3)
    for budget, header, most in ((20, 5, 10**9), (31, 0, 3), (1000, 2, 10**9), (60, 0, 16)):
        for parts in (4, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = context.packed(r, "key", "pos", budget, header, None if most == 10**9 else most)
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            assert {(x.key, x.pos): x.batch for x in got.collect()} == fold(budget, header, most)
    hot = context.next_fit(r.where("key = 'k1'"), "key", "pos", 20, 5)
    assert hot.select(F.spark_partition_id()).distinct().count() > 1
    tables = context.rendered(r, "key", "pos", ["tokens"], 20)
    assert "WindowGroupLimit" in tables._jdf.queryExecution().toString()
    assert {x.key: x.rows for x in tables.collect()} == {k: 19 if k == "k1" else 9 for k in {x[0] for x in data}}


def test_long_texts_are_batched_whole(spark):
    texts = spark.createDataFrame([("s", 1, 20_000), ("s", 2, 0), ("s", 3, 8191)], "stream string, doc_id long, n long")
    got = vectors.request_batches(vectors.input_windows(texts)).collect()
    assert [(x.place.doc_id, x.place.window, x.tokens, x.batch) for x in sorted(got, key=lambda x: x.place)] == [(1, 0, 8191, 0), (1, 1, 8191, 1), (1, 2, 3618, 2), (2, 0, 0, 2), (3, 0, 8191, 3)]
    with pytest.raises(Exception, match="an input has 9 tokens"):
        vectors.request_batches(spark.createDataFrame([("s", 1, 9)], "stream string, place long, tokens long"), 2, 8).collect()


def test_budgets(spark):
    r = spark.createDataFrame([("k", i, n) for i, n in enumerate([4, 4, 9, 1, 12, 1])], "key string, pos long, tokens long")
    assert rows(context.budget_prefix(r, "key", "pos", 10), "pos") == [(0,), (1,)]
    assert [x.batch for x in context.next_fit(r, "key", "pos", 10).orderBy("pos").collect()] == [0, 0, 1, 1, 2, 3]
    frame = pd.DataFrame({"a": ['say "x"', "y", "z"]})
    assert context.render_table(frame, ["a"], 16, len) == ("id,a\n", 0)
    full, all_ = context.render_table(frame, ["a"], 1000, len)
    assert full == 'id,a\n0,"say ""x"""\n1,y\n2,z\n' and all_ == 3
    assert context.render_table(frame, ["a"], len('id,a\n0,"say ""x"""\n'), len)[1] == 1
    with pytest.raises(ValueError):
        context.render_table(frame, ["a"], 3, len)
    assert context.render_prompt("{{a}} {b}", {"b": "1"}) == "{a} 1"
    with pytest.raises(ValueError):
        context.render_prompt("{c}", {"b": "1"})
    assert context.longest_prefix("abcdef", lambda x: len(x) <= 4) == "abcd"
    assert search.local_budgets(1001) == {"reports": 150, "sources": 500, "graph": 351}
    assert reports.reduce_rounds(9, 3) == 2 and reports.reduce_rounds(1, 3) == 0


def test_votes_and_folds(spark):
    r = spark.createDataFrame([(1, 3), (1, 2), (1, 2), (1, 3), (2, 5)], "item long, rating long")
    assert rows(context.majority_vote(r), "item", "rating") == [(1, 2), (2, 5)]
    f = spark.createDataFrame([("q", i) for i in range(7)], "question string, place long")
    assert [x.fold for x in context.folds(f, 3).orderBy("place").collect()] == [1, 1, 1, 2, 2, 3, 3]
    lines = spark.createDataFrame([("k", "- a\n* b\n\n- a\nc")], "key string, text string")
    assert rows(context.question_candidates(lines, 2), "place", "question") == [(1, "a"), (2, "b")]


def test_citations(spark):
    text = "A [Data: Reports (1, 2, +more); Claims (4)] B [Data: Ghosts (1)] C [Data: Sources (x)] D [Data: Entities (1,2,3,4,5,6)] E [Data: ] F [Data: Reports (1"
    assert citation.parse(text) == [(0, "Reports", 1, None), (0, "Reports", 2, None), (0, "Claims", 4, None), (1, "Ghosts", None, "unknown_dataset"), (2, "Sources", None, "invalid_record"), (3, "Entities", None, "too_many_records"), (4, None, None, "malformed"), (5, None, None, "malformed")]
    answers = spark.createDataFrame([(1, text)], "key long, answer string")
    found = citation.references(answers)
    assert rows(found, "dataset", "record_id") == [("Claims", 4), ("Reports", 1), ("Reports", 2)]
    scope = spark.createDataFrame([(1, "Reports", 1, 10), (1, "Claims", 4, 11)], "key long, dataset string, record_id long, unit_id long")
    sources = spark.createDataFrame([(10,)], "unit_id long")
    assert rows(citation.audit(found, scope, sources), "dataset", "record_id", "status") == [("Claims", 4, "unresolved"), ("Reports", 1, "valid"), ("Reports", 2, "outside_context")]


def test_fsrs_formulas():
    model = activation.Model()
    assert model.recall(10.0, 10) == pytest.approx(0.9)
    s, d = model.step(None, 3, 0)
    assert s == pytest.approx(2.3065) and d == pytest.approx(6.4133 - math.exp(0.8334 * 2) + 1)
    assert model.step((s, d), 3, 0)[0] >= s  # on the same day only a lapse lowers the stability
    assert model.step((s, d), 1, 0)[0] < s
    assert model.step((50.0, 5.0), 1, 30)[0] < 50 < model.step((50.0, 5.0), 3, 30)[0] < model.step((50.0, 5.0), 4, 30)[0]
    assert model.step((0.0011, 10.0), 1, 0)[0] >= activation.LEAST_STABILITY
    with pytest.raises(ValueError):
        activation.Model((1.0,))


def test_activation_fold(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    obs = spark.createDataFrame([(1, 10, day(0), 3, 0), (1, 11, day(5), 3, 1), (1, 11, day(5), 3, 2), (1, 12, day(4), 1, 3), (1, 13, day(5), 4, 4)], "subject long, observation_id long, occurred_at timestamp_ntz, grade long, submitted long")
    history = activation.states(obs)
    assert rows(history, "observation_id", "accepted") == [(10, True), (11, True), (12, False), (13, True)]
    now = activation.current_states(history)
    model = activation.Model()
    state = model.step(model.step(model.step(None, 3, 0), 3, 5), 4, 0)
    assert (now.first()["stability"], now.first()["difficulty"]) == pytest.approx(state)
    assert activation.verify(now, activation.current_states(activation.states(obs))).isEmpty()
    recall = now.select(activation.activation(F.col("stability"), F.col("last_review"), F.lit(day(3)).cast("timestamp_ntz")).alias("x")).first()["x"]
    assert recall == 1.0


def test_journal(spark):
    kind = "event_id long, zone_id long, stream_id long, event_type string, occurred_at timestamp_ntz, body string"
    at = lambda n: dt.datetime(2024, 1, 1, 0, n)
    first = spark.createDataFrame([(1, 0, 5, "x", at(1), "a"), (2, 0, 5, "y", at(2), "b")], kind)
    stored = journal.sequenced(first)
    more = spark.createDataFrame([(1, 0, 5, "x", at(1), "a"), (2, 0, 5, "y", at(2), "changed"), (3, 0, 5, "x", at(3), "c")], kind)
    assert rows(journal.append(stored, more)) == [(1, "skipped", 0, 0), (2, "conflict", 0, 0), (3, "appended", 3, 1)]
    positions = spark.createDataFrame([(0, "x", 1)], "zone_id long, event_type string, position long")
    assert rows(journal.pending(stored, positions), "event_id") == [(2,)]


def test_epochs(spark, tmp_path):
    rows_ = spark.range(3).withColumnRenamed("id", "x")
    folder = f"{tmp_path}/epochs"
    assert epochs.current(spark, folder) == 0
    epochs.publish(rows_.limit(1), folder, 1, 0)
    epochs.publish(rows_, folder, 2, 1)
    with pytest.raises(ValueError):
        epochs.publish(rows_, folder, 3, 1)
    assert epochs.read_epoch(spark, folder).count() == 3 and epochs.read_epoch(spark, folder, 1).count() == 1


def test_html(spark, tmp_path):
    page = "<html><head><title> A  b </title><script>x</script></head><body><h2>Head</h2><p>One <b>two</b><br>three</p><ul><li>i</li></ul><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2</td></tr></table></body>"
    assert documents.html_to_markdown(page) == ("A b", "## Head\n\nOne two three\n\n- i\n\n| a | b\\|c |\n\n| --- | --- |\n\n| 1 | 2 |")
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.txt").write_bytes(b"hello\r\nworld")
    (tmp_path / "f/b.txt").write_bytes(b"hello\r\nworld")
    (tmp_path / "f/c.bin").write_bytes(b"\xff\xfe")
    files = documents.read_files(spark, f"{tmp_path}/f")
    assert rows(documents.plain_texts(files), "text") == [("hello\nworld",)] * 2
    assert rows(documents.first_locations(files), "copies", "sound") == [(1, True), (2, True)]
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, digest string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3"), ("e", "7")], "path string, digest string")
    assert rows(documents.reconcile(old, new)) == [("a", "kept"), ("b", "changed"), ("c", "missing"), ("d", "duplicate"), ("e", "added")]


def test_search_plans(spark):
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a")], "part string, parent string")
    ratings = spark.createDataFrame([("r", 3), ("a", 3), ("b", 1), ("c", 0)], "part string, rating long")
    assert rows(search.dynamic_selection(tree, ratings, 2)) == [("a",)]
    assert rows(search.dynamic_selection(tree, ratings, 2, keep_parent=True)) == [("a",), ("r",)]
    follow = spark.createDataFrame([("q", "x"), ("x", "y"), ("y", "q"), ("y", "z")], "question string, next string")
    assert rows(search.branch(spark.createDataFrame([("q",)], "question string"), follow, depth=2)) == [("q", 0), ("x", 1), ("y", 2)]
    budget = search.RequestBudget(calls=1, prompt=10, output=10)
    assert budget.reserve(5, 5) and not budget.reserve(1, 1)
    budget.settle((5, 5), (2, 1))
    assert budget.left == {"calls": 0, "prompt": 8, "output": 9}


def test_dynamic_selection_falls_back_and_goes_deep(spark):
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "b")], "part string, parent string")
    rated = lambda **x: spark.createDataFrame([(k, x.get(k, 0)) for k in "rabc"], "part string, rating long")
    assert rows(search.dynamic_selection(tree, rated(a=3), 2)) == [("a",)]
    assert rows(search.dynamic_selection(tree, rated(b=3, c=3), 2)) == [("c",)]
    assert rows(search.dynamic_selection(tree, rated(c=3), 2)) == []
    assert rows(search.dynamic_selection(tree, rated(c=3), 2, fallback_levels=3)) == [("c",)]
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(13)], "part string, parent string")
    assert rows(search.dynamic_selection(chain, chain.select("part", F.lit(5).alias("rating")), 2)) == [("n12",)]


def test_hierarchy_goes_on_until_nothing_is_too_large(spark, monkeypatch):
    def peel(edges, groups, *_):
        least = groups.groupBy("grp").agg(F.min("node").alias("least"), F.max("node").alias("most"))
        return [groups.join(least, "grp").select("node", F.when(F.col("node") == F.col("least"), F.col("least")).otherwise(F.col("most")).alias("part"))]

    monkeypatch.setattr(communities, "cluster", peel)
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(9)], "source string, target string, weight double")
    tree = communities.hierarchical_communities(edges, largest=1)
    assert tree.where("final").groupBy("level", "part").count().where("count > 1").isEmpty()
    assert tree.agg(F.max("level")).first()[0] == 8


def test_an_observation_that_comes_again_changes_nothing(spark, tmp_path):
    """In one pull and in a later one, with a later place of submission."""
    kind = "subject long, observation_id long, occurred_at timestamp_ntz, grade long, submitted long"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    pulls = [[(1, 10, day(0), 3, 0), (1, 11, day(5), 3, 1), (1, 11, day(5), 3, 2)], [(1, 10, day(0), 3, 3), (1, 12, day(9), 4, 4), (1, 11, day(5), 3, 5)]]
    out = []
    for pull in pulls:
        spark.createDataFrame(pull, kind).write.mode("append").parquet(f"{tmp_path}/events")
        states = consumer.memory_states(spark.readStream.schema(kind).parquet(f"{tmp_path}/events"))
        consumer.consume(states, lambda batch, _: out.extend(tuple(x) for x in batch.collect()), f"{tmp_path}/position")
    assert [(x[1], x[4]) for x in out] == [(10, True), (11, True), (12, True)]
    once = activation.current_states(activation.states(spark.createDataFrame([*pulls[0][:2], pulls[1][1]], kind))).first()
    assert (out[-1][2], out[-1][3]) == pytest.approx((once["stability"], once["difficulty"]))


def test_what_is_too_large_is_an_error_of_its_own(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"123456")
    (tmp_path / "b.txt").write_bytes(b"12345")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "d.txt").write_bytes(b" \n")
    files = {x.path.rsplit("/", 1)[1]: x for x in documents.read_files(spark, str(tmp_path), 5).collect()}
    assert (files["a.txt"].error, files["a.txt"].content, files["a.txt"].digest, files["a.txt"].size) == ("6 bytes, more than 5", None, None, 6)
    assert files["b.txt"].error is None and bytes(files["b.txt"].content) == b"12345"
    assert [x.text for x in documents.plain_texts(documents.read_files(spark, str(tmp_path), 5)).collect()] == ["12345"]
    faults = {x.path.rsplit("/", 1)[1]: x.error for x in documents.text_faults(documents.read_files(spark, str(tmp_path), 5)).collect()}
    assert faults == {"a.txt": "6 bytes, more than 5", "c.txt": "not UTF-8", "d.txt": "no text"}
    with pytest.raises(ValueError):
        documents.html_to_markdown("<p>four</p>", 3)
    texts = documents.html_texts(spark.createDataFrame([(1, "<p>four</p>"), (2, "<p>two</p>"), (3, None)], "page_id long, html string"), 3)
    assert rows(texts, "page_id", "markdown", "error") == [(1, None, "ValueError: a page gives 4 characters, more than 3"), (2, "two", None), (3, "", None)]


def test_reduce_tree_against_a_fold(spark):
    texts = {"a": [f"text {i} of a" for i in range(11)], "b": ["only one"], "c": ["x y", "z"]}
    frame = spark.createDataFrame([(p, i, x) for p, xs in texts.items() for i, x in enumerate(xs)], "part string, place long, text string")

    def fold(now, rounds=0):
        if len(now) == 1:
            return now[0], rounds
        batches = [[]]
        for x in now:
            if batches[-1] and sum(len(y.split(" ")) for y in [*batches[-1], x]) > 9:
                batches.append([])
            batches[-1].append(x)
        return fold([search.stub_model("\n".join(b)) for b in batches], rounds + 1)

    got = {x.part: (x.text, x.rounds) for x in strategies.reduce_tree(frame, 9).collect()}
    assert got == {p: fold(xs) for p, xs in texts.items()}
    with pytest.raises(ValueError):
        strategies.reduce_tree(frame, 2)
