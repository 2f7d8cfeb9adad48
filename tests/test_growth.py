"""Work that must not be done twice, or grow faster than its input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom import session
from sparkloom.functions import text as T
from sparkloom.operators import context, corpus, graph, sentences
from sparkloom.plans import domain

UNICODE = "\x85\xa0   　"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("growth") / "documents.parquet")
    texts = [(1, f"{UNICODE} a\r\nb\rc{UNICODE}\t"), (2, None), (3, "\x85 "), (4, "a\0b"), (5, " ".join(map(str, range(200)))), (6, "a b c")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(folder)
    return spark.read.parquet(folder)


def test_texts_are_normalised_once(documents):
    texts = corpus.prepared_texts(documents)
    assert {x.doc_id: x.text for x in texts.collect()} == {1: "a\nb\nc", 5: " ".join(map(str, range(200))), 6: "a b c"}
    assert plan(texts).count("trim") == 1
    assert plan(documents.select(T.normalize_text(F.col("text")).alias("text"))).count("trim") == 1


def test_windows_do_not_carry_the_tokens(documents):
    windows = corpus.token_windows(corpus.prepared_texts(documents), 64, 16)
    first = next(x for x in plan(windows).splitlines() if "Generate posexplode" in x)
    assert "tokens" not in first.split("window_no")[0].replace("token_count", "")
    got = windows.where("doc_id = 5").orderBy("window_no").collect()
    assert [(x.window_no, x.token_count, x.unit.split(" ")[0]) for x in got] == [(0, 64, "0"), (1, 64, "48"), (2, 64, "96"), (3, 56, "144")]


def test_generations_are_cut_once(spark, documents):
    folder = documents.inputFiles()[0].rsplit("/", 2)[0]
    assert plan(corpus.earlier_units(corpus._spans(spark, folder), 2)).count("Relation [") == 1
    assert corpus.earlier_units(corpus._spans(spark, folder), 2).count() == 1 + 4  # a b c of documents 1 and 6; document 5


def test_generation_ready_counts_repeated_and_missing_texts(spark):
    texts = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    spans = spark.createDataFrame([(1,), (1,), (7,)], "doc_id long")
    assert tuple(corpus.generation_ready(texts, spans).first()) == (3, 3, False)
    assert tuple(corpus.generation_ready(texts.where("doc_id = 1"), spans).first()) == (0, 3, True)
    assert tuple(corpus.generation_ready(texts.limit(0), spans.limit(0)).first()) == (0, 0, False)


def test_spans_meet_a_text_once(spark, documents):
    folder = documents.inputFiles()[0].rsplit("/", 2)[0]
    checked = corpus.corpus_span_windows(spark, folder)
    assert sorted(map(tuple, checked.collect())) == [(1, 1, 5, True), (5, 4, 689, True), (6, 1, 5, True)]
    assert "forall" in plan(checked)


def test_a_task_holds_the_sentences_of_few_texts(spark):
    texts = spark.createDataFrame([(n, f"One {n}. Two! Three" if n % 3 else " ") for n in range(1000)], "doc_id long, text string").coalesce(1)
    assert corpus.TEXTS_HELD < 1000
    spans = corpus.sentence_spans(texts)
    assert "MapInArrow" in plan(spans)
    assert spans.count() == 3 * 666
    assert [tuple(x)[1:] for x in spans.where("doc_id = 998").orderBy("sentence_no").collect()] == [(0, 0, 7), (1, 9, 12), (2, 14, 18)]


def test_a_word_is_asked_once_a_task(monkeypatch):
    asked, parse = [], sentences._token
    monkeypatch.setattr(sentences, "_token", lambda raw: asked.append(raw) or parse(raw))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 50, "text": ["3 (of) No. 3 (of) four"] * 50})
    rows = [x for part in sentences._count_types(iter([batch])) for x in part.to_pylist()]
    assert sorted(asked) == ["(of)", "3", "No."]  # not once a text
    assert {(x["type"], x["dotted"], x["plain"]) for x in rows} == {("##number##", 0, 100), ("of", 0, 100), ("no", 50, 0), ("four", 0, 50)}


def test_words_between_stops_and_around_them():
    assert list(sentences._stops('A b. ... "C d.')) == [("A ", "b.", '"C', True), (" ", "d.", "", True), ("", "", "", True)]
    assert list(sentences._stops("A. B. c ... d")) == [("", "A.", "B.", True), ("", "B.", "c", False), (" ... d", "", "", True)]


SMALL = "/root/testdata/sf0.001"


def test_a_task_takes_no_more_relations_as_lines_grow(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 1000)
    lines = session.table(spark, SMALL, "lineitem")
    tasks = session.tasks_for(lines)
    assert tasks == -(-lines.count() // 1000) > 5
    relations = domain.relations(spark, SMALL)
    found = plan(relations)
    assert "RepartitionByExpression [l_suppkey#" in found and found.count("Aggregate") == 1
    assert f"], {tasks}" in plan(graph.undirected(relations, tasks))
    sizes = relations.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == tasks and max(x["count"] for x in sizes) < 2000


def test_qualities_read_the_edges_once(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 1.0), ("c", "d", 4.0), ("d", "x", 9.0)], "source string, target string, weight double")
    parts = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")], "node string, part string")
    for tasks in (None, 3):
        quality = graph.modularity(edges, parts, tasks=tasks)  # m 7, inside 6, masses 5 and 9
        assert quality.first()[0] == pytest.approx(6 / 7 - (25 + 81) / (4 * 49))
        assert plan(quality).count("weight#") and "Join Inner, (source" not in plan(quality)
        assert graph.cpm_quality(edges, parts, 0.5, tasks).first()[0] == pytest.approx(6 - 0.25 * 8)


def test_degrees_of_some_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), (None, "c")], "source string, target string")
    nodes = spark.createDataFrame([("c",), ("b",), ("z",)], "node string")
    assert {tuple(x) for x in graph.degrees(edges, nodes).collect()} == {("b", 2), ("c", 4)}
    some = graph.degrees(domain.relations(spark, SMALL), session.written(nodes))
    assert plan(some).index("Join LeftSemi") > plan(some).index("Aggregate [l_suppkey")  # other pairs are not summed


def test_packing_visits_few_rows():
    run = context._Run(np.full(10_000, 6), 1500, 40, None)
    found = run.ends(run.closing())
    assert found[0] == (10_000 // 243, 10_000 // 243 * 243) and len(found) <= 10_000
    assert len(run.ends([0])) == 42  # one row a batch


def test_packing_carries_columns(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 5, "y"), ("a", 3, 5, "z"), (None, 1, 5, "n"), (None, 2, 5, "m")], "part string, place long, tokens long, id string")
    packed = context.packed(rows, "part", "place", 10, carry=("id",))
    assert {(x.part, x.id, x.batch) for x in packed.collect()} == {("a", "x", 0), ("a", "y", 0), ("a", "z", 1), (None, "n", 0), (None, "m", 0)}
