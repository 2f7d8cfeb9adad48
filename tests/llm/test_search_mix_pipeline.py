import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import bpe, exact_dedup, language_id, mixing, simhash, topk_search

from .conftest import DOCS, prose


def brute_topk(rows, queries, k):
    """Every usable row is a candidate for other ids; the rows of a query's id share its ranks."""
    usable = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for qid in sorted({i for i, _ in usable if i % queries == 0}):
        asked = [v for i, v in usable if i == qid]
        scores = sorted((-min(max(sum(a * b for a, b in zip(q, v, strict=True)), -(2**63)), 2**63 - 1), i) for q in asked for i, v in usable if i != qid and len(v) == len(q))
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_topk_of_repeated_ids_equals_its_sql(spark, tmp_path):
    """Ids that repeat, as queries and as a third of all candidates, in many blocks."""
    import duckdb

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(300)]
    rows += [(7, rng.normal(0, 0.4, 8).tolist()) for _ in range(150)] + [rows[7]] * 20 + [(100, rng.normal(0, 0.2, 8).tolist()), rows[100], rows[200]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    table = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    got = topk_search.top_k_search(table, F.col("vec_id") % 100 == 0, 10, 60)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(topk_search.ORACLE_SQL["op10_topk_search"]).fetchall()
    assert sorted(want) == brute_topk(rows, 100, 10)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


@pytest.mark.parametrize("block_rows", [64, 100_000])
def test_topk_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 12).tolist()) for i in range(400)]
    rows += [(400 + i, [0.1] * 12) for i in range(60)]  # ties
    rows += [(500, None), (501, [None] * 12), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (None, [0.2] * 12), (510, [0.0] * 12), (520, [0.3] * 5), (600, [0.1] * 5), (30, [9.0] * 12), (700, []), (710, [])]
    rows += [(800, [3e12] * 12), (801, [-3e12] * 12)]
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], "vec_id long, embedding array<float>, block int, v string").repartition(5)
    got = topk_search.top_k_search(df, F.col("vec_id") % 10 == 0, 10, block_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(x) for x in got.collect()) == brute_topk(rows, 10, 10)


@pytest.mark.parametrize("n", [2, 6, 11, 40, 64, 65])
def test_topk_of_a_block_read_to_its_end(n):
    rows = np.floor(1024 * np.random.default_rng(n).normal(0, 0.2, (n, 12)))
    lists = topk_search.SortedLists(np.arange(n), rows)
    answers = lists.top_k(np.arange(n), rows, 10)
    for i in range(n):
        scores = rows @ rows[i]
        ids, found = answers[i]
        want = sorted((-s, j) for j, s in enumerate(scores.tolist()) if j != i)[:10]
        assert [(-s, j) for s, j in zip(found.tolist(), ids.tolist(), strict=True)] == want


def test_topk_of_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    two = topk_search.top_k_search(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], kind), F.col("vec_id") == 0)
    assert [tuple(x) for x in two.collect()] == [(0, 1, 1, -1024 * 1024)]
    assert topk_search.top_k_search(spark.createDataFrame([], kind), F.col("vec_id") == 0).count() == 0


def fill(budget, children):
    """children: (name, capacity, weight). Shares by bisection on the level."""
    low, high = 0.0, 1e12
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(c, middle * w) for _, c, w in children) < budget else (low, middle)
    return {n: min(c, high * w) for n, c, w in children}


def test_mixing_against_brute_force(spark, tricky):
    docs, rows = tricky
    mix = mixing.Mix(lang={"en": 5.0, "de": 1.0}, source={"src0": 0.0, "src1": 3.0}, budget_share=0.9, max_epochs=3)
    placed = [tuple(x) for x in mixing.placed(docs).select("domain", "lang", "source", "doc_id", "n_tokens").collect()]
    tokens = {}
    for d, lang, s, _, n in placed:
        tokens[d, lang, s] = tokens.get((d, lang, s), 0) + n
    weight = lambda level, name: getattr(mix, level).get(name, 1.0)
    cap = lambda keep: sum(3 * n for k, n in tokens.items() if keep(k))
    domains = fill(sum(tokens.values()) * 0.9, [(d, cap(lambda k, d=d: k[0] == d), 1.0) for d in {k[0] for k in tokens}])
    want = {}
    for d, budget in domains.items():
        langs = fill(budget, [(x, cap(lambda k, d=d, x=x: k[:2] == (d, x)), weight("lang", x)) for x in {k[1] for k in tokens if k[0] == d}])
        for x, inner in langs.items():
            leaves = fill(inner, [(k[2], 3 * n, weight("source", k[2])) for k, n in tokens.items() if k[:2] == (d, x)])
            want |= {(d, x, s): share for s, share in leaves.items()}
    got = mixing.mix_sources(docs, mix).collect()
    taken = {}
    for x in got:
        taken[x.domain, x.lang, x.source] = taken.get((x.domain, x.lang, x.source), 0) + x.tokens_taken
    weighted = {k: v for k, v in want.items() if k[2] != "src0"}
    for leaf, share in weighted.items():
        if tokens[leaf]:
            # documents of one id share a place, so a cut among them may take a document more
            assert share - 1.01 <= taken.get(leaf, 0) <= share + 100
    assert not any(k[2] == "src0" for k in taken)
    for leaf in taken:
        counts = {}
        for x in got:
            if (x.domain, x.lang, x.source) == leaf and x.tokens_taken == x.n_tokens:
                counts[x.doc_id] = counts.get(x.doc_id, 0) + 1
        assert max(counts.values(), default=0) <= 3 * 2
    mixed = mixing.mixed_documents(docs, mix)
    assert mixed.columns == docs.columns and mixed.count() == len(got)
    assert mixing.mix_sources(docs, mix).exceptAll(mixing.mix_sources(docs.repartition(7), mix)).isEmpty()


def test_mixing_nothing(empty):
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def small_corpus():
    rng = random.Random(9)
    rows = [(i, prose(rng, "en" if i % 3 else "de", 60), "en" if i % 3 else "de", f"src{i % 4}", None) for i in range(90)]
    rows += [(200 + i, rows[i][1] + " ", rows[i][2], "src9", None) for i in range(20)]  # exact copies but for white space
    rows += [(300 + i, rows[i][1] + " end", rows[i][2], "src9", None) for i in range(10)]  # near copies
    rows += [(400, None, "en", "src1", None), (401, "12 34 !!", "en", "src1", None), (402, "", None, None, 0)]
    return rows


def test_pipeline_stage_by_stage(spark, tmp_path):
    rows = small_corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), [x.split()[0] for x in DOCS.split(", ")]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == columns
    assert {x.doc_id for x in seen["language_id"].collect()} == {r[0] for r in rows if r[0] < 400}
    best = {}
    for x in seen["language_id"].collect():
        key = "".join(x.text.split())
        best[key] = min(best.get(key, (0, 10**9)), (-len(x.text), x.doc_id))
    assert {x.doc_id for x in seen["exact_dedup"].collect()} == {b[1] for b in best.values()}
    fps = {x.doc_id: simhash.fingerprint(x.text) for x in seen["exact_dedup"].collect()}
    ids = sorted(fps)
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    assert {x.doc_id for x in seen["near_dedup"].collect()} == set(label.values())
    near = seen["near_dedup"]
    want = sorted(x.doc_id for x in mixing.mix_sources(near).collect())
    assert sorted(x.doc_id for x in seen["mixing"].collect()) == want
    own = bpe.Bpe(bpe.default_path())
    encoded = lambda x: (x.doc_id, bytes(own.encode_batch([x.text], {})[0]))
    assert sorted((x.doc_id, bytes(x.ids)) for x in seen["bpe"].collect()) == sorted(map(encoded, seen["mixing"].collect()))
    count = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    taken = sorted((x.doc_id, x.tokens_taken) for x in mixing.mix_sources(near).collect())
    assert sorted((x.doc_id, count(x.text)) for x in seen["mixing"].collect()) == taken
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(x.doc_id for x in total.collect()) == want
    assert before.count() == len(want) and exact_dedup.exact_dedup(near).where("NOT kept").count() == 0
    assert language_id.identify(near, language_id.train(near)).count() == near.count()


def test_pipeline_of_tricky_rows(spark, tricky, tmp_path):
    """Repeated rows, a long text, nulls and clashing columns: one row a group stays, and columns pass through."""
    docs, rows = tricky
    docs.unionByName(docs.where("doc_id = 60")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "bpe" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "exact_dedup":
            texts = ["".join(re.split(r"[\x20\x09-\x0D]+", x.text)) for x in docs.collect()]
            assert len(texts) == len(set(texts)) and max(map(len, texts)) > 200_000
        if name == "near_dedup":
            label = [simhash.fingerprint(x.text) for x in docs.collect()]
            assert all((a ^ b).bit_count() > 3 for i, a in enumerate(label) for b in label[:i])
    assert docs.count() > 0


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
