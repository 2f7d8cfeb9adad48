import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import components, exact_dedup, simhash, substring_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def norm(text):
    return SPACE.sub("", text or "")


def test_exact_dedup_against_brute_force(tricky, empty):
    docs, rows = tricky
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(hashlib.sha256(norm(text).encode()).hexdigest(), []).append((-len(text or ""), doc_id is None, doc_id))
    for x in got:
        group = groups[x.text_sha256]
        best = min(group, key=lambda g: (g[0], g[1], g[2] if g[2] is not None else 0))
        assert (x.keep_id, x.group_size) == (best[2], len(group))
    for digest in groups:
        assert sum(x.kept for x in got if x.text_sha256 == digest) == 1  # repeated rows too
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_keep_one_keeps_columns(tricky):
    docs, rows = tricky
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [norm(x.text) for x in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(x[1]) for x in rows})
    again = exact_dedup.keep_one(docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))))
    assert sorted(norm(x.text) for x in again.collect()) == sorted(texts)
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0


def test_keep_one_of_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a b"), (1, "other text here"), (2, "ab"), (3, "c"), (None, "d"), (None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("x")).withColumn("d", F.lit(1)).repartition(4)
    assert sorted((x.doc_id or 0, x.text) for x in exact_dedup.keep_one(docs).collect()) == [(0, "d"), (1, "a b"), (1, "other text here"), (3, "c")]
    assert sorted((x.doc_id or 0, x.text) for x in simhash.keep_one(docs).where("text <> 'ab'").collect()) == [(0, "d"), (1, "a b"), (1, "other text here"), (3, "c")]


def test_many_rounds_of_the_merge_tree(spark):
    entries = spark.range(1000).select((F.col("id") % 64).cast("int").alias("run"), (F.col("id") % 7).cast("string").cast("binary").alias("digest"), F.lit(1).alias("bytes"), F.struct(F.col("id").alias("doc_id")).alias("best"), F.lit(1).alias("size"))
    got = {bytes(x.digest).decode(): (x.best.doc_id, x.size) for x in exact_dedup.merge_tree(entries, 64).collect()}
    assert got == {str(i): (i, len(range(i, 1000, 7))) for i in range(7)}


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash_against_brute_force(tricky, empty):
    docs, rows = tricky
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(r[1]) for r in rows]
    by_id = {}
    for r, fp in zip(rows, fps, strict=True):
        by_id.setdefault(r[0], fp)
    label = brute_components(fps, 3)
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = {r[0]: least.get(c) for r, c in zip(rows, label, strict=True)}
    for x in got:
        assert int(x.fingerprint, 16) == by_id[x.doc_id]
        assert x.component_id == want[x.doc_id]
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(label)) == simhash.keep_one(docs.unionByName(docs)).count()
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("leaf", "fan"), [(256, 8), (16, 3)])
def test_links_of_clustered_fingerprints(spark, leaf, fan):
    """Clusters of close fingerprints over many leaves: every link's ends stay connected, and no others."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**64, 40, np.uint64)
    fps = {int(c) for c in centres}
    for c in centres.tolist():
        for _ in range(60):
            x = c
            for bit in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps |= set(rng.integers(0, 2**64, 800, np.uint64).tolist())
    ordered = sorted(fps)
    signed = np.array(ordered, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5), 3, leaf, fan)
    roots = {x.node: x.root for x in components.components(links).collect()}
    array = np.array(ordered, np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 3
    label = np.arange(len(array))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(array))])
        if (new == label).all():
            break
        label = new
    got = [roots.get(x, x) for x in signed]
    pairs = set(zip(label.tolist(), got, strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_of_a_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 500), (None, 3), (7, None), (301, 300), (300, 301), (301, 302)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 301: 300, 302: 300}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_substring_dedup_against_brute_force(tricky, empty):
    docs, rows = tricky
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    starts = {}
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(words) - 12):
            if doc_id is not None:
                w = tuple(words[i : i + 13])
                starts[w] = min(starts.get(w, doc_id), doc_id)
    want = {}
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - 12):
            if doc_id is not None and starts[tuple(words[i : i + 13])] < doc_id:
                gone |= set(range(i, i + 13))
        want[doc_id] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    for x in got:
        assert (x.n_words, x.n_removed, x.kept) == want[x.doc_id]
        assert sum(b - a for a, b in x.intervals) == x.n_removed
        assert all(b < c for (_, b), (c, _) in zip(x.intervals, x.intervals[1:], strict=False))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_small_chunks_give_the_same(tricky):
    docs, _ = tricky
    want = {(x.doc_id, x.kept) for x in substring_dedup.remove_repeats(docs).collect()}
    found = substring_dedup.remove_repeats(docs.repartition(2), chunk=90, bucket_bytes=4000)
    assert {(x.doc_id, x.kept) for x in found.collect()} == want


def test_each_key_has_a_partition_of_its_own(spark):
    for parts in (8, 57, 400):
        keys = substring_dedup.partition_keys(spark, parts)
        rows = spark.createDataFrame([(int(x),) for x in keys], "at long").repartition(parts, "at")
        assert rows.groupBy(F.spark_partition_id()).count().count() == parts


def test_word_hashes_over_slices(monkeypatch):
    data = np.frombuffer(b"one two  three\tone " * 50, np.uint8)
    starts, ends = substring_dedup.word_bounds(data)
    whole = substring_dedup.word_hashes(data, starts, ends)
    monkeypatch.setattr(substring_dedup, "_SLICE", 20)
    assert (substring_dedup.word_hashes(data, starts, ends) == whole).all()
    assert len(set(whole.tolist())) == 3
