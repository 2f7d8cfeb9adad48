"""Phrase mining and the audit of sources against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm import phrase_mining, source_divergence

from .conftest import CLASHES, DOCS, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_clashes(spark, rows, parts=3):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    for name in [*CLASHES, "chunk", "code", "codes", "n", "term", "total", "terms", "block", "part", "item", "value", "phrase", "place", "rank"]:
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    return docs


def phrases_by_hand(rows, least, most_words, most):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    at = lang or "und", tuple(words[i : i + k])
                    counts[at] = counts.get(at, 0) + 1
    frequent = {x: n for x, n in counts.items() if len(x[1]) > 1 and n >= least}
    longest = {}
    for (lang, words), n in frequent.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    longest[lang, words[i:j]] = max(n, longest.get((lang, words[i:j]), 0))
    rows = []
    for (lang, words), a in frequent.items():
        if 100 * longest.get((lang, words), -1) >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words)))
        rows.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score))
    out = []
    for lang in {x[0] for x in rows}:
        best = sorted((x for x in rows if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        out += [(lang, rank, *x[1:]) for rank, x in enumerate(best, 1)]
    return sorted(out)


def chatter(seed, n):
    """Texts of few words, so that phrases overlap, nest, tie and repeat within themselves."""
    rng = random.Random(seed)
    words = ["a", "A", "b", "bb", "the", "of", "é", "x'", "a\x1cb", " nbsp"]
    return [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ", ", "\n", "  ", "\x0b"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"]), "s", None) for i in range(n)]


@pytest.mark.parametrize(("most_words", "chunk", "most"), [(4, 50, 2000), (4, 1_000_000, 7), (3, 300, 2000), (6, 200, 2000)])
def test_phrases_against_brute_force(spark, most_words, chunk, most):
    rows = chatter(most_words, 150) + [(200, "a a a a a a a a " * 40, "en", None, None), (201, "a a a a a a a a " * 40, "en", None, None), (None, None, None, None, None), (202, "", "fr", None, None), (203, " .,;\n", "fr", None, None)]
    got = phrase_mining.mine_phrases(with_clashes(spark, rows), 12, most_words, most, chunk).collect()
    assert sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in got) == phrases_by_hand(rows, 12, most_words, most)
    assert len(got) > 10


def test_phrases_of_tricky_rows_and_joins_by_shuffle(spark, tricky, empty, monkeypatch):
    docs, rows = tricky
    monkeypatch.setattr(phrase_mining, "BROADCAST_ROWS", -1)
    got = phrase_mining.mine_phrases(docs, 20).collect()
    assert sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in got) == phrases_by_hand(rows, 20, 4, 2000)
    assert phrase_mining.mine_phrases(empty).count() == 0
    assert phrase_mining.mine_phrases(docs.where("doc_id > 30 AND doc_id < 40")).count() == 0


def test_scores_beyond_64_bits(spark):
    """a of 10^13 times the scale passes 2^63."""
    from pyspark.sql import functions as F

    cut = F.expr(f"cast(n AS decimal(20,0)) * {phrase_mining.SCALE} div (l + r)")
    rows = spark.createDataFrame([(10**13 + 7, 10**13 + 9, 3 * 10**13)], "n long, l long, r long")
    assert rows.select(cut.alias("x")).first().x == phrase_mining.SCALE * (10**13 + 7) // (4 * 10**13 + 9)


def audit_by_hand(rows, least, most):
    count, holding, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count.update((lang, source, x) for x in words)
        holding.update((lang, x) for x in set(words))
    out = []
    for lang in {x[0] for x in groups}:
        kept = [x for of, x in holding if of == lang and holding[of, x] >= least]
        sources = [s for of, s in groups if of == lang]

        def part(n, total, v=len(kept)):
            return 1 + 10**9 * (n + 2) // (total + 2 * v)

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        of = {s: {x: count[lang, s, x] for x in kept} for s in sources}
        p = {s: {x: part(n, sum(of[s].values())) for x, n in of[s].items()} for s in sources}
        whole = {x: sum(of[s][x] for s in sources) for x in kept}
        q = {x: part(n, sum(whole.values())) for x, n in whole.items()}
        for s in sources:
            found = sorted(((-sum(apart(p[s][x], p[o][x]) for x in kept), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(found, 1)]
            found = sorted((-apart(p[s][x], q[x]), x.encode()) for x in kept if of[s][x] and p[s][x] > q[x])[:most]
            out += [(lang, s, "term", x.decode(), -v, i) for i, (v, x) in enumerate(found, 1)]
    return sorted(out)


def mixed(seed, n):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice(["en", "de"]), rng.randint(0, 60)) + rng.choice(["", " ÀÉ x-y 12z", " Ünï\x00cøde \x7f"]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "", None, "ß"]), None) for i in range(n)]
    return rows + [(None, None, "fr", "only", None), (900, "rare words here", "it", "a", None), (901, "", "it", "b", None)]


@pytest.mark.parametrize("tile", [1, 64, 1 << 16])
def test_audit_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(source_divergence, "BAND", 500)
    rows = mixed(4, 200)
    rows += rows[:20]  # repeated rows count again
    got = source_divergence.source_divergence(with_clashes(spark, rows), 10, 10, tile).collect()
    assert sorted((x.lang, x.source, x.part, x.item, x.value, x["rank"]) for x in got) == audit_by_hand(rows, 10, 10)
    assert {x.value for x in got if x.lang == "it"} == {0}


def test_audit_of_tricky_rows(spark, tricky, empty, monkeypatch):
    monkeypatch.setattr(source_divergence, "HELD", 3)
    docs, rows = tricky
    got = source_divergence.source_divergence(docs, 3).collect()
    assert sorted((x.lang, x.source, x.part, x.item, x.value, x["rank"]) for x in got) == audit_by_hand(rows, 3, 10)
    assert source_divergence.source_divergence(empty).count() == 0


def test_shares_are_exact():
    """Counts whose products with the scale pass 64 bits."""
    rng = random.Random(1)
    for _ in range(200):
        counts = [rng.randrange(10 ** rng.randint(1, 14)) for _ in range(5)]
        total = sum(counts) + rng.randrange(10**15)
        got = source_divergence.shares(np.array([counts], np.int64), np.array([total]), 5)[0].tolist()
        assert got == [1 + 10**9 * (x + 2) // (total + 10) for x in counts]
    with pytest.raises(ValueError):
        source_divergence.shares(np.array([[1]], np.int64), np.array([10**16]), 5)
