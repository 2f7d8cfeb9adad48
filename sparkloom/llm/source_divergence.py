"""Audit of how far the sources of a language differ in their words: dense tiles of counts, group by term.

Batches count terms in Python and send one row for (lang, source, term); Spark sums these and keeps the
terms that enough documents of a language hold. The kept terms of a language are dealt into blocks by
hash. A block with all groups of its language is one dense numpy int64 matrix, group by term, of
bounded size: shares and the divergences of all pairs of groups come from it by broadcasting, a band of rows at a
time. Each tile gives a partial pair matrix, which Spark sums, and for each group the heap of its
strongest terms, which Spark merges.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed, read

#: A term is kept in a language if at least so many of its documents hold it.
LEAST_DOCS = 10
#: Strongest terms of a group that are returned.
MOST_TERMS = 10
#: Shares are counted in parts of this.
SCALE = 1_000_000_000
#: Cells of a tile (groups times terms), and of the band of pairs that is held at a time.
TILE, BAND = 1 << 16, 1 << 20
#: Entries that a task counts before it sends them on.
HELD = 1 << 19
#: Lower-cases A-Z and turns all other ASCII characters into spaces.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, lower-cased, and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n occurrences, d documents) of every HELD entries or, at its end, of the task."""
    counted: dict[tuple[str, str], Counter] = defaultdict(Counter)
    holding: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counted.items():
            words, n = list(found), list(found.values())
            d = [holding[lang, source][x] for x in words]
            for at in range(0, len(words), 1 << 16):
                part = slice(at, at + (1 << 16))
                texts = pa.array(words[part], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts), pa.string()), pa.array([source] * len(texts), pa.string()), texts, pa.array(n[part], pa.int64()), pa.array(d[part], pa.int64())], names=["lang", "source", "term", "n", "d"])
        counted.clear()
        holding.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(x).to_pylist() for x in ("lang", "source")), batch.column("text"), strict=True):
            words = terms_of(text.as_py())
            found, docs = counted[lang, source], holding[lang, source]
            held -= len(found)
            found.update(words)
            docs.update(set(words))
            held += len(found)
            if held >= HELD:
                yield from flush()
                held = 0
    yield from flush()


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (N + 2 V)) for rows of counts, by three digits of 1000: exact while N + 2 V < 9.2e15."""
    size = (totals + 2 * terms).astype(np.int64)[:, None]
    if size.max(initial=0) >= 9_200_000_000_000_000:
        raise ValueError("more than 9.2e15 occurrences of terms in a group")
    rest, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // size
        rest = rest % size
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); below 2^63 as shares are at most SCALE + 1."""
    return (p - q) ** 2 // (p + q)


_PARTS = "lang string, source string, part string, item string, value long"


def _tile(most_terms: int):
    """The function of one tile: its groups' kept counts, and all groups of the language."""

    def run(_: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang, terms_kept = groups["lang"][0].as_py(), groups["terms"][0].as_py()
        names, order = np.unique(np.array(groups["source"].to_pylist(), object), return_index=True)
        totals = groups["total"].to_numpy()[order]
        words = counts["term"].to_pylist()
        at = {term: i for i, term in enumerate(dict.fromkeys(words))}
        dense = np.zeros((len(names), len(at)), np.int64)
        dense[np.searchsorted(names, np.array(counts["source"].to_pylist(), object)), [at[x] for x in words]] = counts["n"].to_numpy()
        pairs = np.zeros((len(names), len(names)), np.int64)
        heaps: list[tuple[str, str, int]] = []
        if at:
            p = shares(dense, totals, terms_kept)
            band = max(1, BAND // p.size)
            for i in range(0, len(names), band):
                pairs[i : i + band] = divergence(p[i : i + band, None, :], p[None, :, :]).sum(axis=2)
            q = shares(dense.sum(axis=0)[None, :], totals.sum()[None], terms_kept)
            strong, listed = divergence(p, q), list(at)
            for g, name in enumerate(names):
                of = np.flatnonzero((dense[g] > 0) & (p[g] > q[0]))
                best = heapq.nsmallest(most_terms, zip((-strong[g, of]).tolist(), [listed[x].encode() for x in of], strict=True))
                heaps += [(name, term.decode(), -value) for value, term in best]
        one, other = np.nonzero(~np.eye(len(names), dtype=bool))
        source = [*names[one], *[x[0] for x in heaps]]
        item = [*names[other], *[x[1] for x in heaps]]
        value = [*pairs[one, other].tolist(), *[x[2] for x in heaps]]
        part = ["pair"] * len(one) + ["term"] * len(heaps)
        return pa.table({"lang": pa.array([lang] * len(part), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS, tile: int = TILE) -> DataFrame:
    """How far each group (lang, source) lies from each other source of its language, and by which terms from the whole language.

    docs: text, lang, source; other columns are ignored, nulls are ''. Terms are runs of ASCII letters, lower-cased, and
    characters beyond ASCII. A language keeps the terms that at least least_docs of its rows hold, V of them. A group's count of a kept
    term out of N gives the share p = 1 + floor(SCALE * (count + 2) / (N + 2 V)); shares differ by floor((p - q)^2 / (p + q)).
    Returns lang, source, part, item, value, rank: part 'pair' has each other source of the language (value: the
    sum over kept terms, 0 if there are none), part 'term' the most_terms strongest terms that the group has and uses more than
    its language. Ranks go by value descending, then item ascending in UTF-8. A row that repeats counts again; long texts
    are counted whole, empty ones make their group known and add no term; an empty table gives no rows.

    A tile has all groups of a language and tile / groups of its terms. All pairs of a language's groups are the
    result itself, so groups are as many as allow that.
    """
    texts = docs.select(*[F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("lang", "source", "text")])
    counts = texts.mapInArrow(_count_terms, "lang string, source string, term string, n long, d long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = checkpointed(counts.withColumn("d", F.sum("d").over(W.partitionBy("lang", "term"))).where(F.col("d") >= least_docs).drop("d"))
    # a row per group: all of them, with what they have of kept terms
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("terms"))
    groups = texts.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "terms"])
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n_groups"), F.max("terms").alias("terms"))
    # the number of blocks of a language, so that a tile stays at `tile` cells
    blocks = checkpointed(sizes.select("lang", F.greatest(F.lit(1), F.ceil(F.col("n_groups") * F.col("terms") / tile)).alias("blocks")))
    dealt = kept.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks")).drop("blocks")
    lists = groups.join(blocks, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    parts = dealt.groupBy("lang", "block").cogroup(lists.groupBy("lang", "block")).applyInArrow(_tile(most_terms), _PARTS)
    # one tile has a pair or a term; partial matrices add up, heaps merge
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    of = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = summed.withColumn("rank", F.row_number().over(of))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= most_terms))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": op11_source_divergence}

ORACLE_SQL = {
    "op11_source_divergence": rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, r, unnest(w) AS term FROM (SELECT *, row_number() OVER () AS r FROM d)),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
gc AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gn AS (SELECT lang, source, sum(n) AS total FROM gc GROUP BY lang, source),
p AS (SELECT gc.lang, gc.source, gc.term, gc.n, 1 + ({SCALE}::HUGEINT * (gc.n + 2)) // CAST(gn.total + 2 * v.v AS HUGEINT) AS p
      FROM gc JOIN gn ON gc.lang = gn.lang AND gc.source = gn.source JOIN v ON v.lang = gc.lang),
lt AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM gc GROUP BY lang, term),
ln AS (SELECT lang, sum(n)::HUGEINT AS total FROM lt GROUP BY lang),
q AS (SELECT lt.lang, lt.term, 1 + ({SCALE}::HUGEINT * (lt.n + 2)) // CAST(ln.total + 2 * v.v AS HUGEINT) AS q FROM lt JOIN ln ON lt.lang = ln.lang JOIN v ON v.lang = lt.lang),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
allpairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""
}
