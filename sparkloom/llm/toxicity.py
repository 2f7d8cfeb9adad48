"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Every word of a text takes part: words are hashed to 2^BITS terms, whose document frequencies are counted over all
documents. A term weighs (1 + ln tf) * idf * (BASE + relevance), where relevance is 0 for most terms and rises to 1
for those that go with label 1 beyond chance among a bounded draw of labelled documents: without it rare words, which say nothing of
toxicity, would decide who is near. The index holds up to EXAMPLES labelled documents with all their terms: each term's
examples in blocks of BLOCK with the largest weight of every block, so a query bounds its cosine with any example of a block,
takes the blocks in the order of their bounds and stops when no block can hold a nearer example: the
nearest are exact. Terms of a sixteenth of the examples or more are kept as whole rows instead: what they add to all cosines is one product for many
queries, known before any bound. They vote with weights that fall with distance, beside a prior for the base
rate; votes become probabilities by isotonic regression over the examples, each left out in turn.

Terms' weights, the index and the calibration are bounded by BITS and EXAMPLES, whatever the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed, read

#: Labelled documents, in expectation, that relevance is learned on; a bound on the fit.
FIT_DOCS = 12_000
EXAMPLES = 4096
#: Words are hashed to 2^BITS terms; counts reach the driver in slabs of 2^SLAB_BITS terms.
BITS, SLAB_BITS = 20, 12
BLOCK = 512
#: A term is kept as a whole row if one in so many examples has it; queries that meet these rows in one product.
DENSE, TOGETHER = 16, 64
NEAREST = 16
#: Weight of the base rate among the votes.
PRIOR = 1.0
#: A term's part in the weights without relevance, and the deviation from the base rate, in standard deviations, that relevance starts at.
BASE, LEAST_Z = 0.02, 3.0
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a text's words, ascending, and their counts."""
    words = Counter(_WORD.findall((text or "").lower()))
    found = np.fromiter((crc32(x.encode("utf-8", "surrogatepass")) for x in words), np.int64, len(words)) & ((1 << BITS) - 1)
    distinct, at = np.unique(found, return_inverse=True)
    return distinct, np.bincount(at, np.fromiter(words.values(), float, len(words)), len(distinct))


def _rows(n: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    held = np.flatnonzero(n)
    columns = {"term": held, "n": n[held], **{name: x[held] for name, x in more.items()}}
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, n): in how many documents a term is; each task counts in one table of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                n[np.unique(np.fromiter((crc32(x.encode("utf-8", "surrogatepass")) for x in words), np.int64, len(words)) & ((1 << BITS) - 1))] += 1
        yield _rows(n)

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame) -> np.ndarray:
    """The counts (term, n) as one array over all terms: a few packed rows reach the driver, not one for every term."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        slab = np.zeros(1 << SLAB_BITS, np.int64)
        slab[table["term"].to_numpy() & ((1 << SLAB_BITS) - 1)] = table["n"].to_numpy()
        return pa.table({"slab": [key[0].as_py()], "n": [slab.tobytes()]})

    out = np.zeros((1 << (BITS - SLAB_BITS), 1 << SLAB_BITS), np.int64)
    for row in counts.groupBy(F.shiftright("term", SLAB_BITS).alias("slab")).applyInArrow(pack, "slab long, n binary").toLocalIterator():
        out[row["slab"]] = np.frombuffer(row["n"], np.int64)
    return out.ravel()


def relevance(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Each term's relevance, 0 to 1, and the base rate. labelled: text, toxic."""
    totals = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    rate, out = totals["toxic"] / totals["n"] if totals["n"] else 0.0, np.zeros(1 << BITS)
    if not 0 < rate < 1:
        return out, rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                found = terms(text.as_py())[0]
                n[found] += 1
                toxic[found] += label
        yield _rows(n, toxic=toxic)

    counts = labelled.select("text", "toxic").mapInArrow(run, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    z = (F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    beyond = counts.select("term", z.alias("z")).where(F.col("z") > LEAST_Z).toPandas()
    if len(beyond):
        out[beyond["term"].to_numpy()] = (beyond["z"].to_numpy() - LEAST_Z) / (beyond["z"].max() - LEAST_Z)
    return out, rate


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    sizes = ends - starts
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) + (starts - np.cumsum(sizes) + sizes)[of], of


@dataclass
class BlockMaxIndex:
    """Examples by term. Entries are pairs of a term and a block that has it: term t's are first[t] to first[t + 1]; an entry
    has the largest weight in its block and the range of its postings (example, weight)."""

    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray  # of every term: idf * (BASE + relevance)
    first: np.ndarray
    block: np.ndarray
    largest: np.ndarray
    bounds: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    row: np.ndarray  # of every term: its row in `dense`, or -1
    dense: np.ndarray

    @classmethod
    def build(cls, examples: list[tuple[int, int, np.ndarray, np.ndarray]], weights: np.ndarray) -> BlockMaxIndex:
        """examples: (doc_id, label, terms, tf). Those with the same leading term come together, so that blocks differ."""
        lead = []  # of each example its strongest term and that one's weight
        parts = []
        for _, _, t, tf in examples:
            parts.append(unit((1 + np.log(tf)) * weights[t]))
            lead.append((int(t[np.argmax(parts[-1])]) if len(t) else -1, -parts[-1].max(initial=0.0)))
        by = sorted(range(len(examples)), key=lambda i: (*lead[i], examples[i][0]))
        of = np.repeat(np.arange(len(by), dtype=np.int32), [len(examples[i][2]) for i in by])
        term = np.concatenate([examples[i][2].astype(np.int32) for i in by]) if by else np.empty(0, np.int32)
        weight = np.concatenate([parts[i] for i in by]) if by else np.empty(0)
        ids, labels = np.array([examples[i][0] for i in by], np.int64), np.array([examples[i][1] for i in by], float)
        del parts
        order = np.argsort(term, kind="stable")  # examples of a term stay in order
        term, of, weight = term[order], of[order], weight[order]
        held = np.bincount(term, minlength=1 << BITS)
        row = np.full(1 << BITS, -1, np.int32)
        often = np.flatnonzero(held * DENSE >= max(len(by), 1))
        row[often] = np.arange(len(often))
        dense, whole = np.zeros((len(often), len(by))), row[term] >= 0
        dense[row[term[whole]], of[whole]] = weight[whole]
        term, of, weight = term[~whole], of[~whole], weight[~whole]
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (of[1:] // BLOCK != of[:-1] // BLOCK)]) if len(term) else np.empty(0, np.int64)
        largest = np.maximum.reduceat(weight, starts) if len(starts) else np.empty(0)
        first = np.searchsorted(term[starts], np.arange((1 << BITS) + 1)).astype(np.int32)
        bounds = np.append(starts, len(term)).astype(np.int32)
        return cls(ids, labels, weights, first, of[starts] // BLOCK, largest, bounds, of, weight, row, dense)

    def queries(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each query (terms, tf) the terms that aren't whole rows, their weights, and what the others add to the cosines with all examples."""
        for at in range(0, len(vectors), TOGETHER):
            asked = [(found, unit((1 + np.log(tf)) * self.weights[found])) for found, tf in vectors[at : at + TOGETHER]]
            matrix = np.zeros((len(asked), len(self.dense)))
            for i, (found, weight) in enumerate(asked):
                rows = self.row[found]
                matrix[i, rows[rows >= 0]] = weight[rows >= 0]
            for (found, weight), known in zip(asked, matrix @ self.dense, strict=True):
                rare = self.row[found] < 0
                yield found[rare], weight[rare], known

    def nearest(self, found: np.ndarray, weight: np.ndarray, known: np.ndarray, k: int = NEAREST, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples to a query as queries() gives it, ties to the smaller doc_id; `but` is left out."""
        if not len(self.ids):
            return np.empty(0, np.int64), np.empty(0)
        entry, of = _spread(self.first[found].astype(np.int64), self.first[found + 1].astype(np.int64))
        block, q = self.block[entry], weight[of]
        starts = np.arange(0, len(self.ids), BLOCK)
        bounds = np.bincount(block, q * self.largest[entry], len(starts)) + np.maximum.reduceat(known, starts)
        by_bound = np.argsort(-bounds, kind="stable")
        rank = np.empty(len(by_bound), np.int64)
        rank[by_bound] = np.arange(len(by_bound))
        turn = rank[block]
        order = np.argsort(turn, kind="stable")
        entry, q, turn = entry[order], q[order], turn[order]
        places, cosines, least = np.empty(0, np.int64), np.empty(0), 0.0
        at, take = 0, 4
        while at < len(by_bound):
            top = bounds[by_bound[at]]
            if top <= 0 or (len(places) >= k and top < least - 1e-9):
                break
            a, b = np.searchsorted(turn, (at, at + take))
            posting, of = _spread(self.bounds[entry[a:b]].astype(np.int64), self.bounds[entry[a:b] + 1].astype(np.int64))
            scores = known + np.bincount(self.example[posting], q[a:b][of] * self.weight[posting], len(self.ids))
            now = starts[by_bound[at : at + take]]
            members = _spread(now, np.minimum(now + BLOCK, len(self.ids)))[0]
            near = members[scores[members] > max(0.0, least - 1e-9)]
            if but is not None:
                near = near[self.ids[near] != but]
            places, cosines = np.concatenate([places, near]), np.concatenate([cosines, scores[near]])
            if len(places) > k:
                first = np.lexsort((self.ids[places], -np.round(cosines, 9)))[:k]
                places, cosines = places[first], cosines[first]
            if len(places) >= k:
                least = cosines.min()
            at, take = at + take, 2 * take
        order = np.lexsort((self.ids[places], -np.round(cosines, 9)))[:k]
        return places[order], np.minimum(1.0, cosines[order])

    def vote(self, places: np.ndarray, cosines: np.ndarray, rate: float) -> float:
        weights = cosines / (1.1 - cosines)
        return float((weights @ self.labels[places] + PRIOR * rate) / (weights.sum() + PRIOR))


def unit(weights: np.ndarray) -> np.ndarray:
    return weights / max(1e-12, float(np.sqrt(weights @ weights)))


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (vote, probability) of the non-decreasing fit, by pooling adjacent violators."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # labels' sum, size, votes' sum
    for vote, label in zip(votes[order].tolist(), labels[order].tolist(), strict=True):
        pools.append([label, 1.0, vote])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    at = np.array(pools).reshape(-1, 3)
    return at[:, 2] / at[:, 1], (at[:, 0] + 0.5) / (at[:, 1] + 1.0)


@dataclass
class Model:
    index: BlockMaxIndex
    rate: float
    bare_rate: float
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, float, int]]]]:
        """For each text the probability of label 1 and the examples it rests on: (doc_id, cosine, label)."""
        vectors = [terms(x) for x in texts]
        for (found, _), query in zip(vectors, self.index.queries(vectors), strict=True):
            if not len(found) or not len(self.index.ids):
                yield self.bare_rate, []
                continue
            places, cosines = self.index.nearest(*query)
            vote = self.index.vote(places, cosines, self.rate)
            score = float(np.interp(vote, *self.knots)) if len(self.knots[0]) else vote
            yield score, [(int(i), float(c), int(y)) for i, c, y in zip(self.index.ids[places], cosines, self.index.labels[places], strict=True)]


def _drawn(id_column: str, share: float):
    return F.pmod(F.xxhash64(id_column, F.lit(3)), F.lit(1_000_000)) < share * 1_000_000


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, most_examples: int = EXAMPLES) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, toxic): see score_toxicity()."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_docs / max(1, usable.count()))
    drawn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(_drawn("doc_id", share)).join(usable.where(_drawn("doc_id", share)), "doc_id")
    labelled = checkpointed(drawn.groupBy(F.xxhash64("text").alias("of")).agg(F.min_by(F.struct("doc_id", "text", "toxic"), "doc_id").alias("x")).select("x.*"))  # one of each text
    weights, rate = relevance(labelled)
    weights = (np.log((docs.count() + 1) / (_table(document_frequencies(docs)) + 1)) + 1) * (BASE + weights)

    wordless = ~F.col("text").rlike(r"\p{L}")
    bare = labelled.where(wordless).agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    bare_rate = (bare["toxic"] + 0.5 * rate) / (bare["n"] + 0.5) if rate else 0.0

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(x.as_py()) for x in batch.column("text")]
            packed = [pa.array([x[part].astype(np.int32).tobytes() for x in found], pa.binary()) for part in (0, 1)]
            columns = [batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), *packed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "terms", "tf"])

    first = labelled.where(~wordless).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(most_examples)
    table = checkpointed(first.mapInArrow(vectors, "doc_id long, toxic int, terms binary, tf binary"))
    unpacked = lambda t, tf: (np.frombuffer(t, np.int32).astype(np.int64), np.frombuffer(tf, np.int32).astype(float))
    examples = [(x["doc_id"], x["toxic"], *unpacked(x["terms"], x["tf"])) for x in table.collect()]
    index = BlockMaxIndex.build(examples, weights)
    del examples
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(index)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("doc_id").to_pylist(), [unpacked(t, tf) for t, tf in zip(*(batch.column(x).to_pylist() for x in ("terms", "tf")), strict=True)]
            votes = [shared.value.vote(*shared.value.nearest(*query, but=i), rate) for i, query in zip(ids, shared.value.queries(vectors), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column("toxic")], names=["vote", "toxic"])

    tried = table.repartition(max(1, context.defaultParallelism), "doc_id").mapInArrow(left_out, "vote double, toxic int").toPandas()
    shared.unpersist()
    return Model(index, rate, bare_rate, isotonic(tried["vote"].to_numpy(float), tried["toxic"].to_numpy(float)))


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, most_examples: int = EXAMPLES) -> DataFrame:
    """Scores every whole text of docs (doc_id, text) from labels (doc_id, toxic 0 or 1); other columns are ignored.

    Returns one row per row of docs: doc_id, score (0 to 1), predicted (1 if score >= 0.5), evidence
    (nearest examples: doc_id, cosine, toxic; nearest first).
    Null and empty texts, and those without a letter, get the rate of such texts among the labelled
    and no evidence; without labels the score is 0. Labels that are null or have no document don't count;
    of several labels of a document the largest counts. An empty table of docs gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_docs, most_examples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            found = [y for at in range(0, batch.num_rows, TOGETHER) for y in model.value.score([x.as_py() for x in batch.column("text").slice(at, TOGETHER)])]
            evidence = [[{"doc_id": i, "cosine": c, "toxic": y} for i, c, y in near] for _, near in found]
            scores = np.array([x for x, _ in found], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(evidence, kind)], names=["doc_id", "score", "predicted", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where(~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
