"""Exact top-k search by inner product with no-random-access aggregation (NRA).

Rows are dealt into blocks; each goes to its block once, and every query goes to every block, in the
order rows first, queries after them, so that a task builds a block's lists and then answers the queries as they stream by.
A block keeps one list per dimension, sorted by component. For a query
every list is read from the end that adds most to its score, all lists in step; what has been
read of a row gives a lower bound of its score (unread components at their list's worst) and an
upper one (unread components at their list's frontier). Reading stops when no row outside the k best lower bounds
has an upper bound that reaches the k-th of them. Only then are the scores of those k resolved, so a block's k best are right, ties included,
and the k best of all blocks follow from a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed, read

SCALE = 1024
BLOCK_ROWS = 8192
#: Parts of the lists that are read between two tests of the bounds.
STEPS = 6
#: Queries that a block answers together.
ASKED = 128


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v (floor(1024 * x) of every component as array<bigint>); unusable vectors left out."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return vectors.where(usable & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"))


def _matrix(values: np.ndarray, dim: int) -> np.ndarray:
    values = values.reshape(-1, dim) if dim else values.reshape(0, 0)
    top = float(np.abs(values.astype(np.float64)).max(initial=0))
    if top * top * max(dim, 1) < 2**53:
        return values.astype(np.float64)  # sums of products are exact in doubles
    return values.astype(object)


class SortedLists:
    """A block of rows with one list per dimension, ascending; `place` is each component's place in its list, [dimension, row]."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(rows.T)
        order = np.argsort(self.columns, axis=1, kind="stable")
        self.values = np.take_along_axis(self.columns, order, axis=1)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.int32)[None, :], axis=1)

    def top_k(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (a row of `queries`) the k best (ids, scores) of the block, best first, ties by id; its own row is left out.

        Lists are read in slices, for all queries at once: from the top where a query's component is positive, from the
        bottom where it is negative. Bounds are sums over what is read and what isn't; a query that has stopped reads no more.
        """
        n, found = len(self.ids), [(self.ids[:0], np.empty(0))] * len(query_ids)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        partial, going = np.zeros((len(queries), n)), np.arange(len(queries))
        own = [np.flatnonzero(self.ids == x) for x in query_ids]
        from_top, at, step = n - 1 - self.place, 0, max(16, -(-n // STEPS))
        while len(going):
            to = min(n, at + step)
            new_up = self.columns * ((from_top >= at) & (from_top < to))
            new_down = self.columns * ((self.place >= at) & (self.place < to))
            partial = partial + up[going] @ new_up + down[going] @ new_down
            at, open_ = to, np.zeros(len(going), bool)
            if at < n:
                left_up, left_down = (from_top >= at).astype(np.float64), (self.place >= at).astype(np.float64)
                low = partial + (up[going] * self.values[:, 0]) @ left_up + (down[going] * self.values[:, -1]) @ left_down
                high = partial + (up[going] * self.values[:, n - at]) @ left_up + (down[going] * self.values[:, at - 1]) @ left_down
            else:  # read to the end: the bounds are the scores
                low = high = partial
            for j, query in enumerate(going.tolist()):
                most = min(k, n - len(own[query]))
                if not most:
                    continue
                low[j, own[query]] = high[j, own[query]] = -np.inf
                best = np.argpartition(low[j], n - most)[n - most :]
                least = low[j, best].min()
                if at < n:
                    outside = high[j].copy()
                    outside[best] = -np.inf
                    if outside.max() >= least:
                        open_[j] = True
                        continue
                else:
                    best = np.flatnonzero(low[j] >= least)  # with all ties at the k-th
                scores = queries[query] @ self.columns[:, best]  # of the rows that are left, resolved
                first = np.lexsort((self.ids[best], -scores))[:most]
                found[query] = self.ids[best[first]], scores[first]
            going, partial = going[open_], partial[open_]
        return found


def _plain(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For components too large for doubles: every score in exact integers, kept within 64 bits."""
    scores, left = [min(max(int(x), -(2**63)), 2**63 - 1) for x in (rows @ query if rows.shape[1] else np.zeros(len(ids)))], np.flatnonzero(ids != query_id)
    first = sorted(left.tolist(), key=lambda i: (-scores[i], ids[i]))[:k]
    return ids[first], np.array([scores[i] for i in first], np.int64)


def top_k_search(vectors: DataFrame, is_query, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's k best other rows by integer inner product, ties to the smaller vec_id.

    vectors: vec_id, embedding; other columns are ignored. is_query: a condition on vec_id.
    Returns query_id, rank (from 1), vec_id, score; fewer than k rows where there are fewer
    candidates. Null vectors and those with a null or non-finite component take no part, nor do rows
    of a null vec_id. Rows that repeat a vec_id are candidates of their own for queries of other vec_ids; those of a query share its ranks. Scores beyond 64 bits
    count as the limit. Vectors of different dimensions don't meet; those of dimension 0 all score 0. An empty table gives no rows.

    Of n rows each is sent to one block and each query to all, n / block_rows copies of it; a task holds one block, not the queries.
    """
    v = checkpointed(quantised(vectors).withColumn("dim", F.size("v")).withColumn("asks", is_query))
    blocks = max(1, -(-v.count() // block_rows))
    # the rows are written, so a number for each is the same for every task, and deals repeats of a vec_id out too
    rows = v.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(False))
    queries = v.where("asks").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = rows.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "dim", "asks").select("block", "dim", "asks", "vec_id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        block = None
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            key = np.stack([batch.column("block").to_numpy(), batch.column("dim").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(np.int64)])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            out: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                (number, dim, asks), values = key[:, a].tolist(), batch.column("v").slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                if (number, dim) != now:
                    now, held, block = (number, dim), [], None
                if not asks:
                    held.append((ids[a:b], values))
                    continue
                if not held:
                    continue
                if block is None:
                    block = _Block(np.concatenate([x for x, _ in held]), _matrix(np.concatenate([x for _, x in held]), dim), dim)
                asked = _matrix(values, dim) if dim else np.empty((b - a, 0))
                for i in range(a, b, ASKED):
                    part = ids[i : min(b, i + ASKED)]
                    for query_id, (found, scores) in zip(part.tolist(), block.top_k(part, asked[i - a : i - a + len(part)], k), strict=True):
                        out += [(query_id, int(x), int(s)) for x, s in zip(found, scores, strict=True)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Block:
    """A block of one dimension; its lists are sorted when a query first needs them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, dim: int):
        self.ids, self.rows, self.dim, self.lists = ids, rows if dim else np.empty((len(ids), 0)), dim, None
        self.top = float(np.abs(self.rows.astype(np.float64)).max(initial=0))

    def top_k(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        top = float(np.abs(queries.astype(np.float64)).max(initial=0))
        if not self.dim or self.rows.dtype == object or queries.dtype == object or self.top * top * self.dim >= 2**53:
            return [_plain(self.ids, self.rows.astype(object), i, q.astype(object), k) for i, q in zip(query_ids.tolist(), queries, strict=True)]
        if self.lists is None:
            self.lists = SortedLists(self.ids, self.rows)
        return self.lists.top_k(query_ids, queries, k)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op10_topk_search": op10_topk_search}

ORACLE_SQL = {
    "op10_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
