"""Context assembly under token budgets: rendered tables, prefixes, next-fit batches, votes, points and folds."""

from __future__ import annotations

import csv
import io
import random
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import graph
from sparkloom.session import checkpointed, table


def budget_prefix(rows: DataFrame, key: str, order: str, budget: int, header_tokens: int = 0) -> DataFrame:
    """Per key the rows, in order, whose tokens together with the header's fit the budget; it stops at the first that doesn't."""
    used = F.sum("tokens").over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)) + header_tokens
    return rows.withColumn("used", used).where(F.col("used") <= budget)


_UNBOUNDED = 1 << 62


class _Run:
    """Rows of one key in order: where batches begin if one begins at a given row. tokens: non-negative."""

    def __init__(self, tokens: np.ndarray, budget: int, header_tokens: int, most_items: int | None):
        self.n, self.budget, self.header, self.most_items = len(tokens), budget, header_tokens, most_items or _UNBOUNDED
        self.sums = np.concatenate([[0], np.cumsum(tokens)])
        first = np.arange(self.n)
        over = np.searchsorted(self.sums[1:], budget - header_tokens + self.sums[:-1], side="right")
        self.next = np.minimum(np.maximum(first + 1, np.minimum(over, first + self.most_items)), self.n).tolist()

    def close(self, items: int, used: int) -> int:
        """The row before which an open batch of so many items and tokens closes; n if none."""
        over = int(np.searchsorted(self.sums[1:], self.budget - used, side="right"))
        return 0 if items == 0 else min(over, max(0, self.most_items - items), self.n)

    def closing(self) -> list[int]:
        """Every row before which an open batch may close: at most most_items, or one more than the budget."""
        last = self.close(1, self.header)
        grows = range(last) if self.most_items < _UNBOUNDED else np.flatnonzero(np.diff(self.sums[: last + 1]) > 0).tolist()
        return sorted({0, *grows, last} - {self.n})

    def ends(self, starts: list[int]) -> dict[int, tuple[int, int]]:
        """For a batch that begins at each of `starts`: how many batches follow it, and the last one's first row. Batches that begin at different rows soon begin at the same
        ones, so few rows are visited."""
        found: dict[int, tuple[int, int]] = {}
        for at in starts:
            chain = []
            while at < self.n and at not in found:
                chain.append(at)
                at = self.next[at]
            later, last = found[at] if at < self.n else (-1, chain[-1])
            for row in reversed(chain):
                later += 1
                found[row] = later, last
        return found

    def batches(self, batch: int, items: int, used: int) -> np.ndarray:
        """The batch of each row, if one of so many items and tokens is open before the first; none is if items is 0."""
        starts = np.zeros(self.n, np.int64)
        at = self.close(items, used)
        while at < self.n:
            starts[at] = 1
            at = self.next[at]
        return np.cumsum(starts) + batch - (items == 0)


def packed(rows: DataFrame, key: str, order: str, budget: int, header_tokens: int = 0, most_items: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds `batch` to (key, order, tokens) and the columns to carry: rows of a key in order; a batch closes when the next row would exceed the items or
    the budget, and an oversized row has a batch of its own.

    Rows are dealt by ranges of (key, order), so a key's rows may lie in many partitions. A first pass tells for each partition
    how the batch that is open at its border may close and what is open at its end then; the driver follows these few
    numbers from border to border, and a second pass numbers the batches.
    """
    rows = rows.select(key, order, F.col("tokens").cast("long").alias("tokens"), *carry)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row tells its partition itself: where the result is part of a union, tasks have other numbers
    dealt = checkpointed(rows.repartitionByRange(parts, key, order).sortWithinPartitions(key, order).withColumn("_part", F.spark_partition_id()))

    def runs(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table | None, list[tuple[int, int]]]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return None, []
        data = pa.Table.from_batches(held)
        codes = data[key].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        return data, list(pairwise([0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]))

    def run(data: pa.Table, begin: int, end: int) -> _Run:
        return _Run(data["tokens"].slice(begin, end - begin).to_numpy(), budget, header_tokens, most_items)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, cuts = runs(batches)
        if data is None:
            return
        first, last = run(data, *cuts[0]), run(data, *cuts[-1])
        closing = first.closing()
        after = first.ends(closing)
        ends = [(int(first.sums[i]), i, after[i][0], first.n - after[i][1], int(header_tokens + first.sums[-1] - first.sums[after[i][1]])) for i in closing]
        later, of = last.ends([0])[0]
        found = {"part": data["_part"][0].as_py(), "first": data[key][0].as_py(), "last": data[key][-1].as_py(), "one": len(cuts) == 1, "n": first.n, "total": int(first.sums[-1])}
        found |= {"tokens": [int(first.sums[i + 1] - first.sums[i]) for i in closing], "ends": [x for end in ends for x in end], "open": [later, last.n - of, int(header_tokens + last.sums[-1] - last.sums[of])]}
        yield pa.RecordBatch.from_pylist([found], schema=pa.schema([("part", pa.int32()), ("first", data.schema.field(key).type), ("last", data.schema.field(key).type), ("one", pa.bool_()), ("n", pa.int64()), ("total", pa.int64()), *((x, pa.list_(pa.int64())) for x in ("tokens", "ends", "open"))]))

    kind = dict(rows.dtypes)[key]
    seen = dealt.select(key, "tokens", "_part").mapInArrow(borders, f"part int, first {kind}, last {kind}, one boolean, n long, total long, tokens array<long>, ends array<long>, open array<long>").collect()  # a row per partition
    entering: dict[int, tuple[int, int, int]] = {}
    open_key, state = None, (0, 0, header_tokens)
    for x in sorted(seen, key=lambda x: x["part"]):
        batch, items, used = entering[x["part"]] = state if x["first"] == open_key else (0, 0, header_tokens)
        if not x["one"]:
            state = tuple(x["open"])
        else:
            state = (batch, items + x["n"], used + x["total"])
            for at, n in enumerate(x["tokens"]):
                before, i, later, left, tokens = x["ends"][5 * at : 5 * at + 5]
                if items == 0 or used + before + n > budget or (most_items and items + i >= most_items):
                    state = (batch + (items > 0) + later, left, tokens)
                    break
        open_key = x["last"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, cuts = runs(batches)
        if data is None:
            return
        states = [entering[data["_part"][0].as_py()], *[(0, 0, header_tokens)] * (len(cuts) - 1)]
        batch = np.concatenate([run(data, *cut).batches(*state) for cut, state in zip(cuts, states, strict=True)])
        yield from data.drop_columns("_part").append_column("batch", pa.array(batch, pa.int64())).to_batches()

    return dealt.mapInArrow(number, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", batch long")


def packed_sql(name: str, rows: str, key: str, order: str, header: int, budget: int, most_items: int | None = None) -> str:
    """CTEs that pack `rows` (key, order, tokens): `name` has them with their batch. Running sums tell where the next batch begins."""
    return f"""
{name}_l AS (SELECT *, row_number() OVER w AS i, CAST(sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM ({rows}) WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
{name}_s AS (
  SELECT DISTINCT {key}, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS base, CAST(0 AS BIGINT) AS batch FROM {name}_l
  UNION ALL SELECT s.{key}, min(l.i), arg_min(l.cum - l.tokens, l.i), s.batch + 1 FROM {name}_s s JOIN {name}_l l ON l.{key} = s.{key} AND l.i > s.i AND (l.cum - s.base + {header} > {budget} OR l.i - s.i >= {most_items or _UNBOUNDED}) GROUP BY s.{key}, s.batch),
{name} AS (SELECT l.*, s.batch FROM {name}_l l ASOF JOIN {name}_s s ON l.{key} = s.{key} AND l.i >= s.i)"""


def next_fit(rows: DataFrame, key: str, order: str, budget: int, header_tokens: int = 0) -> DataFrame:
    """(key, order, tokens, batch): rows in order; a batch closes when the next row would exceed the budget, and an oversized row has a batch of its own."""
    return packed(rows, key, order, budget, header_tokens)


def render_table(rows: pd.DataFrame, columns: list[str], budget: int, count: Callable[[str], int], delimiter: str = ",", prefix: str = "") -> tuple[str, int]:
    """A CSV table with a generated id column, as many first rows as fit the budget with prefix and header; and how many they are."""

    def line(values: list) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter=delimiter, lineterminator="\n").writerow(values)
        return out.getvalue()

    text = prefix + line(["id", *columns])
    if count(text) > budget:
        raise ValueError("the budget can't hold the prefix and the header")
    taken = 0
    for number, values in enumerate(rows[columns].itertuples(index=False)):
        longer = text + line([number, *values])
        if count(longer) > budget:
            break
        text, taken = longer, number + 1
    return text, taken


def rendered(rows: DataFrame, key: str, order: str, columns: list[str], budget: int) -> DataFrame:
    """(key, rows, context): each key's table under the budget, tokens counted on the rendered text."""

    def build(group_key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        text, taken = render_table(group.sort_values(order), columns, budget, lambda x: len(x.split()))
        return pd.DataFrame({key: [group_key[0]], "rows": [taken], "context": [text]})

    # each row takes a token at least (its id): no more than `budget` rows
    # can be in a table, and each task keeps so many of a key (Spark does so up to spark.sql.optimizer.windowGroupLimitThreshold)
    place = F.row_number().over(W.partitionBy(key).orderBy(order))
    first = rows.withColumn("_place", place).where(F.col("_place") <= budget).drop("_place")
    return first.groupBy(key).applyInPandas(build, f"{key} {dict(rows.dtypes)[key]}, rows long, context string")


def batch_order(batches: DataFrame, key: str) -> DataFrame:
    """Within a batch by weight and rank, falling; equal ones keep their order."""
    return batches.withColumn("place", F.row_number().over(W.partitionBy(key, "batch").orderBy(F.col("weight").desc(), F.col("rank").desc(), "pos")).cast("long"))


def seeded_order(n: int, seed: int = 86) -> list[int]:
    """The Mersenne-Twister shuffle of 0..n-1 by which reports are dealt into batches."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def ranked_points(points: DataFrame, budget: int) -> DataFrame:
    """Points with a positive score, best first, ties in order of batch and point, as long as their tokens fit the budget."""
    order = W.partitionBy("question").orderBy(F.col("score").desc(), "batch", "point")
    ranked = points.where("score > 0").withColumn("place", F.row_number().over(order).cast("long")).withColumn("used", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return ranked.where(F.col("used") <= budget)


def majority_vote(ratings: DataFrame) -> DataFrame:
    """Per item the most frequent rating, ties to the smallest."""
    counts = ratings.groupBy("item", "rating").count()
    return counts.groupBy("item").agg(F.max_by("rating", F.struct("count", -F.col("rating"))).alias("rating"), F.max("count").alias("votes"))


def folds(reports: DataFrame, number: int) -> DataFrame:
    """Contiguous folds over rank order, sizes differing by one at most, larger ones first."""
    return reports.withColumn("fold", F.ntile(number).over(W.partitionBy("question").orderBy("place")).cast("long"))


def fold_summary(answers: DataFrame) -> DataFrame:
    """Mean score of a question's folds and their answers in order."""
    ordered = F.array_sort(F.collect_list(F.struct("fold", "answer")))
    return answers.groupBy("question").agg(F.avg("score").alias("score"), F.array_join(F.transform(ordered, lambda x: x["answer"]), "\n\n").alias("answer"))


def question_candidates(texts: DataFrame, most: int) -> DataFrame:
    """(key, place, question): distinct lines of a text without list marks, the first `most`."""
    lines = texts.select("key", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("question", F.trim(F.regexp_replace("line", r"^\s*[-*]\s*", ""))).where("question <> ''")
    first = lines.groupBy("key", "question").agg(F.min("pos").alias("pos"))
    return first.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("pos")).cast("long")).where(F.col("place") <= most).select("key", "place", "question")


def render_prompt(template: str, values: dict[str, str]) -> str:
    """{field} is replaced, {{ and }} stand for braces; an unknown field or a lone brace is an error."""
    out, at = [], 0
    while at < len(template):
        two, c = template[at : at + 2], template[at]
        if two in ("{{", "}}"):
            out.append(c)
            at += 2
        elif c == "{":
            end = template.find("}", at)
            if end < 0 or template[at + 1 : end] not in values:
                raise ValueError(f"unknown field at {at}")
            out.append(values[template[at + 1 : end]])
            at = end + 1
        elif c == "}":
            raise ValueError(f"lone brace at {at}")
        else:
            out.append(c)
            at += 1
    return "".join(out)


def longest_prefix(text: str, fits: Callable[[str], bool]) -> str:
    """The longest prefix that fits, for a predicate that holds for all shorter ones too."""
    low, high = 0, len(text)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(text[:middle]) else (low, middle - 1)
    return text[:low]


def _rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "doc_id", "lang", T.token_count(F.coalesce("text", F.lit(""))).alias("tokens"))


def context_budget_prefix(spark, sf_dir):
    return budget_prefix(_rows(spark, sf_dir), "source", "doc_id", 2000, 3).select("source", "doc_id", "tokens", "used")


def context_global_batches(spark, sf_dir):
    return next_fit(_rows(spark, sf_dir), "source", "doc_id", 1000, 5)


def context_rendered_tables(spark, sf_dir):
    return rendered(_rows(spark, sf_dir), "source", "doc_id", ["lang", "tokens"], 50).select("source", "rows", F.sha2("context", 256).alias("digest"))


def context_batch_order(spark, sf_dir):
    rows = _rows(spark, sf_dir).select(F.col("source"), (F.col("doc_id") % 7).alias("batch"), (F.col("tokens") % 10).alias("weight"), (F.col("doc_id") % 3).alias("rank"), F.col("doc_id").alias("pos"))
    return batch_order(rows, "source")


def context_seeded_shuffle(spark, sf_dir):
    """Reports, one for each brand, dealt by the shuffle of their positions."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    reports = brands.withColumn("pos", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("p_brand")) - 1)  # one row per brand
    order = spark.createDataFrame(list(enumerate(seeded_order(brands.count()))), "place long, pos int")
    return reports.join(order, "pos").select("p_brand", "place")


def _points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("question"), F.col("user_id").alias("batch"), F.col("event_id").alias("point"), (F.floor("value").cast("long") % 101 - 20).alias("score"), (F.col("event_id") % 13 + 5).alias("tokens"))


def ranked_map_points(spark, sf_dir):
    return ranked_points(_points(spark, sf_dir), 300).select("question", "place", "point", "score", "used")


def map_statistics(spark, sf_dir):
    points = _points(spark, sf_dir)
    return points.groupBy("question").agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("points"), F.count_if(F.col("score") <= 0).alias("dropped"), F.sum("tokens").alias("tokens"))


def rating_majority_vote(spark, sf_dir):
    return majority_vote(_points(spark, sf_dir).select(F.col("batch").alias("item"), (F.abs("score") % 5).alias("rating")))


def drift_folds(spark, sf_dir):
    ranked = _points(spark, sf_dir).withColumn("place", F.row_number().over(W.partitionBy("question").orderBy(F.col("score").desc(), "point"))).where("place <= 23")
    return folds(ranked, 5).select("question", "point", "fold")


def drift_fold_summary(spark, sf_dir):
    ranked = _points(spark, sf_dir).withColumn("place", F.row_number().over(W.partitionBy("question").orderBy(F.col("score").desc(), "point"))).where("place <= 23")
    answers = folds(ranked, 5).groupBy("question", "fold").agg(F.sum("score").alias("score"), F.concat(F.lit("fold "), F.min("point").cast("string")).alias("answer"))
    return fold_summary(answers).select("question", F.round("score", 4).alias("score"), "answer")


def suggested_questions(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("- "), F.coalesce(F.substring_index("text", ".", 1), F.lit(""))).alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    return question_candidates(texts, 20).select("key", "place", F.sha2("question", 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (context_budget_prefix, context_global_batches, context_rendered_tables, context_batch_order, context_seeded_shuffle, ranked_map_points, map_statistics, rating_majority_vote, drift_folds, drift_fold_summary, suggested_questions)
}

_ROWS = r"r AS (SELECT source, doc_id, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents)"
_POINTS = "points AS (SELECT user_id % 20 AS question, user_id AS batch, event_id AS point, CAST(floor(value) AS BIGINT) % 101 - 20 AS score, event_id % 13 + 5 AS tokens FROM events)"
_FOLDS = f"{_POINTS}, k AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, point) AS place FROM points QUALIFY place <= 23), f AS (SELECT *, ntile(5) OVER (PARTITION BY question ORDER BY place) AS fold FROM k)"

ORACLE_SQL = {
    "context_budget_prefix": f"WITH {_ROWS}, u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) + 3 AS used FROM r) SELECT source, doc_id, tokens, used FROM u WHERE used <= 2000",
    "context_global_batches": f"""WITH RECURSIVE {_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM r),
f AS (SELECT source, doc_id, tokens, i, CAST(0 AS BIGINT) AS batch, 5 + tokens AS used FROM n WHERE i = 1
  UNION ALL SELECT n.source, n.doc_id, n.tokens, n.i, CASE WHEN f.used + n.tokens > 1000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + n.tokens > 1000 THEN 5 + n.tokens ELSE f.used + n.tokens END FROM f JOIN n ON n.source = f.source AND n.i = f.i + 1)
SELECT source, doc_id, tokens, batch FROM f""",
    "context_rendered_tables": f"""WITH {_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM r QUALIFY i < 50)
SELECT source, count(*) AS rows, sha256('id,lang,tokens' || chr(10) || string_agg((i - 1) || ',' || coalesce(lang, '') || ',' || tokens || chr(10), '' ORDER BY i)) AS digest FROM n GROUP BY source""",
    "suggested_questions": r"""WITH l AS (SELECT conv_id AS key, '- ' || coalesce(split_part(text, '.', 1), '') AS text, turn FROM conversations),
t AS (SELECT key, string_split(string_agg(text, chr(10) ORDER BY turn, text), chr(10)) AS lines FROM l GROUP BY key),
q AS (SELECT key, pos, trim(regexp_replace(line, '^\s*[-*]\s*', ''), ' ') AS question FROM (SELECT key, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t)),
f AS (SELECT key, question, min(pos) AS pos FROM q WHERE question <> '' GROUP BY key, question)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) AS place, sha256(question) AS digest FROM f QUALIFY place <= 20""",
    "context_batch_order": f"WITH {_ROWS}, b AS (SELECT source, doc_id % 7 AS batch, tokens % 10 AS weight, doc_id % 3 AS rank, doc_id AS pos FROM r) SELECT *, row_number() OVER (PARTITION BY source, batch ORDER BY weight DESC, rank DESC, pos) AS place FROM b",
    "ranked_map_points": f"WITH {_POINTS}, k AS (SELECT *, row_number() OVER w AS place, CAST(sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM points WHERE score > 0 WINDOW w AS (PARTITION BY question ORDER BY score DESC, batch, point)) SELECT question, place, point, score, used FROM k WHERE used <= 300",
    "map_statistics": f"WITH {_POINTS} SELECT question, count(DISTINCT batch) AS batches, count(*) AS points, count(*) FILTER (score <= 0) AS dropped, CAST(sum(tokens) AS BIGINT) AS tokens FROM points GROUP BY question",
    "rating_majority_vote": f"WITH {_POINTS}, c AS (SELECT batch AS item, abs(score) % 5 AS rating, count(*) AS votes FROM points GROUP BY ALL) SELECT item, rating, votes FROM c QUALIFY row_number() OVER (PARTITION BY item ORDER BY votes DESC, rating) = 1",
    "drift_folds": f"WITH {_FOLDS} SELECT question, point, fold FROM f",
    "drift_fold_summary": f"WITH {_FOLDS}, a AS (SELECT question, fold, CAST(sum(score) AS BIGINT) AS score, 'fold ' || min(point) AS answer FROM f GROUP BY ALL) SELECT question, round(avg(score), 4) AS score, string_agg(answer, chr(10) || chr(10) ORDER BY fold) AS answer FROM a GROUP BY question",
}
