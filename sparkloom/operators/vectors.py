"""Vector search: exact cosine top-k in a namespace, eligibility after or before the limit, idempotent sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import context
from sparkloom.session import table


def cosine_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Adds the cosine with the query, clamped to [-1, 1]; both sides are normalised first."""
    norm = sum(x * x for x in query) ** 0.5
    asked = F.array(*[F.lit(x / norm) for x in query])
    score = T.dot(T.l2_normalize(F.col("embedding")), asked)
    return vectors.where(T.valid_vector(F.col("embedding"))).withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))


def top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest by cosine, ties to the smaller id: each task keeps k rows before they meet."""
    return cosine_scores(vectors, query).select("vec_id", "score").orderBy(F.col("score").desc(), "vec_id").limit(k)


def top_k_then_filter(vectors: DataFrame, query: list[float], k: int, eligible: DataFrame) -> DataFrame:
    """The eligible ones among the k nearest: there may be fewer than k."""
    return top_k(vectors, query, k).join(eligible, "vec_id", "left_semi")


def include_exclude(vectors: DataFrame, query: list[float], k: int, include: list[int], exclude: list[int]) -> DataFrame:
    """Included ids first, with score 1; then the first of the 2k nearest that are neither included nor excluded, k in all of these."""
    first = vectors.where(F.col("vec_id").isin(include)).select("vec_id", F.lit(1.0).alias("score"), F.lit(0).alias("tier"))
    near = top_k(vectors, query, 2 * k).where(~F.col("vec_id").isin([*include, *exclude])).orderBy(F.col("score").desc(), "vec_id").limit(k)
    return first.unionByName(near.withColumn("tier", F.lit(1)))


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids that still need an embedding."""
    return wanted.join(stored, "vec_id", "left_anti").select("vec_id")


def add(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """What an idempotent sink appends: valid offered vectors of ids not stored, normalised, one for an id."""
    fresh = offered.where(T.valid_vector(F.col("embedding"))).join(stored, "vec_id", "left_anti")
    return fresh.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("embedding", T.l2_normalize(F.col("embedding")))


def open_namespace(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Integrity probe of a namespace: members without a vector; none if it may be read."""
    return members.join(vectors, "vec_id", "left_anti")


def delete_namespace(members: DataFrame, label: int) -> DataFrame:
    """The membership left when a namespace is dropped; vectors stay cached."""
    return members.where(F.col("label") != label)


def namespace_key(members: DataFrame) -> DataFrame:
    """SHA-256 over the sorted ids of each namespace."""
    ids = F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string"))
    return members.groupBy("label").agg(F.count("*").alias("members"), T.set_digest(ids).alias("key"))


def request_batches(inputs: DataFrame, most_items: int = 16, most_tokens: int = 8191) -> DataFrame:
    """Greedy sequential batches per stream (stream, place, tokens): adds `batch`; a batch closes when the next
    input would exceed items or tokens. An input beyond the limit by itself is an error."""

    too_long = F.raise_error(F.concat(F.lit("an input has "), F.col("tokens").cast("string"), F.lit(f" tokens; a batch may have {most_tokens}")))
    checked = inputs.withColumn("tokens", F.when(F.col("tokens") > most_tokens, too_long.cast("long")).otherwise(F.col("tokens")))
    return context.packed(checked, "stream", "place", most_tokens, 0, most_items)


def input_windows(texts: DataFrame, most_tokens: int = 8191) -> DataFrame:
    """Inputs of a batch from texts (stream, doc_id, n): (stream, place, tokens), windows of at most most_tokens, so that none of a long text's tokens is lost; place is (doc_id, window)."""
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n") / most_tokens).cast("long") - 1)
    windows = texts.select("stream", "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window"))
    tokens = F.least(F.lit(most_tokens).cast("long"), F.col("n") - F.col("window") * most_tokens)
    return windows.select("stream", F.struct("doc_id", "window").alias("place"), tokens.alias("tokens"))


def _query(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id > 0")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 5))


def vector_topk(spark, sf_dir):
    return _rounded(top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 10))


def vector_topk_namespace(spark, sf_dir):
    return _rounded(top_k(_vectors(spark, sf_dir).where("label = 3"), _query(spark, sf_dir), 10))


def vector_topk_filtered(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return _rounded(top_k_then_filter(vectors, _query(spark, sf_dir), 20, vectors.where("label % 2 = 0").select("vec_id")))


def vector_include_exclude(spark, sf_dir):
    return _rounded(include_exclude(_vectors(spark, sf_dir), _query(spark, sf_dir), 10, [5, 7], [11, 12, 13]))


def vector_normalize(spark, sf_dir):
    unit = _vectors(spark, sf_dir).where(T.valid_vector(F.col("embedding"))).withColumn("unit", T.l2_normalize(F.col("embedding")))
    return unit.select("vec_id", F.round(F.element_at("unit", 1), 5).alias("first"), F.round(T.dot(F.col("unit"), F.col("unit")), 5).alias("norm"))


def vector_missing(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return missing(vectors, vectors.where("label < 7"))


def vector_sink(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return add(vectors.where("label < 5").select("vec_id"), vectors.unionByName(vectors.where("label = 9"))).select("vec_id", F.round(F.element_at("embedding", 1), 5).alias("first"))


def vector_namespace_probe(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return open_namespace(vectors.select("vec_id", "label"), vectors.where("vec_id % 50 <> 0").select("vec_id"))


def vector_namespace_delete(spark, sf_dir):
    return delete_namespace(_vectors(spark, sf_dir).select("vec_id", "label"), 3).groupBy("label").agg(F.count("*").alias("members"))


def vector_namespace_key(spark, sf_dir):
    return namespace_key(_vectors(spark, sf_dir))


def embedding_batches(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("stream"), "doc_id", T.token_count(F.coalesce("text", F.lit(""))).alias("n"))
    return request_batches(input_windows(texts)).groupBy("stream", "batch").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


QUERIES = {
    f.__name__: f
    for f in (vector_topk, vector_topk_namespace, vector_topk_filtered, vector_include_exclude, vector_normalize, vector_missing, vector_sink, vector_namespace_probe, vector_namespace_delete, vector_namespace_key, embedding_batches)
}

_SCORES = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, greatest(-1.0, least(1.0, list_cosine_similarity(embedding::DOUBLE[], q))) AS score FROM embeddings, q WHERE vec_id > 0)"
_TOP = lambda k, more="": f"(SELECT vec_id, score, label FROM s {more} ORDER BY score DESC, vec_id LIMIT {k})"

ORACLE_SQL = {
    "embedding_batches": rf"""WITH RECURSIVE t AS (SELECT coalesce(source, '') AS stream, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
i AS (SELECT stream, doc_id, n, unnest(range(0, greatest(1, CAST(ceil(n / 8191.0) AS BIGINT)))) AS w FROM t),{context.packed_sql("pk", "SELECT stream, [doc_id, w] AS place, least(8191, n - w * 8191) AS tokens FROM i", "stream", "place", 0, 8191, 16)}
SELECT stream, batch, count(*) AS items, CAST(sum(tokens) AS BIGINT) AS tokens FROM pk GROUP BY stream, batch""",
    "vector_topk": f"WITH {_SCORES} SELECT vec_id, round(score, 5) AS score FROM {_TOP(10)}",
    "vector_topk_namespace": f"WITH {_SCORES} SELECT vec_id, round(score, 5) AS score FROM {_TOP(10, 'WHERE label = 3')}",
    "vector_topk_filtered": f"WITH {_SCORES} SELECT vec_id, round(score, 5) AS score FROM {_TOP(20)} WHERE label % 2 = 0",
    "vector_include_exclude": f"WITH {_SCORES} SELECT vec_id, 1.0::DOUBLE AS score, 0 AS tier FROM s WHERE vec_id IN (5, 7) UNION ALL (SELECT vec_id, round(score, 5), 1 FROM {_TOP(20)} WHERE vec_id NOT IN (5, 7, 11, 12, 13) ORDER BY score DESC, vec_id LIMIT 10)",
    "vector_normalize": "WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings WHERE vec_id > 0) SELECT vec_id, round(v[1] / norm, 5) AS first, 1.0::DOUBLE AS norm FROM n",
    "vector_missing": "SELECT vec_id FROM embeddings WHERE vec_id > 0 AND label >= 7",
    "vector_sink": "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings WHERE vec_id > 0 AND label >= 5",
    "vector_namespace_probe": "SELECT vec_id, label FROM embeddings WHERE vec_id > 0 AND vec_id % 50 = 0",
    "vector_namespace_delete": "SELECT label, count(*) AS members FROM embeddings WHERE vec_id > 0 AND label <> 3 GROUP BY label",
    "vector_namespace_key": "SELECT label, count(*) AS members, sha256(string_agg(vec_id || chr(0), '' ORDER BY vec_id)) AS key FROM embeddings WHERE vec_id > 0 GROUP BY label",
}
