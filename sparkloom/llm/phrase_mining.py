"""Phrase collocation mining by hierarchical pair naming.

Texts become sequences of ids of the words that are frequent in their language, in chunks of about CHUNK words. From there each level replaces pairs: where two frequent
(k-1)-grams stand one word apart, they form a k-gram, named by the pair of their ids. Chunks send one
row for each distinct pair, Spark sums these, gives the frequent ones an id of their own, and the
ids go back to the chunks (all of them to all tasks while they are few, else by a join), which keep the positions of frequent k-grams only. The pair of a k-gram is
its pointer to two parents, all but its last and all but its first word; counts for the cuts, phrases and
longer phrases that swallow a shorter one are found along these pointers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import read
from sparkloom.operators.graph import numbered_within
from sparkloom.session import dropped, written

#: Words of the longest phrases, least occurrences of a candidate, and phrases of a language that are returned.
MOST_WORDS, LEAST, MOST_PHRASES = 4, 30, 2000
#: A candidate goes if a longer one that contains it has at least this percentage of its occurrences.
SWALLOWED = 80
SCALE = 2_000_000
#: Words of a chunk, about.
CHUNK = 500_000
#: Frequent words or grams of a level that are sent to all tasks, which then name what they read themselves (24 bytes each), and bytes of these words. Of
#: more, chunks get those that they hold by a join.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 20 << 20
#: Distinct words that a task counts before it sends them on.
HELD = 1 << 19
#: Lower-cases A-Z; piece ends become a period, tabs spaces.
_TABLE = bytes(ord(".") if chr(x) in ".,;:!?\n\x0b\x0c\r" else 32 if x == 9 else x + 32 if 65 <= x <= 90 else x for x in range(256))
_END = b"."


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text in order, and a period wherever a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).replace(_END, b" . ").split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of every HELD distinct words or, at its end, of the task."""
    counted: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, found in counted.items():
            found.pop(_END, None)
            words, n = list(found), list(found.values())
            for i in range(0, len(words), 1 << 16):
                texts = pa.array(words[i : i + (1 << 16)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts), pa.string()), texts, pa.array(n[i : i + (1 << 16)], pa.int64())], names=["lang", "word", "n"])
        counted.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            counted[lang].update(words_of(text.as_py()))
        if sum(map(len, counted.values())) >= HELD:
            yield from flush()
    yield from flush()


_CODED = pa.schema([("chunk", pa.int64()), ("codes", pa.binary()), ("code", pa.int32()), ("lang", pa.string()), ("word", pa.string())])


def _coded(chunk_words: int):
    """Chunks as rows of two kinds: one with the codes of all words in order, and one for each distinct (lang, word) with its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        total = 1  # code 0 ends a piece
        vocabulary: dict[str, dict[bytes, int]] = {}
        parts: list[np.ndarray] = []
        held = 0

        def known(lang: str) -> dict[bytes, int]:
            def new() -> int:
                nonlocal total
                total += 1
                return total - 1

            if lang not in vocabulary:
                vocabulary[lang] = defaultdict(new, {_END: 0})
            return vocabulary[lang]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal total, held, number
            codes = np.concatenate(parts)
            empty = [None]
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([codes.tobytes()], pa.binary()), *(pa.array(empty, field.type) for field in list(_CODED)[2:])], schema=_CODED)
            for lang, of in vocabulary.items():
                of.pop(_END)
                words, at = list(of), np.fromiter(of.values(), np.int32, len(of))
                for i in range(0, len(words), 1 << 16):
                    texts = pa.array(words[i : i + (1 << 16)], pa.binary()).cast(pa.string())
                    some = at[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.nulls(len(some), pa.binary()), pa.array(some), pa.array([lang] * len(some), pa.string()), texts], schema=_CODED)
            vocabulary.clear()
            parts.clear()
            number, total, held = number + 1, 1, 0

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                if not words:
                    continue
                parts += [np.fromiter(map(known(lang).__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
                held += len(words)
                if held >= chunk_words:
                    yield from flush()
        if parts:
            yield from flush()

    return run


# A chunk's level: the frequent grams that start in it, in order. `codes` (int32) has which of `ids` (int64, ascending) each is, times two, plus one if the next
# one starts a single word later; gaps between others don't matter any more.
_LEVEL = "chunk long, codes binary, ids binary"
_LEVEL_SCHEMA = pa.schema([("chunk", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary())])


def _level_row(chunk: pa.Scalar, at: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    codes = codes.astype(np.int32) << 1
    codes[:-1] |= at[1:] == at[:-1] + 1
    return pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([codes.tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], schema=_LEVEL_SCHEMA)


def _fields(column: pa.Array, row: int) -> list[np.ndarray]:
    """The fields of the list of structs in a row, as numpy arrays."""
    found = column[row].values
    return [x.to_numpy(zero_copy_only=False) for x in found.flatten()] if found is not None else []


def _name_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 1 of chunks from their codes and the (code, id) of their frequent words."""
    for batch in batches:
        for row in range(batch.num_rows):
            codes = np.frombuffer(batch.column("codes")[row].as_buffer(), np.int32)
            of, ids = _fields(batch.column("named"), row)
            order = np.argsort(ids)
            rank = np.full(max(int(codes.max()), int(of.max())) + 1, -1, np.int32)
            rank[of[order]] = np.arange(len(ids))
            at = np.flatnonzero(rank[codes] >= 0)
            yield _level_row(batch.column("chunk")[row], at, rank[codes[at]], ids[order])


def _chunk_pairs(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk at some level its ids, the numbers of the grams that make a pair with the next one, and the pairs as left code << 32 | right code."""
    codes = np.frombuffer(batch.column("codes")[row].as_buffer(), np.int32)
    ids = np.frombuffer(batch.column("ids")[row].as_buffer(), np.int64)
    together = np.flatnonzero(codes & 1)
    return ids, together, (codes[together] >> 1).astype(np.int64) << 32 | codes[together + 1] >> 1


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, left, right, n): one row for each distinct pair of a chunk."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, _, pairs = _chunk_pairs(batch, row)
            found, n = np.unique(pairs, return_counts=True)
            left, right = ids[found >> 32], ids[found & 0xFFFFFFFF]
            for i in range(0, len(found), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n[part]), batch.column("chunk")[row].as_py())), pa.array(left[part]), pa.array(right[part]), pa.array(n[part])], names=["chunk", "left", "right", "n"])


def _name_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next level of chunks, from this one and the (left, right, id) of their frequent pairs."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, at, pairs = _chunk_pairs(batch, row)
            left, right, named = _fields(batch.column("named"), row)
            order = np.argsort(named)
            keys = (np.searchsorted(ids, left) << 32 | np.searchsorted(ids, right))[order]
            by_key = np.argsort(keys)
            place = np.minimum(np.searchsorted(keys, pairs, sorter=by_key), len(keys) - 1)
            rank = by_key[place]
            frequent = keys[rank] == pairs
            yield _level_row(batch.column("chunk")[row], at[frequent], rank[frequent], named[order])


def _name_texts(shared, chunk_words: int):
    """Level 1 straight from texts, by the ids of all frequent words (shared: lang -> sorted words, their ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {lang: dict(zip(words, ids.tolist(), strict=True)) for lang, (words, ids) in shared.value.items()}
        number = TaskContext.get().partitionId() << 32
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            found = np.concatenate(parts)
            at = np.flatnonzero(found >= 0)
            ids, codes = np.unique(found[at], return_inverse=True)
            return _level_row(pa.scalar(number), at, codes, ids)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                parts += [np.fromiter(map(known.get(lang, {}).get, words, repeat(-1)), np.int64, len(words)), np.full(1, -1)]
                held += len(words)
                if held >= chunk_words:
                    yield flush()
                    parts.clear()
                    number, held = number + 1, 0
        if parts:
            yield flush()

    return run


def _name_pairs_shared(shared):
    """The next level of chunks, by all frequent pairs (shared: ids that occur in them, and the pairs' keys, sorted, with their ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, keys, named = shared.value
        if not len(keys):
            return
        for batch in batches:
            for row in range(batch.num_rows):
                ids, at, pairs = _chunk_pairs(batch, row)
                place = np.minimum(np.searchsorted(parts, ids), len(parts) - 1)
                place[parts[place] != ids] = len(parts)  # in no frequent pair
                wanted = place[pairs >> 32] * (len(parts) + 1) + place[pairs & 0xFFFFFFFF]
                found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                frequent = keys[found] == wanted
                of, codes = np.unique(named[found[frequent]], return_inverse=True)
                yield _level_row(batch.column("chunk")[row], at[frequent], codes, of)

    return run


def _few(grams: DataFrame, letters: Column | None = None) -> bool:
    """Whether the grams of a level may be sent to all tasks."""
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.lit(0) if letters is None else letters), F.lit(0)).alias("bytes")).first()
    return size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES


def _pairs_to_share(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most BROADCAST_ROWS pairs (left, right, id) as arrays."""
    rows = counted.select("left", "right", "id").toArrow()
    left, right, named = (rows[x].to_numpy() for x in ("left", "right", "id"))
    parts = np.unique(np.concatenate([left, right]))
    keys = np.searchsorted(parts, left) * (len(parts) + 1) + np.searchsorted(parts, right)
    order = np.argsort(keys)
    return parts, keys[order], named[order]


def _words_to_share(counted: DataFrame) -> dict[str, tuple[list[bytes], np.ndarray]]:
    """At most BROADCAST_ROWS words (lang, word, id), of BROADCAST_BYTES together, by language."""
    rows = counted.select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow()
    langs, words, ids = rows["lang"].to_numpy(), rows["word"].to_pylist(), rows["id"].to_numpy()
    return {str(lang): ([words[i] for i in np.flatnonzero(langs == lang)], ids[langs == lang]) for lang in set(langs.tolist())}


def _numbered(grams: DataFrame) -> DataFrame:
    """Written with ids, so that these are the same whoever reads them."""
    return written(grams.withColumn("id", F.monotonically_increasing_id()))


def _with_parents(counted: DataFrame, shorter: DataFrame) -> DataFrame:
    """k-grams (id, left, right, n) with what their parents tell: lang, phrase, last word, and the counts of all heads and tails, shortest head and longest tail first."""
    one = shorter.select(F.col("id").alias("left"), "lang", "phrase", F.concat("heads", F.array("n")).alias("heads"))
    other = shorter.select(F.col("id").alias("right"), "last", F.concat(F.array("n"), "tails").alias("tails"))
    return counted.join(one, "left").join(other, "right").select("id", "left", "right", "n", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "heads", "tails")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, chunk_words: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """All candidates (lang, phrase, words, a, l, r, score, swallowed: the most occurrences of a candidate one word longer that contains it, or null), and
    the word occurrences (lang, n) of languages.

    docs: text, lang; other columns are ignored. See mine_phrases for texts, nulls and scores.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    share = docs.sparkSession.sparkContext.broadcast
    words = written(texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counted = _numbered(words.where(F.col("n") >= least))
    none = F.array().cast("array<long>")
    shorter = counted.select("id", "n", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("heads"), none.alias("tails"))
    if _few(counted, F.octet_length("word")):
        level = written(texts.mapInArrow(_name_texts(share(_words_to_share(counted)), chunk_words), _LEVEL))
    else:
        coded = written(texts.mapInArrow(_coded(chunk_words), "chunk long, codes binary, code int, lang string, word string"))
        named = coded.where("codes IS NULL").select("chunk", "code", "lang", "word").join(counted.select("lang", "word", "id"), ["lang", "word"])
        named = named.groupBy("chunk").agg(F.collect_list(F.struct("code", "id")).alias("named"))
        level = written(coded.where("codes IS NOT NULL").select("chunk", "codes").join(named, "chunk").mapInArrow(_name_words, _LEVEL))
        dropped(coded)
    done = []
    for words in range(2, most_words + 1):
        pairs = level.mapInArrow(_count_pairs, "chunk long, left long, right long, n long")
        counted = _numbered(pairs.groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        longer = written(_with_parents(counted, shorter))
        within = longer.select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), "n").groupBy("id").agg(F.max("n").alias("swallowed"))
        if words > 2:
            done.append(shorter.withColumn("words", F.lit(words - 1)).join(within, "id", "left"))
        if words < most_words:
            if _few(counted):
                following = written(level.mapInArrow(_name_pairs_shared(share(_pairs_to_share(counted))), _LEVEL))
            else:
                named = pairs.select("chunk", "left", "right").join(counted.select("left", "right", "id"), ["left", "right"])
                named = named.groupBy("chunk").agg(F.collect_list(F.struct("left", "right", "id")).alias("named"))
                following = written(level.join(named, "chunk").mapInArrow(_name_pairs, _LEVEL))
            dropped(level)
            level = following
        shorter = longer
    done.append(shorter.withColumn("words", F.lit(most_words)).withColumn("swallowed", F.lit(None).cast("long")))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    # every cut: what its two parts count; the lowest score, then the shortest head, decides. In decimals, as the products may pass 64 bits
    cuts = f"transform(arrays_zip(heads, tails), (x, i) -> struct(cast(n AS decimal(20,0)) * {SCALE} div (x.heads + x.tails) AS score, i AS i, x.heads AS l, x.tails AS r))"
    found = found.withColumn("cut", F.array_min(F.expr(cuts)))
    return found.select("lang", "phrase", "words", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score", "swallowed"), totals


def mine_phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, most_phrases: int = MOST_PHRASES, chunk_words: int = CHUNK) -> DataFrame:
    """The strongest collocations of each language.

    docs: text, lang; other columns are ignored. A-Z are lower-cased, pieces end at any of `.,;:!?` and line ends, words at
    spaces and tabs. Phrases of 2 to most_words words of a piece that occur at least `least` times in a language (overlaps included) are candidates. Cut
    after its first k words a candidate scores floor(SCALE * a / (l + r)), where a, l and r count the phrase and its two parts; its lowest
    score counts, ties go to the smallest k. Candidates that lie in a longer candidate with at least SWALLOWED percent of their
    occurrences go. Returns lang, rank (1 to most_phrases; by score, then a, descending, then phrase in byte order), phrase, a, l, r, n (word
    occurrences of the language), score.
    Null lang is 'und'; null and empty texts have no words; long texts are read whole, a row that repeats counts again, and an empty table gives no rows.

    Chunks of about chunk_words words (a text is never cut) send a row for each distinct pair of frequent parts, so a frequent phrase costs a row a chunk at
    most, and a chunk's named pairs come back as one list that the chunk bounds. Ranks are numbered over range partitions.
    """
    found, totals = collocations(docs, least, most_words, chunk_words)
    kept = written(found.where(F.col("swallowed").isNull() | (F.col("swallowed") * 100 < F.col("a") * SWALLOWED)))
    ranked = numbered_within(kept.withColumn("_s", -F.col("score")).withColumn("_a", -F.col("a")), ["lang"], ["_s", "_a", "phrase"]).withColumn("rank", F.col("place") + 1)
    return ranked.where(F.col("rank") <= most_phrases).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(read(spark, sf_dir, "documents"))


QUERIES = {"op13_phrase_mining": op13_phrase_mining}

_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS k, concat_ws(' ', {', '.join(f'w{i}' for i in range(1, k + 1))}) AS phrase FROM e WHERE w{k} IS NOT NULL" for k in range(1, MOST_WORDS + 1))

ORACLE_SQL = {
    "op13_phrase_mining": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM w),
e AS (SELECT lang, w1, {", ".join(f"lead(w1, {i}) OVER (PARTITION BY id ORDER BY pos) AS w{i + 1}" for i in range(1, MOST_WORDS))} FROM u),
f AS (SELECT lang, k, phrase, count(*) AS a FROM ({_GRAMS}) GROUP BY lang, k, phrase),
t AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND a >= {LEAST}),
x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
y AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.cut, l.a AS l, r.a AS r, CAST({SCALE}::HUGEINT * x.a // (l.a + r.a) AS BIGINT) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.s[1 : x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.s[x.cut + 1 :], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, k, a, s, unnest(range(2, k)) AS m FROM c WHERE k > 2),
j AS (SELECT lang, a, array_to_string(s[b : b + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS b FROM i)),
g AS (SELECT lang, phrase, max(a) AS longer FROM j GROUP BY lang, phrase),
q AS (SELECT z.* FROM z LEFT JOIN g ON z.lang = g.lang AND z.phrase = g.phrase WHERE g.longer IS NULL OR 100 * g.longer < {SWALLOWED} * z.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM q)
SELECT o.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score FROM o JOIN t ON o.lang = t.lang WHERE rank <= {MOST_PHRASES}
"""
}
