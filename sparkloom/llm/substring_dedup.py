"""Substring dedup: every window of WINDOW words gets a Rabin-Karp hash; repeats after the first document go.

A window is removable in a document if the same words also start in a document with a smaller
doc_id. Tasks hash all windows of their documents in numpy: a polynomial hash of each word's bytes from
prefix sums, then one of the word hashes, both modulo 2^64. Within CHUNK windows the smallest
document of a hash decides the others at once, so a chunk sends one entry (hash, smallest document) for a
hash, however many documents share it. Entries go to buckets by hash, where the smallest document of all
chunks is known; what is removable goes on, in packed rows, to the group of its document. There
the text is met again, removable windows merge into maximal intervals of words, and the rest is kept.

Two different windows count as equal if their 64-bit hashes agree: with w windows in the corpus
that is expected for w^2 / 2^65 pairs of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import read

WINDOW = 13
#: Windows that a task holds before it sends their entries on.
CHUNK = 1_000_000
#: Bytes of text for a bucket of hashes or a group of documents, on average.
BUCKET_BYTES = 8 << 20
_SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(13).integers(1, 2**64, 256, np.uint64)
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of values[start:end] for every pair, from prefix sums, modulo 2^64."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _powers(_inverse(base), len(values) + 1)[starts])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACES[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, SLICE bytes of text at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE, side="right")))
        low, high = starts[at], ends[to - 1]
        out[at:to] = _range_hashes(_BYTES[data[low:high]], starts[at:to] - low, ends[at:to] - low, _BASE) ^ (ends[at:to] - starts[at:to]).astype(np.uint64)
        at = to
    return out


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """The hash of every run of `window` word hashes."""
    n = max(0, len(words) - window + 1)
    starts = np.arange(n)
    return _range_hashes(words, starts, starts + window, _WORD_BASE)


def text_windows(text: str, window: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A text's bytes, its words' bounds and its windows' hashes."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_bounds(data)
    return raw, starts, ends, window_hashes(word_hashes(data, starts, ends), window)


def _planes(values: np.ndarray) -> bytes:
    """64-bit values as byte planes: the nearly constant ones vanish when the shuffle compresses."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _pack(hashes: np.ndarray, docs: np.ndarray) -> dict[str, bytes]:
    """Sorted hashes, as differences, and their documents."""
    return {"hashes": _planes(np.diff(hashes, prepend=np.uint64(0))), "docs": _planes(docs)}


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_unplaned(row["hashes"]), dtype=np.uint64), _unplaned(row["docs"]).view(np.int64)


def _firsts(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _sorted_pairs(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (hash, document) pairs by hash, then document."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = _firsts(hashes) | _firsts(docs)
    return hashes[new], docs[new]


def _group_of(docs: np.ndarray, groups: int) -> np.ndarray:
    return (_mix(docs.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def partition_keys(spark: SparkSession, parts: int) -> np.ndarray:
    """A key for each of `parts` shuffle partitions that a hash of it leads to, so that no two of the keys meet in one."""
    tried = int(parts * (25 + np.log(parts)))  # that one is missing has a chance of e^-25
    place = F.pmod(F.hash("id"), F.lit(parts)).alias("place")
    found = spark.range(tried).select("id", place).groupBy("place").agg(F.min("id").alias("key")).collect()  # a row per partition
    keys = np.arange(parts, dtype=np.int64)
    keys[[x["place"] for x in found]] = [x["key"] for x in found]
    return keys


_PACKED = "kind int, at long, hashes binary, docs binary"


def _batch(kind: int, at: np.ndarray, hashes: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of packed pairs, one for each value of `at`; hashes must be sorted."""
    order = np.argsort(at, kind="stable")
    bounds = np.flatnonzero(_firsts(at[order]))
    rows = [{"kind": kind, "at": int(at[part[0]])} | _pack(hashes[part], docs[part]) for part in np.split(order, bounds[1:]) if len(part)]
    for i in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_pylist(rows[i : i + 1000], pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary())]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Removes each word that a window covers whose words also start in a document with a smaller doc_id.

    docs: doc_id (integer), text; other columns are ignored. Windows lie within one document and are judged on the
    input. Returns one row per document: doc_id, n_words, n_removed, kept (the words left, joined by a space),
    intervals (maximal runs of removed words as [first, end) word numbers).
    Null text has no words; texts of fewer words than a window lose none. Rows of a null doc_id lose
    none and make others lose none, and are dealt by their texts; long texts are read whole; rows that repeat a doc_id are one document to every window, so they make
    each other lose nothing. An empty table gives no rows.

    There is a bucket of hashes, a group of documents and a shuffle partition for every bucket_bytes of text, so a task's share doesn't grow.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(8, -(-size // bucket_bytes))
    keys = partition_keys(docs.sparkSession, parts)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per chunk: entries of kind 0 for buckets; removable ones, known within the chunk, of kind 1 for groups."""
        hashes: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if hashes:
                h, d = _sorted_pairs(np.concatenate(hashes), np.concatenate(owners))
                first = _firsts(h)
                yield from _batch(0, keys[(h[first] % np.uint64(parts)).astype(np.int64)], h[first], d[first])
                yield from _batch(1, keys[_group_of(d[~first], parts)], h[~first], d[~first])
                hashes.clear()
                owners.clear()

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = text_windows(text.as_py(), window)[3]
                hashes.append(found)
                owners.append(np.full(len(found), doc_id, np.int64))
                held += len(found)
                if held >= chunk:
                    yield from flush()
                    held = 0
        yield from flush()

    def resolve(table: pa.Table) -> pa.Table:
        """Of rows of kind 0 the entries of their bucket that aren't the smallest of their hash. Kind 1 passes."""
        known = table.filter(pc.equal(table["kind"], 1)).select(["at", "hashes", "docs"])
        pairs = [_unpack(row) for row in table.filter(pc.equal(table["kind"], 0)).to_pylist()]
        if not pairs:
            return known
        h, d = _sorted_pairs(np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs]))
        again = ~_firsts(h)
        found = list(_batch(1, keys[_group_of(d[again], parts)], h[again], d[again]))
        schema = pa.schema([("kind", pa.int32()), ("at", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary())])
        return pa.concat_tables([known, pa.Table.from_batches(found, schema).select(["at", "hashes", "docs"])])

    def group_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            of = ids.fill_null(0).to_numpy(zero_copy_only=False).copy()
            for i in np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)).tolist():
                of[i] = xxhash.xxh64_intdigest((batch.column("text")[i].as_py() or "").encode("utf-8", "surrogatepass")) >> 1
            at = keys[_group_of(of, parts)]
            yield pa.RecordBatch.from_arrays([pa.array(at), ids, batch.column("text")], names=["at", "doc_id", "text"])

    def apply(_: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        removable: dict[int, list[np.ndarray]] = {}
        if texts.num_rows and marks.num_rows:
            pairs = [_unpack(row) for row in marks.to_pylist()]
            h, d = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
            order = np.argsort(d, kind="stable")
            h, d = h[order], d[order]
            starts = np.flatnonzero(_firsts(d))
            removable = dict(zip(d[starts].tolist(), np.split(h, starts[1:]), strict=True))
        rows = []
        for doc_id, text in zip(texts["doc_id"].to_pylist(), texts["text"], strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if (marked := removable.get(doc_id)) is None:
                words = raw.split()
                rows.append((doc_id, len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass"), []))
                continue
            raw, starts, ends, hashes = text_windows(raw.decode("utf-8", "surrogatepass"), window)
            hit = np.flatnonzero(np.isin(hashes, marked))
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            edges = np.diff(gone.astype(np.int8), prepend=0, append=0)
            intervals = np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], axis=1).tolist()
            kept = b" ".join([raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)])
            rows.append((doc_id, len(starts), int(gone.sum()), kept.decode("utf-8", "surrogatepass"), intervals))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "n_words", "n_removed", "kept", "intervals"), columns, kinds, strict=True)})

    texts = docs.select("doc_id", "text")
    sent = texts.where("text IS NOT NULL AND doc_id IS NOT NULL").mapInArrow(chunks, _PACKED)
    marks = sent.repartition(parts, "at").groupBy("at").applyInArrow(resolve, "at long, hashes binary, docs binary")
    grouped = texts.mapInArrow(group_texts, "at long, doc_id long, text string")
    return grouped.repartition(parts, "at").groupBy("at").cogroup(marks.repartition(parts, "at").groupBy("at")).applyInArrow(apply, "doc_id long, n_words long, n_removed long, kept string, intervals array<array<long>>")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("intervals").alias("n_intervals"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}

ORACLE_SQL = {
    "op2_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d),
h AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS words FROM p),
m AS (SELECT words, min(doc_id) AS least FROM h GROUP BY words HAVING count(*) > 1),
r AS (SELECT h.doc_id, list(i) AS places FROM h JOIN m ON h.words = m.words AND h.doc_id > m.least GROUP BY h.doc_id),
g AS (SELECT doc_id, list_distinct(flatten(list_transform(places, lambda x: range(x, x + {WINDOW})))) AS gone FROM r),
k AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END AS kept,
         CASE WHEN gone IS NULL THEN 0 ELSE len(list_filter(gone, lambda i: NOT list_contains(gone, i - 1))) END AS n_intervals
  FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256, CAST(n_intervals AS INTEGER) AS n_intervals FROM k
"""
}
