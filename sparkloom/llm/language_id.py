"""Language identification with language-bitmask n-gram filters.

Training keeps, for every language, the character trigrams that are typical of it, and puts each
into that language's Bloom filter. All filters share their hash functions and are stored
bit-sliced: the word at a position has one bit per language. The words at an n-gram's positions,
ANDed, are the set of all languages that contain it, so one probe asks all of them. A document's
score in a language is the popcount of its column over all n-grams, corrected for the false
positives that the filter's density predicts.

The table of words is the whole model. It grows with the n-grams that the languages keep, up to 2^MOST_BITS words per 64 languages; beyond
that filters get denser, which the correction takes into account: no n-gram is left out for room.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed, read

HASHES = 3
#: Least and most bits of a position in the table, and the density of the densest filter that they are chosen for.
LEAST_BITS, MOST_BITS, DENSITY = 20, 24, 0.12
#: Documents of each language, in expectation, that the filters are trained on.
TRAIN_DOCS = 10_000
#: An n-gram is typical of a language if it was seen there at least twice and its share there is at least this part of its share in any other.
TYPICAL = 0.5
LANGUAGES_PER_WORD = 64
#: N-grams that a task holds, besides one text's, before it counts them.
HELD = 1 << 22
_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Keys of the trigrams of the lower-cased text; runs of other than letters (and number signs such as ½) count as one space."""
    words = " ".join(_WORDS.findall(text.lower()))
    points = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, np.uint64)
    return points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]


_WORDS = re.compile(r"[^\W\d_]+")


def slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The positions of each key in a table of 2^bits words."""
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    step = (mixed >> np.uint64(40)) | np.uint64(1)
    return [((mixed + np.uint64(i) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class LanguageFilters:
    """Bit-sliced Bloom filters: table[position, word], bit l % 64 of word l // 64 for language l."""

    languages: list[str]
    table: np.ndarray
    false_positive: np.ndarray

    @classmethod
    def build(cls, kept: list[tuple[str, np.ndarray]], bits: int | None = None) -> LanguageFilters:
        if bits is None:
            needed = HASHES * max((len(keys) for _, keys in kept), default=0) / DENSITY
            bits = min(MOST_BITS, max(LEAST_BITS, int(needed).bit_length()))
        table = np.zeros((1 << bits, max(1, -(-len(kept) // LANGUAGES_PER_WORD))), np.uint64)
        density = []
        for number, (_, keys) in enumerate(kept):
            word, bit = number // LANGUAGES_PER_WORD, np.uint64(1 << number % LANGUAGES_PER_WORD)
            for at in slots(keys, bits):
                table[at, word] |= bit
            density.append(float(np.mean(table[:, word] & bit != 0)))
        return cls([name for name, _ in kept], table, np.array(density) ** HASHES)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """For each language the number of keys that it contains, corrected for false positives."""
        bits = int(self.table.shape[0]).bit_length() - 1
        at = slots(keys, bits)
        found = np.empty(len(self.languages))
        for word in range(self.table.shape[1]):
            mask = self.table[at[0], word]
            for x in at[1:]:
                mask &= self.table[x, word]
            for number in range(word * LANGUAGES_PER_WORD, min(len(found), (word + 1) * LANGUAGES_PER_WORD)):
                found[number] = np.count_nonzero(mask & np.uint64(1 << number % LANGUAGES_PER_WORD))
        return np.maximum(0.0, (found - len(keys) * self.false_positive) / (1 - self.false_positive))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language ('und' without a letter), the part of its share in all languages' shares, and its share of the n-grams."""
        if text is None or not _LETTER.search(text) or not self.languages:
            return "und", 0.0, 0.0
        keys = grams(text)
        found = self.counts(keys)
        best = int(found.argmax())
        total = found.sum()
        if not total:
            return self.languages[best], 0.0, 0.0
        return self.languages[best], float(found[best] / total), float(min(1.0, found[best] / len(keys)))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of every HELD n-grams or, at its end, of the rest of a batch."""
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        held = 0
        for at, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True), 1):
            by_lang.setdefault(lang, []).append(found := grams(text.as_py()))
            held += len(found)
            if held < HELD and at < batch.num_rows:
                continue
            for name, parts in by_lang.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            by_lang, held = {}, 0


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageFilters:
    """Learns the filters from documents' text and lang (rows where either is null are left out).

    Of a language with more than train_docs documents, a part is drawn by a hash of the text, so
    that about so many are read: a bound on what the classifier is fitted on. Copies of a text count once. Long texts
    are read whole, empty ones add nothing, and no documents, or none with a language, give filters that know none.
    """
    usable = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    sizes = {lang: n for lang, n in usable.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return LanguageFilters.build([])
    part = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_docs / n))]), F.col("lang"))
    drawn = usable.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000)) < part * 1_000_000)
    drawn = drawn.withColumn("of", F.xxhash64("text")).dropDuplicates(["lang", "of"]).drop("of")  # all copies of a text are drawn or none
    counts = drawn.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    shares = checkpointed(counts).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("lang")))
    most = F.max("share").over(W.partitionBy("gram"))
    typical = shares.withColumn("most", most).where((F.col("share") >= TYPICAL * F.col("most")) & (F.col("n") > 1))
    rows = typical.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()  # n-grams of a bounded draw
    return LanguageFilters.build(sorted((lang, np.array(found, np.int64).view(np.uint64)) for lang, found in rows))


def in_fold(modulus: int, remainder: int) -> Column:
    """The documents of a fold by CRC-32 of doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus == remainder


def identify(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """Predicts the language of every document from its whole text.

    docs: doc_id, text; other columns are ignored. Returns one row per input row: doc_id, lang_pred,
    score (share of the language among all languages' corrected counts), known (share of the text's
    n-grams that the language contains). Null texts and those without a letter are 'und' with score 0;
    so is every text if no language was learned. Ties go to the language first in order. Long texts are read whole, rows that
    repeat each by themselves; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the table: see above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column("text")]
            lang, score, known = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "known"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, known double")


def identified(docs: DataFrame, filters: LanguageFilters, least_known: float) -> DataFrame:
    """The documents, with all their columns and lang set to the language found, that the filters don't reject:
    those with a letter and at least the part least_known of their n-grams in that language.

    Null and empty texts go; long texts are read whole; repeated rows and ties (the first language in order) are treated alike each
    time; columns of any names pass as they are, and an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch.column("text")]
            lang = pa.array([x[0] for x in found], pa.string())
            keeps = pa.array([x[0] != "und" and x[2] >= least_known for x in found], pa.bool_())
            at = batch.schema.get_field_index("lang")
            yield batch.set_column(at, "lang", lang).filter(keeps)

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    filters = train(docs.where(~in_fold(4, 2)))
    return identify(docs, filters).withColumn("held_out", F.coalesce(in_fold(4, 2), F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "known")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
