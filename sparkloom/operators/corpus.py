"""Text units: normalised texts cut into windows of tokens, content-addressed, with spans and generations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.session import table, written

SIZE, OVERLAP = 64, 16
_TOKEN = r"[^\x20\x09-\x0D]+"
#: Texts whose sentences a task holds at once as Python objects.
TEXTS_HELD = 200


def prepared_texts(documents: DataFrame) -> DataFrame:
    """doc_id and the normalised text; documents without one are left out. A filter would normalise a second time, so a text is the one entry of an array or of none."""
    return documents.select("doc_id", F.explode(F.array_compact(F.array(T.normalize_text(F.col("text"))))).alias("text"))


def window_starts(n_tokens: Column, size: int, overlap: int) -> Column:
    """First tokens of the windows: every size - overlap tokens, until a window reaches the end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n_tokens - size) / step).cast("long"))
    return F.when(n_tokens > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i * step))


def token_windows(texts: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, window_no, unit, token_count): windows of `size` tokens that share `overlap`, tokens joined by a blank. A text is cut before its windows become rows,
    as rows that each hold all tokens would grow with the square of its length."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")

    def cut(tokens: Column) -> Column:
        unit = lambda start: F.array_join(F.slice(tokens, start.cast("int") + 1, F.lit(size)), " ")
        count = lambda start: F.least(F.lit(size), F.size(tokens) - start).cast("long")
        return F.transform(window_starts(F.size(tokens), size, overlap), lambda start: F.struct(unit(start).alias("unit"), count(start).alias("token_count")))

    windows = T.bound(F.regexp_extract_all("text", F.lit(_TOKEN), 0), cut)
    rows = texts.select("doc_id", F.posexplode(windows).alias("window_no", "window"))
    return rows.select("doc_id", F.col("window_no").cast("long").alias("window_no"), "window.unit", "window.token_count")


def text_units(texts: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Units with the SHA-512 of their text as id; equal texts are one unit wherever they occur."""
    return token_windows(texts, size, overlap).withColumn("unit_id", F.sha2("unit", 512))


def span_windows(texts: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, start_char, end_char, unit): windows as half-open code-point ranges of the text itself; the last ends with the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                at = [m.start() for m in re.finditer(_TOKEN, text)]
                for first in range(0, max(1, len(at) - overlap), size - overlap) if at else ():
                    begin = 0 if first == 0 else at[first]
                    end = at[first + size] if first + size < len(at) else len(text)
                    rows.append((doc_id, begin, end, text[begin:end]))
            yield pd.DataFrame(rows, columns=["doc_id", "start_char", "end_char", "unit"])

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id long, start_char long, end_char long, unit string")


_SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+")


def sentence_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, sentence_no, start_char, end_char): sentences as code-point ranges, ends inclusive."""

    names, kinds = ["doc_id", "sentence_no", "start_char", "end_char"], [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_HELD):
                rows, few = [], batch.slice(at, TEXTS_HELD)
                for doc_id, text in zip(few.column("doc_id").to_pylist(), few.column("text").to_pylist(), strict=True):
                    begin, number = 0, 0
                    for end in [*(m.start() for m in _SENTENCE_END.finditer(text)), len(text)]:
                        part = text[begin:end]
                        if inner := part.strip():
                            first = begin + len(part) - len(part.lstrip())
                            rows.append((doc_id, number, first, first + len(inner) - 1))
                            number += 1
                        begin = end
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, sentence_no long, start_char long, end_char long")


_PHRASE = re.compile(r"[A-Z][\w-]+(?:\s+[A-Z][\w-]+)+|\w+-\w+")
STOP_NOUNS = frozenset(["stuff", "thing", "things", "lots", "bit", "bits"])


def noun_phrases(texts: DataFrame, longest_word: int = 15) -> DataFrame:
    """(doc_id, phrases): runs of capitalised words and hyphen compounds, upper-cased, as a canonical set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted({re.sub(r"\s+", " ", m[0]).upper() for m in _PHRASE.finditer(text) if all(len(w) <= longest_word for w in m[0].split()) and m[0].lower() not in STOP_NOUNS}) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "phrases": found})

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id long, phrases array<string>")


def corpus_stats(units: DataFrame) -> DataFrame:
    """One row: texts, distinct units, spans."""
    return units.agg(F.count_distinct("doc_id").alias("texts"), F.count_distinct("unit_id").alias("units"), F.count("*").alias("spans"))


def generation_copy(spans: DataFrame, local: DataFrame, previous: int) -> DataFrame:
    """The spans of generation `previous` whose texts are still local, as those of the next one."""
    return spans.where(F.col("corpora_id") == previous).join(local, "doc_id", "left_semi").withColumn("corpora_id", F.lit(previous + 1).cast("long"))


def earlier_units(spans: DataFrame, generation: int) -> DataFrame:
    """Units of a generation that an earlier one already had."""
    met = spans.groupBy("unit_id").agg(F.bool_or(F.col("corpora_id") == generation).alias("now"), F.bool_or(F.col("corpora_id") < generation).alias("earlier"))
    return met.where("now AND earlier AND unit_id IS NOT NULL").select("unit_id")


def generation_ready(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: texts without a span, spans, and whether the generation is complete."""
    counts = spans.groupBy("doc_id").agg(F.count("*").alias("spans"))
    met = counts.select("doc_id", F.lit(0).alias("texts"), "spans").unionByName(texts.select("doc_id", F.lit(1).alias("texts"), F.lit(0).cast("long").alias("spans")))
    of = met.groupBy("doc_id").agg(F.sum("texts").alias("texts"), F.sum("spans").alias("spans"))
    without = F.sum(F.when((F.col("spans") == 0) | F.col("doc_id").isNull(), F.col("texts")))
    counted = of.agg(F.coalesce(without, F.lit(0)).alias("missing"), F.coalesce(F.sum("spans"), F.lit(0)).alias("spans"))
    return counted.withColumn("ready", (F.col("missing") == 0) & (F.col("spans") > 0))


def locate_sources(spans: DataFrame, texts: DataFrame, units: DataFrame) -> DataFrame:
    """Where requested units come from: span and text, in text order."""
    return spans.join(units, "unit_id", "left_semi").join(texts.select("doc_id", "source", "lang"), "doc_id").orderBy("doc_id", "window_no")


def dedup_documents(documents: DataFrame) -> DataFrame:
    """One document for a content digest, the first; its copies are counted."""
    digest = documents.where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    return digest.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.count_distinct("size").alias("sizes"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_texts(table(spark, sf_dir, "documents"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations: the first without documents of even id from one source, the second with all."""
    units = text_units(_texts(spark, sf_dir)).withColumn("unit_id", F.sha2("unit", 256)).drop("unit")
    first, second = (F.lit(x).cast("long") for x in (1, 2))
    return units.select("*", F.explode(F.when(F.col("doc_id") % 3 != 0, F.array(first, second)).otherwise(F.array(second))).alias("corpora_id"))  # the units are cut once


def corpus_text_normalize(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("long").alias("chars"))


def corpus_text_units(spark, sf_dir):
    units = token_windows(_texts(spark, sf_dir))
    return units.select("doc_id", "window_no", "token_count", F.sha2("unit", 256).alias("digest"))


def corpus_unit_dedup(spark, sf_dir):
    units = token_windows(_texts(spark, sf_dir)).withColumn("unit_id", F.sha2("unit", 256))
    return units.groupBy("unit_id").agg(F.count("*").alias("spans"), F.min("doc_id").alias("first_doc"))


def corpus_statistics(spark, sf_dir):
    return corpus_stats(text_units(_texts(spark, sf_dir)))


def corpus_generation_copy(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    local = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return generation_copy(spans, local, 1).groupBy("corpora_id", "doc_id").agg(F.count("*").alias("spans"))


def corpus_earlier_units(spark, sf_dir):
    return earlier_units(_spans(spark, sf_dir), 2)


def corpus_generation_ready(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return generation_ready(_texts(spark, sf_dir), spans.where("corpora_id = 1"))


def corpus_locate_sources(spark, sf_dir):
    spans = written(_spans(spark, sf_dir).where("corpora_id = 2"))  # read twice
    asked = spans.where("window_no = 0").select("unit_id")
    return locate_sources(spans, table(spark, sf_dir, "documents"), asked).select("doc_id", "window_no", "unit_id", "source", "lang")


def corpus_document_dedup(spark, sf_dir):
    return dedup_documents(table(spark, sf_dir, "documents"))


def corpus_span_windows(spark, sf_dir):
    """Spans whose slices rebuild the texts: per document the windows and whether each is its slice."""
    texts = _texts(spark, sf_dir)
    spans = span_windows(texts).groupBy("doc_id").agg(F.collect_list(F.struct("start_char", "end_char", "unit")).alias("spans"))  # so that a text meets its spans once
    slice_ = lambda x: F.substring("text", x["start_char"].cast("int") + 1, (x["end_char"] - x["start_char"]).cast("int"))
    exact = F.forall("spans", lambda x: slice_(x) == x["unit"])
    checked = spans.join(texts, "doc_id").select("doc_id", F.size("spans").alias("windows"), F.array_max(F.transform("spans", lambda x: x["end_char"])).alias("end_char"), exact.alias("exact"))
    return checked.groupBy("doc_id").agg(F.sum("windows").alias("windows"), F.max("end_char").alias("end_char"), F.bool_and("exact").alias("exact"))


def corpus_sentences(spark, sf_dir):
    return sentence_spans(_texts(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max("end_char").alias("last_char"))


def corpus_noun_phrases(spark, sf_dir):
    return noun_phrases(_texts(spark, sf_dir)).select("doc_id", F.size("phrases").alias("n_phrases"), F.array_join("phrases", "|").alias("phrases"))


QUERIES = {f.__name__: f for f in (corpus_text_normalize, corpus_text_units, corpus_unit_dedup, corpus_statistics, corpus_generation_copy, corpus_earlier_units, corpus_generation_ready, corpus_locate_sources, corpus_document_dedup, corpus_span_windows, corpus_sentences, corpus_noun_phrases)}

_SPACE_SQL = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TEXTS_SQL = rf"""
raw AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^{_SPACE_SQL}|{_SPACE_SQL}$', '', 'g') AS text FROM documents WHERE text IS NOT NULL),
texts AS (SELECT * FROM raw WHERE text <> '' AND NOT contains(text, chr(0)))"""
_UNITS_SQL = rf"""{_TEXTS_SQL},
tok AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
win AS (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - {SIZE}) / {SIZE - OVERLAP}.0) AS BIGINT)) + 1)) AS window_no FROM tok WHERE len(w) > 0),
units AS (SELECT doc_id, window_no, least({SIZE}, len(w) - window_no * {SIZE - OVERLAP}) AS token_count,
  sha256(array_to_string(w[window_no * {SIZE - OVERLAP} + 1 : window_no * {SIZE - OVERLAP} + {SIZE}], ' ')) AS unit_id FROM win)"""
_SPANS_SQL = f"{_UNITS_SQL}, spans AS (SELECT *, CAST(1 AS BIGINT) AS corpora_id FROM units WHERE doc_id % 3 <> 0 UNION ALL SELECT *, 2 FROM units)"

ORACLE_SQL = {
    "corpus_text_normalize": f"WITH {_TEXTS_SQL} SELECT doc_id, sha256(text) AS digest, length(text) AS chars FROM texts",
    "corpus_text_units": f"WITH {_UNITS_SQL} SELECT doc_id, window_no, token_count, unit_id AS digest FROM units",
    "corpus_unit_dedup": f"WITH {_UNITS_SQL} SELECT unit_id, count(*) AS spans, min(doc_id) AS first_doc FROM units GROUP BY unit_id",
    "corpus_span_windows": f"WITH {_UNITS_SQL} SELECT doc_id, count(*) AS windows, any_value(length(text)) AS end_char, true AS exact FROM units JOIN texts USING (doc_id) GROUP BY doc_id",
    "corpus_statistics": f"WITH {_UNITS_SQL} SELECT count(DISTINCT doc_id) AS texts, count(DISTINCT unit_id) AS units, count(*) AS spans FROM units",
    "corpus_generation_copy": f"WITH {_SPANS_SQL} SELECT CAST(2 AS BIGINT) AS corpora_id, doc_id, count(*) AS spans FROM spans WHERE corpora_id = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY doc_id",
    "corpus_earlier_units": f"WITH {_SPANS_SQL} SELECT DISTINCT unit_id FROM spans WHERE corpora_id = 2 AND unit_id IN (SELECT unit_id FROM spans WHERE corpora_id = 1)",
    "corpus_generation_ready": f"WITH {_SPANS_SQL}, m AS (SELECT count(*) AS missing FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM spans WHERE corpora_id = 1)), s AS (SELECT count(*) AS spans FROM spans WHERE corpora_id = 1) SELECT missing, spans, missing = 0 AND spans > 0 AS ready FROM m, s",
    "corpus_locate_sources": f"WITH {_SPANS_SQL} SELECT s.doc_id, window_no, unit_id, source, lang FROM spans s JOIN documents d ON s.doc_id = d.doc_id WHERE corpora_id = 2 AND unit_id IN (SELECT unit_id FROM spans WHERE corpora_id = 2 AND window_no = 0)",
    "corpus_document_dedup": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies, count(DISTINCT strlen(text)) AS sizes FROM documents WHERE text IS NOT NULL GROUP BY text",
}
