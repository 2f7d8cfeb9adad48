"""Sentence spans by unsupervised training: abbreviations, sentence starters and collocations by log-likelihood (Kiss and Strunk 2006).

Two passes count in the tasks, Spark sums the counts per language and decides by likelihood ratios what is an abbreviation, what starts
sentences and which words belong together over a period; a third pass decides each stop by them. What is learned goes to all
tasks, after a check of its size.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import checkpointed, table

#: Scores from which a type is an abbreviation, a pair a collocation and a type a starter: fixed values of the method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Rows of a learned table that are sent to all tasks at most; more are an error.
MOST_LEARNED = 2_000_000
#: Entries that a task counts before it sends them on.
HELD = 1 << 19
NUMBER = "##number##"
#: Where and how a type was seen: at a sentence's start, inside, or after an uncertain stop; with an upper or a lower case letter first.
START_UPPER, INSIDE_UPPER, UNSURE_UPPER, START_LOWER, INSIDE_LOWER, UNSURE_LOWER = 1, 2, 4, 8, 16, 32
UPPER, LOWER = START_UPPER | INSIDE_UPPER | UNSURE_UPPER, START_LOWER | INSIDE_LOWER | UNSURE_LOWER

_TOKEN = re.compile(r"\S+")
#: From the first character of a word that may end a sentence to the word's end.
_STOP = re.compile(r"[.?!…]\S*")
_OPENERS, _CLOSERS, _AFTER = "\"'([{«“‘„", "\"')]}»”’", "\"')]}»”’,;:"
_NUMBER = re.compile(r"[+-]?\d[\d.,]*")


class Token(NamedTuple):
    """A token of a text: its type (lower case, without its period, numbers as one), whether a period ends it, what else does, and its case."""

    type: str
    period: bool
    ends: bool
    #: ? or !, or an ellipsis
    sure: bool
    ellipsis: bool
    upper: bool
    lower: bool
    initial: bool


@lru_cache(1 << 17)
def _token(raw: str) -> Token:
    letter = raw[:1]
    if raw.isalpha():  # nearly all words are letters, with a period or without
        return Token(raw.lower(), False, True, False, False, letter.isupper(), letter.islower(), False)
    if raw.endswith(".") and raw[:-1].isalpha():
        return Token(raw[:-1].lower(), True, True, False, False, letter.isupper(), letter.islower(), len(raw) == 2)
    core = raw.lstrip(_OPENERS)
    bare = core.rstrip(_AFTER)
    tail = core[len(bare) :]
    ends = not any(x in ",;:" for x in tail)  # a comma after a period says that the sentence goes on
    ellipsis = bare.endswith("...") or bare.endswith("…")
    period = bare.endswith(".") and not ellipsis
    word = bare[:-1] if period else bare.rstrip(".…") if ellipsis else bare.rstrip("?!")
    letter = word[:1]
    type_ = NUMBER if _NUMBER.fullmatch(word) else word.lower()
    return Token(type_, period, ends, bare.endswith(("?", "!")), ellipsis, letter.isupper(), letter.islower(), period and len(word) == 1 and word.isalpha())


def tokens_of(text: str) -> list[Token]:
    """The tokens of a text, which their letters alone decide."""
    return [_token(x) for x in _TOKEN.findall(text)]


def _columns(names: list[str], columns: list) -> Iterator[pa.RecordBatch]:
    """Columns as batches; one value stands for a whole column."""
    rows = max(len(x) for x in columns if not isinstance(x, str | int))
    arrays = [pa.repeat(pa.scalar(x, pa.string() if isinstance(x, str) else pa.int64()), rows) if isinstance(x, str | int) else x for x in columns]
    yield from pa.Table.from_arrays(arrays, names=names).to_batches(1 << 16)


def _strings(values) -> pa.Array:
    return pa.array(list(values), pa.string())


def _numbers(values) -> pa.Array:
    return pa.array(list(values), pa.int64())


def _count_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, type, dotted, plain): how often a type is seen with and without a period. Words are counted as they are written; what they are is asked once for each of a task."""
    found: dict[str, Counter] = defaultdict(Counter)
    names = ["lang", "type", "dotted", "plain"]

    def types() -> Iterator[pa.RecordBatch]:
        for lang, words in found.items():
            dotted, plain = {}, {}
            for raw, n in words.items():
                if raw.isalpha():
                    type_ = raw.lower()
                    plain[type_] = plain.get(type_, 0) + n
                elif (token := _token(raw)).type:
                    of = dotted if token.period else plain
                    of[token.type] = of.get(token.type, 0) + n
            yield from _columns(names, [lang, _strings(dotted), _numbers(dotted.values()), 0])
            yield from _columns(names, [lang, _strings(plain), 0, _numbers(plain.values())])
        found.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            found[lang].update(text.as_py().split())
            if sum(map(len, found.values())) >= HELD:
                yield from types()
    yield from types()


def _stops(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """(between, word, after, inside): each word of a text that has a type and a stop in it, what lies between it and the word before it that was given, the next word that has a type
    (empty: none), and whether the word before has no stop; at last what is left, with an empty word. Words without a type do nothing."""
    begin, at, inside = 0, 0, True
    while stop := _STOP.search(text, at):
        first, end = stop.start(), stop.end()
        while first > at and not text[first - 1].isspace():
            first -= 1
        raw = text[first:end]
        if not _token(raw).type:
            at = end
            continue
        follows = _TOKEN.search(text, end)
        while follows and not _token(follows[0]).type:
            follows = _TOKEN.search(text, follows.end())
        yield text[begin:first], raw, follows[0] if follows else "", inside
        inside = not (follows and _STOP.search(follows[0]))
        begin = at = len(text) if not follows else follows.end() if inside else follows.start()
    yield text[begin:], "", "", True


def _count_context(shared):
    """(lang, kind, a, b, n, seen): `type` a with how it was `seen`; `start`, a begins a sentence; `pair`, b follows the number or initial a; `break`, ends of sentences.

    Only a word with a stop in it and the next one tell more than that a type is seen inside. So the texts are cut at these, the words between go into a set, and what a
    stop and the next word say is asked once for each two of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[str]] = shared.value
        inside: dict[str, set[str]] = defaultdict(set)
        around: dict[str, Counter] = defaultdict(Counter)
        names = ["lang", "kind", "a", "b", "n", "seen"]

        def told() -> Iterator[pa.RecordBatch]:
            for lang in inside.keys() | around.keys():
                seen: dict[str, int] = {}
                for raw in inside[lang]:
                    if raw.isalpha():
                        type_, upper, lower = raw.lower(), raw[0].isupper(), raw[0].islower()
                    else:
                        type_, upper, lower = (token := _token(raw)).type, token.upper, token.lower
                    if type_ and (upper or lower):
                        seen[type_] = seen.get(type_, 0) | (INSIDE_UPPER if upper else INSIDE_LOWER)
                counts: Counter = Counter()
                abbreviations = known.get(lang, set())
                for (raw, after), n in around[lang].items():
                    token = _token(raw)
                    if token.ends and (token.sure or token.period and token.type not in abbreviations):
                        counts["break", "", ""] += n
                        where = UNSURE_UPPER if token.initial or token.type == NUMBER else START_UPPER
                    else:
                        where = UNSURE_UPPER if token.ends and (token.period or token.ellipsis) else INSIDE_UPPER
                    if not after:
                        continue
                    follows = _token(after)
                    if follows.upper or follows.lower:
                        seen[follows.type] = seen.get(follows.type, 0) | (where if follows.upper else where << 3)
                    if token.ends and token.period:
                        if token.initial or token.type == NUMBER:
                            counts["pair", token.type, follows.type] += n
                        elif token.type not in abbreviations:
                            counts["start", follows.type, ""] += n
                yield from _columns(names, [lang, "type", _strings(seen), "", 0, _numbers(seen.values())])
                yield from _columns(names, [lang, *(_strings(x[i] for x in counts) for i in range(3)), _numbers(counts.values()), 0])
            inside.clear()
            around.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words, pairs = inside[lang], around[lang]
                for between, raw, after, within in _stops(text.as_py()):
                    words.update(between.split())
                    if raw:
                        pairs[raw, after] += 1
                    if raw and within:
                        words.add(raw)
                if sum(map(len, inside.values())) + sum(map(len, around.values())) >= HELD:
                    yield from told()
        yield from told()

    return run


def _times_log(n: Column, p: Column) -> Column:
    """n log p, 0 if n is 0."""
    return F.when(n == 0, F.lit(0.0)).otherwise(n * F.log(p))


def _likelihood_ratio(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Dunning's -2 log lambda that b follows a by more than chance; counts of a, b, a then b, and of all."""
    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    alone = lambda x, of, q: _times_log(x, q) + _times_log(of - x, 1 - q)
    return -2 * (alone(both, a, p) + alone(b - both, n - a, p) - alone(both, a, p1) - alone(b - both, n - a, p2))


@dataclass(frozen=True)
class Stops:
    """What was learned, by language."""

    abbreviations: dict[str, set[str]]
    starters: dict[str, set[str]]
    collocations: dict[str, set[tuple[str, str]]]
    #: How types were seen that come after an abbreviation, an initial, a number or an ellipsis, or may do so.
    seen: dict[str, dict[str, int]]


def _learned(rows: DataFrame) -> list:
    if (n := rows.count()) > MOST_LEARNED:
        raise ValueError(f"{n} rows were learned, {MOST_LEARNED} may be")
    return rows.collect()


def _by_lang(rows: list, value, make) -> dict:
    out: dict = {}
    for row in rows:
        out.setdefault(row["lang"], []).append(value(row))
    return {lang: make(found) for lang, found in out.items()}


def abbreviations(types: DataFrame) -> DataFrame:
    """(lang, type, score) of the abbreviations among types (lang, type, dotted, plain).

    The likelihood ratio that a period comes with the type nearly always, rather than as often as with any other, is raised for
    inner periods and lowered by length, and by each time that the type is seen without one.
    """
    totals = types.groupBy("lang").agg(F.sum(F.col("dotted") + F.col("plain")).alias("n"), F.sum("dotted").alias("periods"))
    rows = types.where("dotted > 0").where(F.col("type").rlike(r"\p{L}") & (F.col("type") != NUMBER)).join(totals, "lang")
    dotted, plain, p = F.col("dotted"), F.col("plain"), F.col("periods") / F.col("n")
    chance, nearly_always = _times_log(dotted, p) + _times_log(plain, 1 - p), _times_log(dotted, F.lit(0.99)) + _times_log(plain, F.lit(0.01))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    size = F.length("type") - inner
    score = -2 * (chance - nearly_always) * F.exp(-size) * (inner + 1) * F.pow(size.cast("double"), -plain)
    return rows.select("lang", "type", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def train(texts: DataFrame) -> Stops:
    """Learns from texts (lang, text), each language by itself; rows with a null in either are left out, a null language by the caller."""
    usable = texts.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    types = checkpointed(usable.mapInArrow(_count_types, "lang string, type string, dotted long, plain long").groupBy("lang", "type").agg(F.sum("dotted").alias("dotted"), F.sum("plain").alias("plain")))
    known = _by_lang(_learned(abbreviations(types)), lambda x: x["type"], set)
    shared = texts.sparkSession.sparkContext.broadcast(known)
    context = usable.mapInArrow(_count_context(shared), "lang string, kind string, a string, b string, n long, seen long")
    context = checkpointed(context.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"), F.bit_or("seen").alias("seen")))
    counts = types.select("lang", F.col("type").alias("a"), (F.col("dotted") + F.col("plain")).alias("count"))
    totals = counts.groupBy("lang").agg(F.sum("count").alias("total"))
    breaks = context.where("kind = 'break'").select("lang", F.col("n").alias("breaks"))
    starts = context.where("kind = 'start'").select("lang", "a", F.col("n").alias("both")).join(counts, ["lang", "a"]).join(breaks, "lang").join(totals, "lang")
    ratio = _likelihood_ratio(F.col("breaks"), F.col("count"), F.col("both"), F.col("total"))
    starters = starts.where((F.col("total") > F.col("breaks")) & (F.col("both") <= F.col("breaks"))).where((ratio >= STARTER) & (F.col("total") * F.col("both") > F.col("count") * F.col("breaks"))).select("lang", "a")
    pairs = context.where("kind = 'pair' AND n > 1").select("lang", "a", "b", F.col("n").alias("both")).join(counts, ["lang", "a"]).join(counts.toDF("lang", "b", "count_b"), ["lang", "b"]).join(totals, "lang")
    ratio = _likelihood_ratio(F.col("count"), F.col("count_b"), F.col("both"), F.col("total"))
    collocations = pairs.where((F.col("total") > F.col("count")) & (ratio >= COLLOCATION) & (F.col("total") * F.col("both") > F.col("count") * F.col("count_b"))).select("lang", "a", "b")
    # only types that are seen in both cases, or in upper case inside a sentence, tell anything
    seen = context.where("kind = 'type'").select("lang", "a", "seen").where((F.col("seen").bitwiseAND(UPPER) != 0) & (F.col("seen").bitwiseAND(LOWER) != 0) | (F.col("seen").bitwiseAND(START_LOWER) != 0))
    return Stops(
        known, _by_lang(_learned(starters), lambda x: x["a"], set), _by_lang(_learned(collocations), lambda x: (x["a"], x["b"]), set),
        _by_lang(_learned(seen), lambda x: (x["a"], x["seen"]), dict),
    )


def _by_case(token: Token, seen: dict[str, int]) -> bool | None:
    """Whether the case of the token after a stop says that it starts a sentence; None if it says neither."""
    of = seen.get(token.type, 0)
    if token.upper and of & LOWER and not of & INSIDE_UPPER:
        return True
    if token.lower and (of & UPPER or not of & START_LOWER):
        return False
    return None


def _is_end(raw: str, following: str, lang: str | None, stops: Stops) -> bool:
    """Whether a sentence ends with a word that another one follows, which has a type."""
    abbreviations, starters, collocations, seen = (x.get(lang, y) for x, y in ((stops.abbreviations, set()), (stops.starters, set()), (stops.collocations, set()), (stops.seen, {})))
    token, after = _token(raw), _token(following)
    if not (token.sure or token.period or token.ellipsis) or not token.ends:
        return False
    if token.sure:
        return True
    if (token.type, after.type) in collocations:
        return False
    case = _by_case(after, seen)
    if token.ellipsis or token.period and token.type in abbreviations and not token.initial:
        return case is True or after.upper and after.type in starters
    if token.initial or token.type == NUMBER:
        return case is not False and not (case is None and token.initial and after.upper and not seen.get(after.type, 0) & LOWER)
    return True


def decisions(stops: Stops):
    """(word, following word, language) -> whether a sentence ends between them; what was asked before is remembered."""
    return lru_cache(1 << 17)(lambda raw, following, lang: _is_end(raw, following, lang, stops))


def sentence_ends(text: str, lang: str | None, stops: Stops, decide=None) -> list[int]:
    """Where the text's sentences end, the last one's end included. decide: `decisions` of the stops, if there are many texts."""
    decide = decide or decisions(stops)
    out, last = [], 0
    for stop in _STOP.finditer(text):
        first, end = stop.start(), stop.end()
        while first > last and not text[first - 1].isspace():
            first -= 1
        last = end
        after = _TOKEN.search(text, end)
        if after and not _token(after[0]).type:  # one word without a type may lie between
            after = _TOKEN.search(text, after.end())
        if after and _token(after[0]).type and decide(text[first:end], after[0], lang):
            out.append(end)
    return [*out, len(text)]


def trained_spans(texts: DataFrame, stops: Stops) -> DataFrame:
    """(doc_id, sentence_no, start_char, end_char): sentences of texts (doc_id, lang, text) as code-point ranges, ends inclusive.

    A text of a language that nothing was learned for is cut at every stop that isn't an initial's. Null and blank texts have none.
    """
    shared = texts.sparkSession.sparkContext.broadcast(stops)
    names, kinds = ["doc_id", "sentence_no", "start_char", "end_char"], [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = decisions(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                part = batch.slice(at, 200)
                for doc_id, lang, text in zip(*(part.column(x).to_pylist() for x in ("doc_id", "lang", "text")), strict=True):
                    begin, number = 0, 0
                    for end in sentence_ends(text or "", lang, shared.value, decide):
                        piece = (text or "")[begin:end]
                        if inner := piece.strip():
                            first = begin + len(piece) - len(piece.lstrip())
                            rows.append((doc_id, number, first, first + len(inner) - 1))
                            number += 1
                        begin = end
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    return texts.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, sentence_no long, start_char long, end_char long")


def corpus_trained_sentences(spark, sf_dir):
    """Sentences of all documents, by what all documents of their language teach."""
    documents = table(spark, sf_dir, "documents")
    # a file may be one row group, which one task reads: texts are dealt once to all tasks, which read them three times
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    documents = checkpointed(documents.select("doc_id", "lang", "text").repartition(tasks, "doc_id"))
    return trained_spans(documents, train(documents))


QUERIES = {"corpus_trained_sentences": corpus_trained_sentences}
ORACLE_SQL: dict[str, str] = {}
