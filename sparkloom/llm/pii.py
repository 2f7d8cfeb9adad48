"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; these are the seeds. The words around
a seed are lexical patterns of its kind: one word on each side, two before, two after. Other runs of tokens that aren't
plain words are candidates, of no kind: they are of the kind of the patterns whose slot they fill. Spark scores the graph of patterns and
instances in rounds. A candidate starts with its likeness to the seeds of the kind (make-up of characters, and length), a
pattern is as good as the mean score of all that fills its slot, plain words included, which a second pass over the texts counts for the
patterns that seeds and candidates share; an instance is as good as its likeness and the patterns it is found in together. Patterns of
high confidence that several seeds support then discover instances of their kind that no base pattern matches.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed, read

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
#: Least score of a pattern, least distinct seeds that support it, and least score of a discovered instance.
LEAST_PATTERN, LEAST_SEEDS, LEAST_INSTANCE = 0.6, 3, 0.35
#: A candidate has at most so many tokens, and a number of characters between these.
MOST_TOKENS, LEAST_CHARS, MOST_CHARS = 4, 5, 256
#: 2^BITS bits tell which contexts the second pass counts; more patterns than fit make it count some in vain.
BITS = 23
#: A longer word stands in a pattern by its checksum and length.
LONG_WORD = 64

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'[]{}<>*#$%&"
#: A plain word: letters, with hyphens or apostrophes between them.
_PLAIN = re.compile(r"(?:[^\W\d_]+(?:['’-][^\W\d_]+)*)?")


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from their @: a local part is the run of its characters before one."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the IP pattern: of a chain of numbers joined by dots each four in order, if they are at most 255."""
    found = []
    for m in _NUMBERS.finditer(text):
        if m[0].count(".") < 3:
            continue
        numbers, at = m[0].split("."), m.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_at_most_255, four)):
                found.append((at, end))
            at = end + 1
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every base match, sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        found += [(a, 1, b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= x <= "9" for x in m[0]) <= 15]
    return sorted(found)


def _at_most_255(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def _inner(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its edges; brackets go with their partners."""
    while start < end:
        if text[start] in _EDGES or (text[start] == "(" and ")" not in text[start:end]) or text[start] == ")":
            start += 1
        elif text[end - 1] in _EDGES or (text[end - 1] == ")" and "(" not in text[start:end]) or text[end - 1] == "(":
            end -= 1
        else:
            break
    return start, end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of runs of neighbouring tokens that aren't plain words, outside base matches."""
    found, run = [], []
    spans = [(a, b) for a, _, b in base]
    starts, ends = sorted(a for a, _ in spans), sorted(b for _, b in spans)

    def close() -> None:
        if 0 < len(run) <= MOST_TOKENS and run[-1][1] - run[0][0] <= MOST_CHARS:
            start, end = _inner(text, run[0][0], run[-1][1])
            if end - start >= LEAST_CHARS and not _PLAIN.fullmatch(text, start, end):
                found.append((start, end))
        run.clear()

    for m in _TOKEN.finditer(text):
        if m[0].strip(_EDGES).isalpha():  # most tokens are plain at a glance
            if run:
                close()
            continue
        a, b = m.span()
        outside = bisect_left(starts, b) == bisect_right(ends, a)  # no base match reaches into the token
        start, end = _inner(text, a, b) if b - a <= MOST_CHARS else (a, b)
        if outside and start < end and not _PLAIN.fullmatch(text, start, end):
            run.append((a, b))
        else:
            close()
    close()
    return found


def _word(word: str) -> str:
    return word if len(word) <= LONG_WORD else f"{crc32(word.encode('utf-8', 'surrogatepass')):08x}:{len(word)}"


def patterns_around(text: str, tokens: list[tuple[int, int]], start: int, end: int) -> list[str]:
    """The lexical patterns of an instance: one word on each side, two before, two after. What a token holds before or after the instance is a word."""
    first, last = bisect_right(tokens, (start, len(text))) - 1, bisect_left(tokens, (end, 0)) - 1
    left = [text[a:b] for a, b in tokens[max(0, first - 2) : first]] + ([text[tokens[first][0] : start]] if tokens[first][0] < start else [])
    right = ([text[end : tokens[last][1]]] if end < tokens[last][1] else []) + [text[a:b] for a, b in tokens[last + 1 : last + 3]]
    left, right = ["^", "^", *(_word(x.lower()) for x in left)][-2:], [*(_word(x.lower()) for x in right), "$", "$"][:2]
    return [f"0 {left[1]} {right[0]}", f"1 {left[0]} {left[1]}", f"2 {right[0]} {right[1]}"]


def _mixed(form: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of patterns in the bits, from their words' checksums."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(form)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)


def make_up(instance: str) -> list[float]:
    """Shares of letters, digits and other characters, and the length's logarithm."""
    letters, digits = sum(map(str.isalpha, instance)), sum(map(str.isdigit, instance))
    n = max(1, len(instance))
    return [letters / n, digits / n, (n - letters - digits) / n, float(np.log(n))]


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_SEEN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("instance", pa.string()), ("made", pa.list_(pa.float64())), ("patterns", pa.list_(pa.string()))])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, seen = [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
            both = [*((a, k, b) for a, k, b in base), *((a, None, b) for a, b in candidates(text, base))]
            tokens = [m.span() for m in _TOKEN.finditer(text)] if both else []
            seen.append([{"start": a, "kind": k, "end": b, "instance": _word(text[a:b].lower()), "made": make_up(text[a:b]), "patterns": patterns_around(text, tokens, a, b)} for a, k, b in both])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))], names=["doc_id", "base", "seen"])


_EXTRACTED = "doc_id long, base array<struct<start: long, kind: int, end: long>>, seen array<struct<start: long, kind: int, end: long, instance: string, made: array<double>, patterns: array<string>>>"


def pattern_bits(patterns: DataFrame) -> np.ndarray:
    """The bits of all patterns: a table of fixed size, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            for form, a, b in (x.split(" ") for x in batch.column("pattern").to_pylist()):
                bits[_mixed(int(form), *(np.array([crc32(w.encode("utf-8", "surrogatepass"))]) for w in (a, b)))] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    parts = patterns.select("pattern").distinct().coalesce(4).mapInArrow(run, "bits binary").collect()
    return np.unpackbits(np.bitwise_or.reduce([np.frombuffer(x["bits"], np.uint8) for x in parts])).astype(bool)


class _Checksums(dict):
    """CRC-32 of words, remembered up to a number of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        found = self[word] = crc32(_word(word).encode("utf-8", "surrogatepass"))
        return found


def plain_fills(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(pattern, plain): how often a plain word fills the slot of a pattern that the bits let through; each task adds up its own."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Checksums()
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text"):
                words = _TOKEN.findall((text.as_py() or "").lower())
                if not words:
                    continue
                padded = ["^", "^", *words, "$", "$"]
                sums = np.fromiter(map(known.__getitem__, padded), np.int64, len(padded))
                sides = [(sums[1:-3], sums[3:-1], 1, 3), (sums[:-4], sums[1:-3], 0, 1), (sums[3:-1], sums[4:], 3, 4)]
                for form, (a, b, x, y) in enumerate(sides):
                    for i in np.flatnonzero(shared.value[_mixed(form, a, b)]).tolist():
                        if _PLAIN.fullmatch(words[i].strip(_EDGES + "()")):
                            counts[f"{form} {_word(padded[i + x])} {_word(padded[i + y])}"] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "plain"])

    return docs.select("text").mapInArrow(run, "pattern string, plain long").groupBy("pattern").agg(F.sum("plain").alias("plain"))


def _likeness(made: str, mean: str) -> Column:
    """1 less the difference of the make-ups, times the ratio of the lengths: 1 for what is made and as long as the mean seed."""
    at = lambda column, i: F.element_at(column, i)
    differs = sum((F.abs(at(made, i) - at(mean, i)) for i in (1, 2, 3)), F.lit(0.0)) / 2
    return (1 - differs) * F.exp(-F.abs(at(made, 4) - at(mean, 4)))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """edges: (kind, pattern, instance, likeness (1: a seed), seed, plain), distinct by kind, pattern and instance.

    Returns scores of patterns (kind, pattern, score, seeds) and of instances (kind, instance, score).
    """
    instances = edges.groupBy("kind", "instance").agg(F.max("likeness").alias("score"))
    for _ in range(rounds):
        scored = edges.join(instances, ["kind", "instance"])
        score = F.sum("score") / (F.count("*") + F.max("plain"))
        patterns = checkpointed(scored.groupBy("kind", "pattern").agg(score.alias("pattern_score"), F.count_if("seed").alias("seeds")))
        # only well supported patterns speak for an instance, and no single one settles it
        voice = F.when(F.col("seeds") >= LEAST_SEEDS, F.col("pattern_score")).otherwise(F.lit(0.0))
        spoken = edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("seed").alias("seed"), F.max("likeness").alias("likeness"), F.sum(F.log1p(-0.95 * voice)).alias("doubt"))
        instances = checkpointed(spoken.select("kind", "instance", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("likeness") * (1 - F.exp("doubt"))).alias("score")))
    return patterns.withColumnRenamed("pattern_score", "score"), instances


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Base and discovered spans of personal data in every whole text.

    docs: doc_id, text; other columns are ignored. Returns one row per input row: doc_id, base and
    discovered, arrays of (start, kind, end) in code points, ends exclusive, in order; kind numbers KINDS.
    Null text is empty and has no spans. Rows that repeat a doc_id have the spans of each row's own text. An instance that
    fits several kinds equally is of the first. Long texts are read whole, by one task each. An empty table gives no rows.
    """
    rows = checkpointed(docs.select("doc_id", "text").mapInArrow(_extract, _EXTRACTED).withColumn("row_no", F.monotonically_increasing_id()))
    seen = rows.select("row_no", F.explode("seen").alias("x")).select("row_no", "x.*")
    pairs = seen.select("row_no", "start", "kind", "end", "instance", "made", F.explode("patterns").alias("pattern"))
    seeds, others = pairs.where("kind IS NOT NULL"), pairs.where("kind IS NULL").drop("kind")
    # a pattern counts if several seeds support it and a candidate is found in it: others can discover nothing
    supported = seeds.groupBy("kind", "pattern").agg(F.count_distinct("instance").alias("seeds")).where(F.col("seeds") >= LEAST_SEEDS).drop("seeds")
    useful = checkpointed(supported.join(others.select("pattern").distinct(), "pattern", "left_semi"))
    empty = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    if useful.isEmpty():
        return rows.select("doc_id", "base", empty.alias("discovered"))
    plain = plain_fills(docs, pattern_bits(useful))
    useful = checkpointed(useful.join(plain, "pattern", "left").select("kind", "pattern", F.coalesce("plain", F.lit(0)).alias("plain")))
    mean = seeds.select("kind", "instance", "made").groupBy("kind").agg(F.array(*[F.avg(F.element_at("made", i)) for i in (1, 2, 3, 4)]).alias("mean"))  # a row per kind
    slots = others.join(useful, "pattern").join(mean, "kind").withColumn("likeness", _likeness("made", "mean"))
    known = seeds.join(useful, ["kind", "pattern"]).select("kind", "pattern", "instance", F.lit(1.0).alias("likeness"), F.lit(True).alias("seed"), "plain")
    rest = slots.select("kind", "pattern", "instance", "likeness", F.lit(False).alias("seed"), "plain")
    edges = known.unionByName(rest).groupBy("kind", "pattern", "instance").agg(F.max("likeness").alias("likeness"), F.max("seed").alias("seed"), F.first("plain").alias("plain"))
    patterns, instances = score_patterns(checkpointed(edges))
    trusted = patterns.where((F.col("score") >= LEAST_PATTERN) & (F.col("seeds") >= LEAST_SEEDS)).select("kind", "pattern")
    likely = instances.where(F.col("score") >= LEAST_INSTANCE)
    found = slots.join(trusted, ["kind", "pattern"], "left_semi").join(likely, ["kind", "instance"])
    best = found.groupBy("row_no", "start", "end").agg(F.min(F.struct((-F.col("score")).alias("worse"), "kind")).alias("best"))
    spans = best.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("start", "best.kind", "end"))).alias("discovered"))
    return rows.select("row_no", "doc_id", "base").join(spans, "row_no", "left").select("doc_id", "base", F.coalesce("discovered", empty).alias("discovered"))


def _is(kind: int):
    return lambda x: x == kind


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    name = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.sort_array(F.concat("base", "discovered"))).alias("spans"), F.size("discovered").cast("long").alias("n_discovered"))


QUERIES = {"op7_pii": op7_pii}
ORACLE_SQL: dict[str, str] = {}
