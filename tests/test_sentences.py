"""Trained sentence spans: texts with abbreviations, and the training against plain counts."""

import math
import random
from collections import Counter

import pytest

from sparkloom.operators import sentences as S

FOLDER = "/root/testdata/sf0.001"


def news(rng, n):
    """Prose in which titles, units and shortened words carry periods, mid-sentence and before names."""
    names = ["Miller", "Jones", "Adams", "Baker", "Clark"]
    verbs = ["met", "saw", "paid", "called", "joined"]
    things = ["summer", "spring", "the days", "the board", "a friend", "the company", "her team", "the mayor"]
    starts = ["The", "It", "She", "However,", "They"]
    out = []
    for _ in range(n):
        kind = rng.randrange(5)
        if kind == 0:
            out.append(f"Dr. {rng.choice(names)} {rng.choice(verbs)} {rng.choice(things)}.")
        elif kind == 1:
            out.append(f"{rng.choice(starts)} {rng.choice(verbs)} {rng.choice(things)}, e.g. on holidays in summer and spring days.")
        elif kind == 2:
            out.append(f"{rng.choice(starts)} {rng.choice(verbs)} Mr. {rng.choice(names)} of Acme Corp. in {rng.randint(1, 28)} days of spring and summer.")
        elif kind == 3:
            out.append(f"{rng.choice(starts)} said that {rng.choice(things)} {rng.choice(verbs)} {rng.choice(things)}!")
        else:
            out.append(f"{rng.choice(starts)} {rng.choice(verbs)} {rng.choice(things)}. Was it {rng.choice(things)}?")
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    rows = [(i, "en", news(rng, 30)) for i in range(40)]
    german = ["Hunde gehen im Sommer nach Hause wie alt und jung.", "Im Sommer sind Hunde gern zu Hause und alt dazu, ja.", "Ja sagt der Mann da.", "Er ist da und sagt ja dazu.", "Dazu sagt jung und alt nichts.", "Nichts ist jung.", "Das ist z.B. ein Haus am See.", "Der Mann geht heute nach Hause.", "Wir sehen z.B. Katzen und Hunde.", "Das Haus ist alt.", "Der See liegt bei der Stadt, z.B. im Sommer."]
    rows += [(100 + i, "de", " ".join(rng.choice(german) for _ in range(30))) for i in range(20)]
    return [*rows, (200, None, "No language. Two sentences."), (201, "en", None), (202, "en", " \n "), (203, "en", ""), (204, "xx", "Nothing learned here. By J. Smith... or so. Yes.")]


SCHEMA = "doc_id long, lang string, text string"


def test_abbreviations_do_not_end_sentences(spark, corpus):
    frame = spark.createDataFrame(corpus, SCHEMA).repartition(4)
    stops = S.train(frame)
    assert {"dr", "mr", "e.g"} <= stops.abbreviations["en"] and "z.b" in stops.abbreviations["de"]
    assert not {"board", "mayor", "see", "alt"} & (stops.abbreviations["en"] | stops.abbreviations["de"])
    probe = [(1, "en", "Dr. Adams met the board. It paid a friend, e.g. in spring. She saw Mr. Clark."), (2, "de", "Das ist z.B. ein Haus. Der See ist alt."), (3, "en", 'He said "the board met." They joined (the team.) J. Miller called?! The end')]
    spans = S.trained_spans(spark.createDataFrame(probe, SCHEMA), stops).orderBy("doc_id", "sentence_no").collect()
    cut = {i: [text[x.start_char : x.end_char + 1] for x in spans if x.doc_id == i] for i, _, text in probe}
    assert cut[1] == ["Dr. Adams met the board.", "It paid a friend, e.g. in spring.", "She saw Mr. Clark."]
    assert cut[2] == ["Das ist z.B. ein Haus.", "Der See ist alt."]
    assert cut[3] == ['He said "the board met."', "They joined (the team.)", "J. Miller called?!", "The end"]


def likelihood(a, b, both, n):
    def part(x, of, p):
        return (x * math.log(p) if x else 0.0) + ((of - x) * math.log(1 - p) if of - x else 0.0)

    p, p1, p2 = b / n, both / a, (b - both) / (n - a)
    return -2 * (part(both, a, p) + part(b - both, n - a, p) - part(both, a, p1) - part(b - both, n - a, p2))


def trained_by_hand(rows):
    """The same decisions from counts in plain Python."""
    found = {}
    for lang in {lang for _, lang, text in rows if lang is not None and text is not None}:
        texts = [S.tokens_of(text) for _, of, text in rows if of == lang and text is not None]
        texts = [[t for t in tokens if t.type] for tokens in texts]
        dotted, plain = Counter(t.type for x in texts for t in x if t.period), Counter(t.type for x in texts for t in x if not t.period)
        n, periods = sum(dotted.values()) + sum(plain.values()), sum(dotted.values())
        short = set()
        for word, c in dotted.items():
            if word == S.NUMBER or not any(x.isalpha() for x in word):
                continue
            p, without, inner = periods / n, plain[word], word.count(".")
            size = len(word) - inner
            log = lambda k, q: k * math.log(q) if k else 0.0
            ratio = -2 * (log(c, p) + log(without, 1 - p) - log(c, 0.99) - log(without, 0.01))
            if ratio * math.exp(-size) * (inner + 1) * float(size) ** -without >= S.ABBREVIATION:
                short.add(word)
        starts, pairs, breaks, seen = Counter(), Counter(), 0, Counter()
        for tokens in texts:
            where = S.INSIDE_UPPER
            for i, t in enumerate(tokens):
                seen[t.type] |= where if t.upper else where << 3 if t.lower else 0
                before = tokens[i - 1] if i else None
                if before and before.ends and before.period:
                    uncertain = before.initial or before.type == S.NUMBER
                    pairs[before.type, t.type] += uncertain
                    starts[t.type] += not uncertain and before.type not in short
                full = t.ends and (t.sure or t.period and t.type not in short)
                breaks += full
                if full:
                    where = S.UNSURE_UPPER if t.initial or t.type == S.NUMBER else S.START_UPPER
                else:
                    where = S.UNSURE_UPPER if t.ends and (t.period or t.ellipsis) else S.INSIDE_UPPER
        count = dotted + plain
        starters = {w for w, k in starts.items() if k and k <= breaks < n and n * k > count[w] * breaks and likelihood(breaks, count[w], k, n) >= S.STARTER}
        together = {x for x, k in pairs.items() if k > 1 and n > count[x[0]] and n * k > count[x[0]] * count[x[1]] and likelihood(count[x[0]], count[x[1]], k, n) >= S.COLLOCATION}
        found[lang] = short, starters, together, {w: f for w, f in seen.items() if f & S.UPPER and f & S.LOWER or f & S.START_LOWER}
    return found


def spread(stops):
    langs = set().union(*(x.keys() for x in (stops.abbreviations, stops.starters, stops.collocations, stops.seen)))
    return {lang: (stops.abbreviations.get(lang, set()), stops.starters.get(lang, set()), stops.collocations.get(lang, set()), stops.seen.get(lang, {})) for lang in langs}


def test_training_against_plain_counts(spark, corpus, monkeypatch):
    monkeypatch.setattr(S, "HELD", 50)  # many partial counts
    got = spread(S.train(spark.createDataFrame(corpus, SCHEMA).repartition(7)))
    want = trained_by_hand(corpus)
    assert got == {lang: x for lang, x in want.items() if any(x)}


def test_query_against_plain_python(spark):
    rows = [(x.doc_id, x.lang, x.text) for x in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = trained_by_hand(rows)
    stops = S.Stops(*({lang: x[i] for lang, x in want.items()} for i in range(4)))
    spans = set()
    for doc_id, lang, text in rows:
        begin, number = 0, 0
        for end in S.sentence_ends(text or "", lang, stops):
            inner = (text or "")[begin:end].strip()
            if inner:
                first = text.index(inner, begin)
                spans.add((doc_id, number, first, first + len(inner) - 1))
                number += 1
            begin = end
    assert {tuple(x) for x in S.corpus_trained_sentences(spark, FOLDER).collect()} == spans


def test_too_much_learned_is_an_error(spark, corpus, monkeypatch):
    monkeypatch.setattr(S, "MOST_LEARNED", 1)
    with pytest.raises(ValueError, match="may be"):
        S.train(spark.createDataFrame(corpus, SCHEMA))
