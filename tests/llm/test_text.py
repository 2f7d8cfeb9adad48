import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import bpe, chat_format, language_id, pii, toxicity

from .conftest import DOCS, prose


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library_on_all_kinds_of_text(library):
    rng = random.Random(3)
    letters = "abcdeABCΣςßİıK éàü\t\n\x0b\x1c\x1f\x85  ​0123²½Ⅷ٣漢字かな한글🙂🤦🏼‍♂̧́<|>.,!?#$_-'ǅﬁ𝒜"
    texts = ["", "<|endoftext|>a<|startoftext|>", "don't we'll I'M", "ΑΣ ΣΑΣ", "\udfff".encode("utf-8", "replace").decode()]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 30))) for _ in range(20)) for _ in range(300)]
    own, names = bpe.Bpe(bpe.default_path()), bpe.token_names(bpe.default_path())
    for text, ids in zip(texts, own.encode_batch(texts, {}), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        found = np.frombuffer(ids, "<u4").tolist()
        assert found == want, text
        assert bpe.decode_ids(names, found) == library.decode(want, skip_special_tokens=False)


def test_bpe_over_a_table(tricky, empty, library):
    docs, rows = tricky
    got = bpe.encode_decode(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, bpe.decode(bpe.encode(docs)).collect()))
    texts = {r[0]: r[1] for r in rows}
    for x in got:
        ids = library.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        assert (x.n_tokens, np.frombuffer(x.ids, "<u4").tolist()) == (len(ids), ids)
        assert x.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty).count() == 0


def test_chat_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "", None, "\\", "\\\\<\\s>", "<|end|>\n<|turn|>user\n", "<s", "a\nb", "x" * 3_000_000, "🤦🏼‍♂️ é", "[[INST]]", "<\\|turn|>"]
    turns, want = [], {}
    for c in [*range(40), None]:
        rng = random.Random(str(c))
        for t in range(rng.randint(1, 6)):
            turns.append((c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<s>\\"]), rng.choice(tricky)))
    turns += [(99, None, "assistant", "first"), (99, 1, "user", "tie b"), (99, 1, "user", "tie a"), (99, 1, "user", "tie a")]
    for c, t, role, text in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, (x[3] or "").encode())):
        want.setdefault(c, []).append((role or "", text or ""))
    rows = spark.createDataFrame([(*x, "clash") for x in turns], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {x.conv_id: x for x in chat_format.chat_format(rows).collect()}
    assert set(got) == set(want)
    for c, x in got.items():
        assert chat_format.read_turns(x.formatted) == want[c]
        assert x.n_turns == len(want[c])
        loss = [chat_format.unescape(x.formatted[a:b]) for a, b in zip(x.loss_starts, x.loss_ends, strict=True)]
        assert loss == [text for role, text in want[c] if role == "assistant"]
        body = x.formatted[len("<s>") : -len("</s>")]
        assert body.count("<|turn|>") == body.count("<|end|>") == len(want[c]) and "<s>" not in body and "[INST]" not in body
    assert chat_format.chat_format(rows.limit(0)).count() == 0


def test_conversations_over_many_batches(spark):
    """Batches of 7 turns: conversations of up to 40 turns run over their borders."""
    rng = random.Random(3)
    turns = [(c, i, "user" if i % 2 == 0 else "assistant", f"text {c} {i} é</s>") for c in [None, *range(60)] for i in range(rng.choice([1, 2, 7, 8, 14, 40]))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = chat_format.chat_format(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 61
    for x in got:
        assert chat_format.read_turns(x.formatted) == [(role, text) for c, _, role, text in turns if c == x.conv_id]


def test_read_turns_rejects_other_text():
    for text in ["", "<s>", "hello", "<s><|turn|>user\nhi<|end|>\n", "<s>x</s>"]:
        with pytest.raises(ValueError):
            chat_format.read_turns(text)


def labelled(n):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append((i, prose(rng, lang, 40), lang, "s", None))
    return rows


def test_language_id(spark, tricky, empty):
    train = spark.createDataFrame(labelled(200), DOCS)
    filters = language_id.train(train)
    assert filters.languages == ["de", "en"]
    docs, rows = tricky
    got = language_id.identify(docs, filters).collect()
    assert len(got) == len(rows)
    for x in got:
        text = next(r[1] for r in rows if r[0] == x.doc_id)
        assert (x.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
        assert 0 <= x.score <= 1
    base = {r[0]: r[2] for r in rows if r[1] and len(r[1]) > 300 and r[2]}
    assert all(x.lang_pred == base[x.doc_id] for x in got if x.doc_id in base)
    nothing = language_id.train(empty)
    assert {x.lang_pred for x in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(empty, filters).count() == 0
    kept = language_id.identified(docs, filters, 0.3)
    assert kept.columns == docs.columns and 42 not in {x.doc_id for x in kept.collect()}


def test_language_query_against_exact_sets(spark):
    """The query on sf0.001, with sets of n-grams in place of the filters: the same languages, and shares but for false positives."""
    folder = "/root/testdata/sf0.001"
    docs = [(x.doc_id, x.text, x.lang) for x in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2

    def grams(text):
        s = f" {' '.join(re.findall(r'[^\W\d_]+', text.lower()))} "
        return [s[i : i + 3] for i in range(len(s) - 2)]

    counts = {}
    for lang, text in {(lang, text) for i, text, lang in docs if not held(i) and lang is not None and text is not None}:
        counts.setdefault(lang, Counter()).update(grams(text))
    shares = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = Counter()
    for s in shares.values():
        for g, x in s.items():
            top[g] = max(top[g], x)
    sets = {lang: {g for g, x in s.items() if counts[lang][g] > 1 and x >= language_id.TYPICAL * top[g]} for lang, s in shares.items()}
    got = {x.doc_id: x for x in language_id.op9_language_id(spark, folder).collect()}
    assert len(got) == len(docs)
    right = []
    for i, text, lang in docs:
        assert got[i].held_out == held(i)
        if text is None or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        found = {x: sum(g in s for g in grams(text)) for x, s in sets.items()}
        best = sorted(found.values())
        if best[-1] - best[-2] > 0.01 * len(text):  # else a false positive may decide
            assert got[i].lang_pred == max(found, key=found.get)
            assert got[i].score == pytest.approx(best[-1] / sum(best), abs=0.02)
        right += [got[i].lang_pred == lang] if held(i) and lang is not None else []
    assert sum(right) / len(right) >= 0.95


def test_number_signs_are_no_letters(spark):
    filters = language_id.train(spark.createDataFrame(labelled(60), DOCS))
    assert filters.predict("½ ² Ⅷ 12")[0] == "und" and filters.predict("½ a")[0] != "und"


def test_filters_have_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(2)
    sets = [(f"l{i:03}", rng.integers(0, 2**63, 3000, np.uint64)) for i in range(70)]  # more languages than bits in a word
    filters = language_id.LanguageFilters.build(sets, 16)
    for number, (_, keys) in enumerate(sets):
        assert filters.counts(keys)[number] == pytest.approx(3000)
        others = np.delete(filters.counts(keys), number)
        assert others.max() < 60  # corrected for false positives


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2:
                total = sum(digits[::-1][0::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[::-1][1::2])
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    rng = random.Random(5)
    for _ in range(20000):
        text = "".join(rng.choice("ab1@.-+% ()2349\n5é@..") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert [k for _, k, _ in pii.base_spans("4111 1111 1111 1111, +1 (499) 555-6503, 10.0.0.255 me@x.org")] == [2, 3, 1, 0]


def test_patterns_discover_new_identifiers(spark, tricky, empty):
    texts = [f"please write to user{i}@mail.example.com for details of lot {i}" for i in range(6)]
    texts += ["please write to carol(at)hidden(dot)org for details of lot 9", "unrelated dave(at)nowhere(dot)org mention", None, "", "call +1 (499) 555-6503 now"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in pii.find_personal_data(docs).collect()}
    assert len(got) == len(texts)
    assert [texts[6][s.start : s.end] for s in got[6].discovered] == ["carol(at)hidden(dot)org"]
    assert not any(got[i].discovered for i in range(len(texts)) if i != 6)
    assert all(len(got[i].base) == 1 for i in range(6)) and got[8].base == [] == got[9].base
    many, rows = tricky
    assert pii.find_personal_data(many).count() == len(rows)
    assert pii.find_personal_data(empty).count() == 0


def masked_rows(n, seed=8):
    """Documents with an identifier in one of several contexts; of every kind a fifth is written so that no base pattern matches. Slots also hold plain words, and numbers stand elsewhere."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(4, 8)))

    def card():
        digits = number(15)
        check = next(d for d in "0123456789" if pii.luhn(digits + d))
        return digits + check

    plain = [lambda: f"{name()}{number(2)}@{name()}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), card, lambda: f"+{number(2)} {number(3)} {number(3)} {number(4)}"]
    masked = [lambda: f"{name()}{number(2)}(at){name()}(dot)example(dot)com", lambda: "-".join(str(rng.randrange(256)) for _ in range(4)), lambda: "/".join(number(4) for _ in range(4)), lambda: f"00{number(2)} {number(3)}-{number(3)}-{number(4)}"]
    contexts = [[("please write to", "for the forms"), ("her mailbox", "is always full")], [("logged in from", "at night"), ("the host", "did not answer")], [("charged the card", "twice"), ("card number", "has expired")], [("call us on", "before noon"), ("his phone", "was off")]]
    rows, hidden = [], {}
    for i in range(n):
        kind = rng.randrange(4)
        left, right = rng.choice(contexts[kind])
        filler = prose(rng, "en", rng.randint(10, 40)).split()
        at, what = rng.randrange(len(filler)), rng.random()
        inner = name() if what < 0.03 else masked[kind]() if what < 0.2 else plain[kind]()
        before = " ".join([*filler[:at], left]) + " "
        rows.append((i, f"{before}{inner} {right} " + " ".join(filler[at:]) + f" in {1900 + i % 100}, lot {number(6)}"))
        if 0.03 <= what < 0.2:
            hidden[i] = (len(before), kind, len(before) + len(inner))
    return rows, hidden


def test_masked_identifiers_are_discovered(spark):
    rows, hidden = masked_rows(3000)
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    found = {(x.doc_id, *s) for x in got for s in x.discovered}
    want = {(i, *s) for i, s in hidden.items()}
    assert len(found & want) / len(want) >= 0.9, len(found & want) / len(want)
    assert len(found - want) <= 0.02 * len(want), sorted(found - want)[:10]


def test_long_runs_are_found_in_linear_time():
    for text in ("1" * 3_000_000 + ".", "1.2" * 500_000, "+1 " * 300_000, "a@" * 300_000, "(" * 2_000_000):
        began = time.time()
        pii.candidates(text, pii.base_spans(text))
        assert time.time() - began < 30


def toxic_rows(n):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, "en", 40).split()
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vilest", "grotty", "nastyish"])
        rows.append((i, " ".join(words), "en", "s", None))
        labels.append((i, 1, int(i % 5 == 0)))
    return rows, labels


def test_toxicity_learns_and_generalises(spark, tricky, empty):
    rows, labels = toxic_rows(400)
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, marks.where("doc_id % 4 <> 1")).collect()}
    held = [i for i in range(400) if i % 4 == 1]
    assert sum(got[i].predicted == int(i % 5 == 0) for i in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 for x in got.values())
    hit = next(got[i] for i in held if i % 5 == 0)
    assert hit.evidence and hit.evidence == sorted(hit.evidence, key=lambda x: -round(x.cosine, 9)) and hit.evidence[0].toxic == 1
    odd, all_rows = tricky
    assert toxicity.score_toxicity(odd, marks.limit(0)).where("score = 0").count() == len(all_rows)
    nulls = spark.createDataFrame([(None, 1), (5, None), (5, 1), (5, 0), (999, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd, nulls).count() == len(all_rows)
    assert toxicity.score_toxicity(empty, marks).count() == 0


def test_toxicity_relevance_whatever_the_partitions(spark):
    rows, labels = toxic_rows(400)
    labelled = spark.createDataFrame([(x[1], y[2]) for x, y in zip(rows, labels, strict=True)], "text string, toxic int")
    (one, rate), (many, _) = (toxicity.relevance(labelled.repartition(n)) for n in (1, 50))
    assert (one == many).all() and rate == 0.2 and one.max() == 1.0
    assert all(one[toxicity.terms(x)[0][0]] > 0.3 for x in ("vilest", "grotty", "nastyish")) and one[toxicity.terms("xyzzy")[0][0]] == 0


@pytest.mark.parametrize(("block", "dense"), [(512, 16), (64, 4), (7, 1000), (64, 0)])
def test_block_max_search_is_exact(block, dense, monkeypatch):
    """With most terms as whole rows, some, all, or none."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    monkeypatch.setattr(toxicity, "DENSE", dense)
    rng = np.random.default_rng(6)
    weights = np.zeros(1 << toxicity.BITS)
    weights[:60] = rng.uniform(1, 5, 60)
    examples = []
    for i in range(1000):
        f = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        examples.append((i, int(rng.integers(0, 2)), f, rng.integers(1, 9, len(f)).astype(float)))
    index = toxicity.BlockMaxIndex.build(examples, weights)

    def dense(f, tf):
        v = np.zeros(60)
        v[f] = (1 + np.log(tf)) * weights[f]
        return v / math.sqrt(v @ v)

    matrix = np.array([dense(f, tf) for _, _, f, tf in examples])
    for i, _, f, tf in examples[:150]:
        for but in (None, i):
            scores = matrix @ dense(f, tf)
            want = [(-round(s, 9), n) for n, s in enumerate(scores.tolist()) if s > 1e-12 and n != but]
            places, cosines = index.nearest(*next(index.queries([(f, tf)])), 16, but)
            assert [(-round(min(c, 1.0), 9), int(n)) for c, n in zip(cosines, index.ids[places], strict=True)] == sorted(want)[:16]


def test_toxicity_query_against_brute_force(spark):
    """The query on sf0.001: cosines over all words of all labelled examples, nearest, votes and scores."""
    folder = "/root/testdata/sf0.001"
    docs = [(x.doc_id, x.text or "") for x in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(x.doc_id).encode()) % 5 and x.toxic is not None}
    got = {x.doc_id: x for x in toxicity.op3_toxicity(spark, folder).collect()}
    assert len(got) == len(docs)
    count = lambda text: Counter(zlib.crc32(w.encode()) % 2**toxicity.BITS for w in re.findall(r"[^\W\d_]+", text.lower()))
    bags = {i: count(text) for i, text in docs}
    texts = dict(docs)
    first = {}
    for i in sorted(labels):
        first.setdefault(texts.get(i), i)
    fitted = [i for text, i in first.items() if text is not None]
    rate = sum(labels[i] for i in fitted) / len(fitted)
    df, n, toxic = (Counter(x for i in ids for x in bags[i]) for ids in (bags, fitted, [i for i in fitted if labels[i]]))
    z = {x: (toxic[x] - n[x] * rate) / math.sqrt(n[x] * rate * (1 - rate)) - toxicity.LEAST_Z for x in n}
    top = max(max(z.values()), 1e-12)
    weight = {x: (math.log((len(docs) + 1) / (df[x] + 1)) + 1) * (toxicity.BASE + max(0.0, z.get(x, 0.0)) / top) for x in df}

    def vector(bag):
        v = {x: (1 + math.log(c)) * weight[x] for x, c in bag.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {x: w / size for x, w in v.items()}

    examples = {i: vector(bags[i]) for i in fitted if bags[i]}
    for i, text in docs:
        query = vector(bags[i]) if bags[i] else {}
        near = sorted((-round(s, 9), j) for j, e in examples.items() if (s := sum(w * e.get(x, 0.0) for x, w in query.items())) > 1e-12)[: toxicity.NEAREST]
        assert [(x.doc_id, round(x.cosine, 6)) for x in got[i].evidence] == [(j, round(-s, 6)) for s, j in near], text[:80]
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.5)


def test_isotonic_is_monotone():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.9]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all()


def test_copies_of_a_text_teach_a_language_once(spark):
    rng = random.Random(11)
    rows = [(prose(rng, lang, 60), lang) for lang in ("en", "de") * 40]
    once, often = (language_id.train(spark.createDataFrame(rows + [(rows[0][0] + " zzyzx", "en")] * n, "text string, lang string")) for n in (1, 2000))
    assert once.languages == often.languages and (once.table == often.table).all()


def test_fold_functions_agree(spark):

    rows = spark.range(50).selectExpr("id AS doc_id").withColumn("in", language_id.in_fold(4, 2)).collect()
    assert all(x["in"] == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
