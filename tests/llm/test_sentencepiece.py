"""The library as judge: ids, spans and decoded texts, by the public model and by one with a full character map."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from sparkloom.llm import sentencepieces as sp

LETTERS = "abcdeABC éàüßİı\t\n\x0b\x1c\x85  ​▁0123²½①ﬁＡＢ漢字かなが한글🙂🤦🏼‍♂̧́<|>.,!?#_-'ǅ𝒜ﷺ㌔"


def texts_of(rng: random.Random) -> list[str]:
    texts = ["", " ", "  ", "   a", "a   ", " a  b ", "<s>a</s><unk><0x0A>", "▁", "▁▁a ▁", "\0", "a\0b", "x" * 3000, " " * 1000 + "y", "ab" * 400 + " " * 300 + "é" * 300, "🤦🏼‍♂️", "ﷺ", "é", "が"]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    return texts + [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 30))) for _ in range(20)) for _ in range(200)]


def models() -> dict[str, bytes]:
    """The public model, and its pieces behind normalisers with a large compiled map, with and without squeezing of spaces, prefix and escapes."""
    with open(sp.default_path(), "rb") as file:
        public = file.read()
    found = {"public": public}
    for rule, squeeze, prefix in [("nmt_nfkc", True, True), ("nmt_nfkc_cf", False, True), ("nfkc", True, False)]:
        spec, whole = proto.NormalizerSpec(), proto.ModelProto()
        spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
        spec.remove_extra_whitespaces, spec.add_dummy_prefix = squeeze, prefix
        whole.ParseFromString(public)
        whole.normalizer_spec.CopyFrom(spec)
        found[rule] = whole.SerializeToString()
    return found


@pytest.mark.parametrize("name", ["public", "nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
def test_ids_spans_and_text_equal_the_library(name):
    data = models()[name]
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), sp.SentencePiece(data)
    known = sp.Segments(own)
    rng = random.Random(5)
    for text in texts_of(rng):
        ids, begins, ends = own.encode(text, known)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text
        spans = [(x.begin, x.end) for x in library.encode(text, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist(), strict=True))[1:-1] == spans, text
        assert (begins[0], ends[0], begins[-1], ends[-1]) == (0, 0, len(text.encode()), len(text.encode()))
        assert own.decode(ids.tolist()) == library.decode(ids.tolist()), text
    for _ in range(3000):  # ids that no text gives
        ids = [rng.choice([rng.randrange(32000), rng.randrange(0, 262), rng.choice([1, 2, 259, 28705])]) for _ in range(rng.randint(1, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_spans_lead_back_to_the_source():
    """Whatever normalising did, spans are in order, and together cover the text up to what squeezing drops."""
    own = sp.SentencePiece(models()["nmt_nfkc_cf"])
    known = sp.Segments(own)
    for text in texts_of(random.Random(9)):
        _, begins, ends = own.encode(text, known)
        assert (begins[1:] >= begins[:-1]).all() and (ends[1:] >= ends[:-1]).all() and (begins <= ends).all()
        raw = text.encode()
        "".join(raw[a:b].decode() for a, b in zip(begins.tolist(), ends.tolist(), strict=True))  # each span is whole characters


def test_other_models_are_refused():
    whole = proto.ModelProto()
    whole.ParseFromString(models()["public"])
    whole.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        sp.SentencePiece(whole.SerializeToString())


def test_over_a_table(spark, tricky, empty):
    docs, rows = tricky
    library = sentencepiece.SentencePieceProcessor(model_file=sp.default_path())
    got = sp.encode_decode(docs).collect()
    assert len(got) == len(rows)
    plain = sorted((str(x.doc_id), bytes(x.ids), bytes(x.begins), bytes(x.ends)) for x in sp.encode(docs).collect())
    assert plain == sorted((str(x.doc_id), bytes(x.ids), bytes(x.begins), bytes(x.ends)) for x in got)
    assert sorted((str(x.doc_id), x.decoded) for x in got) == sorted((str(x.doc_id), x.decoded) for x in sp.decode(sp.encode(docs)).collect())
    texts = {r[0]: r[1] or "" for r in rows}
    for x in got:
        ids = library.encode(texts[x.doc_id], add_bos=True, add_eos=True)
        assert (x.n_tokens, np.frombuffer(x.ids, "<u4").tolist()) == (len(ids), ids)
        assert x.decoded == library.decode(ids)
        assert np.frombuffer(x.ends, "<i4")[-1] == len(texts[x.doc_id].encode())
    assert sp.encode_decode(empty).count() == 0


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=sp.default_path())
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for x in sp.op12_sentencepiece(spark, folder).collect():
        ids = library.encode(texts[x.doc_id], add_bos=True, add_eos=True)
        assert x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
