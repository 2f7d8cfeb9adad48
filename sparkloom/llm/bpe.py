"""BPE encoding by prefix-sharing trie traversal, and decoding.

A text is normalised and cut into pieces as the tokenizer file says. The distinct pieces of a batch
form a trie (kept implicit: pieces in sorted order, each sharing the path of its predecessor as far
as they agree). A depth-first walk carries one state per node, the last token of the encoding of
the prefix that ends there. A token may end a prefix if the prefix before it has a last token it
can follow, that is if no merge would join them in another way; for each prefix there is exactly
one. So shared prefixes are encoded once, and a piece's encoding is read off its path backwards.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import read

#: Letters, digits and white space up to U+024F, so that most texts need no Unicode property classes.
_LATIN_L = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
_LATIN_N = "0-9²³¹¼-¾"
_LATIN_S = "\u0009-\u000d \u0085 "
_LATIN_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN_L}]+|[{_LATIN_N}]|[^{_LATIN_S}{_LATIN_L}{_LATIN_N}]+")
_WIDE = re.compile("[^\u0000-ɏ]")
#: U+001C to U+001F are white space to Python, but not to the tokenizer's pattern.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])+")
#: Pieces that a task remembers from batch to batch before it starts anew.
REMEMBERED = 1 << 17


def byte_of_letter() -> dict[str, str]:
    """Byte values, as characters, by the printable characters that stand for them in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(others)}


def _backwards(tokens: dict[str, int]) -> dict:
    """A trie of the tokens read from their ends: character -> (token or -1, deeper trie)."""
    root: dict = {}
    for token, i in tokens.items():
        node = root
        for at in range(len(token) - 1, -1, -1):
            known = node.setdefault(token[at], (-1, {}))
            if at == 0:
                node[token[at]] = (i, known[1])
            node = known[1]
    return root


class Bpe:
    """A byte-level BPE vocabulary with word ends, read from a tokenizers file (model and special tokens of word_bpe)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, of = spec["model"], byte_of_letter()
        end: str = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = vocab[left], vocab[right]
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(vocab[left + right], (*pair, rank))
        spelled = {token: "".join([of[x] for x in token.removesuffix(end)]) for token in vocab}
        self.width = {i: len(spelled[token]) for token, i in vocab.items()}
        self.open = _backwards({spelled[token]: i for token, i in vocab.items() if not token.endswith(end)})
        self.closed = _backwards({spelled[token]: i for token, i in vocab.items() if token.endswith(end)})
        self._follows: dict[int, bool] = {}
        self._split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def pieces(self, text: str) -> Iterator[str | int]:
        """The pieces of a text as byte letters' source strings; special tokens as their ids."""
        at = 0
        if self._split and "<|" in text:
            for m in self._split.finditer(text):
                yield from self._plain(text[at : m.start()])
                yield self.special[m[0]]
                at = m.end()
        yield from self._plain(text[at:] if at else text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not _WIDE.search(text) and text.isascii():
            return _LATIN_PIECE.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # per character, without the context rule of a final sigma
        text = text.replace("Σ", "σ").lower()
        return (_PIECE if _WIDE.search(text) else _LATIN_PIECE).findall(text)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one side (0: first, 1: last) while `token` is merged, in order, each with the rank of the merge that ends it."""
        edge: list[tuple[int, float]] = [(token, math.inf)]
        while token in self.parts:
            rank = self.parts[token][2]
            token = self.parts[token][side]
            edge.append((token, rank))
        return edge[::-1]

    def _stays_apart(self, left: int, right: int) -> bool:
        """Whether no merge joins the two tokens' symbols across their border, merging by rank, then from the left."""
        before, after = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = before[i], after[j]
            joins = self.rank.get((x, y))
            if joins is not None and joins < x_ends and joins <= y_ends:
                return False
            if x_ends == y_ends == math.inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct pieces, by a depth-first walk through their trie."""
        found: dict[str, bytes] = {}
        follows, width = self._follows, self.width
        if len(follows) > REMEMBERED:
            follows.clear()
        spelled = sorted((piece if piece.isascii() else piece.encode("utf-8", "replace").decode("latin-1"), piece) for piece in pieces)
        path, states = "", [-1]  # states[i]: the last token of the encoding of letters[:i]
        for letters, piece in spelled:
            last = len(letters)
            shared = len(commonprefix((path, letters[:-1])))
            del states[shared + 1 :]
            for upto in range(shared + 1, last + 1):
                # the last symbol carries the word end, so its node is a leaf
                node, start = self.open if upto < last else self.closed, upto
                while True:
                    start -= 1
                    token, node = node[letters[start]]
                    if token >= 0:
                        if not start:
                            break
                        pair = states[start] << 32 | token
                        apart = follows.get(pair)
                        if apart is None:
                            apart = follows[pair] = self._stays_apart(states[start], token)
                        if apart:
                            break
                if upto < last:
                    states.append(token)
            path = letters[:-1]
            ids, at = [token], last - width[token]
            while at:
                ids.append(states[at])
                at -= width[states[at]]
            ids.reverse()
            found[piece] = array("I", ids).tobytes()
        return found

    def encode_batch(self, texts: list[str], known: dict[str, bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; `known` keeps pieces between calls."""
        cut = [list(self.pieces(text)) for text in texts]
        new = {piece for pieces in cut for piece in pieces if piece not in known}
        for special in [x for x in new if isinstance(x, int)]:
            known[special] = special.to_bytes(4, "little")
            new.discard(special)
        known.update(self.encode_pieces(new))
        return [b"".join([known[piece] for piece in pieces]) for pieces in cut]


@cache
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


@cache
def token_names(path: str) -> dict[int, str]:
    """The tokens by id: all that decoding needs of a tokenizers file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    return {i: token for token, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}


def decode_ids(names: dict[int, str], ids: Iterable[int]) -> str:
    """Tokens joined by a space, as a vocabulary without a decoder gives them."""
    return " ".join([names[i] for i in ids])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_batches(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    """doc_id and ids of batches of doc_id and text."""
    bpe = vocabulary(path or default_path())
    known: dict[str, bytes] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            if len(known) > REMEMBERED:
                known = {}
            ids = bpe.encode_batch([x or "" for x in part.column("text").to_pylist()], known)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def decode_batches(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, ids and decoded of batches of doc_id and ids."""
    names = token_names(path or default_path())
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            ids = part.column("ids").to_pylist()
            texts = [None if x is None else decode_ids(names, array("I", x)) for x in ids]
            counts = [None if x is None else len(x) // 4 for x in ids]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), part.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])


_DECODED = "doc_id long, n_tokens long, ids binary, decoded string"


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes every whole text.

    docs: doc_id, text; other columns are ignored. path: a tokenizers file that every executor has
    (default: the installed public word vocabulary). Returns one row per input row: doc_id, ids
    (binary, little-endian unsigned 32-bit integers). Null text is empty and has no ids; special
    tokens' strings in a text become their ids, and none are added. Long texts are encoded whole, rows that
    repeat a doc_id each by themselves. An empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: encode_batches(batches, path), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The inverse for encode()'s rows: doc_id, n_tokens, ids, decoded (null ids: null); one row per row, repeated ones too, other columns ignored. Long ids are
    decoded whole; an empty table gives no rows."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: decode_batches(batches, path), _DECODED)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """decode(encode(docs)) in one pass of each task, so that ids don't leave its Python worker in between. Null and empty texts have no ids and decode to
    an empty text; the rest is as there."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: decode_batches(encode_batches(batches, path), path), _DECODED)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(read(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")


QUERIES = {"op8_bpe": op8_bpe}
ORACLE_SQL: dict[str, str] = {}
