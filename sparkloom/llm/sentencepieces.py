"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation walks a text through the model's compiled character map: at each place the longest prefix
that the map knows is replaced, other characters stay, and every byte of the normalised text records
where in the source it came from. Pieces are merged in the normalised text, and the alignment projects
each one back to a span of the source's bytes. The map is a double array: units of 32 bits whose offset
leads from a byte to the next, with the number of a replacement at the end of a key.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import read

SPACE = "▁"
#: Segments in each of the two generations that a worker remembers, and the longest that is remembered.
REMEMBERED, LONGEST = 1 << 18, 64
#: Symbols up to which the best pair is found by looking at all pairs, instead of a heap.
FEW = 128
#: Bytes of text that a task encodes before it hands on what it has.
SLICE = 4 << 20
#: Numbers of fields in a model file and kinds of pieces: fixed values of the format.
PIECES, TRAINER, NORMALIZER, DENORMALIZER = 1, 2, 3, 5
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE, MODEL_TYPE, UNK_SURFACE, SUFFIX, BYTE_FALLBACK = 2, 3, 44, 24, 35
CHARSMAP, DUMMY_PREFIX, EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 2, 3, 4, 5

#: Spaces and what follows them up to the next ones.
_SEGMENTS = re.compile(" *[^ ]+| +")

# each byte that belongs to no character becomes a replacement character of its own
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """A compiled character map: the longest known prefix of a text at a place, and what replaces it."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size :]
        self._starts: dict[str, bool] = {}

    def _walk(self, raw: bytes, at: int) -> Iterator[tuple[int, int | None]]:
        """The places reached byte by byte, each with the number of the replacement of the key that ends there, if one does."""
        units = self.units
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        while at < len(raw):
            node ^= raw[at]
            unit = units[node]
            if unit & 0x800000FF != raw[at]:
                return
            at += 1
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            yield at, units[node] & 0x7FFFFFFF if unit >> 8 & 1 else None

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Where the longest key that starts at `at` ends, and its replacement."""
        best = None
        for end, value in self._walk(raw, at):
            if value is not None:
                best = end, value
        return best and (best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])])

    def starts(self, letter: str) -> bool:
        """Whether any key starts with this character."""
        known = self._starts.get(letter)
        if known is None:
            raw = letter.encode()
            known = self._starts[letter] = bool(self.units) and any(end == len(raw) for end, _ in self._walk(raw, 0))
        return known


class SentencePiece:
    """A BPE model with byte fallback, read from a model file."""

    def __init__(self, data: bytes):
        specs: dict[int, dict] = {TRAINER: {}, NORMALIZER: {}, DENORMALIZER: {}}
        rows = []
        for number, value in _fields(data):
            if number == PIECES:
                row = dict(_fields(value))
                rows.append((row[1].decode(), struct.unpack("<f", row.get(2, bytes(4)))[0], row.get(3, NORMAL)))
            elif number in specs:
                specs[number] = dict(_fields(value))
        trainer, normalizer = specs[TRAINER], specs[NORMALIZER]
        kinds = {kind for _, _, kind in rows}
        if trainer.get(MODEL_TYPE) != BPE or not trainer.get(BYTE_FALLBACK) or trainer.get(SUFFIX) or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or specs[DENORMALIZER].get(CHARSMAP):
            raise ValueError("only BPE models with byte fallback, without pieces of the user's own, unused ones, spaces as suffixes or a denormaliser")
        self.map = CharacterMap(normalizer.get(CHARSMAP, b""))
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(x, 1)) for x in (DUMMY_PREFIX, EXTRA_WHITESPACES, ESCAPE_WHITESPACES))
        if not self.escape:
            raise ValueError("only models that escape spaces")
        self.bos, self.eos = (next((i for i, x in enumerate(rows) if x[0] == name), None) for name in ("<s>", "</s>"))
        # within, a plain space stands for the mark of spaces, of which it has the width: texts stay ASCII if they are
        self.ids = {piece.replace(SPACE, " "): i.to_bytes(4, "little") for i, (piece, _, kind) in enumerate(rows) if kind == NORMAL}
        byte_ids = {int(piece[3:5], 16): i for i, (piece, _, kind) in enumerate(rows) if kind == BYTE}
        self.byte_ids = [byte_ids[x].to_bytes(4, "little") for x in range(256)]
        order = {score: rank for rank, score in enumerate(sorted({score for _, score, _ in rows}, reverse=True))}
        #: Pieces that a merge may make, by the order of merges.
        self.rank = {piece.replace(SPACE, " "): order[score] for piece, score, kind in rows if kind == NORMAL}
        #: Whether no piece runs on over the border before a space, so that segments are encoded by themselves.
        self.segmented = not any(" " in piece.lstrip(" ") for piece in self.ids)
        self.width = np.array([1 if kind == BYTE else len(piece.encode()) if kind == NORMAL else 0 for piece, _, kind in rows], np.int64)
        unknown = trainer.get(UNK_SURFACE, " ⁇ ".encode())
        told = {NORMAL: lambda x: x.replace(SPACE, " ").encode(), UNKNOWN: lambda x: unknown, CONTROL: lambda x: None, BYTE: lambda x: bytes([int(x[3:5], 16)])}
        #: What an id is in a decoded text; None for control pieces.
        self.bytes_of: list[bytes | None] = [told[kind](piece) for piece, _, kind in rows]
        self.spaced = {i for i, (piece, _, kind) in enumerate(rows) if kind == NORMAL and piece.startswith(SPACE)}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, with plain spaces for their marks, and for each byte that it has with marks (and its end) the byte of the source it comes from."""
        if not self.squeeze and not any(map(self.map.starts, set(text))):
            return self._plain(text)
        raw = text.encode()
        out, origin, at = [], [], 0
        if self.squeeze:  # spaces in front go
            while at < len(raw):
                end, found = self._step(raw, at)
                if found != b" ":
                    break
                at = end
        if at == len(raw):
            return "", np.zeros(1, np.int64) + at
        space = SPACE.encode()

        def add(data: bytes, source: int) -> None:
            out.append(data)
            origin.append((source, len(data)))

        if self.prefix:
            add(space, at)
        spaced = self.squeeze
        while at < len(raw):
            end, found = self._step(raw, at)
            if spaced:
                found = found.lstrip(b" ")
            if found:
                add(found.replace(b" ", space), at)
                spaced = found.endswith(b" ")
            spaced = spaced and self.squeeze
            at = end
        whole = b"".join(out)
        starts, sizes = np.array(origin, np.int64).reshape(-1, 2).T
        align = np.append(np.repeat(starts, sizes), at)
        while self.squeeze and whole.endswith(space):  # so do those at the end
            whole = whole[: -len(space)]
            align = align[: len(whole) + 1]
        return whole.decode().replace(SPACE, " "), align

    def _step(self, raw: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(raw, at) if self.map.units else None
        if found is None:
            first = raw[at]
            end = at + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            return end, raw[at:end]
        return found

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        """normalise() of a text that no rule touches: only spaces grow, if they are escaped."""
        if not text:
            return "", np.zeros(1, np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.arange(len(raw), dtype=np.int32)
        if not text.isascii():  # all bytes of a character come from where it starts
            at = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, at, 0))
        width = len(SPACE.encode())
        align = np.concatenate([np.zeros(width * self.prefix, np.int32), np.repeat(at, np.where(raw == 32, width, 1)), np.array([len(raw)], np.int32)])
        return " " * self.prefix + text.replace(SPACE, " "), align

    def _merged(self, segment: str) -> list[str]:
        """The pieces of a segment: of all neighbours that a piece joins the best are joined, the first of equals, until there are none."""
        parts = list(segment)
        if len(parts) > FEW:
            return self._merged_by_heap(parts)
        rank, none = self.rank.get, len(self.rank)
        ranks = [*map(rank, map(add, parts, parts[1:]), repeat(none)), none]
        while (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] = joined = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + joined, none)
            if i + 1 < len(parts):
                ranks[i] = rank(joined + parts[i + 1], none)
        return parts

    def _merged_by_heap(self, parts: list[str]) -> list[str]:
        rank, after, before = self.rank, list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(parts) and (joined := parts[i] + parts[after[i]]) in rank:
                heapq.heappush(heap, (rank[joined], i, joined))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j == len(parts) or parts[i] + parts[j] != joined:
                continue  # one of the two is gone or has grown
            parts[i], parts[j], after[i] = joined, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [x for x in parts if x]

    def encode_segment(self, segment: str) -> bytes:
        """The ids of a segment as 32-bit integers; a character without a piece becomes its bytes."""
        ids, parts = self.ids, self._merged(segment)
        try:
            return b"".join([ids[x] for x in parts])
        except KeyError:
            return b"".join([ids.get(x) or b"".join([self.byte_ids[y] for y in x.encode()]) for x in parts])

    def encode(self, text: str, known: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids with begin and end ids, and the first byte and the end of each one's span in the source."""
        whole, align = self.normalise(text)
        known.trim()
        segments = _SEGMENTS.findall(whole) if self.segmented else [whole] if whole else []
        ids = np.frombuffer(b"".join(map(known.__getitem__, segments)), "<u4")
        bounds = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.width[ids], out=bounds[1:])
        at = align[bounds].astype("<i4")
        begin, end = (np.array([x], "<u4") for x in (self.bos, self.eos))
        none, size = np.zeros(1, "<i4"), np.array([len(text.encode())], "<i4")
        return np.concatenate([begin, ids, end]), np.concatenate([none, at[:-1], size]), np.concatenate([none, at[1:], size])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any ids: control pieces are nothing, but bytes on their two sides don't make one character."""
        ids = list(ids)
        told = [self.bytes_of[i] for i in ids]
        if self.prefix or self.squeeze:
            for n, i in enumerate(ids):  # a space in front of the text, that normalising had put there
                if told[n] is None:
                    continue
                if i in self.spaced:
                    told[n] = told[n][1:]
                if told[n] or not self.squeeze:
                    break
        if None not in told:
            return b"".join(told).decode("utf-8", "each_byte")
        out, run = [], []
        for x in [*told, None]:
            if x is not None:
                run.append(x)
            elif run:
                out.append(b"".join(run).decode("utf-8", "each_byte"))
                run = []
        return "".join(out)


class Segments(dict):
    """The ids of segments, found when first asked for. When they are many, those that aren't asked for again are forgotten."""

    def __init__(self, model: SentencePiece):
        super().__init__()
        self.model = model
        self.before: dict[str, bytes] = {}

    def __missing__(self, segment: str) -> bytes:
        found = self.before.get(segment) or self.model.encode_segment(segment)
        if len(segment) <= LONGEST:
            self[segment] = found
        return found

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()


@cache
def model(path: str) -> SentencePiece:
    with open(path, "rb") as file:
        return SentencePiece(file.read())


@cache
def segments(path: str) -> Segments:
    """What a worker remembers from task to task."""
    return Segments(model(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts, about SLICE bytes of text at a time."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= SLICE:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


_ENCODED = "doc_id long, n_tokens long, ids binary, begins binary, ends binary"


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str | None, decoded: bool) -> Iterator[pa.RecordBatch]:
    pieces, known = model(path or default_path()), segments(path or default_path())
    for doc_ids, texts in _slices(batches):
        found = [pieces.encode(text, known) for text in texts]
        columns = [pa.array(doc_ids, pa.int64()), pa.array([len(x[0]) for x in found], pa.int64()), pa.array([x[0].tobytes() for x in found], pa.binary())]
        columns += [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (1, 2)]
        names = ["doc_id", "n_tokens", "ids", "begins", "ends"]
        if decoded:
            columns.append(pa.array([pieces.decode(x[0].tolist()) for x in found], pa.string()))
            names.append("decoded")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes every whole text, with begin and end ids, and tells which bytes of the source each id stands for.

    docs: doc_id, text; other columns are ignored. path: a model file that every executor has (default: the installed public
    one). Returns one row per input row, repeated rows included: doc_id, n_tokens, ids, begins, ends (binary, little-endian 32-bit
    integers, one for each id). A span covers bytes of the text's UTF-8, end exclusive; the begin and end ids have empty ones at its
    borders, as has a space that normalising puts in front. Of a character without a piece the last byte piece has the
    whole span, the others an empty one before it. Null text is empty: it has the begin and end ids only.
    Strings of control pieces in a text are plain text. A text is held by one task, a segment (spaces, then what isn't one) as long as it
    may be is merged by a heap; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encode_batches(batches, path, False), _ENCODED)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded of rows with doc_id and ids, be they encode()'s or any others (null ids: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path or default_path())
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """encode(docs) with `decoded`, what its ids decode to, in one pass of each task."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encode_batches(batches, path, True), f"{_ENCODED}, decoded string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(read(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256", "sha2(concat(begins, ends), 256) AS spans_sha256")


QUERIES = {"op12_sentencepiece": op12_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
