r"""Chat formatting by columnar byte assembly.

A conversation becomes <s>, its turns and </s>; a turn is <|turn|>, role, a line feed, text, <|end|>
and a line feed. Control strings inside roles and texts are broken by a backslash after their first
character, and a backslash is doubled, so that removing one backslash before any character gives the text back.

Turns come sorted by conversation, and a task works on batches of whole conversations: segment
lengths (header, content, footer of each turn) and their cumulative sums say where every byte
goes, and index arrays copy headers and contents into one preallocated Arrow buffer. Only texts
that hold a control string or a backslash are rewritten one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import read

OPEN, CLOSE, TURN, END = "<s>", "</s>", "<|turn|>", "<|end|>"
#: Strings that texts must not hold as they are: the template's own and those of common chat templates.
CONTROL = [OPEN, CLOSE, TURN, END, "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_SPECIAL = "|".join(re.escape(x) for x in ["\\", *CONTROL])
_ESCAPE = re.compile(_SPECIAL)
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_READ_TURN = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|end\|>))*)" + re.escape(END) + "\n", re.DOTALL)
#: Bytes that one pass of index arrays copies.
_PASS = 1 << 21

SCHEMA = "conv_id long, formatted string, n_turns long, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation; raises ValueError if it isn't one."""
    at, turns = len(OPEN), []
    while m := _READ_TURN.match(formatted, at):
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if not formatted.startswith(OPEN) or formatted[at:] != CLOSE:
        raise ValueError("not a formatted conversation")
    return turns


def _escaped(texts: pa.Array) -> pa.Array:
    """The texts as large_string, escaped; most need no change and stay in their column."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    touched = pc.match_substring_regex(texts, _SPECIAL)
    if pc.any(touched).as_py():
        changed = pa.array([escape(x) for x in texts.filter(touched).to_pylist()], pa.large_string())
        texts = pc.replace_with_mask(texts, touched, changed)
    return texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts


def _copy(out: np.ndarray, source: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """Fills `out` with the segments source[starts[i]:starts[i] + length], which end at ends[i] in it."""
    lengths = np.diff(ends, prepend=0)
    shift = starts - (ends - lengths)
    at = 0
    while at < len(out):
        to = min(len(out), at + _PASS)
        first, last = np.searchsorted(ends, [at, to - 1], side="right")
        inside = np.minimum(ends[first : last + 1], to) - np.maximum(ends[first : last + 1] - lengths[first : last + 1], at)
        out[at:to] = source[np.repeat(shift[first : last + 1], inside) + np.arange(at, to)]
        at = to


def assemble(conv: np.ndarray, null_conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Formats whole conversations, given as turns in order."""
    n = len(conv)
    texts = _escaped(texts)
    coded = pc.fill_null(roles.cast(pa.string()), "").dictionary_encode()
    names = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy()
    first = np.ones(n, bool)
    first[1:] = (conv[1:] != conv[:-1]) | (null_conv[1:] != null_conv[:-1])
    last = np.append(first[1:], True)
    # constants: the headers of all roles, with and without the opening, then the footers
    plain = [f"{TURN}{escape_role(x)}\n" for x in names]
    constants = [*plain, *(OPEN + x for x in plain), f"{END}\n", f"{END}\n{CLOSE}"]
    blobs = [x.encode() for x in constants]
    place = np.concatenate([[0], np.cumsum([len(x) for x in blobs])])
    chars = np.array([len(x) for x in constants])
    header, footer = code + first * len(names), 2 * len(names) + last
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    source = np.concatenate([np.frombuffer(b"".join(blobs), np.uint8), data])
    starts, lengths = np.empty((n, 3), np.int64), np.empty((n, 3), np.int64)
    starts[:, 0], lengths[:, 0] = place[header], place[header + 1] - place[header]
    starts[:, 1], lengths[:, 1] = place[-1] + offsets[:-1], np.diff(offsets)
    starts[:, 2], lengths[:, 2] = place[footer], place[footer + 1] - place[footer]
    ends = np.cumsum(lengths.ravel())
    buffer = pa.allocate_buffer(int(ends[-1]))
    _copy(np.frombuffer(buffer, np.uint8), source, starts.ravel(), ends)
    # code points: where each text starts and ends in its own conversation
    width = pc.utf8_length(texts).to_numpy().astype(np.int64)
    end = np.cumsum(chars[header] + width + chars[footer])
    text_end = end - chars[footer]
    begin = (end - width - chars[header] - chars[footer])[first]
    group = np.cumsum(first) - 1
    loss = np.array([x == "assistant" for x in names])[code]
    counts = np.bincount(group[loss], minlength=len(begin))
    list_offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    spans = [pa.array((x - begin[group])[loss]) for x in (text_end - width, text_end)]
    row_end = ends.reshape(n, 3)[last, 2]
    formatted = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.concatenate([[0], row_end]).astype(np.int64)), buffer)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv[first], mask=null_conv[first]), formatted.cast(pa.string()), pa.array(np.bincount(group)), *(pa.ListArray.from_arrays(list_offsets, x) for x in spans)],
        names=["conv_id", "formatted", "n_turns", "loss_starts", "loss_ends"],
    )


def _whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formats batch by batch; the turns of a batch's last conversation wait for the next one."""
    waiting: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        if rows := sum(x.num_rows for x in waiting):
            turns = pa.Table.from_batches(waiting).combine_chunks().to_batches(max_chunksize=rows)[0]
            ids = turns.column("conv_id")
            yield assemble(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), turns.column("role"), turns.column("text"))

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_pylist()
        cut = batch.num_rows
        while cut and ids[cut - 1] == ids[-1]:
            cut -= 1
        if cut == 0 and waiting and waiting[-1].column("conv_id")[-1].as_py() == ids[-1]:
            waiting.append(batch)
            continue
        waiting.append(batch.slice(0, cut))
        yield from done()
        waiting = [batch.slice(cut)]
    yield from done()


def chat_format(turns: DataFrame) -> DataFrame:
    """Formats conversations as strings with a loss mask over the assistants' texts.

    turns: conv_id, turn, role, text; other columns are ignored. Returns one row per conversation:
    conv_id, formatted, n_turns, and the code-point spans of the loss mask, loss_starts and
    loss_ends (ends exclusive), one for each assistant turn, in order.
    Turns go by turn (null first), then role and text, so repeated rows stay turns of their own; null role or
    text is empty; turns of a null conv_id form one conversation. An empty table gives no rows.
    A conversation is one row of the result, so its turns meet in one task, batch by batch; long texts are whole.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_whole_conversations, SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        rows = []
        for conv_id, formatted, starts, ends in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_starts", "loss_ends")), strict=True):
            read_back = read_turns(formatted)
            loss = "".join(unescape(formatted[a:b]) for a, b in zip(starts, ends, strict=True))
            rows.append((conv_id, len(read_back), sha("".join(f"{role}\n{text}\n" for role, text in read_back)), len(loss), sha(loss), len(formatted)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat_format(turns.unionByName(own)).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


QUERIES = {"op5_chat_format": op5_chat_format}

_CONTROL_SQL = r"\\|<s>|</s>|<\|turn\|>|<\|end\|>|\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>"

ORACLE_SQL = {
    "op5_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '{_CONTROL_SQL}|\n')) + length(text) + len(regexp_extract_all(text, '{_CONTROL_SQL}')) AS chars FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(7 + sum(17 + chars) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
}
