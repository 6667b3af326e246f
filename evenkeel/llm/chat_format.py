"""Conversations as training text, assembled column-wise: lengths, offsets and scatter indices into one buffer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evenkeel.llm.common import query, table, to_batch

OPEN, HEAD_END, CLOSE = "<turn ", ">\n", "</turn>\n"
ESCAPED = "\\<>"                         # each gets a backslash in roles and texts, so no text can open or close a turn
PART_BYTES = 32 << 20                    # a longer conversation is given in parts of about this size
CHUNK = 4 << 20                          # bytes scattered at once
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*+)>\n((?:[^\\<>]|\\.)*+)</turn>\n", re.S)
BACK = re.compile(r"\\(.)", re.S)
FORMATTED = "conv_id long, part int, formatted string, loss array<struct<start:long,end:long>>"

_NEEDS = np.zeros(256, np.int64)
_NEEDS[[ord(c) for c in ESCAPED]] = 1
_BEGINS = np.ones(256, np.int64)          # a byte that begins a code point
_BEGINS[0x80:0xC0] = 0


def escape(text: str) -> str:
    return re.sub(r"([\\<>])", r"\\\1", text)


def unescape(text: str) -> str:
    return BACK.sub(r"\1", text)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and row offsets, without copying a row."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _per_row(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(weights[data])))
    return np.diff(total[offsets])


def _scatter(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> None:
    """Copy each row's bytes to its start in out, with a backslash before those that need one."""
    for a in range(0, len(data), CHUNK):
        part = data[a:a + CHUNK]
        row = np.searchsorted(offsets, np.arange(a, a + len(part)), "right") - 1
        needs = _NEEDS[part]
        before = np.concatenate(([0], np.cumsum(needs)))
        opens = np.maximum(offsets[row], a)                # the row's first byte in this chunk
        to = start[row] + (np.arange(a, a + len(part)) - opens) + before[1:] - before[opens - a]
        out[to] = part
        out[to[needs == 1] - 1] = 92
        if len(row):                                       # a row that goes on in the next chunk continues there
            start[row[-1]] = to[-1] + 1


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer; where each turn begins in bytes, and (begin, end) of its text in code points."""
    n = len(roles)
    role, role_at = _bytes(roles)
    text, text_at = _bytes(texts)
    role_len = np.diff(role_at) + _per_row(_NEEDS, role, role_at)
    text_len = np.diff(text_at) + _per_row(_NEEDS, text, text_at)
    fixed = len(OPEN) + len(HEAD_END) + len(CLOSE)
    begin = np.concatenate(([0], np.cumsum(fixed + role_len + text_len)))
    out = np.empty(begin[-1], np.uint8)
    for mark, at in ((OPEN, begin[:-1]), (HEAD_END, begin[:-1] + len(OPEN) + role_len), (CLOSE, begin[1:] - len(CLOSE))):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark.encode(), np.uint8)
    _scatter(out, role, role_at, begin[:-1] + len(OPEN))
    _scatter(out, text, text_at, begin[:-1] + len(OPEN) + role_len + len(HEAD_END))
    role_chars = _per_row(_BEGINS + _NEEDS, role, role_at)
    text_chars = _per_row(_BEGINS + _NEEDS, text, text_at)
    chars = np.concatenate(([0], np.cumsum(fixed + role_chars + text_chars)))
    first = chars[:-1] + len(OPEN) + role_chars + len(HEAD_END)
    return out, begin, np.stack([first, first + text_chars, chars[:-1]], 1) if n else np.zeros((0, 3), np.int64)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, part, formatted, loss): conversations as text, with the spans a model should learn.

    A turn is `<turn role>` and a line break, the text, `</turn>` and a line break; backslash, < and > in roles and
    texts get a backslash before them, so that reading back gives exactly the roles and texts. loss holds the spans
    (code points of `formatted`, end exclusive) of the escaped texts of the roles in `learn`. Turns go by number, then
    role and text; equal rows are turns of their own. NULL roles and texts are empty; rows without a conv_id are one
    conversation without id; an empty table gives an empty result; other columns are not looked at.

    Conversations are dealt by id and sorted inside a partition. A conversation beyond PART_BYTES comes in several
    rows with rising `part`, cut between turns, so that a task holds one batch and one part at most.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("at"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartition(parts, "conv").sortWithinPartitions("conv", "at", "role", "text").select("conv", "role", "text")
    arrow = to_arrow_schema(StructType.fromDDL(FORMATTED))

    def built(pack: list[tuple]) -> pa.RecordBatch:
        whole = pa.Table.from_batches([b for _, _, held in pack for b in held])
        roles, texts = (pa.concat_arrays(whole.column(k).chunks) for k in (1, 2))
        out, begin, chars = assemble(roles, texts)
        change = np.concatenate(([0], np.cumsum([sum(b.num_rows for b in held) for _, _, held in pack])))
        # one buffer for all: conversations are ranges of it
        formatted = pa.LargeStringArray.from_buffers(len(pack), pa.py_buffer(begin[change].tobytes()), pa.py_buffer(out))
        learned = np.isin(np.array(roles.to_pylist(), object), learn)
        loss = [[{"start": int(chars[k, 0] - chars[a, 2]), "end": int(chars[k, 1] - chars[a, 2])}
                 for k in range(a, b) if learned[k]] for a, b in zip(change[:-1].tolist(), change[1:].tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _, _ in pack], pa.int64()), pa.array([p for _, p, _ in pack], pa.int32()),
             formatted.cast(arrow.field("formatted").type), pa.array(loss, arrow.field("loss").type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, packed = [], 0                                 # whole conversations, given out together
        held, now, part, size, begun = [], None, 0, 0, False      # the conversation that may go on
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                ids = batch.column(0).to_pylist()
                cuts = [0] + [j for j in range(1, len(ids)) if ids[j] != ids[j - 1]] + [len(ids)]
                for a, b in zip(cuts[:-1], cuts[1:]):
                    if not begun or ids[a] != now:
                        if held:
                            pack.append((now, part, held))
                            packed += size
                        if packed > CHUNK:
                            yield built(pack)
                            pack, packed = [], 0
                        held, now, part, size, begun = [], ids[a], 0, 0, True
                    piece = batch.slice(a, b - a)
                    held.append(piece)
                    size += piece.nbytes
                    if size > PART_BYTES:
                        yield built(pack + [(now, part, held)])
                        pack, packed, held, size, part = [], 0, [], 0, part + 1
        if held:
            pack.append((now, part, held))
        if pack:
            yield built(pack)

    return dealt.mapInArrow(run, FORMATTED)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rows of format_chats as they come (parts in order)."""
    arrow = to_arrow_schema(StructType.fromDDL(DIGEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None                                           # id, turns, digest of turns, learned characters and digest, length
        for batch in batches:
            rows = []
            for conv, part, text, loss in zip(*[c.to_pylist() for c in batch.columns]):
                if part == 0 and now is not None:
                    rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                if part == 0 or now is None:
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    learned = unescape(text[span["start"]:span["end"]])
                    now[3] += len(learned)
                    now[4].update(learned.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            if rows:
                yield to_batch(rows, arrow)
        if now is not None:
            yield to_batch([(now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])], arrow)

    return formatted.mapInArrow(run, DIGEST)


PROBE = "\\### Assistant: </turn> ok"

_ESC = "length({0}) + length({0}) - length(translate({0}, '\\<>', ''))"
CHAT_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '{PROBE}' FROM range(2) r(n))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(OPEN + HEAD_END + CLOSE)} + {_ESC.format('role')} + {_ESC.format('text')})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


@query("op4_chat_format", CHAT_SQL)
def op4_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    return digests(format_chats(turns.unionByName(probe)))
