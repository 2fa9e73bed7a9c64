"""Chat formatting by columnar byte assembly.

Rows are sorted by conversation and turn.  For each batch the byte lengths of all segments (turn mark, role, content,
end mark) are laid out at once; cumulative lengths give the offsets, and scatter indices copy headers and contents into
one preallocated buffer that Arrow then cuts into conversations.  Control strings inside texts are broken up with a
backslash, which can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of the template: an assistant's turn stands between the first two, any other between the last two.
OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (OPEN, CLOSE, ASK, ASKED)
ASSISTANT = "assistant"
#: Bytes of content laid out at once, and bytes copied by one scatter.
SLICE_BYTES, COPY_BYTES = 4 << 20, 1 << 20


def escape(texts: pa.Array) -> pa.Array:
    """Double every backslash, then put one behind the first character of every control string."""
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for c in CONTROL:
        texts = pc.replace_substring(texts, c, c[0] + "\\" + c[1:])
    return texts


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column, offsets starting at zero."""
    column = pa.array(column.to_pylist(), pa.large_string()) if column.offset else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The turns as one byte buffer; byte ends of the turns; code points of each turn; where its loss starts and its length."""
    roles, texts = pc.fill_null(roles, ""), escape(pc.fill_null(texts, ""))
    answer = pc.equal(roles, ASSISTANT).to_numpy(zero_copy_only=False)
    asked = pc.replace_substring(escape(roles), "\n", "\\\n")
    heads = pc.if_else(pa.array(answer), "", pc.binary_join_element_wise(asked, "\n", ""))
    head_data, head_at = _bytes(heads)
    text_data, text_at = _bytes(texts)
    marks = np.frombuffer("".join(CONTROL).encode(), np.uint8)
    mark_sizes = np.array([len(c) for c in CONTROL])
    mark_at = np.cumsum(mark_sizes) - mark_sizes
    pool = np.concatenate([marks, head_data, text_data])
    n = len(answer)
    first, last = np.where(answer, 0, 2), np.where(answer, 1, 3)
    sources = np.stack([mark_at[first], len(marks) + head_at[:-1], len(marks) + len(head_data) + text_at[:-1], mark_at[last]], 1).ravel()
    sizes = np.stack([mark_sizes[first], np.diff(head_at), np.diff(text_at), mark_sizes[last]], 1).ravel()
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1]) if n else 0
    out = np.empty(total, np.uint8)
    for a in range(0, total, COPY_BYTES):
        b = min(total, a + COPY_BYTES)
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        reach = np.minimum(ends[lo:hi], b) - np.maximum(starts[lo:hi], a)
        np.take(pool, np.repeat(sources[lo:hi] - starts[lo:hi], reach) + np.arange(a, b), out=out[a:b])
    text_chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    head_chars = pc.utf8_length(heads).to_numpy(zero_copy_only=False)
    chars = mark_sizes[first] + head_chars + text_chars + mark_sizes[last]
    return out, ends[3::4], chars, mark_sizes[first] + head_chars, np.where(answer, text_chars, 0)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + SLICE_BYTES, "right")) - 1)
        yield a, b
        a = b


def format_chat(rows: DataFrame) -> DataFrame:
    """(conv_id, part, text, turns, loss): formatted conversations, a long one in several parts of whole turns.

    ``loss`` lists the (start, end) of the assistant texts in code points of the whole conversation.  Input columns are
    conv_id, turn, role and text; others are dropped.  Turns are ordered by turn (null first), then role and text, so
    repeated rows and ties have a fixed order.  Null roles and texts count as empty; a null conv_id is one conversation.
    Memory is bounded by a batch: a conversation is never held whole.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, text string, turns int, loss array<struct<start:bigint,end:bigint>>"
    dealt = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, position = object(), 0, 0
        for batch in batches:
            for a, b in _slices(batch.column(3)):
                piece = batch.slice(a, b - a)
                ids = piece.column(0).to_pylist()
                data, ends, chars, loss_at, loss_size = assemble(piece.column(2), piece.column(3))
                cuts = [0, *[k for k in range(1, len(ids)) if ids[k] != ids[k - 1]], len(ids)]
                buffer = pa.py_buffer(data)
                out = []
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if ids[x] != now:
                        now, part, position = ids[x], 0, 0
                    at = position + np.concatenate([[0], np.cumsum(chars[x:y])])
                    loss = [{"start": int(at[k - x] + loss_at[k]), "end": int(at[k - x] + loss_at[k] + loss_size[k])} for k in range(x, y) if loss_size[k]]
                    out.append((ids[x], part, y - x, loss))
                    part, position = part + 1, int(at[-1])
                offsets = np.concatenate([[0], ends])[cuts].astype(np.int32)
                texts = pa.StringArray.from_buffers(len(out), pa.py_buffer(offsets), buffer)
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([o[0] for o in out], piece.column(0).type), pa.array([o[1] for o in out], pa.int32()), texts,
                        pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], span),
                    ],
                    names=["conv_id", "part", "text", "turns", "loss"],
                )

    return dealt.mapInArrow(run, schema)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted part, unescaped."""
    out, at = [], 0
    while at < len(text):
        if text.startswith(OPEN, at):
            end = text.index(CLOSE, at)
            out.append((ASSISTANT, unescape(text[at + len(OPEN) : end])))
            at = end + len(CLOSE)
        elif text.startswith(ASK, at):
            end = text.index(ASKED, at)
            head = re.compile(r"(?:[^\\\n]|\\.)*", re.DOTALL).match(text, at + len(ASK))
            out.append((unescape(head[0]), unescape(text[head.end() + 1 : end])))
            at = end + len(ASKED)
        else:
            raise ValueError(f"no turn mark at {at}")
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output of ``format_chat`` as it lies (parts in order, not shuffled).

    Hashes run on from part to part, so a conversation of any length needs the memory of one part.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != now:
                    if state is not None:
                        done.append(state)
                    now, state = row["conv_id"], [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(row["text"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for s in row["loss"]:
                    own = unescape(row["text"][s["start"] - state[5] : s["end"] - state[5]])
                    state[3] += len(own)
                    state[4].update(own.encode())
                state[5] += len(row["text"])
            yield _rows(done, names, batch.schema.field("conv_id").type)
        if state is not None:
            yield _rows([state], names, batch.schema.field("conv_id").type)

    def _rows(done, names, id_type):
        columns = list(zip(*[(s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]) for s in done], strict=True)) or [[]] * 6
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return formatted.mapInArrow(run, schema)
