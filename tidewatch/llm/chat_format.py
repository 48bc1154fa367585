"""Chat conversations as training text with a loss mask, assembled as columns of bytes, and read back.

A user's turn is ``[INST] text [/INST]``, an assistant's ``text</s>``, that of another role ``[ROLE] role [/ROLE] text</s>``.
``[INST]``, ``[/INST]``, ``[ROLE]``, ``[/ROLE]``, ``<s>`` and ``</s>`` are control strings. Inside a text or a role a backslash is
put behind the first character of each, and one more where backslashes stand there already, so that taking one away gives
the text back and a control string that is met is always the template's. The loss mask holds the bytes of the assistants'
texts, without their end marks.

Rows are ordered by conversation and turn over all tasks, so that a conversation of any length is spread over several of
them, and formatted in *pieces*: of each Arrow batch, the rows of one conversation. A batch is assembled at once: lengths of
headers, contents and footers give cumulative offsets, these the place of each source byte, and all are copied into one
buffer that backs the Arrow column. Turns need no context, so the pieces of a conversation in order are its text.

Defined results: null texts and roles are empty; rows without a turn come first, those of equal turns are ordered by role
and text; rows of null ids are one conversation; repeated rows are turns of their own; texts of any length and of any
characters come back as they were; further columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKED = r"(\[\\*(?=/?(?:INST|ROLE)\])|<\\*(?=/?s>))"
UNMARKED = re.compile(r"(\[\\*(?=\\/?(?:INST|ROLE)\])|<\\*(?=\\/?s>))\\")
TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?)</s>|(?P<assistant>.*?)</s>", re.DOTALL)
FORMATTED = "piece long, formatted string, loss_spans array<struct<start: int, end: int>>"
PIECES = "piece long, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long"
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: First characters of a text that take part in the ranges of the order.
LEAD = 32


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, r"$1\\")


def unescaped(text: str) -> str:
    return UNMARKED.sub(r"\1", text)


def string_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of an Arrow string column."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def assembled(columns) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with the rows' strings side by side, column after column in each row, and where each string starts (rows
    x columns; one more row holds the end)."""
    parts = [string_parts(c) for c in columns]
    lengths = np.stack([np.diff(offsets) for _, offsets in parts], 1)
    ends = np.cumsum(lengths.ravel())
    starts = np.concatenate([[0], ends[:-1]]).reshape(lengths.shape) if len(ends) else np.zeros(lengths.shape, np.int64)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for k, (data, offsets) in enumerate(parts):
        out[np.repeat(starts[:, k] - offsets[:-1], lengths[:, k]) + np.arange(len(data))] = data
    return out, np.vstack([starts, np.full((1, len(parts)), len(out))])


def assemble(batches):
    """Arrow function: (conv_id, piece, formatted, loss_spans) from (conv_id, header, content, footer, is_loss) in order."""
    import pyarrow as pa
    from pyspark import TaskContext

    piece = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        out, starts = assembled([batch.column(c) for c in ("header", "content", "footer")])
        ids = batch.column("conv_id")
        codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.concatenate([[0], np.nonzero(np.diff(codes))[0] + 1])
        cuts = np.append(starts[first, 0], len(out)).astype(np.int32)
        formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts), pa.py_buffer(out))
        masked = np.nonzero(batch.column("is_loss").to_numpy(zero_copy_only=False))[0]
        base = cuts[np.searchsorted(first, masked, "right") - 1]
        spans = pa.StructArray.from_arrays([pa.array((starts[masked, k] - base).astype(np.int32)) for k in (1, 2)], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(masked, np.append(first, batch.num_rows)).astype(np.int32)), spans)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(piece + np.arange(len(first))), formatted, lists], ["conv_id", "piece", "formatted", "loss_spans"])
        piece += len(first)


def id_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, formatted, loss_spans) from turns (conv_id, turn, role, text); spans are bytes of the piece's UTF-8 text."""
    empty = F.lit("")
    rows = rows.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = ["conv_id", "turn", "role"]
    ordered = rows.repartitionByRange(*order, F.left("text", F.lit(LEAD))).sortWithinPartitions(*order, "text")
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    parts = ordered.select(
        "conv_id",
        F.when(user, "[INST] ").when(assistant, "").otherwise(F.concat(F.lit("[ROLE] "), escaped(F.col("role")), F.lit(" [/ROLE] "))).alias("header"),
        escaped(F.col("text")).alias("content"),
        F.when(user, " [/INST]").otherwise("</s>").alias("footer"),
        assistant.alias("is_loss"),
    )
    return parts.mapInArrow(assemble, f"conv_id {id_type(rows)}, {FORMATTED}")


def turns_of(formatted: str):
    """(role, text) of the turns of a formatted piece; raises if something else stands between them."""
    at = 0
    for found in TURN.finditer(formatted):
        if found.start() != at:
            break
        at = found.end()
        kind = found.lastgroup
        yield unescaped(found["role"]) if kind == "other" else kind, unescaped(found[kind])
    if at != len(formatted):
        raise ValueError(f"no turn at character {at} of a formatted text")


def read_pieces(batches):
    """Arrow function: the turns of each piece as bytes, and what its loss mask covers, as bytes and characters."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns, data = list(turns_of(text)), text.encode()
            loss = "".join(unescaped(data[s["start"] : s["end"]].decode()) for s in spans)
            rows.append((len(turns), "".join(f"{role}\n{said}\n" for role, said in turns).encode(), loss.encode(), len(loss), len(text)))
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), *columns], ["conv_id", "piece", "n_turns", "turns", "loss", "loss_chars", "formatted_chars"])


def digest_pieces(schema):
    """Arrow function: one row of sums and running digests for each conversation, from its pieces in order."""

    def digest(batches):
        import pyarrow as pa

        def sent(state):
            conv, n, turns, chars, loss, length = state
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": length}], schema)

        state = None
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        yield sent(state)
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[2].update(row["turns"])
                state[4].update(row["loss"])
                for k, name in ((1, "n_turns"), (3, "loss_chars"), (5, "formatted_chars")):
                    state[k] += row[name]
        if state is not None:
            yield sent(state)

    return digest


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from ``format_chats``. Pieces are parsed
    wherever they lie; those of a conversation are then hashed in order by one task, which holds a batch of them at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    pieces = formatted.mapInArrow(read_pieces, f"conv_id {id_type(formatted)}, {PIECES}")
    strings = {"turns_sha256", "loss_sha256"}
    names = [part.split()[0] for part in DIGESTS.split(", ")]
    schema = pa.schema([("conv_id", to_arrow_type(formatted.schema["conv_id"].dataType)), *[(n, pa.string() if n in strings else pa.int64()) for n in names]])
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(digest_pieces(schema), f"conv_id {id_type(formatted)}, {DIGESTS}")
