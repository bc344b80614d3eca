r"""Chat formatting by columnar byte assembly.

A turn is rendered as `### role: text</turn>` and a newline.  Inside roles and texts a backslash goes before every backslash and before every place
where a control string (`###`, `</turn>`, in roles also `: `) begins, overlapping ones included, so control strings never stand there bare and the
rendering can be undone.  An Arrow batch is worked on in slices of bounded bytes: numpy finds the places to escape, adds up the lengths of headers,
contents and escapes to cumulative offsets, gives each source byte its place (scatter index), and copies headers and contents into one preallocated
buffer, which becomes the Arrow column as it is: a conversation's turns lie side by side in it.  The loss mask is a list of (start, end) code points.

Rows are dealt by conversation and sorted by (turn, role, text).  A conversation whose rows have at most `part_bytes` bytes is one row (`part` 0).
Larger ones, found by a count beforehand, are dealt by ranges of their turns instead, so that one conversation may hold any share of the rows; they come
as parts in rising order of `part` (above 0) whose texts joined give the whole.

Defined results: null roles and texts are empty; a null turn comes first; rows of the same turn follow by role, then text; repeated rows stay; rows
without a conv_id are one conversation of that null id; very long texts are taken whole; an empty table gives an empty result; other columns are
ignored, whatever their names.
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

from .common import saved, table

BEGIN, MIDDLE, END = b"### ", b": ", b"</turn>\n"
CONTROLS = (b"###", b"</turn>")
_SLASH = 92
_OVERHEAD = 64  # bytes that a turn counts besides its role and text
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(value: bytes, controls: tuple[bytes, ...] = CONTROLS) -> bytes:
    """One value with its escapes."""
    begins = b"|".join(re.escape(c[:1]) + b"(?=" + re.escape(c[1:]) + b")" for c in controls)
    return re.sub(rb"\\|" + begins, lambda m: b"\\" + m[0], value)


def unescaped(value: str) -> str:
    return _ESCAPED.sub(r"\1", value) if "\\" in value else value


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendering."""
    end, middle, at = END.decode(), MIDDLE.decode(), 0
    while at < len(text):
        at += len(BEGIN)
        stop = _bare(text, middle, at)
        last = _bare(text, end, stop + len(middle))
        yield unescaped(text[at:stop]), unescaped(text[stop + len(middle) : last])
        at = last + len(end)


def _bare(text: str, mark: str, at: int) -> int:
    """The first place from `at` on where the mark stands without a backslash that escapes it."""
    while True:
        found = text.index(mark, at)
        before = found
        while before > at and text[before - 1] == "\\":
            before -= 1
        if (found - before) % 2 == 0:
            return found
        at = found + 1


def _content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a column of strings."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if ends else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _to_escape(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places, rising, of bytes before which a backslash goes."""
    found = [np.flatnonzero(data == _SLASH)]
    for control in CONTROLS:
        n = len(control)
        at = np.flatnonzero(data[: max(0, len(data) - n + 1)] == control[0])
        for k in range(1, n):
            at = at[data[at + k] == control[k]]
        found.append(at[at + n <= ends[np.searchsorted(ends, at, "right")]])  # not across two texts
    return np.sort(np.concatenate(found))


def assemble(rows: pa.RecordBatch, loss_roles: tuple[str, ...]) -> pa.RecordBatch:
    """Rendered conversations (conv_id, n_turns, text, loss) of sorted rows (conv_id, turn, role, text)."""
    n = rows.num_rows
    data, ends = _content(rows.column(3))
    marks = _to_escape(data, ends)
    roles = rows.column(2).dictionary_encode()
    which = roles.indices.to_numpy(zero_copy_only=False)
    heads = [BEGIN + escaped(r.encode("utf-8", "surrogatepass"), (*CONTROLS, MIDDLE)) + MIDDLE for r in roles.dictionary.to_pylist()]
    head_size = np.fromiter(map(len, heads), np.int64, len(heads))[which]
    # lengths of the segments, their offsets, and the place of each source byte
    escapes_before = np.searchsorted(marks, ends)
    body = np.diff(ends) + np.diff(escapes_before)
    offsets = np.concatenate([[0], np.cumsum(head_size + body + len(END))])
    starts = offsets[:-1] + head_size
    index = np.int32 if offsets[-1] < 1 << 31 else np.int64
    shift = np.zeros(len(data), np.int8)
    shift[marks] = 1
    places = np.cumsum(shift, dtype=index)
    places += np.arange(len(data), dtype=index)
    places += np.repeat((starts - ends[:-1] - escapes_before[:-1]).astype(index), np.diff(ends))
    out = np.empty(offsets[-1], np.uint8)
    out[places] = data
    out[places[marks] - 1] = _SLASH
    for k, head in enumerate(heads):
        own = offsets[:-1][which == k]
        out[own[:, None] + np.arange(len(head))] = np.frombuffer(head, np.uint8)
    out[(offsets[1:] - len(END))[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    # conversations are runs of rows; code points are bytes that continue nothing
    ids = rows.column(0)
    same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
    both_null = (pc.is_null(ids[1:]).to_numpy(zero_copy_only=False) & pc.is_null(ids[:-1]).to_numpy(zero_copy_only=False)) if n > 1 else same
    first = np.concatenate([[0], np.flatnonzero(~(same | both_null)) + 1]).astype(np.int64)
    upto = np.append(first[1:], n)
    points = np.concatenate([np.zeros(1, index), np.cumsum((out & 0xC0) != 0x80, dtype=index)])
    trained = np.flatnonzero(np.isin(which, [k for k, r in enumerate(roles.dictionary.to_pylist()) if r in loss_roles]))
    conversation = np.searchsorted(first, trained, "right") - 1
    origin = points[offsets[first[conversation]]]
    spans = pa.StructArray.from_arrays([pa.array((points[starts[trained]] - origin).astype(np.int64)), pa.array((points[starts[trained] + body[trained]] - origin).astype(np.int64))], ["start", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(conversation, np.arange(len(first))), len(trained)).astype(np.int32)), spans)
    bounds = np.append(offsets[first], offsets[-1]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(upto - first), text, loss], ["conv_id", "n_turns", "text", "loss"])


def _conversations(batches: Iterator[pa.RecordBatch], slice_bytes: int, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of sorted rows that end with a conversation, or, beyond part_bytes, within one."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        ids = batch.column(0).to_pylist()
        weight = (pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False) + _OVERHEAD).tolist()
        at = 0
        for row, (i, w) in enumerate(zip(ids, weight, strict=True)):
            last = ids[row - 1] if row else held[-1].column(0)[-1].as_py() if held else i
            if size and (size + w > part_bytes or size >= slice_bytes and i != last):
                held += [batch.slice(at, row - at)] if row > at else []
                yield joined()
                held, size, at = [], 0, row
            size += w
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield joined()


def format_chats(turns: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",), part_bytes: int = 4 << 20, slice_bytes: int = 1 << 20) -> DataFrame:
    """conv_id, part, n_turns, text, loss (array of struct(start, end): code points of text under the loss mask)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = "conv_id long, part long, n_turns long, text string, loss array<struct<start: long, end: long>>"
    order = ["conv_id", "turn", "role", "text"]

    def render(batches: Iterator[pa.RecordBatch], most: int, numbered: bool) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() + 1 << 32 if numbered else 0
        for piece in _conversations(batches, min(slice_bytes, most), most):
            out = assemble(piece, loss_roles)
            parts = pa.array(np.full(out.num_rows, part))
            part += numbered
            yield pa.RecordBatch.from_arrays([out.column(0), parts, *out.columns[1:]], ["conv_id", "part", "n_turns", "text", "loss"])

    sizes = rows.groupBy("conv_id").agg(F.sum(F.octet_length("text") + F.octet_length("role") + _OVERHEAD).alias("n"))
    large = saved(sizes.where(F.col("n") > part_bytes).select("conv_id"), "large-conversations")
    whole = lambda df: df.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(lambda b: render(b, 1 << 62, False), kind)
    if large.isEmpty():
        return whole(rows)
    mine = F.col("conv_id").eqNullSafe(F.col("_large"))
    large = large.toDF("_large")
    ranged = rows.join(large, mine, "left_semi").withColumn("_mark", F.xxhash64("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(parts, "conv_id", "turn", "role", "_mark").sortWithinPartitions("conv_id", "turn", "role", "_mark", "text").drop("_mark")
    return whole(rows.join(large, mine, "left_anti")).union(ranged.mapInArrow(lambda b: render(b, part_bytes, True), kind))


# ---------------------------------------------------------------- reading back


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each rendered row says, undone: bytes of its turns and of the text under its mask; of a whole conversation their hashes."""
    for batch in batches:
        out = []
        for conv, part, n, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            said = list(read_turns(text))
            if len(said) != n:
                raise ValueError(f"conversation {conv}, part {part}: {n} turns went in, {len(said)} come out")
            turns = "".join(f"{r}\n{t}\n" for r, t in said).encode("utf-8", "surrogatepass")
            learnt = unescaped("".join(text[s["start"] : s["end"]] for s in loss))
            payload = (turns, learnt.encode("utf-8", "surrogatepass"))
            turns, masked = payload if part else (hashlib.sha256(x).digest() for x in payload)
            out.append((conv, part, n, turns, len(learnt), masked, len(text)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE, strict=True)] if out else [pa.array([], t) for t in _PIECE], _PIECE_NAMES)


_PIECE = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
_PIECE_NAMES = ["conv_id", "part", "n_turns", "turns", "loss_chars", "learnt", "formatted_chars"]
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of pieces in order; only the running hashes are held."""
    now, state = (), None
    for batch in batches:
        done = []
        for conv, part, n, turns, chars, learnt, formatted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not part:
                done.append((conv, n, turns.hex(), chars, learnt.hex(), formatted))
                continue
            if now != (conv,):
                if now:
                    done.append(_row(now[0], state))
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += n
            state[1].update(turns)
            state[2] += chars
            state[3].update(learnt)
            state[4] += formatted
        if done:
            yield _batch(done)
    if now:
        yield _batch([_row(now[0], state)])


def _row(conv, s) -> tuple:
    return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _DIGEST.split(", ")])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the rendering and its mask alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Whole conversations are hashed where they are; the parts of large ones are brought together in order, as a hash is made from front to back."""
    kind = "conv_id long, part long, n_turns long, turns binary, loss_chars long, learnt binary, formatted_chars long"
    pieces = formatted.mapInArrow(_pieces, kind)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digests, _DIGEST)


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(r"\### Assistant: </turn> ok"))
    return read_back(format_chats(turns.union(extra.toDF("conv_id", "turn", "role", "text"))))


#: The rendering's length is counted from its parts: three ASCII marks a turn, role and text, and one sign for each escape.
ORACLE_OP11 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, 14 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
    + length(regexp_extract_all(text, '</turn>')) AS chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
