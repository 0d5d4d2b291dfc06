"""Chat formatting by columnar byte assembly.

Template: a user turn is ``[INST] text [/INST]``, an assistant turn
``<s>text</s>``, a turn of any other role ``[ROLE]role[/ROLE]text[/ROLE]``.
Inside texts and role names a backslash is doubled, and a control string gets a
backslash after its first character, so none of them can be mistaken for the
template's and ``parse`` gives back the very texts.

Turns are dealt by conversation, sorted, and assembled batch by batch in numpy:
lengths of headers, texts and footers, their cumulative offsets, and scatter
indices that copy all bytes into one preallocated Arrow buffer. The loss mask
is the list of [start, end) spans, in code points of the formatted string, of
the assistants' texts.

Defined results: null text is empty, a null role is the empty role name; turns
go by turn, then role, then text (nulls first), equal rows stay; rows with a
null conv_id form one conversation; an empty table gives an empty result. Extra
columns are ignored. One conversation becomes one string, so it has to fit in a
task; copies of conversations don't meet in one.
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

from .common import row_id

#: The strings that mark turns.
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]")
_NEEDS = r"[\\]|\[/?INST\]|</?s>|\[/?ROLE\]"
_MARK = re.compile("|".join(map(re.escape, CONTROL)))

FORMATTED = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    """A text without control strings that unescape() turns back."""
    return _MARK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def header(role: str) -> tuple[str, str]:
    """What stands before and after the text of a role's turn."""
    if role == "user":
        return "[INST] ", " [/INST]"
    if role == "assistant":
        return "<s>", "</s>"
    return f"[ROLE]{escape(role)}[/ROLE]", "[/ROLE]"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the text as formatted."""
    turns, at = [], 0
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            start, end = at + 7, formatted.index(" [/INST]", at + 7)
            role, at = "user", end + 8
        elif formatted.startswith("<s>", at):
            start, end = at + 3, formatted.index("</s>", at + 3)
            role, at = "assistant", end + 4
        elif formatted.startswith("[ROLE]", at):
            named = formatted.index("[/ROLE]", at + 6)
            start, end = named + 7, formatted.index("[/ROLE]", named + 7)
            role, at = unescape(formatted[at + 6 : named]), end + 7
        else:
            raise ValueError(f"no turn begins at {at}")
        turns.append((role, unescape(formatted[start:end]), start, end))
    return turns


def _binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), bounds


def assemble(roles: pa.Array, texts: pa.Array, firsts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted conversations of turns that lie in order; firsts: where each
    conversation begins. Returns the strings, then for each turn whether it is
    an assistant's and the code points at which its text starts and ends."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    dirty = pc.match_substring_regex(texts, _NEEDS)
    if pc.any(dirty).as_py():
        texts = pc.if_else(dirty, pa.array([escape(t) if d else "" for t, d in zip(texts.to_pylist(), dirty.to_pylist(), strict=True)], pa.large_string()), texts)
    coded = pc.dictionary_encode(pc.fill_null(roles.cast(pa.string()), ""))
    names = coded.dictionary.to_pylist()
    kind = coded.indices.to_numpy(zero_copy_only=False)
    n = len(kind)
    # three pieces a turn: header, text, footer, all drawn from one source of bytes
    heads = [[p.encode() for p in header(r)] for r in names]
    fixed = np.frombuffer(b"".join(p for pair in heads for p in pair), np.uint8)
    sizes = np.array([[len(p) for p in pair] for pair in heads], np.int64).reshape(-1, 2)
    places = np.concatenate([[0], np.cumsum(sizes.reshape(-1))])[:-1].reshape(-1, 2)
    data, bounds = _binary(texts)
    lengths, source = np.empty((n, 3), np.int64), np.empty((n, 3), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = sizes[kind, 0], np.diff(bounds), sizes[kind, 1]
    source[:, 0], source[:, 1], source[:, 2] = places[kind, 0], bounds[:-1] + len(fixed), places[kind, 1]
    ends = np.cumsum(lengths.reshape(-1))
    total = int(ends[-1]) if n else 0
    out = np.empty(total, np.uint8)
    pool = np.concatenate([fixed, data])
    flat_l, flat_s, begins = lengths.reshape(-1), source.reshape(-1), ends - lengths.reshape(-1)
    step = 1 << 22
    for a in range(0, total, step):  # scatter indices of a few MB at a time
        b = min(total, a + step)
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, b, "left"))
        lo, hi = np.maximum(begins[i:j], a), np.minimum(ends[i:j], b)
        out[a:b] = pool[np.repeat(flat_s[i:j] + lo - begins[i:j] - lo, hi - lo) + np.arange(a, b)]
    # code points: bytes that don't continue a character
    turn_bytes = np.concatenate([[0], ends[2::3]])
    conv = np.append(turn_bytes[firsts], total)
    chars, held = np.zeros(len(flat_l), np.int64), flat_l > 0
    for a in range(0, total, step):  # no number for each byte is ever held
        b = min(total, a + step)
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, b, "left"))
        some = np.arange(i, j)[held[i:j]]
        chars[some] += np.add.reduceat(((out[a:b] & 0xC0) != 0x80).view(np.uint8), np.maximum(begins[some], a) - a, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(chars)])
    base = before[3 * firsts[np.searchsorted(firsts, np.arange(n), "right") - 1]] if n else np.zeros(0, np.int64)
    start, end = before[1:-1:3] - base, before[2::3] - base
    strings = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(conv.astype(np.int64).tobytes()), pa.py_buffer(out))
    spoken = np.array([r == "assistant" for r in names], bool)[kind] if n else np.zeros(0, bool)
    return strings, spoken, start, end


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows regrouped so that no conversation spans two tables."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        ids = t.column("conv_id").combine_chunks()
        last = ids[len(ids) - 1]
        same = pc.is_null(ids) if not last.is_valid else pc.fill_null(pc.equal(ids, last), False)
        cut = int(np.argmax(same.to_numpy(zero_copy_only=False)))  # sorted: the last conversation begins here
        if cut:
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held = [t.slice(cut)]
        else:
            before = held[-1].column("conv_id") if held else None
            if before is not None and before[len(before) - 1] != ids[0]:
                yield pa.concat_tables(held)
                held = []
            held.append(t)
    if held:
        yield pa.concat_tables(held)


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _runs(batches):
        t = t.combine_chunks()
        ids = t.column("conv_id").combine_chunks()
        plain = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        empty = pc.is_null(ids).to_numpy(zero_copy_only=False)
        new = np.ones(len(ids), bool)
        new[1:] = (plain[1:] != plain[:-1]) | (empty[1:] != empty[:-1])
        firsts = np.flatnonzero(new)
        strings, spoken, start, end = assemble(t.column("role").combine_chunks(), t.column("text").combine_chunks(), firsts)
        at = np.flatnonzero(spoken)
        spans = pa.StructArray.from_arrays([pa.array(start[at]), pa.array(end[at])], ["start", "end"])
        offsets = np.searchsorted(at, np.append(firsts, len(ids)), "left").astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(firsts)), pa.array(np.diff(np.append(firsts, len(ids)))), strings.cast(pa.string()), pa.ListArray.from_arrays(pa.array(offsets), spans)],
            names=["conv_id", "n_turns", "formatted", "loss"],
        )


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, formatted, loss): one row for each conversation."""
    df = rows.select(row_id(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    df = df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return df.select("conv_id", "role", "text").mapInArrow(_format_batches, FORMATTED)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
            turns, said, digest = parse(formatted), hashlib.sha256(), hashlib.sha256()
            for role, text, _, _ in turns:
                said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            chars = 0
            for span in loss:
                own = unescape(formatted[span["start"] : span["end"]])
                chars += len(own)
                digest.update(own.encode("utf-8", "surrogatepass"))
            out.append((conv, len(turns), said.hexdigest(), chars, digest.hexdigest(), len(formatted)))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted conversations say, parsed from the strings and loss spans alone."""
    return formatted.mapInArrow(_read_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def oracle_sql(added: list[tuple[int, int, str, str]]) -> str:
    """read_back() of all conversations and the added rows, for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def escaped(c: str) -> str:
        c = f"replace({c}, {quote(chr(92))}, {quote(chr(92) * 2)})"
        for mark in CONTROL:
            c = f"replace({c}, {quote(mark)}, {quote(mark[0] + chr(92) + mark[1:])})"
        return c

    rows = " UNION ALL ".join(f"SELECT {a}, {b}, {quote(r)}, {quote(t)}" for a, b, r, t in added)
    order = "ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST"
    fixed = {r: sum(map(len, header(r))) for r in ("user", "assistant")}
    return f"""
WITH c AS (SELECT conv_id, turn, role AS r0, text AS t0 FROM conversations UNION ALL {rows}),
t AS (SELECT *, coalesce(r0, '') AS role, coalesce(t0, '') AS text FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({escaped('text')}) + CASE role WHEN 'user' THEN {fixed['user']} WHEN 'assistant' THEN {fixed['assistant']} ELSE {sum(map(len, header('')))} + length({escaped('role')}) END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
