"""Chat formatting by columnar byte assembly.

A conversation becomes `<s>` and its turns: user `[INST] text [/INST]`, system `[SYS] text [/SYS]`, assistant
` text</s>`, any other role `[ROLE] name` + newline + `text [/ROLE]`. Control strings inside a text are escaped by a
backslash after their first character (and what already looks so escaped gets one backslash more), so that
unescaping gives the text back and a marker in the output is always the template's own.

Rows are dealt by conversation and sorted by turn; each Arrow batch is then assembled without a loop over
its rows: every turn is five segments of a byte pool, their lengths give the output's offsets by a cumulative
sum, and the output buffer is filled by gathering from the pool, a few MB at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows

#: The control strings of the template, all with a first character that occurs nowhere else in them.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
_TAIL = r"(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\])"
_ESCAPE = re.compile(r"([<\[])" + _TAIL)
_UNESCAPE = re.compile(r"([<\[])\\" + _TAIL)
#: By role code: user, system, assistant, other.
ROLES = ("user", "system", "assistant")
HEADS = ("[INST] ", "[SYS] ", " ", "[ROLE] ")
FEET = (" [/INST]", " [/SYS]", "</s>", " [/ROLE]")
#: Output bytes of one Arrow batch and of one gathering step.
BATCH_BYTES, STEP_BYTES = 16 << 20, 4 << 20


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _escaped(texts: pa.Array) -> pa.Array:
    """The texts, nulls as empty, control strings escaped; only rows that hold one are touched in Python."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    held = pc.match_substring_regex(texts, r"[<\[]\\*(?:/?s>|/?INST\]|/?SYS\]|/?ROLE\])")
    if not pc.any(held).as_py():
        return texts
    return pc.replace_with_mask(texts, held, pa.array([escape(t) for t in texts.filter(held).to_pylist()], pa.large_string()))


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a large_string array without nulls, and its n + 1 offsets into it."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The segments one after the other in one preallocated buffer."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, np.uint8)
    begins = ends - lengths
    for at in range(0, total, STEP_BYTES):
        to = min(total, at + STEP_BYTES)
        first, last = np.searchsorted(ends, at, "right"), np.searchsorted(begins, to, "left")
        own = slice(first, last)
        part = np.minimum(ends[own], to) - np.maximum(begins[own], at)
        out[at:to] = pool[np.arange(at, to) + np.repeat(starts[own] - begins[own], part)]
    return out


def assemble(first: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Format turns that are sorted by conversation.

    first: for each turn whether it begins a conversation. Returns the output bytes, the offset where each
    turn's conversation text begins or goes on (n + 1 offsets), and start and end of each turn's text in them.
    """
    n = len(first)
    texts, roles = _escaped(texts), pc.fill_null(roles.cast(pa.large_string()), "")
    code = pc.index_in(roles, pa.array(ROLES, pa.large_string())).fill_null(len(ROLES)).to_numpy(zero_copy_only=False).astype(np.int64)
    names = pc.if_else(pa.array(code == len(ROLES)), roles, pa.scalar("", pa.large_string()))
    if (code == len(ROLES)).any():
        names = pa.array([escape(json.dumps(r, ensure_ascii=False)[1:-1]) + "\n" if c == len(ROLES) else "" for r, c in zip(names.to_pylist(), code, strict=True)], pa.large_string())
    text_data, text_at = _bytes(texts)
    name_data, name_at = _bytes(names)
    fixed = [x.encode() for x in ("<s>", *HEADS, *FEET)]
    at = np.concatenate(([0], np.cumsum([len(x) for x in fixed])))
    size = np.array([len(x) for x in fixed], np.int64)
    pool = np.concatenate((np.frombuffer(b"".join(fixed), np.uint8), name_data, text_data))
    names_from, texts_from = at[-1], at[-1] + len(name_data)
    starts = np.stack((np.zeros(n, np.int64), at[1 + code], name_at[:-1] + names_from, text_at[:-1] + texts_from, at[1 + len(HEADS) + code]), axis=1)
    lengths = np.stack((np.where(first, size[0], 0), size[1 + code], np.diff(name_at), np.diff(text_at), size[1 + len(HEADS) + code]), axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    turn_at = np.concatenate(([0], ends[:, 4])) if n else np.zeros(1, np.int64)
    return _gather(pool, starts.ravel(), lengths.ravel()), turn_at, ends[:, 2], ends[:, 3]


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, role, text), conversations one after the other, to rows of (id, n_turns, formatted, loss_start, loss_end).

    A conversation that goes on into the next batch waits for it.
    """
    kept: list[pa.RecordBatch] = []

    def formatted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        n = table.num_rows
        if not n:
            return
        ids = table.column(0).chunk(0)
        first = np.concatenate(([True], _changes(ids)))
        # Cut into runs of whole conversations of about BATCH_BYTES.
        heads = np.flatnonzero(first)
        weight = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(table.column(2).chunk(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 32)))
        run = weight[heads] // BATCH_BYTES
        cuts = [*heads[np.concatenate(([True], run[1:] != run[:-1]))], n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = table.slice(a, b - a).combine_chunks()
            roles, texts, begun = part.column(1).chunk(0), part.column(2).chunk(0), first[a:b]
            data, turn_at, start, end = assemble(begun, roles, texts)
            own = np.flatnonzero(begun)
            offsets = turn_at[np.concatenate((own, [b - a]))]
            which = np.repeat(np.arange(len(own)), np.diff(np.concatenate((own, [b - a]))))
            loss = pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False)
            spans = np.concatenate(([0], np.cumsum(np.bincount(which[loss], minlength=len(own))))).astype(np.int32)
            base = offsets[:-1][which[loss]]
            text = pa.Array.from_buffers(pa.large_string(), len(own), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).chunk(0).take(pa.array(own)),
                    pa.array(np.bincount(which, minlength=len(own)).astype(np.int64)),
                    text.cast(pa.string()),
                    pa.ListArray.from_arrays(pa.array(spans), pa.array((start[loss] - base).astype(np.int64))),
                    pa.ListArray.from_arrays(pa.array(spans), pa.array((end[loss] - base).astype(np.int64))),
                ],
                names=["conv_id", "n_turns", "formatted", "loss_start", "loss_end"],
            )

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        last = np.flatnonzero(np.concatenate(([True], _changes(ids))))[-1]
        goes_on = kept and _same(kept[-1].column(0), ids)
        if last == 0 and goes_on:
            kept.append(batch)
            continue
        if kept and not goes_on:
            yield from formatted(pa.Table.from_batches(kept))
            kept = []
        if last:
            yield from formatted(pa.Table.from_batches([*kept, batch.slice(0, last)]))
        kept = [batch.slice(last)]
    if kept:
        yield from formatted(pa.Table.from_batches(kept))


def _changes(ids: pa.Array) -> np.ndarray:
    """For each row but the first whether its id differs from the one before; two nulls are equal."""
    if len(ids) < 2:
        return np.zeros(0, bool)
    a, b = ids.slice(0, len(ids) - 1), ids.slice(1)
    differ = pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)
    both = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return differ & ~both


def _same(before: pa.Array, after: pa.Array) -> bool:
    return before[len(before) - 1].as_py() == after[0].as_py()


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: id_col, n_turns, formatted, loss_start and loss_end.

    loss_start and loss_end are byte offsets into `formatted` (UTF-8) of each assistant text, in order: the
    loss mask. Turns go by turn, then role, then text; a null turn comes first. A null text or role is empty,
    null ids are one conversation. An empty table gives no row; other columns aren't read. A conversation is
    one output string, so its turns meet in one task, which keeps no more than that conversation and one batch.
    """
    rows = turns.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{turn_col}`").alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = arrow_rows(dealt, _format_batches, f"conv_id {kind}, n_turns bigint, formatted string, loss_start array<bigint>, loss_end array<bigint>")
    return out.withColumnRenamed("conv_id", id_col)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        code = next((k for k in (0, 1, 3) if formatted.startswith(HEADS[k], at)), 2)
        end = formatted.index(FEET[code], at + len(HEADS[code])) if code == 2 else formatted.index(FEET[code][1:], at + len(HEADS[code])) - 1
        text = formatted[at + len(HEADS[code]) : end]
        role = ROLES[code] if code < len(ROLES) else ""
        if code == len(ROLES):
            name, _, text = text.partition("\n")
            role = json.loads(f'"{unescape(name)}"')
        turns.append((role, unescape(text)))
        at = end + len(FEET[code])
    return turns


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, _, formatted, starts, ends = (batch.column(k) for k in range(5))
        rows = []
        for text, start, end in zip(formatted.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
            turns, raw = parse(text), text.encode()
            seen, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, said in turns:
                seen.update(f"{role}\n{said}\n".encode())
            for a, b in zip(start, end, strict=True):
                said = unescape(raw[a:b].decode())
                loss.update(said.encode())
                chars += len(said)
            rows.append((len(turns), seen.hexdigest(), chars, loss.hexdigest(), len(text)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted text and its loss mask say, for each conversation: counts and SHA-256 digests of turns and loss text."""
    kind = chats.schema[id_col].dataType.simpleString()
    rows = chats.select(F.col(id_col).alias("conv_id"), "n_turns", "formatted", "loss_start", "loss_end")
    out = arrow_rows(rows, _digest_batches, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return out.withColumnRenamed("conv_id", id_col)
