"""Chat formatting: whole conversations rendered and encoded once, with loss masks aligned by token offsets."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: TURN role BODY text END for each turn. These strings are single tokens and never occur in escaped text.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of a conversation that are encoded at once; a longer one is cut between turns, where control tokens stand.
PART_CHARS = 1 << 20
_OPEN, _SHUT = re.compile(r"<(~*)\|"), re.compile(r"<~(~*)\|")


def escape(text: str) -> str:
    """The text with a ~ more between each < and | that have only ~ between them: no control string is left."""
    return _OPEN.sub(r"<~\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text) if "<" in text else text


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level tokenizer of a rank file with the control strings as further tokens, and each token's bytes."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    top = max(ranks.values()) + 1
    special = {s: top + i for i, s in enumerate((TURN, BODY, END))}
    made = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    lengths = np.zeros(top + len(special), np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    for token, i in special.items():
        lengths[i] = len(token)
    return made, lengths, special


def _encode(text: str, spans: list[tuple[int, int]], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a rendered text, and the runs of tokens [from, to) that the byte spans cover."""
    made, lengths, _ = encoding(path)
    ids = made.encode_to_numpy(text, allowed_special="all").astype(np.int64)
    ends = np.cumsum(lengths[ids])
    begins = ends - lengths[ids]
    at = np.array(spans, np.int64).reshape(-1, 2)
    first, last = np.searchsorted(ends, at[:, 0], "right"), np.searchsorted(begins, at[:, 1], "left")
    last = np.maximum(first, last)
    full = last > first
    if not (np.array_equal(begins[first[full]], at[full, 0]) and np.array_equal(ends[last[full] - 1], at[full, 1])):
        raise ValueError("a token crosses the border of a turn")
    return ids.astype(np.int32), np.stack([first[full], last[full]], 1).astype(np.int32)


def _format(batches: Iterator[pa.RecordBatch], path: str, part_chars: int, loss_roles: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and turn; one row a part goes out."""
    out: list[tuple] = []
    held = 0
    now, part, text, size, chars, spans, turns = None, 0, [], 0, 0, [], 0
    any_ = False

    def close() -> None:
        nonlocal part, text, size, chars, spans, turns, held
        whole = "".join(text)
        ids, loss = _encode(whole, spans, path)
        out.append((now, part, turns, whole, ids, loss.reshape(-1)))
        held += len(whole)
        part, text, size, chars, spans, turns = part + 1, [], 0, 0, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal out, held
        cols = list(zip(*out, strict=True))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([*x, np.zeros(0, np.int32)]), pa.int32()))
        batch = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), lists(cols[4]), lists(cols[5])], names=["conv", "part", "turns", "formatted", "token_ids", "loss_spans"])
        out, held = [], 0
        return batch

    for batch in batches:
        for conv, role, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if any_ and (conv != now or chars >= part_chars):
                close()
                if held >= 1 << 22:
                    yield flush()
            if not any_ or conv != now:
                now, part, any_ = conv, 0, True
            head = TURN + escape(role or "") + BODY
            inner = escape(body or "")
            size += len(head.encode())
            wide = len(inner.encode())
            if (role or "") in loss_roles:
                spans.append((size, size + wide))
            size += wide + len(END)
            text += [head, inner, END]
            chars += len(head) + len(inner) + len(END)
            turns += 1
    if any_:
        close()
    if out:
        yield flush()


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",), tokenizer: str = TOKENIZER, part_chars: int = PART_CHARS) -> DataFrame:
    """One row per conversation: conv, part (0), turns, formatted (the rendered text), token_ids, and loss_spans (flat
    [from, to) token offsets of each non-empty text of a loss role).

    Turns are ordered by turn number, ties by role and text. Control strings in roles and texts are escaped; null roles
    and texts are empty; rows with a null conversation form one. A conversation is encoded once as a whole; one of over
    ``part_chars`` characters has several rows, cut between turns, where control tokens keep the encoding the same, so a
    conversation of any length is streamed, in order, in bounded memory. Rows of a conversation stand together and in order
    within their partition. The only shuffle is by conversation. Conversation ids must be integers; other columns are not read.
    """
    roles = frozenset(loss_roles)
    ordered = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"), F.col(turn_col).alias("turn"))
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    return ordered.mapInArrow(lambda it: _format(it, tokenizer, part_chars, roles), "conv long, part int, turns long, formatted string, token_ids array<int>, loss_spans array<int>")


def _read(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    made, _, _ = encoding(path)
    out: list[tuple] = []
    now, any_ = None, False
    turns, loss, n, chars, shown = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def close() -> None:
        out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), shown))

    for batch in batches:
        convs, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ids_of, spans_of = batch.column(4), batch.column(5)
        for k, (conv, part) in enumerate(zip(convs, parts, strict=True)):
            if part == 0:
                if any_:
                    close()
                now, any_ = conv, True
                turns, loss, n, chars, shown = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            ids = ids_of[k].values.to_numpy()
            text = made.decode_bytes(ids.tolist()).decode()
            shown += len(text)
            for turn in text.split(TURN)[1:]:
                role, _, body = turn.removesuffix(END).partition(BODY)
                turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                n += 1
            for a, b in spans_of[k].values.to_numpy().reshape(-1, 2):
                under = unescape(made.decode_bytes(ids[a:b].tolist()).decode())
                chars += len(under)
                loss.update(under.encode())
        if len(out) >= 1000:
            yield _rows(out)
            out = []
    if any_:
        close()
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """What ``format_conversations`` rows hold, from their tokens and masks alone: turns parsed from the decoded text, and
    the unescaped text under each run of the mask; digests are of the whole conversation. Needs the rows in their order."""
    return formatted.mapInArrow(lambda it: _read(it, tokenizer), "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
