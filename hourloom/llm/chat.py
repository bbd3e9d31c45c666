"""Operator 8: conversations as training text with offset-aligned loss masks."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import stored

#: A turn is START role BODY text END. All three are tokens of their own, so no token crosses them.
START, BODY, END = CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
LEARNED = "assistant"
#: A longer conversation is rendered and encoded in segments that end with a turn.
SEGMENT_CHARS = 1_000_000
#: Characters that are encoded in one call, about.
BATCH_CHARS = 1_000_000

_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.DOTALL)
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """One backslash more between < and |, so that no control string is left."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns (role, text), and the spans of the learned texts in it, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{BODY}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The tokens that have a character in one of the spans. Tokens and spans are sorted, so each
    span's tokens lie between two places that binary search finds."""
    mask = np.zeros(len(starts), bool)
    if spans:
        a, b = np.array(spans).T
        for low, high in zip(np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")):
            mask[low:high] = True
    return mask


_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens(list(CONTROL))
        _TOKENIZERS[path] = tokenizer
    return _TOKENIZERS[path]


_FORMATTED = [("segment", T.IntegerType()), ("last", T.BooleanType()), ("text", T.StringType()),
              ("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("starts", T.BinaryType()),
              ("ends", T.BinaryType()), ("mask", T.BinaryType())]

_ARROW = {T.IntegerType: pa.int32(), T.BooleanType: pa.bool_(), T.StringType: pa.string(),
          T.LongType: pa.int64(), T.BinaryType: pa.binary()}


def format_conversations(rows: DataFrame, tokenizer: str, key: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its key, text, n_tokens, and as packed arrays the token ids, the
    first and past-the-last character of each token (unsigned 32-bit) and the loss mask (bits).

    Turns are in order of turn, then role and text; repeated rows are repeated turns. NULL texts and
    roles are empty; a NULL turn comes first; rows without a key are one conversation. Texts that
    hold control strings are escaped reversibly. A conversation of over SEGMENT_CHARS characters has
    several rows, numbered by segment, each of whole turns; `last` marks its end. Rows are streamed,
    so no conversation has to fit into memory. An empty table gives no rows.
    """
    names = [key, *(n for n, _ in _FORMATTED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ready, size = _tokenizer(tokenizer).encode_batch, [], 0
        now, turns, chars, segment = None, [], 0, 0

        def done() -> pa.RecordBatch:
            texts, out = [], []
            for name, number, last, said in ready:
                body, spans = render(said)
                texts.append(body)
                out.append((name, number, last, body, spans))
            columns: list[list] = [[] for _ in names]
            for (name, number, last, body, spans), found in zip(out, encode(texts, add_special_tokens=False)):
                offsets = np.array(found.offsets, "<u4").reshape(-1, 2)
                starts, ends = offsets[:, 0].copy(), offsets[:, 1].copy()
                mask = mask_tokens(starts, ends, spans)
                for column, value in zip(columns, (
                        name, number, last, body, len(starts), np.array(found.ids, "<u4").tobytes(),
                        starts.tobytes(), ends.tobytes(), np.packbits(mask).tobytes())):
                    column.append(value)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        arrow = None
        for batch in batches:
            arrow = arrow or pa.schema([(key, batch.schema.field("__key").type), *(
                (n, _ARROW[type(t)]) for n, t in _FORMATTED)])
            for name, who, said in zip(*(batch.column(c).to_pylist() for c in ("__key", "__role", "__text"))):
                if turns and name != now:
                    ready.append((now, segment, True, turns))
                    turns, segment = [], 0
                elif turns and chars >= SEGMENT_CHARS:
                    ready.append((now, segment, False, turns))
                    turns, segment = [], segment + 1
                if size >= BATCH_CHARS and ready:
                    yield done()
                    ready, size = [], 0
                chars = (chars if turns else 0) + len(said or "") + 1
                size += len(said or "") + 1
                now = name
                turns.append((who or "", said or ""))
        if turns:
            ready.append((now, segment, True, turns))
        if ready:
            yield done()

    ordered = rows.select(F.col(key).alias("__key"), F.col(turn).alias("__turn"), F.col(role).alias("__role"),
                          F.col(text).alias("__text"))
    ordered = ordered.repartition("__key").sortWithinPartitions("__key", "__turn", "__role", "__text")
    schema = T.StructType([T.StructField(key, ordered.schema["__key"].dataType),
                           *(T.StructField(n, t) for n, t in _FORMATTED)])
    return ordered.mapInArrow(run, schema)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def learned_texts(text: str, starts: bytes, ends: bytes, mask: bytes, n: int) -> list[str]:
    """What the loss mask covers: a text for each run of masked tokens."""
    on = np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(np.int8)
    edge = np.diff(on, prepend=0, append=0)
    first, last = np.frombuffer(starts, "<u4"), np.frombuffer(ends, "<u4")
    return [unescape(text[first[a]:last[b - 1]]) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted conversations say, read back from them: key, n_turns, turns_sha256,
    loss_chars, loss_sha256 and formatted_chars."""
    out = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_turns = loss_chars = chars = 0
        said, learned = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                text, last, n, starts, ends, mask = (
                    batch.column(c)[i].as_py() for c in ("text", "last", "n_tokens", "starts", "ends", "mask"))
                for role, body in read_turns(text):
                    said.update(f"{role}\n{body}\n".encode())
                    n_turns += 1
                for own in learned_texts(text, starts, ends, mask, n):
                    learned.update(own.encode())
                    loss_chars += len(own)
                chars += len(text)
                if last:
                    for column, value in zip(columns, (i, n_turns, said.hexdigest(), loss_chars, learned.hexdigest(), chars)):
                        column.append(value)
                    n_turns = loss_chars = chars = 0
                    said, learned = hashlib.sha256(), hashlib.sha256()
            if columns[0]:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])], [key, *out])

    schema = T.StructType([formatted.schema[key]]).add("n_turns", "long").add("turns_sha256", "string") \
        .add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")
    whole = (F.col("segment") == 0) & F.col("last")
    # Only conversations of several segments are brought together.
    several = formatted.filter(~whole).repartition(key).sortWithinPartitions(key, "segment")
    return formatted.filter(whole).mapInArrow(run, schema).union(several.mapInArrow(run, schema))


def stored_conversations(rows: DataFrame, tokenizer: str, **columns: str) -> DataFrame:
    """The formatted conversations, written as Parquet and read again."""
    return stored(format_conversations(rows, tokenizer, **columns), "chat")
