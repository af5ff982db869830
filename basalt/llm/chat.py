"""Chat formatting with offset-aligned loss masks.

Every conversation is rendered whole, encoded once with character offsets, and
the sorted spans of its assistant texts are intersected with the token spans by
binary search.

The template writes a turn as ``<turn ROLE>\\nTEXT</turn>\\n``.  Inside roles and
texts a backslash goes before every backslash, ``<`` and (roles only) ``>`` and
line end, so control strings cannot occur inside them and every escape can be
read back.

Defined results: turns are ordered by turn (null first), then role and text, so
ties and repeated rows have one order; null role or text counts as empty; a
row without a conv_id belongs to no conversation and is one of its own; an empty
table gives no rows; other columns are not read.  A conversation is one sequence
for the model and is rendered in one task, as long as it is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_arrow

OPEN, AFTER_ROLE, CLOSE = "<turn ", ">\n", "</turn>\n"
_TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)
SCHEMA = "conv_id long, formatted string, token_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>, span_start array<int>, span_end array<int>"


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("<", "\\<")
    return text.replace(">", "\\>").replace("\n", "\\\n") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the code-point spans of its ``loss_role`` texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role, role=True)}{AFTER_ROLE}", escape(text)
        at += len(head)
        if role == loss_role:
            spans.append((at, at + len(body)))
        at += len(body) + len(CLOSE)
        out += [head, body, CLOSE]
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises if it is not one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss mask of tokens and, for each masked stretch, its clipped bounds.

    Both token and span bounds are sorted, so the first span that ends after a
    token's start is found by binary search.  A token is under the mask if it
    overlaps a span; tokens that reach over a span's edge are clipped to it, and
    pieces of one character that share its offsets count once.
    """
    if not len(spans) or not len(starts):
        return np.zeros(len(starts), bool), np.zeros(0, np.int32), np.zeros(0, np.int32)
    spans = spans[spans[:, 1] > spans[:, 0]]
    first = np.searchsorted(spans[:, 1], starts, "right")
    last = np.searchsorted(spans[:, 0], ends, "left")
    mask = (last > first) & (ends > starts)
    token = np.repeat(np.flatnonzero(mask), (last - first)[mask])
    inner = np.arange(len(token)) - np.repeat(np.cumsum((last - first)[mask]) - (last - first)[mask], (last - first)[mask])
    span = first[token] + inner
    low, high = np.maximum(starts[token], spans[span, 0]), np.minimum(ends[token], spans[span, 1])
    if not len(low):
        return mask, np.zeros(0, np.int32), np.zeros(0, np.int32)
    reach = np.maximum.accumulate(high)
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] > reach[:-1]) | (span[1:] != span[:-1])  # a gap or another text starts a new stretch
    at = np.flatnonzero(fresh)
    return mask, low[at].astype(np.int32), np.append(reach[at[1:] - 1], reach[-1]).astype(np.int32)


def format_chats(conversations: DataFrame, tokenizer_path: str, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation with its text, tokens, offsets, mask and masked spans.

    ``tokenizer_path`` is the content of the tokenizer's JSON file or a path
    that the driver can read; its content (a vocabulary, so of a fixed size) is
    broadcast.
    """
    spark = conversations.sparkSession
    content = tokenizer_path if tokenizer_path.lstrip().startswith("{") else open(tokenizer_path, encoding="utf-8").read()  # noqa: SIM115
    shared = spark.sparkContext.broadcast(content)
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.select("conv_id", alone.alias("alone"), turn.alias("t"))
    chats = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("alone")

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer, target = Tokenizer.from_str(shared.value), arrow_schema(SCHEMA)
        tokenizer.encode_special_tokens = True
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = [render([(t["role"], t["text"]) for t in turns], loss_role) for turns in batch.column("turns").to_pylist()]
                columns: list[list] = [[] for _ in target.names[2:]]
                for (_, spans), code in zip(made, tokenizer.encode_batch([text for text, _ in made], add_special_tokens=False), strict=True):
                    offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
                    mask, low, high = mask_tokens(offsets[:, 0], offsets[:, 1], np.array(spans, np.int64).reshape(-1, 2))
                    for column, value in zip(columns, (code.ids, offsets[:, 0], offsets[:, 1], mask, low, high), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([batch.column("conv_id"), [text for text, _ in made], *columns], target.types, strict=True)], schema=target)

    return map_arrow(chats, run, SCHEMA)


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's digest columns, read back from the formatted conversations."""
    import hashlib

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        target = arrow_schema(schema)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns, text = parse(row["formatted"]), row["formatted"]
                loss = "".join(unescape(text[a:b]) for a, b in zip(row["span_start"], row["span_end"], strict=True))
                out.append((row["conv_id"], len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(target.types)], schema=target)

    return map_arrow(formatted.select("conv_id", "formatted", "span_start", "span_end"), run, schema)
