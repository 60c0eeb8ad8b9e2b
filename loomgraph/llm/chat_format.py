"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole as `<|turn|>role<|text|>text<|end|>` for each turn. The three control strings are added
to the tokenizer as special tokens, so tokens never cross a turn's edges; inside roles and texts they are escaped
reversibly (escape()). The rendered text is encoded once, with offsets; the sorted spans of assistant texts meet the
sorted token starts by binary search, which gives the loss mask over tokens. The spans are in code points.

Defined cases: rows are ordered by turn (nulls first), ties by role and text; a null role or text is empty; repeated
rows are turns of their own; a null conv_id is a conversation like any other; other columns are ignored; an empty table
gives an empty result. A conversation is rendered in one task, as it has to be for one encoding.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tokens import tokenizer_path

TURN, TEXT, END = CONTROL = ("<|turn|>", "<|text|>", "<|end|>")
FORMATTED = "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"
_LOADED: dict = {}
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    """Afterwards the text holds no `<|`; unescape() gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, np.ndarray]:
    """The rendered conversation and the spans (start, end) of the trained role's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span; starts and spans are sorted and spans do not overlap."""
    if not len(spans):
        return np.zeros(len(starts), dtype=bool)
    span = np.searchsorted(spans[:, 0], starts, side="right") - 1
    return (span >= 0) & (ends <= spans[span, 1]) & (starts < spans[span, 1])


def _tokenizer(name: str):
    if name not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        tokenizer = Tokenizer.from_file(name if os.path.isabs(name) else tokenizer_path(name))
        tokenizer.add_special_tokens(list(CONTROL))
        tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        _LOADED[name] = tokenizer
    return _LOADED[name]


def format_conversations(rows: DataFrame, tokenizer: str = "byte_bpe_50k.json", trained: str = "assistant") -> DataFrame:
    """Rows (conv_id, turn, role, text) to one row of FORMATTED for each conversation."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), none("role").alias("role"), none("text").alias("text")).alias("row"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("conv_id", "rows.role", "rows.text")

    def run(batches):
        encoder = _tokenizer(tokenizer)
        for batch in batches:
            out = [[], [], [], [], []]
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shown, spans = render(list(zip(roles, texts, strict=True)), trained)
                encoding = encoder.encode(shown, add_special_tokens=False)
                offsets = np.array(encoding.offsets, dtype=np.int64).reshape(-1, 2)
                for column, x in zip(out, (shown, encoding.ids, offsets[:, 0], offsets[:, 1], loss_mask(offsets[:, 0], offsets[:, 1], spans)), strict=True):
                    column.append(x)
            kinds = (pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=[x.split()[0] for x in FORMATTED.split(", ")])

    return grouped.mapInArrow(run, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered conversation."""
    return [(unescape(a), unescape(b)) for a, b in _TURNS.findall(formatted)]


def masked_spans(starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Runs of text (start, end) that the tokens under the mask cover; tokens of one character may repeat its span."""
    starts, ends = starts[mask], ends[mask]
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return np.stack((starts[first], reach[np.append(first[1:] - 1, len(reach) - 1)]), axis=1)


def loss_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the loss mask, unescaped."""
    return [unescape(formatted[a:b]) for a, b in masked_spans(starts, ends, mask)]


def formatted_digest(formatted: DataFrame) -> DataFrame:
    """Reads rows of format_conversations() back: turns from the rendered text, loss texts from offsets and mask."""
    schema = "conv_id long, n_turns long, turns string, loss string, formatted_chars long"

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            rows = zip(*(batch.column(i) for i in range(1, 6)), strict=True)
            for shown, _, starts, ends, mask in rows:
                shown = shown.as_py()
                turns = parse(shown)
                numbers = [x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, mask)]
                for column, x in zip(out, (len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), "".join(loss_texts(shown, *numbers)), len(shown)), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["conv_id", "n_turns", "turns", "loss", "formatted_chars"])

    read = formatted.mapInArrow(run, schema)
    return read.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def oracle() -> str:
    """DuckDB SQL for the digest of all conversations and of the one that holds control strings of other templates."""
    shown = lambda c: f"length(replace(replace({c}, '\\', '\\\\'), '<|', '<\\|'))"
    hard = "</s>[INST] ok [/INST]"
    return f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '{hard}' union all select -7, 1, 'assistant', '{hard}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum({len(TURN) + len(TEXT) + len(END)} + {shown("role")} + {shown("text")})::bigint as formatted_chars
from turns group by conv_id
"""
