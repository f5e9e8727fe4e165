"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of the
assistant texts are intersected with the sorted token spans by binary search."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings, and the tokenizer's own.
OPEN, MIDDLE, CLOSE, OWN = "### ", "\n<turn>", "</turn>\n", "<|endoftext|>"
#: Of each control string, what must not stand in a text: its first two characters get
#: a backslash between them. ``###`` stands for OPEN, so that runs of # break up, too.
_UNSAFE = re.compile(r"#(?=##)|<(?=/?turn>)|<(?=\|endoftext\|>)")
#: Fixed value: how this public vocabulary cuts a text before its bytes are merged.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: White space as the pattern has it, in runs that are too long for its look-ahead.
_LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")
_TURN = re.compile(r"### ((?:[^\\\n]|\\.)*)\n<turn>(.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), role, flags=re.DOTALL)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts of ``loss_role``."""
    out, spans, at = [], [], 0
    for role, text in turns:
        start = f"{OPEN}{escape_role(role)}{MIDDLE}"
        body = escape(text)
        out += [start, body, CLOSE]
        if role == loss_role:
            spans.append((at + len(start), at + len(start) + len(body)))
        at += len(start) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def mask_of(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each token (rows of start and end) 1 if it lies under a span, and the stretches
    of characters that the tokens under each span cover, clipped to it. Both are sorted;
    the tokens of all spans are found by binary search."""
    under = np.array(spans, np.int64).reshape(-1, 2)
    mask, covered = np.zeros(len(offsets), np.int32), []
    first, last = np.searchsorted(offsets[:, 1], under[:, 0], "right"), np.searchsorted(offsets[:, 0], under[:, 1], "left")
    for (a, b), i, j in zip(spans, first.tolist(), last.tolist(), strict=True):
        if i < j:
            mask[i:j] = 1
            covered.append((max(a, int(offsets[i, 0])), min(b, int(offsets[j - 1, 1]))))
    return mask, covered


class Encoder:
    """A byte-level vocabulary (lines of a token in base 64 and its rank) with the control
    strings as tokens of their own, so that no token crosses the edge of a turn's text."""

    def __init__(self, vocabulary: bytes, pattern: str = WORD_PATTERN):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        free = max(ranks.values()) + 1
        own = {text: free + k for k, text in enumerate((OWN, OPEN, MIDDLE, CLOSE))}
        self.tokens = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=own)
        self.n_bytes = np.zeros(free + len(own), np.int64)
        for token, n in (*ranks.items(), *own.items()):
            self.n_bytes[n] = len(token)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a text and their character ranges; tokens that share a character
        all have it in their range. A text is cut before the last blank of a very long run,
        where the pattern cuts it anyway."""
        cuts = [0, *(m.end() - 1 for m in _LONG_BLANK.finditer(text) if m.end() < len(text)), len(text)]
        ids = np.array([n for a, b in zip(cuts, cuts[1:]) for n in self.tokens.encode(text[a:b], allowed_special="all", disallowed_special=())], np.int32)
        if not len(ids):
            return ids, np.zeros((0, 2), np.int64)
        char = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        ends = np.cumsum(self.n_bytes[ids])
        return ids, np.stack([char[ends - self.n_bytes[ids]] - 1, char[ends - 1]], axis=1)


@lru_cache(maxsize=4)
def load_encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def format_conversations(conversations: DataFrame, tokenizer: str, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: id, formatted, token_ids, loss_mask, loss_spans
    (character ranges of ``formatted`` under the mask).

    Rows are ordered by turn (null first), ties by role and text; null roles and texts
    are empty. Rows with a null id are one conversation with a null id. An empty table
    gives an empty one; other columns are ignored. ``tokenizer`` is a file of ranked tokens
    that the driver reads; the tasks get its content. A conversation is one row here as it
    is one training sample, so it must fit into a task's memory."""
    with open(tokenizer, "rb") as f:
        vocabulary = conversations.sparkSession.sparkContext.broadcast(f.read())
    rows = conversations.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("t"))
    kind = dict(conversations.dtypes)[conv_col]
    grouped = grouped.select(F.col("conv").cast("string").alias("conv"), F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder(vocabulary.value)
        for whole in batches:
            for k in range(0, len(whole), 64):
                b = whole.iloc[k : k + 64]
                out = []
                for roles, texts in zip(b["roles"], b["texts"], strict=True):
                    text, spans = render(list(zip(roles, texts, strict=True)), loss_role)
                    ids, offsets = encoder.encode(text)
                    mask, covered = mask_of(offsets, spans)
                    out.append((text, ids, mask, [{"start": a, "end": z} for a, z in covered]))
                yield pd.DataFrame({"conv": b["conv"].to_numpy(), "formatted": [o[0] for o in out], "token_ids": [o[1] for o in out], "loss_mask": [o[2] for o in out], "loss_spans": [o[3] for o in out]})

    out = grouped.mapInPandas(encode, "conv string, formatted string, token_ids array<int>, loss_mask array<int>, loss_spans array<struct<start: int, end: int>>")
    return out.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", conv_col)


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from the output of format_conversations: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, mask, spans in zip(b["formatted"], b["loss_mask"], b["loss_spans"], strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                out.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(text), len(mask), int(np.sum(mask))))
            yield pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]).assign(conv=b["conv"].to_numpy())

    kind = dict(formatted.dtypes)[conv_col]
    rows = formatted.select(F.col(conv_col).cast("string").alias("conv"), "formatted", "loss_mask", "loss_spans")
    out = rows.mapInPandas(read, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long, conv string")
    return out.select(F.col("conv").cast(kind).alias(conv_col), *out.columns[:-1])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def oracle(source: str = "conversations") -> str:
    """The digests in DuckDB SQL: what the escapes add is counted, not written out."""
    added = lambda c: f"(len({c}) - len(replace({c}, '\\', '')) + coalesce(list_sum(list_transform(regexp_extract_all({c}, '#{{3,}}'), lambda x : len(x) - 2)), 0) + " + " + ".join(f"(len({c}) - len(replace({c}, '{x}', ''))) // {len(x)}" for x in ("<turn>", "</turn>", OWN)) + ")"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {source}
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(MIDDLE) + len(CLOSE)} + len(role) + len(text) + {added("role")} + len(role) - len(replace(role, chr(10), '')) + {added("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
