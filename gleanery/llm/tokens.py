"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Texts up to ``leaf_chars`` are encoded where they are read. A longer text is
cut into halves, recursively, until each leaf is short enough; leaves are rows
of their own, so one long text is encoded by many tasks. Leaves are joined
pairwise up the tree. Around each join a window is encoded again and grows
until both sides agree exactly:

* a side agrees where the window reaches a *sure cut*, a place where no match
  of the pre-tokenizer pattern can span (a non-blank before a blank, a letter
  before a digit and so on), because the scan never looks to its left;
* inside one unsplit run, a side agrees where the window's outermost token is
  the one that side already has. Every adjacent pair of the joined list then
  occurs in one of three correct encodings, and a byte-level BPE encoding is
  the one list whose adjacent pairs all encode to themselves.

Null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Entries kept of the word memo of a worker; words beyond are encoded each time.
MEMO_WORDS = 400_000
LEAF_CHARS = 16_384
# The pre-tokenizer pattern published with the vocabularies, and Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = re.compile(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+\\Z")
_BLANK = re.compile(f"[{BLANKS}]")


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """tiktoken encoding without special tokens."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Words(dict):
    """Ids of words seen, as packed int32. A non-blank before a blank is a sure cut, so words encode alone."""

    def __init__(self, name: str, folder: str):
        super().__init__()
        self.encode = encoder(name, folder).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), np.int32).tobytes()
        if len(self) < MEMO_WORDS and len(word) < 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def words(name: str, folder: str) -> Words:
    return Words(name, folder)


def encode_text(text: str | None, memo: Words) -> bytes:
    """Ids of a text as packed int32."""
    return b"".join(map(memo.__getitem__, _WORD.findall(text or "")))


def _kind(ch: str) -> str:
    if _BLANK.match(ch):
        return "s"
    return "l" if regex.match(r"\p{L}", ch) else "n" if regex.match(r"\p{N}", ch) else "o"


def sure_cut(before: str, after: str) -> bool:
    """No match of the pattern holds both characters, whatever stands around them."""
    a, b = _kind(before), _kind(after)
    if b == "s":
        return a != "s"
    return a != "s" and a != b and (a, b) != ("o", "l")


def join_ids(left: str, a: list[int], right: str, b: list[int], enc, window: int = 64) -> list[int]:
    """Ids of ``left + right`` from the ids of both, re-encoding only around the join."""
    if not left or not right:
        return a or b
    width = {t: len(enc.decode_single_token_bytes(t)) for t in {*a[-4 * window :], *b[: 4 * window]}}
    size = lambda t: width.get(t) or width.setdefault(t, len(enc.decode_single_token_bytes(t)))
    grow = window
    while True:
        lo, hi = max(0, len(left) - grow), min(len(right), grow)
        at = next((i for i in range(len(left) - 1, max(lo, 1) - 1, -1) if sure_cut(left[i - 1], left[i])), 0 if lo == 0 else None)
        to = next((i for i in range(1, hi) if sure_cut(right[i - 1], right[i])), len(right) if hi == len(right) else None)
        soft_l, soft_r = at is None, to is None
        run = _kind(left[-1])
        # Without a sure cut, agreement by tokens needs one unsplit run up to that side.
        if soft_l and not (run != "s" and all(_kind(c) == run for c in left[lo:])):
            grow *= 2
            continue
        if soft_r and not (_kind(right[0]) != "s" and all(_kind(c) == _kind(right[0]) for c in right[:hi])):
            grow *= 2
            continue
        if (soft_l or soft_r) and _kind(right[0]) != run and not sure_cut(left[-1], right[0]):
            grow *= 2
            continue
        at, to = (lo if soft_l else at), (hi if soft_r else to)
        tail, head = left[at:].encode(), right[:to].encode()
        drop_a = drop_b = cut_a = cut_b = 0
        while cut_a < len(tail):
            drop_a += 1
            cut_a += size(a[-drop_a])
        while cut_b < len(head):
            cut_b += size(b[drop_b])
            drop_b += 1
        lead = b"".join(enc.decode_single_token_bytes(t) for t in a[len(a) - drop_a :])
        trail = b"".join(enc.decode_single_token_bytes(t) for t in b[:drop_b])
        whole = lead + trail
        try:
            ids = enc.encode_ordinary(whole.decode())
        except UnicodeDecodeError:
            grow *= 2
            continue
        ok_l = not soft_l or (ids and ids[0] == a[len(a) - drop_a])
        ok_r = not soft_r or (ids and ids[-1] == b[drop_b - 1])
        if ok_l and ok_r:
            return a[: len(a) - drop_a] + ids + b[drop_b:]
        grow *= 2


def leaves(text: str, leaf_chars: int) -> list[str]:
    """Halves of halves, in order, none longer than ``leaf_chars``."""
    if len(text) <= leaf_chars:
        return [text]
    mid = len(text) // 2
    return leaves(text[:mid], leaf_chars) + leaves(text[mid:], leaf_chars)


def concatenate(parts: list[str], ids: list[list[int]], enc) -> list[int]:
    """Joins neighbours until one list is left."""
    while len(parts) > 1:
        n = len(parts) // 2
        joined = [join_ids(parts[2 * i], ids[2 * i], parts[2 * i + 1], ids[2 * i + 1], enc) for i in range(n)]
        texts = [parts[2 * i] + parts[2 * i + 1] for i in range(n)]
        ids, parts = joined + ids[2 * n :], texts + parts[2 * n :]
    return ids[0]


def _lists(rows: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row (``id_col``, ``ids`` array<int>) per input row, repeated rows included.

    Null or empty text gives the empty list; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = dict(rows.dtypes)["_id"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = words(name, folder)
        for b in batches:
            for k in range(0, b.num_rows, 2000):  # bounds the ids held at once
                c = b.slice(k, 2000)
                yield pa.RecordBatch.from_arrays([c.column(0), _lists([encode_text(t, memo) for t in c.column(1).to_pylist()])], names=["_id", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                parts = leaves(b.column(2)[i].as_py(), leaf_chars)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * n, b.column(0).type), pa.array([b.column(1)[i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], names=["_id", "_row", "leaf", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = words(name, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _lists([encode_text(t, memo) for t in b.column(3).to_pylist()])], names=["_id", "_row", "leaf", "part", "ids"])

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("leaf")
        ids = concatenate(t.column("part").to_pylist(), t.column("ids").to_pylist(), encoder(name, folder))
        return pa.table({"_id": t.column("_id").slice(0, 1), "ids": _lists([np.array(ids, np.int32).tobytes()])})

    out = f"_id {id_type}, ids array<int>"
    is_long = F.coalesce(F.length("_text") > leaf_chars, F.lit(False))
    near = rows.where(~is_long).mapInArrow(short, out)
    parts = rows.where(is_long).withColumn("_row", F.monotonically_increasing_id()).select("_id", "_row", "_text").mapInArrow(split, f"_id {id_type}, _row bigint, leaf int, part string")
    # The leaves of one text are spread over the cluster before they are encoded.
    far = parts.repartition(F.hash("_row", "leaf")).mapInArrow(encode, f"_id {id_type}, _row bigint, leaf int, part string, ids array<int>").groupBy("_row").applyInArrow(join, out)
    return near.unionByName(far).select(F.col("_id").alias(id_col), "ids")
