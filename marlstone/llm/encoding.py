"""Token ids of whole texts by a public byte-level BPE vocabulary.

Method: prefix dynamic programming. For each prefix of a pre-token the one token that can end a
valid encoding of that prefix is stored; it is the suffix token whose left neighbour, already
stored for the shorter prefix, joins with it as the merge order would. The ids of a prefix are read
by following the stored tokens backwards, so appending bytes only extends the array, and an edit
re-encodes from the pre-token it touches until the old split is met again.

Null and empty texts give an empty list. Strings that spell special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern that belongs to the byte-level vocabularies (a fixed value of the public format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens kept by a worker before the memo starts anew.
MEMO = 400_000


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self[key] = self.make(key)
        return value


class PrefixEncoder:
    """Encoder over ``{token bytes: rank}``; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._joins: dict[tuple[int, int], bool] = {}
        self.pieces = _Memo(self._piece)

    def _merged(self, data: bytes) -> list[int]:
        """Lowest-rank pair merging, used for the two-token strings that settle a join."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def joins(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._joins.get(key)
        if known is None:
            known = self._joins[key] = self._merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Grow ``last`` (the last token of each prefix of ``data``) to cover all of ``data``."""
        ranks, longest = self.ranks, self.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(data[start:end])
                if token is not None and (start == 0 or self.joins(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary lacks byte {data[end - 1]}")
        return last

    def read(self, last: list[int]) -> list[int]:
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return ids[::-1]

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read(self.extend(data, []))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.split(text)))) if text else 0

    def start(self, text: str) -> Encoded:
        """A text with its pre-tokens, ready for edits."""
        ends = [m.end() for m in self.pattern.finditer(text)]
        return Encoded(text, ends, [self.pieces[text[a:b]] for a, b in zip([0, *ends], ends, strict=False)])

    def edit(self, old: Encoded, at: int, removed: int, added: str) -> Encoded:
        """The text after an edit. Pre-tokens that end well before the edit are kept; from there the
        text is split anew until a pre-token ends where one behind the edit ended before, and the
        rest is kept too. A pre-token looks one character past its end, hence the step back by one."""
        text = old.text[:at] + added + old.text[at + removed :]
        keep = max(0, bisect_left(old.ends, at) - 1)
        moved, place = len(added) - removed, old.ends[keep - 1] if keep else 0
        behind = {e + moved: i for i, e in enumerate(old.ends[keep:], keep) if e > at + removed}
        ends, ids = old.ends[:keep], old.ids[:keep]
        for m in self.pattern.finditer(text, place):
            ends.append(m.end())
            ids.append(self.pieces[m[0]])
            if m.end() in behind and m.end() < len(text):
                i = behind[m.end()] + 1
                return Encoded(text, ends + [e + moved for e in old.ends[i:]], ids + old.ids[i:])
        return Encoded(text, ends, ids)


class Encoded(NamedTuple):
    text: str
    ends: list[int]  # of the pre-tokens
    ids: list[list[int]]  # of each pre-token

    def flat(self) -> list[int]:
        return list(chain.from_iterable(self.ids))


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> PrefixEncoder:
    with open(path, "rb") as lines:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(key, ids)``: one row for each input row, in no order. Repeated rows are kept."""
    kind = df.schema[key].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path).encode
        ids = [encode(t) for t in batch.column(1).to_pylist()]
        ends = np.zeros(len(ids) + 1, "int32")
        np.cumsum(np.fromiter(map(len, ids), "int32", len(ids)), out=ends[1:])
        flat = np.fromiter(chain.from_iterable(ids), "int32", int(ends[-1]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "ids"])

    return map_batches(df.select(df[key].alias("key"), df[text].alias("text")), fn, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(key, tokens)``: the number of ids of each text, 0 for null and empty ones."""
    kind = df.schema[key].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = encoder(path).count
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], ["key", "tokens"])

    return map_batches(df.select(df[key].alias("key"), df[text].alias("text")), fn, f"key {kind}, tokens bigint").withColumnRenamed("key", key)
