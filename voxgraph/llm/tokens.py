"""Encoding with a public byte-level BPE vocabulary: minimal perfect hash for whole pre-tokens, heap merges for the rest."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
#: Fixed: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PerfectHash:
    """Minimal perfect hash over byte strings by hash and displace; key i of the list lies in slot order[i].

    get() compares the stored key, so a string outside the vocabulary is never taken for a member.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.seeds = [0] * self.buckets
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        free = bytearray(b"\x01") * n
        singles = []
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                singles += [b] * len(members[b])
                continue
            seed = 0
            while True:
                slots = [self._slot(hashes[i], seed) for i in members[b]]
                if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                seed += 1
            self.seeds[b] = seed
            for i, s in zip(members[b], slots):
                free[s], self.keys[s], self.values[s] = 0, keys[i], values[i]
        left = (s for s in range(n) if free[s])
        for b in singles:  # a bucket of one key names its slot
            s, i = next(left), members[b][0]
            self.seeds[b], self.keys[s], self.values[s] = -1 - s, keys[i], values[i]

    def _slot(self, h: int, seed: int) -> int:
        if seed < 0:
            return -1 - seed
        x = h ^ seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (x ^ x >> 32) % self.n

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        slot = self._slot(h, self.seeds[h % self.buckets])
        return self.values[slot] if self.keys[slot] == key else None


class BytePairEncoder:
    """Encodes pre-tokens of a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.whole = PerfectHash([base64.b64decode(k) for k, _ in pairs], [int(v) for _, v in pairs])
        self.split = regex.compile(PATTERN)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary: merges of least rank, leftmost first, from a heap over linked bytes."""
        get, n = self.whole.get, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (rank := get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (rank, a, b, end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if end[a] != b or end[b] != stop or b < 0:  # one of the two has been merged since
                continue
            end[a], end[b] = stop, -1
            if stop < n:
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, a = [], 0
        while a < n:
            out.append(get(piece[a : end[a]]))
            a = end[a]
        return out

    def piece(self, text: str) -> list[int]:
        raw = text.encode()
        found = self.whole.get(raw)
        return [found] if found is not None else self.merge(raw)

    def encode(self, text: str, known: dict[str, list[int]]) -> list[int]:
        """Ids of a text; known holds the pre-tokens that the batch has met."""
        out: list[int] = []
        for p in self.split.findall(text):
            ids = known.get(p)
            if ids is None:
                ids = known[p] = self.piece(p)
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    """One encoder per process and file: the vocabulary's size bounds it."""
    return BytePairEncoder(path)


def _encoded(df: DataFrame, text: str, keep: tuple[str, ...], path: str, count_only: bool) -> DataFrame:
    out = "n_tokens" if count_only else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            known: dict[str, list[int]] = {}
            ids = [coder.encode(t, known) if t else [] for t in batch.column(len(keep)).to_pylist()]
            made = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], [*keep, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{kinds}, {out} {'long' if count_only else 'array<int>'}")


def token_ids(df: DataFrame, text: str, *keep: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row (keep..., ids) per row of df: the text's token ids without special tokens.

    Empty and null texts have the empty list; other columns stay as they are. Each row is encoded where it lies: no
    shuffle, no broadcast; a worker reads the rank file once.
    """
    return _encoded(df, text, keep, f"{folder}/{tokenizer}.tiktoken", False)


def token_counts(df: DataFrame, text: str, *keep: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row (keep..., n_tokens) per row of df; as token_ids, but only the number of ids. Empty and null texts have 0."""
    return _encoded(df, text, keep, f"{folder}/{tokenizer}.tiktoken", True)
