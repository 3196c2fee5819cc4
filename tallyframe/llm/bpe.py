"""Byte-level BPE by prefix dynamic programming.

For the bytes of a piece (a match of the splitting pattern), every prefix has exactly one last
token that a BPE encoding of this prefix can end with. ``PrefixEncoder`` stores that token for
each prefix. The encoding of the whole is read backwards along these tokens; appending bytes
only adds entries, and an edit leaves all entries before it as they are. Of the tokens that end
at a place the right one is the one whose pair with the last token of the prefix before it is
stable: merging the two sides together never takes a merge across their border.

The vocabulary is a file of ranks (base64 bytes and rank on each line). Tokens that merging
can't reach are left out of the programme; as in the reference encoder of such files, a piece
that is a token as a whole is that token.

Defined results: null text is the empty text (no ids). The input's columns are kept; ``ids`` and
``decoded`` replace columns of these names. Equal texts give equal ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.arrowtools import extended, small_batches, steps, table, without
from tallyframe.llm.splitting import splitter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces whose ids a worker remembers; the memory is emptied when full, results don't depend on it.
REMEMBERED = 600_000
#: Pairs of tokens whose stability a worker remembers.
PAIRS = 1_000_000
#: Bytes of text that a step takes; a longer single text is a step of its own.
STEP_BYTES = 1 << 20


class Vocabulary:
    """Ranks, how each token was merged, and which pairs of tokens are stable."""

    def __init__(self, path: str = RANKS):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.stable: dict[int, bool] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = None
                continue
            parts = self._merge(token, rank)
            if len(parts) == 2 and all(p in self.halves for p in parts):
                self.halves[rank] = (parts[0], parts[1])
                self.merged[parts[0], parts[1]] = rank
        self.reachable = {self.bytes_of[r]: r for r in self.halves}
        self.longest = max(map(len, self.reachable))
        #: Reachable tokens by their bytes, and -1 for bytes that only begin one.
        self.begun = {t[:n]: -1 for t in self.reachable for n in range(1, len(t))} | self.reachable

    def _merge(self, token: bytes, below: int) -> list[int]:
        """Ranks of the parts after all merges whose rank is under ``below``."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def is_stable(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is what merging their bytes gives.

        Takes the two apart in the order opposite to merging. A border pair that could have been
        merged before the part just taken off existed would have been taken instead.
        """
        key = left << 20 | right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > PAIRS:
                self.stable.clear()
            known = self.stable[key] = self._is_stable(left, right)
        return known

    def _is_stable(self, left: int, right: int) -> bool:
        limit = 1 << 62
        merged, halves = self.merged, self.halves
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            a, b = halves[left], halves[right]
            if a is None and b is None:
                return True
            # the later merge is undone first; on the right side an equal rank loses to what lies left of it
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]


class PrefixEncoder:
    """The last token of every prefix of a growing piece of bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.data = bytearray()
        self.last: list[int] = []

    def append(self, more: bytes) -> PrefixEncoder:
        self.data += more
        return self._extend()

    def edit(self, at: int, removed: int, added: bytes) -> PrefixEncoder:
        """Replaces ``removed`` bytes at ``at``; prefixes up to there keep their tokens."""
        self.data[at : at + removed] = added
        del self.last[at:]
        return self._extend()

    def _extend(self) -> PrefixEncoder:
        v, last, data = self.v, self.last, bytes(self.data)
        begun, stable, known = v.begun.get, v.is_stable, v.stable.get
        done, n = len(last), len(data)
        last += [-1] * (n - done)
        # every token from each place on; of those that end at one place the longest come first
        for start in range(max(0, done - v.longest + 1), n):
            left = last[start - 1] if start else -1
            for end in range(start + 1, n + 1):
                token = begun(data[start:end])
                if token is None:
                    break
                if token >= 0 and end > done and last[end - 1] < 0:
                    if start:
                        fits = known(left << 20 | token)
                        if not (stable(left, token) if fits is None else fits):
                            continue
                    last[end - 1] = token
        return self

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.v.bytes_of[token])
        return out[::-1]


class Encoder:
    """Texts to ids and back."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = Vocabulary(path)
        self.split = splitter(pattern)
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        whole = self.vocabulary.ranks.get(raw)
        return [whole] if whole is not None else PrefixEncoder(self.vocabulary).append(raw).ids()

    def encode(self, text: str) -> array:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        pieces, known = self.split(text), self.known
        new = set(pieces).difference(known)
        for p in new:
            known[p] = array("I", self.piece(p)).tobytes()
        out = array("I", b"".join(map(known.__getitem__, pieces)))
        for p in new:
            if len(p) > 64:
                del known[p]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@lru_cache(2)
def encoder(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def _encoded(batches: Iterator[pa.RecordBatch], text: str, path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, pattern).encode
    for b in steps(batches, text, STEP_BYTES):
        ids = [encode(x) if x else array("I") for x in b.column(text).to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
        flat = array("I", b"".join(x.tobytes() for x in ids))
        values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, values)], names=[*b.schema.names, "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], ids: str, path: str) -> Iterator[pa.RecordBatch]:
    decode = encoder(path).decode
    for b in batches:
        c = b.column(ids)
        whole, ends, null = c.values.to_numpy(), c.offsets.to_pylist(), c.is_null().to_pylist()
        out = [None if gone else decode(whole[i:j].tolist()) for i, j, gone in zip(ends, ends[1:], null, strict=False)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])


def encode_column(df: DataFrame, text: str = "text", path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ``ids`` (array<int>)."""
    small_batches(df.sparkSession)
    kept = without(df, ["ids"])
    return kept.mapInArrow(lambda batches: _encoded(batches, text, path, pattern), extended(kept, "ids array<int>"))


def decode_column(df: DataFrame, ids: str = "ids", path: str = RANKS) -> DataFrame:
    """Adds ``decoded`` (binary); null ids give null."""
    small_batches(df.sparkSession)
    kept = without(df, ["decoded"])
    return kept.mapInArrow(lambda batches: _decoded(batches, ids, path), extended(kept, "decoded binary"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encode_column``, then ``decode_column``, then digests of both, step by step in one worker."""
    small_batches(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _decoded(_encoded(batches, "text", RANKS, public_tokenizers.PATTERN), "ids", RANKS):
            c = b.column("ids")
            values, ends = c.values.to_numpy().astype("<u4"), c.offsets.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([j - i for i, j in zip(ends, ends[1:], strict=False)], pa.int64()),
                    pa.array([hashlib.sha256(values[i:j]).hexdigest() for i, j in zip(ends, ends[1:], strict=False)]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in b.column("decoded").to_pylist()]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
