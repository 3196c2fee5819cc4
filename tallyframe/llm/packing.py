"""Sequence packing by non-negative least squares on the length histogram.

1. Every document is encoded and cut into full windows and a rest; a piece's size is its length
   in steps of STEP tokens, rounded up, so that there are WINDOW / STEP sizes however many rows.
2. All combinations of up to DEPTH sizes that fill a window exactly are columns of a matrix (how
   often the combination uses each size). Non-negative least squares finds repeat counts whose
   use of the sizes comes nearest to the histogram of pieces.
3. Repeat counts are rounded down, as far as the histogram allows. What is left is packed
   greedily: the largest size that fits, again and again, the resulting combination as often as
   the rest allows.
4. The plan is a list of combinations with repeat counts, so its size depends on the number of
   sizes only. Pieces are numbered within their size (by partition and offsets, no group in one
   task), which places each in a window; offsets in a window are running sums of true lengths.

Padding is what rounding up costs (half a step for a piece on average) and what the last,
greedily packed windows leave empty.

Defined results: null text is the empty text, a document of the end id alone. Rows that share an
id are packed separately, as if they were different documents. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm.arrowtools import small_batches, steps, table
from tallyframe.llm.spans import GOLD, mix, sixteens
from tallyframe.llm.splitting import _PLAIN, WORD_PATTERN, splitter
from tallyframe.session import cut, fewer

WORDS = public_tokenizers.path("word_bpe_49k.json")
END = 2
WINDOW = 4096
STEP = 16
DEPTH = 3
#: Words whose ids a worker remembers; emptied when full, which changes no result.
REMEMBERED = 700_000
#: New words that go to the library as one text.
TOGETHER = 1000


#: Of a byte of lower-cased plain text: 0 white space, 1 part of a letter, 2 digit, 3 anything else.
_KIND = np.array([0 if b in b"\t\n\x0b\x0c\r " else 1 if b >= 128 or 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 for b in range(256)], np.uint8)


def plain_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of plain text begin and end: what its splitting pattern matches, found on all bytes at once."""
    kind = _KIND[data]
    start = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)]))
    end = np.append(start[1:], len(data))
    there = kind[start] > 0
    first, end = start[there], end[there]
    # an apostrophe alone and what it shortens are one piece: 's 't 'm 'd 're 've 'll
    k = np.flatnonzero((data[first] == 39) & (end - first == 1))
    k = k[k + 1 < len(first)]
    k = k[(first[k + 1] == end[k]) & (kind[end[k]] == 1)]
    a, b = data[first[k + 1]], data[np.minimum(first[k + 1] + 1, len(data) - 1)]
    two = (end[k + 1] - first[k + 1] >= 2) & (((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108)))
    size = np.where(two, 2, np.where(np.isin(a, list(b"stmd")), 1, 0))
    end[k] += size
    first[k + 1] += size
    left = first < end
    return first[left], end[left]


class WordEncoder:
    """Ids of whole texts, little-endian unsigned 32-bit, by the tokenizer file; each word is encoded once.

    The file's steps are applied here to whole texts (normal form C, lower case by code point,
    the splitting pattern), and its BPE to words that aren't remembered. Strings of special
    tokens are ordinary text. Plain texts (ASCII and À to ſ) are split, looked up and put together
    in numpy; words of up to 16 bytes are two numbers, others go by their bytes. Other texts are
    looked up word by word.
    """

    def __init__(self, path: str = WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = spec["pre_tokenizer"]["pretokenizers"]
        pattern = parts[0]["pattern"]["Regex"]
        self.split = splitter(pattern)
        self.plain = _PLAIN if pattern == WORD_PATTERN else lambda text: None
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, parts[1]]}
        spec["added_tokens"] = []
        self.words = Tokenizer.from_str(json.dumps(spec))
        suffix, vocabulary = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        #: Of the words of plain texts: keys in order, with their slots.
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: By slot: what the word is (its bytes as two numbers, and how many; 0 for long ones, which are in ``long``).
        self.words_are = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64))
        self.long: dict[bytes, int] = {}
        #: Ids of the words of all slots in a row, and where each slot's begin; one more place than slots.
        self.pool, self.begins = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Of several texts at once; words that none of them had before are encoded together."""
        if 4 * (len(self.known) + len(self.long)) + len(self.begins) > REMEMBERED:
            self.forget()
        low = [(t if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ")).lower() for t in texts]
        plain = [i for i, t in enumerate(low) if self.plain(t)]
        other = [i for i, t in enumerate(low) if not self.plain(t)]
        out: list[bytes] = [b""] * len(texts)
        for group, work in ((plain, self._plain), (other, self._general)):
            if group:
                for i, x in zip(group, work([low[i] for i in group]), strict=True):
                    out[i] = x
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() + b"\n" for t in texts]
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        first, end = plain_words(data)
        low, high = sixteens(data, first, end)
        size = end - first
        keys, at = np.unique(mix(mix(low) + mix(high ^ GOLD) + size.astype(np.uint64)), return_inverse=True)
        where = np.empty(len(keys), np.int64)  # where each key is first
        where[at[::-1]] = np.arange(len(at))[::-1]
        place = np.searchsorted(self.keys, keys)
        there = place < len(self.keys)
        there[there] = self.keys[place[there]] == keys[there]
        fresh = ~there & (size[where] <= 16)
        slot = np.full(len(keys), -1, np.int64)
        slot[there] = self.slots[place[there]]
        words = [joined[first[w] : end[w]] for w in where[fresh].tolist()]
        slot[fresh] = len(self.begins) - 1 + np.arange(len(words))
        self.keys, self.slots = (np.insert(x, place[fresh], y[fresh]) for x, y in ((self.keys, keys), (self.slots, slot)))
        self.words_are = tuple(np.concatenate([x, y[where[fresh]]]) for x, y in zip(self.words_are, (low, high, size), strict=True))
        # a key is a hash: the word itself decides, and words that are too long for it go by their bytes
        slots = slot[at]
        same = (size <= 16) & (slots >= 0)
        for known, own in zip(self.words_are, (low, high, size), strict=True):
            same[same] = known[slots[same]] == own[same]
        for k in np.flatnonzero(~same).tolist():
            w = joined[first[k] : end[k]]
            if w not in self.long:
                self.long[w] = len(self.begins) - 1 + len(words)
                words.append(w)
            slots[k] = self.long[w]
        if words:
            ids, sizes = self._encode_words([w.decode() for w in words])
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(sizes)])
            self.pool = np.concatenate([self.pool, ids])
            more = len(self.begins) - 1 - len(self.words_are[0])
            self.words_are = tuple(np.concatenate([x, np.zeros(more, x.dtype)]) for x in self.words_are)
        each = np.diff(self.begins)[slots]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.begins[slots] - ends[:-1], each)]
        cuts = ends[np.searchsorted(first, np.cumsum([0, *map(len, raw)]))].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]

    def _general(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        if new:
            ids, sizes = self._encode_words(new)
            raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
            self.known.update(zip(new, [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        return [b"".join(map(self.known.__getitem__, p)) for p in split]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has. Words hold no white space, and only a word's last id ends a word."""
        texts = [" ".join(words[at : at + TOGETHER]) for at in range(0, len(words), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.words.encode_batch_fast(texts, add_special_tokens=False)])
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(words):
            raise ValueError("the tokenizer doesn't mark where words end")
        return ids, sizes


@lru_cache(2)
def word_encoder(path: str = WORDS) -> WordEncoder:
    return WordEncoder(path)


def combinations(sizes: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All non-increasing tuples of up to ``depth`` sizes 1..sizes that add up to ``sizes``."""
    out: list[tuple[int, ...]] = []

    def extend(left: int, most: int, own: tuple[int, ...]) -> None:
        if not left:
            out.append(own)
        elif len(own) < depth:
            for k in range(min(left, most), 0, -1):
                if k * (depth - len(own)) < left:
                    break
                extend(left - k, k, (*own, k))

    extend(sizes, sizes, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active sets of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(rounds or 6 * a.shape[0]):
        pull = a.T @ (b - a @ x)
        pull[active] = -np.inf
        k = int(pull.argmax())
        if pull[k] <= 1e-6 * scale:
            break
        active[k] = True
        while True:
            own = np.flatnonzero(active)
            part = a[:, own]
            try:
                z = np.linalg.solve(part.T @ part, part.T @ b)
            except np.linalg.LinAlgError:  # columns that depend on each other
                z = np.linalg.lstsq(part, b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[own] = z
                break
            low = own[z <= 0]
            ratio = x[low] / np.maximum(x[low] - z[z <= 0], 1e-300)
            x[own] += ratio.min() * (z - x[own])
            active[low[ratio <= ratio.min()]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan_windows(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with repeat counts that use each size exactly as often as ``histogram`` (index 0: size 1) says."""
    sizes, left = len(histogram), histogram.astype(np.int64).copy()
    shapes = combinations(sizes, depth)
    matrix = np.zeros((sizes, len(shapes)))
    for k, s in enumerate(shapes):
        for u in s:
            matrix[u - 1, k] += 1
    x = nnls(matrix, left.astype(float))
    plan = []
    for k in np.argsort(-x, kind="stable"):
        uses = matrix[:, k].astype(np.int64)
        n = int(min(np.floor(x[k] + 1e-6), (left[uses > 0] // uses[uses > 0]).min()))
        if n > 0:
            plan.append((shapes[k], n))
            left -= n * uses
    while left.any():
        room, own = sizes, np.zeros(sizes, np.int64)
        for u in range(sizes, 0, -1):
            n = min(room // u, int(left[u - 1]))
            own[u - 1], room = n, room - n * u
        n = int((left[own > 0] // own[own > 0]).min())
        plan.append((tuple(int(u) + 1 for u in np.repeat(np.arange(sizes), own)[::-1]), n))
        left -= n * own
    return plan


def token_pieces(df: DataFrame, doc_id: str, text: str, path: str, end: int, window: int, step: int) -> DataFrame:
    """A row a piece, with its size, its partition and its number among the partition's pieces of that size."""
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = word_encoder(path).encode_all, TaskContext.get().partitionId()
        last, seen = np.array([end], "<u4").tobytes(), {}
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "units", "part", "nth"]
        for b in steps(batches, "text", 1 << 20):
            rows = []
            for d, x in zip(b.column(0).to_pylist(), encode([x or "" for x in b.column(1).to_pylist()]), strict=True):
                ids = x + last
                total = len(ids) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    units = -(-length // step)
                    nth = seen[units] = seen.get(units, -1) + 1
                    rows.append((d, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, units, part, nth))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

    rows = fewer(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    return rows.mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, units long, part long, nth long")


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = WORDS, end: int = END, window: int = WINDOW, step: int = STEP, depth: int = DEPTH) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``."""
    pieces = cut(token_pieces(df, doc_id, text, path, end, window, step))
    earlier = Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = (  # a row a partition and size
        pieces.groupBy("units", "part").agg(F.count("*").alias("n")).select("units", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    sizes = window // step
    histogram = np.zeros(sizes, np.int64)
    for r in by_part.groupBy("units").agg(F.sum("n").alias("n")).collect():  # a row a size
        histogram[r.units - 1] = r.n
    spans: dict[int, list[tuple[int, int, int]]] = {}
    used, first = np.zeros(sizes, np.int64), 0
    for shape, n in plan_windows(histogram, depth):
        for slot, u in enumerate(shape):
            spans.setdefault(u, []).append((int(used[u - 1]), first, slot))
            used[u - 1] += n
        first += n
    begins = {u: tuple(np.array(c) for c in zip(*s, strict=True)) for u, s in spans.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units, rank = b.column("units").to_numpy(), b.column("before").to_numpy() + b.column("nth").to_numpy()
            sequence, slot = np.empty_like(rank), np.empty_like(rank)
            for u in np.unique(units):
                own = units == u
                start, base, slots = begins[int(u)]
                k = np.searchsorted(start, rank[own], "right") - 1
                sequence[own], slot[own] = base[k] + rank[own] - start[k], slots[k]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(slot)], names=[*names, "sequence_id", "slot"])

    placed = pieces.join(by_part.drop("n"), ["units", "part"]).mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
