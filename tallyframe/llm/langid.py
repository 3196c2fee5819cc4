"""Language identification by cross-parsing.

Each language has a suffix automaton over a sample of its labelled text. Reading a document by
it, greedily, takes the longest piece that occurs somewhere in the sample, then the next one:
the fewer pieces (phrases) the document falls into, the closer the language. With c phrases over
n bytes, c log2(SAMPLE_BYTES) / n estimates the cross entropy in bits a byte. A phrase costs as much
where a sample is shorter, so that a tiny one is not the cheapest for every document. The language of least entropy wins, ties go to
the first name.

Text is lower-cased UTF-8, ASCII characters other than letters being spaces. All bytes of a document
count. A document is read in windows of WINDOW bytes side by side; a phrase that a window's border
cuts is put right after: every window but a document's first is read again from the state in
which the one before ended, as far as that makes a difference.

The automata are fitted on a bounded sample: of SAMPLE_DOCS documents of a language at most in
expectation, equal texts counting once (all where there are no more), drawn by a hash of the text, a stretch of
each at a place drawn by the same hash, SAMPLE_BYTES bytes in all. The model grows with the number of languages.

Defined results: text that is null or has no letter is ``und`` with score 0. With no labelled
text at all, everything is ``und``. ``lang_pred``, ``score`` and ``bits`` replace columns of these names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.draws import drawn
from tallyframe.llm.arrowtools import extended, id_remainder, small_batches, steps, table, without

SAMPLE_BYTES = 40_000
SAMPLE_DOCS = 256
WINDOW = 512
#: Windows that are read side by side.
WINDOWS = 4096
LETTER = regex.compile(r"\p{L}")
NOTHING = "und"
_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def normal(text: str) -> bytes:
    return text.lower().encode().translate(_SPACED)


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class CrossParser:
    """The automata of all languages, as one table.

    A cell holds twice the next state's offset, plus 1 where the move begins a phrase. A move
    that the automaton lacks begins a phrase with that byte, hence leads where the start would.
    """

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        used = sorted({b for s in samples.values() for b in s})
        self.symbol = np.full(256, len(used), np.uint8)  # a byte that no sample has
        self.symbol[used] = np.arange(len(used))
        width = len(used) + 2
        self.pad = len(used) + 1
        tables, self.start = [], []
        at = 0
        for lang in self.langs:
            moves = suffix_automaton(bytes(self.symbol[np.frombuffer(samples[lang], np.uint8)]))
            cells = np.zeros((len(moves), width), np.int64)
            cells[:] = 2 * at * width + 1
            for c, to in moves[0].items():
                cells[:, c] = 2 * (at + to) * width + 1
            for state, own in enumerate(moves):
                if state:
                    for c, to in own.items():
                        cells[state, c] = 2 * (at + to) * width
            cells[:, self.pad] = 2 * at * width
            tables.append(cells)
            self.start.append(at * width)
            at += len(moves)
        kind = np.int32 if 2 * at * width < 2**31 else np.int64
        self.cells = np.concatenate([x.astype(kind) for x in tables] or [np.zeros(0, kind)], axis=None)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) by each language (columns)."""
        sizes = np.array([len(t) for t in texts])
        windows = -(-sizes // WINDOW)
        flat = np.full(int(windows.sum()) * WINDOW, self.pad, np.uint8)
        first = np.concatenate([[0], np.cumsum(windows)])
        for t, w in zip(texts, first, strict=False):
            flat[w * WINDOW : w * WINDOW + len(t)] = self.symbol[np.frombuffer(t, np.uint8)]
        goes_on = np.ones(int(first[-1]), bool)
        goes_on[first[:-1][windows > 0]] = False
        count = np.zeros((len(self.langs), first[-1]), np.int32)
        last = list(self.start)  # where each language's parse of the window before ended
        for a in range(0, int(first[-1]), WINDOWS):
            lines = np.ascontiguousarray(flat[a * WINDOW : (a + WINDOWS) * WINDOW].reshape(-1, WINDOW).T).astype(self.cells.dtype)
            for k, start in enumerate(self.start):
                count[k, a : a + lines.shape[1]], last[k] = self._windows(lines, start, last[k], goes_on[a : a + lines.shape[1]])
        total = np.concatenate([np.zeros((len(self.langs), 1), np.int64), np.cumsum(count, axis=1)], axis=1)
        return (total[:, first[1:]] - total[:, first[:-1]]).T

    def _windows(self, lines: np.ndarray, start: int, before: int, goes_on: np.ndarray) -> tuple[np.ndarray, int]:
        """Phrases that begin in each window (columns), those that go on being read from the end of the one before; and the last end."""
        n = lines.shape[1]
        read, state = np.empty_like(lines), np.full(n, start, lines.dtype)
        for t, line in enumerate(lines):
            read[t] = self.cells[state + line]
            state = read[t] >> 1
        count, end = (read & 1).sum(axis=0, dtype=np.int32), state
        more, begun = np.zeros(n, np.int32), np.full(n, start, lines.dtype)
        while True:
            follows = np.where(goes_on, np.concatenate([[before], end[:-1]]), start).astype(lines.dtype)
            again = np.flatnonzero(follows != begun)
            if not len(again):
                return count + more, int(end[-1])
            begun[again] = follows[again]
            more[again], end[again] = 0, read[-1, again] >> 1
            own, state = again, follows[again]
            for t in range(WINDOW):
                cell, known = self.cells[state + lines[t, own]], read[t, own]
                more[own] += (cell & 1).astype(np.int32) - (known & 1).astype(np.int32)
                apart = cell >> 1 != known >> 1
                own, state = own[apart], cell[apart] >> 1
                if not len(own):
                    break
            end[own] = state

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Cross entropy in bits a byte."""
        return self.phrases(texts) * np.log2(SAMPLE_BYTES) / np.maximum(1, [len(t) for t in texts])[:, None]


def sample(labelled: DataFrame, text: str, lang: str, seed: int = 7) -> dict[str, bytes]:
    """The bounded sample of each language, on the driver: at most 4 x SAMPLE_BYTES characters in expectation come there."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text", F.lit(seed + 1))).alias("n"))
    stretch = F.ceil(F.lit(4.0 * SAMPLE_BYTES) / F.least("n", F.lit(SAMPLE_DOCS))).cast("int")
    place = F.pmod(F.xxhash64("text", F.lit(seed + 2)), F.greatest(F.char_length("text") - stretch + 1, F.lit(1))).cast("int") + 1
    chosen = (
        rows.withColumn("draw", F.xxhash64("text", F.lit(seed)))
        .join(F.broadcast(sizes), "lang")  # as many rows as the model has languages
        .filter(drawn(F.col("draw"), SAMPLE_DOCS, F.col("n")))
        .select("lang", "draw", F.substring("text", place, stretch).alias("text"))
        .distinct()
    )
    parts: dict[str, list[tuple]] = defaultdict(list)
    for r in chosen.collect():
        parts[r.lang].append((r.draw, normal(r.text)))
    return {name: joined for name, own in parts.items() if (joined := b" ".join(_evenly([t for _, t in sorted(own)], SAMPLE_BYTES)))}


def _evenly(texts: list[bytes], most: int) -> list[bytes]:
    """The texts cut to one length, such that they have about ``most`` bytes in all."""
    left, room = len(texts), most
    for n in sorted(map(len, texts)):
        if n * left > room:
            return [t[: max(1, room // left)] for t in texts]
        left, room = left - 1, room - n
    return texts


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> CrossParser:
    return CrossParser(sample(labelled, text, lang))


def identify(df: DataFrame, parser: CrossParser, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1: how far the next best language is behind) and ``bits`` (of the winner)."""
    small_batches(df.sparkSession)
    names = ["lang_pred", "score", "bits"]
    kept = without(df, names)
    shared = df.sparkSession.sparkContext.broadcast(parser)  # bounded by SAMPLE_BYTES and the number of languages

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in steps(batches, text):
            texts = [x if x and own.langs and LETTER.search(x) else None for x in b.column(text).to_pylist()]
            pred, score, bits = [NOTHING] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if there := [i for i, x in enumerate(texts) if x is not None]:
                found = own.bits([normal(texts[i]) for i in there])
                best = found.argmin(axis=1)
                for i, k, each in zip(there, best.tolist(), np.sort(found, axis=1), strict=True):
                    pred[i], bits[i] = own.langs[k], float(each[0])
                    score[i] = float(1 - each[0] / each[1]) if len(each) > 1 and each[1] > 0 else 1.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=[*b.schema.names, *names])

    return kept.mapInArrow(work, extended(kept, "lang_pred string, score double, bits double"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = fit(docs.filter(id_remainder("doc_id", 3) != 1))
    found = identify(docs.select("doc_id", "text"), parser)
    return found.select("doc_id", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits")
