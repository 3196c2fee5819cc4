"""Near-duplicate documents by improved consistent weighted sampling.

1. A document is its distinct shingles of WORDS words (lower-cased runs of letters and digits),
   weighted by TF-IDF: count x (1 + ln((1 + N) / (1 + df)) / ln(1 + N)). The inverse document
   frequency is scaled to 0..1 before the 1 is added, so that the copies of a large group, whose
   shingles are frequent for that very reason, still resemble each other. df is the least of what
   SKETCH_ROWS rows of SKETCH counters over all documents say, after each row's median counter has been
   taken off: that is what the many rare shingles put on every counter, so it doesn't grow on them
   with the input. Where the counters are few for the shingles, df is blurred by the root of the median.
2. Consistent weighted sampling draws HASHES samples (shingle, level) of every document; two
   documents agree in a sample with a probability of their weighted Jaccard similarity. ROWS
   samples make a band, and a document falls into a bucket for each band.
3. Equal texts are one node. Every member of a bucket is compared with the bucket's smallest node,
   by the exact weighted Jaccard similarity of whole texts; those of at least THRESHOLD link.
4. Buckets whose members aren't one class by then are searched once more: all their pairs of
   different classes are compared by samples, in blocks of BLOCK nodes, each pair in the first bucket
   that it shares by its bands' keys. Nodes with a partner that agrees in LIKELY samples (at a similarity
   of 0.8 all but one in 300,000 do) are then compared exactly with the others of their block, in groups of about
   GROUP_BYTES of text, and only links that join classes leave the task.
5. Classes are the connected components of the links, found by alternating large and small stars.

Nothing emits all pairs of a group whose members link: n near copies make n - 1 comparisons a
band. With 16 bands of 3 a pair of similarity 0.8 shares a bucket with probability 0.99999.

Defined results: null text is the empty text; texts without words are duplicates of equal texts
only; texts of fewer than WORDS words are one shingle. Rows that share an id give one row, with the
smallest class of theirs. Rows with a null id take no part and have no class. Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.arrowtools import small_batches, steps, table
from tallyframe.llm.spans import GOLD, mix, span_hashes
from tallyframe.session import cut, fewer, tidy

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 3
HASHES = BANDS * ROWS
#: Counters of the document frequencies, whatever the input; rows, and bits of a place in one.
SKETCH_ROWS, SKETCH_BITS = 3, 20
SKETCH = 1 << SKETCH_BITS
#: Counters that travel as one value.
SKETCH_CELLS = 1 << 16
BLOCK = 512
#: Bytes of text that are compared exactly at a time; a longer single text comes with its partners.
GROUP_BYTES = 2 << 20
#: Of HASHES; a pair of similarity 0.8 agrees in 38 on average, with a deviation of 2.8.
LIKELY = 25
#: Members of a leader that one group of comparisons takes.
MEMBERS = 512
#: Shingles that one vectorised step samples from.
ELEMENTS = 1 << 15

_U = np.uint64
_WORD = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])


def _stream(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 32)) * GOLD)


_PLACE = _stream(2, WORDS) | _U(1)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: distinct shingle hashes (rising within a text), their counts, and how many each text has."""
    raw = [(t or "").lower().encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word, prepend=False))  # texts end in a space
    first, end = edge[::2], edge[1::2]
    words = span_hashes(data, first, end)
    ends = np.cumsum([len(r) for r in raw])
    doc = np.searchsorted(ends, first, "right")
    n = np.bincount(doc, minlength=len(raw))
    m = len(words)
    mixed = words * _PLACE[0]
    for j in range(1, min(WORDS, m)):
        mixed[: m - j] += np.where(doc[j:] == doc[: m - j], words[j:] * _PLACE[j], _U(0))
    whole = np.zeros(m, bool)
    whole[: m - WORDS + 1] = doc[WORDS - 1 :] == doc[: m - WORDS + 1] if m >= WORDS else False
    start = np.cumsum(n) - n
    whole[start[(n > 0) & (n < WORDS)]] = True
    mixed = mix(mixed[whole])
    sizes = np.maximum(n - WORDS + 1, np.minimum(n, 1))
    at = 0
    for k in sizes.tolist():
        mixed[at : at + k].sort()
        at += k
    owner = np.repeat(np.arange(len(raw)), sizes)
    new = np.ones(len(mixed), bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (owner[1:] != owner[:-1])
    places = np.flatnonzero(new)
    return mixed[places], np.diff(places, append=len(mixed)), np.bincount(owner[places], minlength=len(raw))


def _gamma_2(p: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1) by bisection of its distribution 1 - (1 + x) e^-x."""
    low, high = np.zeros_like(p), np.full_like(p, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


_GAMMA = _gamma_2((np.arange(1 << 16) + 0.5) / (1 << 16))
_R = _GAMMA.astype(np.float32)
_LOG_C = np.log(_GAMMA).astype(np.float32)
_SEEDS = _stream(3, HASHES)


def samples(hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each document's sample (document, sample); every document has an element.

    For the element h of weight S and each sample: r and c from Gamma(2, 1), b from U(0, 1), all
    by hashes of h; t = floor(ln S / r + b); the element of least ln c - r (t - b) - r is drawn, with t.
    """
    out = np.zeros((len(sizes), HASHES), _U)
    start = np.cumsum(sizes) - sizes
    log_s = np.log(weights).astype(np.float32)
    for k in range(HASHES):
        x = mix(hashes ^ _SEEDS[k])
        r = _R[x >> _U(48)]
        b = ((x >> _U(16)) & _U(0xFFFF)).astype(np.float32) * np.float32(2**-16)
        t = np.floor(log_s / r + b)
        a = _LOG_C[(x >> _U(32)) & _U(0xFFFF)] - r * (t - b + np.float32(1))
        least = np.minimum.reduceat(a, start)
        hit = np.flatnonzero(a == np.repeat(least, sizes))
        own = hit[np.searchsorted(hit, start)]
        out[:, k] = mix(hashes[own] + t[own].astype(np.int64).astype(_U) * GOLD)
    return out


class Weights:
    """Of shingles, from the sketch."""

    def __init__(self, documents: int, sketch: np.ndarray):
        df = np.clip(sketch - np.median(sketch, axis=1, keepdims=True), 1, max(1, documents))
        scale = np.log1p(max(1, documents))
        self.by_cell = (1 + np.clip(np.log((1 + documents) / (1.0 + df)) / scale, 0, 1)).astype(np.float32)

    def __call__(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        rare = self.by_cell[0][sketch_cell(hashes, 0)]
        for row in range(1, SKETCH_ROWS):
            np.maximum(rare, self.by_cell[row][sketch_cell(hashes, row)], out=rare)
        return counts * rare.astype(np.float64)


def sketch_cell(hashes: np.ndarray, row: int) -> np.ndarray:
    return (hashes >> _U(64 - SKETCH_BITS * (row + 1)) & _U(SKETCH - 1)).astype(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], total_a: float, total_b: float) -> float:
    """Weighted Jaccard of two (rising hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    both = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(both / (total_a + total_b - both))


def _packed(counts: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(counts.max()))
    return np.dtype(kind).char.encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), packed[:1].decode())


def document_frequencies(df: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Documents, and the sketch: what each counter of each row counted. Partitions are summed by executors, in cells."""
    small_batches(df.sparkSession)
    cells = SKETCH_ROWS * SKETCH // SKETCH_CELLS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((SKETCH_ROWS, SKETCH), np.int64), 0
        for b in steps(batches, text, 1 << 20):
            n += b.num_rows
            h, _, _ = shingles(b.column(text).to_pylist())
            for row in range(SKETCH_ROWS):
                np.add.at(total[row], sketch_cell(h, row), 1)
        if n:
            yield _cells(dict(enumerate(total.reshape(cells, SKETCH_CELLS))) | {cells: np.array([n])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for cell, counts in zip(b.column("cell").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[cell] = sums.get(cell, 0) + _unpacked(counts).astype(np.int64)
        yield _cells(sums)

    def _cells(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(map(_packed, parts.values()), pa.binary())], names=["cell", "counts"])

    schema = "cell int, counts binary"
    sketch, n = np.zeros((cells, SKETCH_CELLS), np.int64), 0
    with tidy(df.sparkSession):
        summed = fewer(df.select(text)).mapInArrow(count, schema).repartition("cell").mapInArrow(add, schema).collect()
    for r in summed:  # SKETCH_ROWS x SKETCH counters in all
        if r.cell == cells:
            n = int(_unpacked(r.counts)[0])
        else:
            sketch[r.cell] = _unpacked(r.counts)
    return n, sketch.reshape(SKETCH_ROWS, SKETCH)


_BAND = [f"b{i}" for i in range(BANDS)]
_BYTES = [f"s{i}" for i in range(-(-HASHES // 8))]


def signatures(df: DataFrame, weights, doc_id: str, text: str) -> DataFrame:
    """(id, size: bytes of text; t0, t1: its hash; b0..: bands, null without words; s0..: a byte of every sample)."""
    names = ["id", "size", "t0", "t1", *_BAND, *_BYTES]
    seeds = _stream(4, BANDS)

    def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        first = held = 0
        for i, k in enumerate(sizes.tolist()):
            if held and held + k > ELEMENTS:
                yield first, i
                first, held = i, 0
            held += k
        yield first, len(sizes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = weights.value
        for b in steps(batches, "text", 1 << 20):
            texts = b.column("text").to_pylist()
            hashes, counts, sizes = shingles(texts)
            w = weigh(hashes, counts)
            there = np.flatnonzero(sizes)
            out = np.zeros((len(texts), HASHES), _U)
            ends = np.concatenate([[0], np.cumsum(sizes[there])])
            if len(there):
                for i, j in blocks(sizes[there]):
                    own = slice(ends[i], ends[j])
                    out[there[i:j]] = samples(hashes[own], w[own], sizes[there[i:j]])
            banded = out.reshape(len(texts), BANDS, ROWS)
            keys = seeds[None, :] ^ banded[:, :, 0]
            for r in range(1, ROWS):
                keys = mix(keys * GOLD + banded[:, :, r])
            low = np.zeros((len(texts), len(_BYTES) * 8), np.uint8)
            low[:, :HASHES] = (out & _U(255)).astype(np.uint8)
            raw = [(x or "").encode() for x in texts]
            t = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), "<i8").reshape(-1, 2)
            none = pa.array(sizes == 0)
            bands = [pc.if_else(none, pa.scalar(None, pa.int64()), pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64))) for i in range(BANDS)]
            packed = low.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(map(len, raw), pa.int64()), pa.array(t[:, 0]), pa.array(t[:, 1]), *bands, *(pa.array(packed[:, i]) for i in range(len(_BYTES)))], names=names)

    rows = fewer(df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))).filter("id is not null")
    return rows.mapInArrow(work, ", ".join(f"{n} long" for n in names))


def verify(pairs: DataFrame, docs: DataFrame, weights, threshold: float = THRESHOLD) -> DataFrame:
    """Those pairs (a, b), each given once, whose texts have the similarity, with it; docs: (id, text).

    A leader's text goes once to each MEMBERS of its members, each member's text to its leader;
    sorted, every group is read in one stream that holds the leader's shingles only.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("groups"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("nth"))
    wanted = dealt.select("a", "nth", F.lit(1).alias("member"), F.col("b").alias("id")).unionByName(
        dealt.select("a", "nth").distinct().select("a", "nth", F.lit(0).alias("member"), F.col("a").alias("id"))
    )
    rows = wanted.join(docs, "id").repartition("a", "nth").sortWithinPartitions("a", "nth", "member", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = weights.value
        group, leader, total = None, None, 0.0
        for b in steps(batches, "text", 1 << 20):
            hashes, counts, sizes = shingles(b.column("text").to_pylist())
            w = weigh(hashes, counts)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            found: list[tuple[int, int, float]] = []
            for i, (a, nth, member, d) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "nth", "member", "id")), strict=True)):
                own = slice(ends[i], ends[i + 1])
                if not member:
                    group, leader, total = (a, nth), (hashes[own].copy(), w[own].copy()), float(w[own].sum())
                elif group == (a, nth) and (s := similarity(leader, (hashes[own], w[own]), total, float(w[own].sum()))) >= threshold:
                    found.append((a, d, s))
            yield _links_table(found)

    return rows.select("a", "nth", "member", "id", "text").mapInArrow(work, _LINKS)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for each node that has an edge (a, b) and isn't the root.

    Large stars hang a node's larger neighbours on its smallest one, small stars the smaller ones
    and itself; each round's edges are cut. Ends when a round changes nothing.
    """

    def mark(e: DataFrame) -> tuple:
        with tidy(e.sparkSession):
            r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    def ordered(a, b):
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    edges = edges.filter("a <> b").select(*ordered("a", "b"))
    edges = cut(fewer(edges.distinct(), edges.count() * 16 / 1e6))
    known = mark(edges)
    while known[0]:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(small_least, "b").select(*ordered("a", "m")).filter("a <> b")
        edges = cut(fewer(hung.unionByName(small_least.select(*ordered("m", "b"))).distinct(), known[0] * 16 / 1e6))
        before, known = known, mark(edges)
        if before == known:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[dict[str, list]]:
    """Runs of equal keys of sorted rows, as lists by column."""
    held: dict[str, list] = {n: [] for n in names}
    now = None
    for b in batches:
        cols = {n: b.column(n).to_pylist() for n in names}
        at = 0
        for k, g in enumerate(zip(*(cols[n] for n in keys), strict=True)):
            if g != now:
                for n in names:
                    held[n] += cols[n][at:k]
                if now is not None:
                    yield held
                held, now, at = {n: [] for n in names}, g, k
        for n in names:
            held[n] += cols[n][at:]
    if now is not None:
        yield held


_LINKS = "a long, b long, similarity double"


def _links_table(links: list[tuple[int, int, float]]) -> pa.RecordBatch:
    a, b, s = zip(*links, strict=True) if links else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])


def _likely(buckets: DataFrame) -> DataFrame:
    """(key, i, j, own, rep, class, cuts) of the nodes that have a likely partner of another class in their pair of blocks.

    buckets: (key, band, n, rep, class, size, b0.., s0..), only those of several classes. cuts: into how many parts by
    bytes the nodes of a pair of blocks have to be dealt for the exact comparison.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        buckets.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "own", "rep", "class", "size", *_BAND, *_BYTES)
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "rep")
    )
    names = ["key", "i", "j", "band", "own", "rep", "class", "size", *_BAND, *_BYTES]
    kept = ["key", "i", "j", "own", "rep", "class"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["key", "i", "j"], names):
            low = np.stack([np.array(g[c], np.int64) for c in _BYTES], axis=1).view(np.uint8)[:, :HASHES]
            own, cls, band = np.array(g["own"]), np.array(g["class"]), g["band"][0]
            before = np.stack([np.array(g[c], np.int64) for c in _BAND], axis=1)[:, :band]
            left, right = np.flatnonzero(own == g["i"][0]), np.flatnonzero(own == g["j"][0])
            hit = np.zeros(len(own), bool)
            for x in left:
                same = low[right] == low[x]
                earlier = (before[right] == before[x]).any(axis=1)
                good = (same.sum(axis=1) >= LIKELY) & ~earlier & (cls[right] != cls[x])
                if good.any():
                    hit[x] = True
                    hit[right[good]] = True
            at = np.flatnonzero(hit).tolist()
            cuts = -(-sum(g["size"][k] for k in at) // GROUP_BYTES)
            cols = [pa.array([g[c][k] for k in at], pa.int32() if c in ("i", "j", "own") else pa.int64()) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([cuts] * len(at), pa.int32())], names=[*kept, "cuts"])

    return dealt.mapInArrow(work, "key long, i int, j int, own int, rep long, class long, cuts int")


def _linked(nodes: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Links (a, b, similarity) that join classes within the pairs of blocks of ``nodes``, by exact similarity."""
    keys = ["key", "i", "j", "p", "q"]
    names = [*keys, "own", "part", "rep", "class", "text"]
    part, other = F.col("part"), F.col("other")
    same, left = F.col("i") == F.col("j"), F.col("own") == F.col("i")
    dealt = (
        nodes.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn("p", F.when(same, F.least(part, other)).when(left, part).otherwise(other))
        .withColumn("q", F.when(same, F.greatest(part, other)).when(left, other).otherwise(part))
    )
    rows = dealt.join(texts, dealt.rep == texts.id).select(*names).repartition(*keys).sortWithinPartitions(*keys, "rep")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = weights.value
        for g in _groups(batches, keys, names):
            hashes, counts, sizes = shingles(g["text"])
            if not len(hashes) or not sizes.all():
                continue
            w = weigh(hashes, counts)
            known, at = np.unique(hashes, return_inverse=True)
            start = np.cumsum(sizes) - sizes
            total = np.add.reduceat(w, start)
            own, part, parent = np.array(g["own"]), np.array(g["part"]), {c: c for c in g["class"]}
            right = np.flatnonzero((own == g["j"][0]) & (part == g["q"][0]))
            dense, found = np.zeros(len(known)), []

            def root(c: int, parent=parent) -> int:
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            for x in np.flatnonzero((own == g["i"][0]) & (part == g["p"][0])).tolist():
                span = slice(start[x], start[x] + sizes[x])
                dense[at[span]] = w[span]
                both = np.add.reduceat(np.minimum(w, dense[at]), start)
                dense[at[span]] = 0
                for y in right[(both >= threshold * (total + total[x] - both))[right]].tolist():
                    a, b = root(g["class"][x]), root(g["class"][y])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        s = float(both[y] / (total[y] + total[x] - both[y]))
                        found.append((min(g["rep"][x], g["rep"][y]), max(g["rep"][x], g["rep"][y]), s))
            yield _links_table(found)

    return rows.mapInArrow(work, _LINKS).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, links: bool = False) -> DataFrame:
    """(id, class_id) of each row: the smallest id of its class.

    With ``links`` also n_links, how many of the links on which the classes rest are the text's own,
    best_similarity, the largest of these, and copies, how many rows have the same text.
    """
    sc = df.sparkSession.sparkContext
    weights = sc.broadcast(Weights(*document_frequencies(df.select(F.col(text).alias("text")), "text")))  # SKETCH_ROWS x SKETCH numbers
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    signed = cut(signatures(docs, weights, "id", "text"))
    rows, bytes_ = signed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    reps = signed.groupBy("t0", "t1").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("size").alias("size"), *[F.min(c).alias(c) for c in (*_BAND, *_BYTES)])
    reps = cut(fewer(reps, rows * 250 / 1e6))
    banded = reps.filter("b0 is not null").select("rep", "size", *_BYTES, F.posexplode(F.array(*_BAND)).alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    members = cut(fewer(banded.join(buckets, "key"), rows * BANDS * 100 / 1e6))
    texts = cut(fewer(docs.join(members.select(F.col("rep").alias("id")).distinct(), "id"), bytes_ / 1e6))
    star = members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    found = cut(fewer(verify(star, texts, weights, threshold), bytes_ / 1e6))
    classes = components(found.select("a", "b"))
    classed = members.join(classes, F.col("rep") == F.col("node"), "left").withColumn("class", F.coalesce("root", "rep")).drop("node", "root", "leader")
    split = classed.groupBy("key").agg(F.min("class").alias("_x"), F.max("class").alias("_y")).filter("_x <> _y").select("key")
    shared = classed.join(split, "key").join(reps.select("rep", *_BAND), "rep")
    more = cut(fewer(_linked(_likely(shared), texts, weights, threshold), bytes_ / 1e6))
    if not more.isEmpty():
        found = found.unionByName(more)
        classes = components(found.select("a", "b"))
    own = ["t0", "t1", "rep", *(["copies"] if links else [])]
    by_text = reps.select(*own).join(classes, F.col("rep") == F.col("node"), "left").withColumn("class_id", F.coalesce("root", "rep")).drop("node", "root")
    out = [F.min("class_id").alias("class_id")]
    if links:
        ends = found.select("similarity", F.explode(F.array("a", "b")).alias("_end")).groupBy("_end").agg(F.count("*").alias("n_links"), F.max("similarity").alias("best_similarity"))
        by_text = by_text.join(ends, F.col("rep") == F.col("_end"), "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))).drop("_end")
        out += [F.sum("n_links").alias("n_links"), F.max("best_similarity").alias("best_similarity"), F.sum("copies").alias("copies")]
    named = signed.select("id", "t0", "t1").distinct() if links else signed.select("id", "t0", "t1")
    return named.join(by_text.drop("rep"), ["t0", "t1"]).groupBy("id").agg(*out)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), links=True).withColumnRenamed("id", "doc_id")
