"""Line dedup through a sharded minimal perfect hash.

A line's key is the line without white space (space, tab to carriage return) at its ends and with
A-Z lower-cased. A key of at least MIN_POINTS code points that is in at least two documents stays
only in the smallest doc_id that holds it; there all its lines stay.

1. Documents become (doc_id, 128-bit hash) of their distinct keys; no text leaves them.
2. Hashes are counted (partial sums before the shuffle): the smallest document, and how many.
3. The distinct hashes are dealt into shards of about KEYS_IN_SHARD. Each shard builds a minimal
   perfect hash of bit arrays by levels (a key lives at the first level where its bit is its
   alone, its slot is the number of set bits before), and arrays by slot: a 64-bit fingerprint,
   the count of documents and the smallest of them.
4. The documents' hashes probe the shards' arrays. A shard with many probes, as a very common
   line makes, is copied for several tasks, the probes being spread by document.
5. What has to go meets its document, which is split once more and put together again.

Defined results: null text is the empty text, which is one empty line. Documents with a null id
neither count nor lose lines. Rows that share an id are one document for counting and each lose
the lines that it must lose. The input's columns are kept; ``n_lines``, ``n_dropped`` and
``kept_text`` replace columns of these names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.arrowtools import extended, small_batches, steps, table, without
from tallyframe.session import PART_MB, cut, fewer

MIN_POINTS = 10
KEYS_IN_SHARD = 200_000
PROBES_IN_TASK = 400_000
#: Bytes of text that a step takes; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes | None:
    """The key of a line that may be dropped, else None."""
    key = line.strip(_SPACE).lower()  # bytes.lower() changes A-Z alone
    if len(key) < MIN_POINTS or len(key) < 4 * MIN_POINTS and len(key.decode()) < MIN_POINTS:
        return None
    return key


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalHash:
    """Slots 0..n-1 for n distinct pairs of 64-bit numbers; of others a slot at random, or -1."""

    LEVELS = 64

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.n, self.levels = len(a), []
        before = 0
        left = np.arange(len(a))
        while len(left):
            if len(self.levels) == self.LEVELS:
                raise ValueError("keys are repeated")
            size = max(64, 2 * len(left))
            at = self._place(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone, dtype=np.int64) - alone + before
            # a rank for each 64 bits suffices; the rest is counted from the bits
            self.levels.append((size, np.packbits(alone), rank[::64].copy()))
            before += int(alone.sum())
            left = left[~alone[at]]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(a ^ _mix(b, 100 + level), level) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (size, bits, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(a[left], b[left], level, size)
            alone = np.unpackbits(bits, count=size).astype(bool)
            inside = np.cumsum(alone) - alone
            inside -= np.repeat(inside[::64], 64)[:size]
            hit = alone[at]
            out[left[hit]] = ranks[at[hit] >> 6] + inside[at[hit]]
            left = left[~hit]
        return out


class Shard:
    """The arrays of a shard, by slot."""

    def __init__(self, a: np.ndarray, b: np.ndarray, owner: np.ndarray, count: np.ndarray):
        self.hash = MinimalHash(a, b)
        slots = self.hash.slots(a, b)
        self.fingerprint, self.count, self.owner = np.empty_like(b), np.empty(len(a), np.uint32), np.empty_like(owner)
        self.fingerprint[slots], self.count[slots], self.owner[slots] = b, np.minimum(count, 2**32 - 1), owner

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of documents (0: unknown) and the smallest document of each pair."""
        slots = self.hash.slots(a, b)
        known = (slots >= 0) & (self.fingerprint[slots] == b) if self.hash.n else np.zeros(len(a), bool)
        if not self.hash.n:
            return np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64)
        return np.where(known, self.count[slots], 0), self.owner[slots]


def document_keys(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h1, h2) of each document's distinct keys."""
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP_BYTES):
            ids, hashes = [], []
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {key_hash(k) for k in map(line_key, set(x.encode().split(b"\n"))) if k is not None}
                hashes += own
                ids += [d] * len(own)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", "h1", "h2"])

    rows = fewer(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).filter("doc_id is not null and text is not null")
    return rows.mapInArrow(work, "doc_id long, h1 long, h2 long")


def line_drops(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keys_in_shard: int = KEYS_IN_SHARD, probes_in_task: int = PROBES_IN_TASK) -> DataFrame:
    """(doc_id, drops: the hashes of the keys that the document loses)."""
    keys = cut(document_keys(df, doc_id, text))
    counted = (
        keys.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        .select("h1", "h2", "owner", "n", F.when(F.col("last") > F.col("owner"), F.greatest("n", F.lit(2))).otherwise(1).alias("documents"))
    )
    counted = cut(fewer(counted, keys.count() * 40 / 1e6))
    shards = max(1, -(-counted.count() // keys_in_shard))
    shard = F.pmod("h1", F.lit(shards)).cast("int")
    load = counted.groupBy(shard.alias("shard")).agg(F.ceil(F.sum("n") / probes_in_task).cast("int").alias("copies"))

    def build(group: pa.Table) -> pa.Table:
        cols = {c: group.column(c).to_numpy() for c in ("h1", "h2", "owner", "documents")}
        made = Shard(cols["h1"].view(np.uint64), cols["h2"].view(np.uint64), cols["owner"], cols["documents"])
        return pa.table({"shard": group.column("shard")[:1], "arrays": pa.array([pickle.dumps(made, 5)], pa.binary())})

    index = cut(fewer(counted.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard int, arrays binary"), shards * PART_MB))
    copies = F.broadcast(load)  # a row of 8 bytes a shard, hence a byte for every KEYS_IN_SHARD / 8 lines
    spread = index.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "arrays")
    probes = (
        keys.withColumn("shard", shard)
        .join(copies, "shard")
        .select("shard", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int").alias("copy"), "doc_id", "h1", "h2")
    )

    def probe(arrays: pa.Table, asked: pa.Table) -> pa.Table:
        if not arrays.num_rows or not asked.num_rows:
            return asked.slice(0, 0).select(["doc_id", "h1", "h2"])
        found = pickle.loads(arrays.column("arrays")[0].as_py())
        a, b = (asked.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        count, owner = found.probe(a, b)
        return asked.filter(pa.array((count > 1) & (owner != asked.column("doc_id").to_numpy()))).select(["doc_id", "h1", "h2"])

    gone = spread.groupBy("shard", "copy").cogroup(probes.groupBy("shard", "copy")).applyInArrow(probe, "doc_id long, h1 long, h2 long")
    return gone.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))


def drop_repeated_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``n_lines``, ``n_dropped`` and ``kept_text``."""
    names = ["n_lines", "n_dropped", "kept_text"]
    kept = without(df, names)
    column = {c: f"c{i}" for i, c in enumerate(kept.columns)}  # so that no name of the input meets one of these
    rows = kept.toDF(*column.values())
    drops = line_drops(rows, column[doc_id], column[text]).select(F.col("doc_id").alias("doc"), "drops")
    joined = rows.join(drops, F.col(column[doc_id]).cast("long") == F.col("doc"), "left").drop("doc")
    fields = list(column.values())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, column[text], STEP_BYTES):
            n_lines, n_dropped, texts = [], [], []
            for x, gone in zip(b.column(column[text]).to_pylist(), b.column("drops").to_pylist(), strict=True):
                lines = (x or "").split("\n")
                n_lines.append(len(lines))
                if gone:
                    bad = {np.array([g["h1"], g["h2"]], "<i8").tobytes() for g in gone}
                    lines = [s for s in lines if (k := line_key(s.encode())) is None or key_hash(k) not in bad]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f) for f in fields), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())], names=[*fields, *names]
            )

    return joined.mapInArrow(work, extended(rows, "n_lines long, n_dropped long, kept_text string")).toDF(*kept.columns, *names)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_LINES = r"""
lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as nr
  from documents),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
repeated as (
  select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key having count(distinct doc_id) > 1),
judged as (
  select k.*, r.owner is not null and r.owner <> k.doc_id as gone from keyed k left join repeated r on k.key = r.key)
"""
OP8_SQL = f"""
with {_LINES}
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by nr) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""
