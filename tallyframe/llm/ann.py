"""Approximate nearest neighbours by cosine: inverted file with product-quantised residuals.

Vectors are scaled to length 1. Coarse centroids (k-means) divide them into lists, about the root of the rows in
number; beyond MOST_LISTS, centroids of what the coarse ones leave divide every list again, up to
MOST_LISTS times, so that lists go on growing with the rows while both sets are fitted on the bounded sample. The residual
to its centroid is cut into SUBSPACES parts, each stored as one byte, the nearest of up to 256
sub-centroids. A query probes the lists of its nearest centroids; how many is measured on the
sample: as many as hold REACHED of the true neighbours of ASKERS sample rows in the sample, few where
vectors cluster and over half of the lists where they are spread evenly. In a list, a table of the
query's inner products with all sub-centroids (the query itself not being quantised) scores every
code by lookups. A score is off by no more than the length of what its code leaves of the vector,
which the index holds: the cosines of the SHORTLIST best codes give a k-th best one, and every row
whose score could still reach it is reranked by the cosine of the original vectors in double
precision. So codes never cut a neighbour off, however crowded a list is; where vectors are spread so
evenly that codes tell little, most of a list is reranked. The best of all lists are the result.

Centroids and sub-centroids are fitted on FIT_ROWS rows in expectation, drawn by hash, equal
vectors counting once; every row is indexed. Lists are cut into blocks of BLOCK rows on
average and so are the queries that probe a list, so that neither a hot vector nor a
popular list makes a large task; each pair of blocks is one group.

Defined results: vectors that are null, zero, of another dimension than most of the sample, or
hold null or non-finite components take no part, neither do null ids. Queries picked from the rows by a
condition exclude their own row only: other rows of their id are candidates, and every row
of a repeated id asks for itself and is a candidate of its own. Queries given as a table exclude the rows of their id. Ties
go to the smaller id; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.draws import drawn
from tallyframe.llm.arrowtools import table
from tallyframe.session import cut, fewer

FIT_ROWS = 16_384
MOST_LISTS = 1024
SUBSPACES = 16
#: Codes whose cosines give the bound that the other rows have to reach; no limit to what is reranked.
SHORTLIST = 64
#: More than rounding adds to a score or a cosine.
MARGIN = 1e-9
BLOCK = 8192
#: How many of the sample's true neighbours must lie in the probed lists, and how many sample rows ask.
REACHED, ASKERS = 0.97, 256
#: A query probes on until these many rows are in reach.
REACH = 256
#: Distances of queries to lists that are held at a time.
ORDERED = 1 << 21


def vectors(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a usable vector, and these as float64."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    if dim is None:
        counts = Counter(sizes[there & (sizes > 0)].tolist())
        dim = max(counts, key=lambda k: (counts[k], k), default=0)
    rows = np.flatnonzero(there & (sizes == dim) & (dim > 0))
    x = values[ends[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    with np.errstate(over="ignore", invalid="ignore"):
        norm = (x * x).sum(axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        size = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        sums = np.zeros_like(centres)
        there = np.flatnonzero(size)
        sums[there] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(size[there])[:-1]]), axis=0)
        centres[there] = sums[there] / size[there][:, None]
        empty = np.flatnonzero(size == 0)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


class Quantiser:
    def __init__(self, sample: np.ndarray, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        x = np.unique(unit(sample), axis=0)
        self.dim = x.shape[1]
        wanted = max(1, round(rows**0.5))
        self.coarse = kmeans(x, min(MOST_LISTS, wanted), rng)
        self.fine = np.zeros((1, self.dim))
        if wanted > MOST_LISTS:
            self.fine = kmeans(x - self.coarse[nearest(x, self.coarse)], min(MOST_LISTS, -(-wanted // MOST_LISTS)), rng)
        self.lists = len(self.coarse) * len(self.fine)
        self.parts = min(SUBSPACES, self.dim)
        self.width = -(-self.dim // self.parts)
        rest = self.split(x - self.centre(self.assign(x)))
        self.books = [kmeans(rest[:, p], 256, rng) for p in range(self.parts)]
        self.probes = self.measure(x, x[rng.choice(len(x), min(ASKERS, len(x)), replace=False)])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The list of each unit vector."""
        own = nearest(x, self.coarse)
        return own if len(self.fine) == 1 else own * len(self.fine) + nearest(x - self.coarse[own], self.fine)

    def centre(self, lists) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def order(self, x: np.ndarray) -> np.ndarray:
        """The lists of each unit vector, nearest first."""
        half = ((self.coarse * self.coarse).sum(axis=1)[:, None] + (self.fine * self.fine).sum(axis=1)) / 2 + self.coarse @ self.fine.T
        far = half - (x @ self.coarse.T)[:, :, None] - (x @ self.fine.T)[:, None, :]
        return np.argsort(far.reshape(len(x), -1), axis=1, kind="stable")

    def blocks(self, n: int) -> Iterator[slice]:
        """So many vectors that their orders are bounded, at a time."""
        step = max(1, ORDERED // self.lists)
        for at in range(0, n, step):
            yield slice(at, at + step)

    def measure(self, x: np.ndarray, askers: np.ndarray, k: int = 5) -> int:
        k = min(k, len(x) - 1)
        if not k:
            return 1
        close = askers @ x.T
        close[close > 1 - 1e-12] = -np.inf  # themselves
        near = self.assign(x)[np.argpartition(-close, k - 1, axis=1)[:, :k]]
        rank = np.concatenate([np.take_along_axis(np.argsort(self.order(askers[own]), axis=1), near[own], axis=1) for own in self.blocks(len(askers))])
        return int(np.quantile(rank, REACHED)) + 1

    def split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.parts * self.width))
        wide[:, : self.dim] = x
        return wide.reshape(len(x), self.parts, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List and codes of unit vectors, and the length of what they leave of each."""
        own = self.assign(x)
        rest = self.split(x - self.centre(own))
        codes = np.stack([nearest(rest[:, p], self.books[p]) for p in range(self.parts)], axis=1)
        left = sum(((rest[:, p] - book[codes[:, p]]) ** 2).sum(axis=1) for p, book in enumerate(self.books))
        return own, codes.astype(np.uint8), np.sqrt(left)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with each sub-centroid: (query, part, code)."""
        parts = self.split(q)
        out = np.zeros((len(q), self.parts, 256))
        for p, book in enumerate(self.books):
            out[:, p, : len(book)] = parts[:, p] @ book.T
        return out


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1)[: len(x) + 1], pa.int32()), pa.array(x.ravel()))


def fit(df: DataFrame, vec_id: str, embedding: str) -> Quantiser | None:
    rows = df.count()
    draw = drawn(F.xxhash64(vec_id, F.lit(9)), FIT_ROWS, rows)
    sample = df.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).filter(draw).select(embedding).toArrow().column(0)
    _, x = vectors(sample) if len(sample) else (None, np.zeros((0, 0)))
    return Quantiser(x, rows) if len(x) else None


def build_index(df: DataFrame, q: Quantiser, vec_id: str = "vec_id", embedding: str = "embedding", asks: Column | None = None) -> DataFrame:
    """(row, vec_id, asks, list, codes, left, vector) of every usable row, in the shared folder; row numbers the rows, asks tells the queries."""
    shared = df.sparkSession.sparkContext.broadcast(q)  # 2 * MOST_LISTS + 256 * SUBSPACES centroids at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = vectors(b.column(3), shared.value.dim)
            if len(rows):
                own, codes, left = shared.value.encode(unit(x))
                kept = [b.column(i).take(pa.array(rows)) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left), _arrays(x)], names=["row", "vec_id", "asks", "list", "codes", "left", "vector"]
                )

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(F.lit(False) if asks is None else asks, F.lit(False)).alias("asks"), F.col(embedding).alias("vector"))
    numbered = fewer(rows).filter("vec_id is not null and vector is not null").select(F.monotonically_increasing_id().alias("row"), "*")
    return cut(numbered.mapInArrow(work, "row long, vec_id long, asks boolean, list int, codes binary, left double, vector array<double>"))


def search(df: DataFrame, queries: Column | DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query. queries: a condition on the rows of ``df``, or a table."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = df.sparkSession
    q = fit(df, vec_id, embedding)
    if q is None:
        return spark.createDataFrame([], schema)
    within = isinstance(queries, Column)
    index = build_index(df, q, vec_id, embedding, queries if within else None)
    sizes = np.zeros(q.lists, np.int64)
    for r in index.groupBy("list").agg(F.count("*").alias("n")).collect():  # MOST_LISTS ** 2 rows at most
        sizes[r.list] = r.n
    shared = spark.sparkContext.broadcast((q, sizes))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, sizes = shared.value
        for b in batches:
            rows, found = vectors(b.column(2), q.dim)
            for own in q.blocks(len(rows)):
                x = found[own]
                order = q.order(unit(x))
                reach = np.cumsum(sizes[order], axis=1)
                taken = (np.arange(len(sizes)) < q.probes) | (np.concatenate([np.zeros((len(x), 1)), reach[:, :-1]], axis=1) < REACH)
                taken &= sizes[order] > 0
                which, at = np.nonzero(taken)
                ids = [b.column(i).take(pa.array(rows[own][which])) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(order[which, at], pa.int32()), _arrays(x[which])], names=["asker", "query_id", "list", "vector"])

    if within:
        given = index.filter("asks").select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"), "vector")
    else:
        given = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(embedding).alias("vector")).filter("query_id is not null and vector is not null")
        given = cut(given.select(F.monotonically_increasing_id().alias("asker"), "*"))
    asked = given.mapInArrow(probes, "asker long, query_id long, list int, vector array<double>")
    loads = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    cuts = [(i, int(-(-max(1, n) // BLOCK)), int(-(-loads.get(i, 1) // BLOCK))) for i, n in enumerate(sizes.tolist())]
    blocks = lambda: F.broadcast(spark.createDataFrame(cuts, "list int, row_blocks int, query_blocks int"))  # noqa: E731  a row a list
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(blocks(), "list").withColumn("row_block", F.pmod(F.xxhash64("row"), F.col("row_blocks")).cast("int")).withColumn("query_block", spread("query_blocks")).drop("row_blocks", "query_blocks")
    right = asked.join(blocks(), "list").withColumn("query_block", F.pmod(F.xxhash64("asker"), F.col("query_blocks")).cast("int")).withColumn("row_block", spread("row_blocks")).drop("row_blocks", "query_blocks")
    keys = ["list", "row_block", "query_block"]

    def kth(close: np.ndarray) -> np.ndarray:
        """The k-th largest of each row, or less than all where there are fewer."""
        return np.partition(close, -k, axis=1)[:, -k] if close.shape[1] >= k else np.full(len(close), -np.inf)

    def scan(rows: pa.Table, asked: pa.Table) -> pa.Table:
        q, _ = shared.value
        found: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            ids, mine = rows.column("vec_id").to_numpy(), rows.column("row" if within else "vec_id").to_numpy()
            order = np.lexsort((rows.column("row").to_numpy(), ids))
            ids, mine = ids[order], mine[order]
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order].astype(np.intp)
            x = vectors(rows.column("vector"), q.dim)[1][order]
            length, left = np.sqrt((x * x).sum(axis=1)), rows.column("left").to_numpy()[order]
            near = q.centre(int(rows.column("list")[0].as_py()))
            asker, y = asked.column("asker").to_numpy(), vectors(asked.column("vector"), q.dim)[1]
            query, not_mine = asked.column("query_id").to_numpy(), asked.column("asker" if within else "query_id").to_numpy()
            for a in range(0, len(y), 64):
                own = unit(y[a : a + 64])
                books = q.tables(own)
                score = np.repeat((own @ near)[:, None], len(ids), axis=1)
                for p in range(q.parts):
                    score += books[:, p][:, codes[:, p]]
                score[not_mine[a : a + 64][:, None] == mine] = -np.inf
                first = np.argpartition(-score, SHORTLIST - 1, axis=1)[:, :SHORTLIST] if len(ids) > SHORTLIST else np.broadcast_to(np.arange(len(ids)), score.shape)
                close = np.einsum("ijk,ik->ij", x[first], own) / length[first]
                close[np.take_along_axis(score, first, axis=1) == -np.inf] = -np.inf
                could = (score + left >= kth(close)[:, None] - MARGIN) & (score > -np.inf)
                some = np.flatnonzero(could.any(axis=0))
                close = own @ x[some].T / length[some]
                close[~could[:, some]] = -np.inf
                could = (close >= kth(close)[:, None] - MARGIN) & (close > -np.inf)
                for i in range(len(own)):
                    row, v = some[could[i]], y[a + i]
                    exact = (x[row] * v).sum(axis=1) / (length[row] * np.sqrt((v * v).sum()))
                    top = np.lexsort((ids[row], -exact))[:k]
                    found += zip([int(asker[a + i])] * len(top), [int(query[a + i])] * len(top), ids[row[top]].tolist(), exact[top].tolist(), strict=True)
        cols = zip(*found, strict=True) if found else ([], [], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["asker", "query_id", "vec_id", "score"])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "asker long, query_id long, vec_id long, score double")
    order = Window.partitionBy("asker").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 50 == 0)
