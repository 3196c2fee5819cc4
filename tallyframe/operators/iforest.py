"""Isolation forest (Liu, Ting and Zhou, 2008): fitted on bounded samples, scored by executors in numpy.

A tree isolates the points of a small sample by random cuts; outliers end up near the root. A
point's score is 2^(-mean depth / c), c being the mean depth of an unsuccessful search among as
many points; 0.5 is ordinary, 1 a certain outlier.

The samples of all trees come from one draw of SAMPLE_ROWS rows in expectation by a hash of the
row id, so that the forest is the same for any partitioning. A block of points goes down each tree
together, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.draws import drawn

TREES = 200
TREE_ROWS = 256
SAMPLE_ROWS = 16_384
SEED = 42


def search_depth(n) -> np.ndarray:
    """Mean depth at which a search among n points fails."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        deep = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Nodes of all trees in a row, the two children of a node side by side; a leaf is its own child and holds its depth."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    roots: list[int]
    levels: int
    rows: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for a in range(0, len(x), 4096):
            part = np.ascontiguousarray(x[a : a + 4096])
            flat, row = part.ravel(), np.arange(len(part)) * part.shape[1]
            for root in self.roots:
                node = np.full(len(part), root)
                for _ in range(self.levels):
                    value = flat.take(row + self.feature.take(node))
                    node = self.child.take(node) + (value >= self.cut.take(node))
                total[a : a + 4096] += self.depth.take(node)
        return 2.0 ** (-total / len(self.roots) / max(float(search_depth(self.rows)), 1e-12))


def grow(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    most = int(np.ceil(np.log2(max(rows, 2))))
    nodes: list[list] = []
    roots = []
    for _ in range(trees):
        roots.append(len(nodes))
        nodes.append([])
        todo = [(len(nodes) - 1, x[rng.choice(len(x), rows, replace=False)], 0)]
        while todo:
            me, own, level = todo.pop()
            nodes[me] = [0, np.inf, me, level + float(search_depth(len(own)))]
            low, high = own.min(axis=0), own.max(axis=0)
            varied = np.flatnonzero(high > low)
            if level < most and len(varied):
                f = int(rng.choice(varied))
                at = rng.uniform(low[f], high[f])
                under = own[:, f] < at
                if under.any() and not under.all():
                    nodes[me] = [f, at, len(nodes), 0.0]
                    todo += [(len(nodes), own[under], level + 1), (len(nodes) + 1, own[~under], level + 1)]
                    nodes += [[], []]
    f, c, child, d = zip(*nodes, strict=True)
    return Forest(np.array(f), np.array(c), np.array(child), np.array(d), roots, most, rows)


def fit(features: DataFrame, columns: list[str], row_id: str, rows: int, **kw) -> Forest:
    """``rows``: of the table, for the draw; ``kw``: trees, rows a tree, seed."""
    sample = features.filter(drawn(F.xxhash64(row_id, F.lit(SEED)), SAMPLE_ROWS, rows)).orderBy(row_id).select(*columns).toArrow()
    x = np.stack([sample.column(c).to_numpy() for c in columns], axis=1)
    return grow(x, **kw)


def score(features: DataFrame, columns: list[str], forest: Forest, name: str = "isolation") -> DataFrame:
    """Adds the score as a column."""
    shared = features.sparkSession.sparkContext.broadcast(forest)  # trees x 2 x rows a tree nodes at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(x), pa.float64())], names=[*b.schema.names, name])

    return features.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema), f"{name} double"]))
