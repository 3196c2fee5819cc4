"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A document is toxic if any of its sentences is. A sentence s has the probability
p(s) = sigmoid(b + sum of the weights of its distinct features), and the document has
1 - prod(1 - p(s)), the noisy-or. Weights and b maximise the likelihood of the documents'
labels, so that the model finds out by itself which sentences made a document toxic; these are
what ``score_documents`` lists as offending.

The model is fitted on a bounded sample of the labelled documents, FIT_DOCS of either label at
most, drawn by a hash of the id; each label's rows weigh as much as they do among all labelled rows. Whole
texts count, however long: executors find their features, and the driver gets, of each document, how many
sentences have none of the vocabulary's, and the distinct sets that the others have. Features take part if they are
in MIN_DOCS documents of the sample and G2 of feature against label is at least MIN_G2, the WORDS
best of them at most.

Sentences end at ``. ! ?`` and line ends. Words are runs of letters and digits, lower-cased.
Features are the words and, as insults are inflected too, their first 4 and first 5 bytes.

Defined results: null and empty texts have no sentence with words and get the score of a
document of one empty sentence. Without labelled rows every score is next to 0; with
one label only, every document that has words gets it. Labels repeated for an id count once, as toxic if any
says so; of texts that share an id one is learned from; null ids, labels and texts don't count. The output's
columns replace those of the same names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, expm1, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.arrowtools import extended, id_remainder, small_batches, steps, table, without
from tallyframe.session import cut, fewer

FIT_DOCS = 3000
MIN_DOCS = 3
MIN_G2 = 15.0
WORDS = 4096
LEADS = (4, 5)
ROUNDS = 400
#: Bytes of text that a step of the operators takes; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
_ENDS = b".!?\n\r"
#: Sentence ends become line ends, what is in no word becomes a space.
_TABLE = bytes(10 if b in _ENDS else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def folded(text: str) -> bytes:
    """Lower-cased UTF-8 of the same length as the text's own, sentences being lines."""
    raw = text.encode()
    low = text.lower().encode()
    return (low if len(low) == len(raw) else raw.lower()).translate(_TABLE)


def features(words: list[bytes]) -> set[tuple[int, bytes]]:
    """Distinct features, each as its number of bytes (0: a whole word) and the bytes."""
    return {(n, w[:n] if n else w) for w in words for n in (0, *LEADS) if len(w) > n}


def softplus(z):
    return np.logaddexp(0, z)


@dataclass
class Model:
    #: By number of leading bytes (0: whole words).
    weights: dict[int, dict[bytes, float]] = field(default_factory=dict)
    bias: float = -20.0

    def score(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Of the document: its score, its sentences that have words, and the offending ones (first byte, end, score)."""
        none = _softplus(self.bias)
        whole, leads = self.weights.get(0, {}), [(n, self.weights[n], self.weights[n].keys()) for n in LEADS if n in self.weights]
        known, weight = whole.keys(), whole.__getitem__
        total, plain, at, found = 0.0, 0, 0, []
        for s in folded(text or "").split(b"\n"):
            words = s.split()
            if words:
                z, hit = 0.0, False
                if own := known & words:
                    z, hit = sum(map(weight, own)), True
                for n, w, k in leads:
                    if own := k & {x[:n] for x in words if len(x) > n}:
                        z, hit = z + sum(map(w.__getitem__, own)), True
                if hit:
                    z += self.bias
                    total += _softplus(z)
                    found.append((at, at + len(s), z))
                else:
                    plain += 1
            at += len(s) + 1
        n = plain + len(found)
        total += none * (plain if n else 1)
        score = -expm1(-total)
        bad = [(i, j, _sigmoid(z)) for i, j, z in found if z >= 0]
        if score >= 0.5 and not bad and found:
            i, j, z = max(found, key=lambda x: x[2])
            bad = [(i, j, _sigmoid(z))]
        return score, n, bad


def _softplus(z: float) -> float:
    return z + log1p(exp(-z)) if z > 0 else log1p(exp(z))


def _sigmoid(z: float) -> float:
    return 1 / (1 + exp(-z)) if z > -700 else 0.0


def g2(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Twice the log-likelihood ratio of features that so many toxic and clean documents have, of n1 and n0."""
    toxic, clean, n = np.asarray(toxic, float), np.asarray(clean, float), n1 + n0
    total = np.zeros_like(toxic)
    for seen, row, column in ((toxic, toxic + clean, n1), (clean, toxic + clean, n0), (n1 - toxic, n - toxic - clean, n1), (n0 - clean, n - toxic - clean, n0)):
        there = seen > 0
        total[there] += 2 * seen[there] * np.log(seen[there] * n / (row[there] * column))
    return total


def feature_counts(texts: list[str], toxic: list[int]) -> dict[tuple[int, bytes], list[int]]:
    """Of each feature, how many clean and how many toxic documents have it."""
    found: dict[tuple[int, bytes], list[int]] = {}
    for t, label in zip(texts, toxic, strict=True):
        for f in features(folded(t).split()):
            found.setdefault(f, [0, 0])[label] += 1
    return found


def bag(text: str, vocabulary: dict[tuple[int, bytes], int]) -> tuple[int, Counter]:
    """Sentences that have words but none of the vocabulary's features, and how often each set of features is a sentence's."""
    plain, sets = 0, Counter()
    for words in map(bytes.split, folded(text).split(b"\n")):
        if own := vocabulary.keys() & features(words):
            sets[tuple(sorted(map(vocabulary.__getitem__, own)))] += 1
        elif words:
            plain += 1
    return plain, sets


def learn(vocabulary: dict[tuple[int, bytes], int], bags: list[tuple[int, Counter]], toxic: list[int], weigh: tuple[float, float] = (1.0, 1.0), l2: float = 0.02) -> Model:
    """Maximises the weighted likelihood; ``weigh``: what a row of label 0 and of label 1 counts."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, 20.0 if share else -20.0)
    plain = np.array([n for n, _ in bags], float)
    sets = [(d, s, n) for d, (_, own) in enumerate(bags) for s, n in own.items()]
    doc_of, times = np.array([d for d, _, _ in sets], np.int64), np.array([n for _, _, n in sets], float)
    word = np.array([w for _, s, _ in sets for w in s], np.int64)
    sentence = np.repeat(np.arange(len(sets)), [len(s) for _, s, _ in sets])
    weight = np.where(y == 1, weigh[1], weigh[0])
    weight /= weight.sum()
    x = np.zeros(len(vocabulary) + 1)
    x[-1] = -6.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, ROUNDS + 1):
        w, b = x[:-1], x[-1]
        z = b + np.bincount(sentence, w[word], len(doc_of))
        total = np.bincount(doc_of, times * softplus(z), len(y)) + plain * softplus(b) + 1e-9
        to_total = weight * np.where(y == 1, -1 / np.expm1(total), 1.0)
        to_z = times * to_total[doc_of] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, to_z[sentence], len(w)), to_z.sum() + (to_total * plain).sum() / (1 + np.exp(-b)))
        grad[:-1] += l2 / len(y) * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    weights: dict[int, dict[bytes, float]] = {}
    for (n, w), i in vocabulary.items():
        if abs(x[i]) > 1e-3:
            weights.setdefault(n, {})[w] = float(x[i])
    return Model(weights, float(x[-1]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """The model of a bounded sample of ``labels``; two passes over labels, one over the documents, two over the sample."""
    small_batches(docs.sparkSession)
    flags = (
        labels.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("y"))
        .filter("id is not null and y in (0, 1)")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    sizes = {r.y: r.n for r in flags.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = [flags.filter(F.col("y") == k).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(FIT_DOCS) for k in (0, 1)]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * FIT_DOCS rows at most
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text is not null").join(chosen, "id")
    sample = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text"), F.col("text"))).alias("t")).select("id", "y", "t.text")
    sample = cut(fewer(sample, 0))  # of so few documents one partition a core or so does
    got = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = got.get(0, 0), got.get(1, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP_BYTES):
            found = feature_counts(b.column("text").to_pylist(), b.column("y").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), *(pa.array([c[k] for c in found.values()], pa.int64()) for k in (0, 1))],
                names=["n", "bytes", "clean", "toxic"],
            )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = g2(b.column("toxic").to_numpy(), b.column("clean").to_numpy(), n1, n0)
            yield pa.RecordBatch.from_arrays([b.column("n"), b.column("bytes"), pa.array(good)], names=["n", "bytes", "g2"])

    counted = sample.select("y", "text").mapInArrow(count, "n int, bytes binary, clean long, toxic long").groupBy("n", "bytes").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    judged = counted.filter(F.col("clean") + F.col("toxic") >= MIN_DOCS).mapInArrow(judge, "n int, bytes binary, g2 double")
    best = judged.filter(F.col("g2") >= MIN_G2).orderBy(F.col("g2").desc(), "n", "bytes").limit(WORDS)
    vocabulary = {(r.n, bytes(r.bytes)): i for i, r in enumerate(best.collect() if n0 and n1 else [])}

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP_BYTES):
            bags = [bag(t, vocabulary) for t in b.column("text").to_pylist()]
            found = [pa.array([list(own) for _, own in bags], pa.list_(pa.list_(pa.int32()))), pa.array([list(own.values()) for _, own in bags], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([n for n, _ in bags], pa.int64()), *found], names=["id", "y", "plain", "sets", "times"])

    kind = sample.schema["id"].dataType.simpleString()
    found = sample.mapInArrow(sets, f"id {kind}, y int, plain long, sets array<array<int>>, times array<long>").orderBy("id").collect() if n0 or n1 else []
    bags = [(r.plain, Counter(dict(zip(map(tuple, r.sets), r.times, strict=True)))) for r in found]
    weigh = tuple(sizes.get(k, 0) / n if n else 1.0 for k, n in enumerate((n0, n1)))
    return learn(vocabulary, bags, [r.y for r in found], weigh)


def score_documents(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score``, ``predicted``, ``n_sentences`` and ``offending`` (first byte, end and score of each such sentence)."""
    small_batches(df.sparkSession)
    names = ["score", "predicted", "n_sentences", "offending"]
    kept = without(df, names)
    shared = df.sparkSession.sparkContext.broadcast(model)  # WORDS words at most
    span = pa.struct([("start_byte", pa.int32()), ("end_byte", pa.int32()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for b in steps(batches, text, STEP_BYTES):
            rows = [score(x) for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array([r[0] for r in rows], pa.float64()),
                    pa.array([int(r[0] >= 0.5) for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([[{"start_byte": i, "end_byte": j, "score": p} for i, j, p in r[2]] for r in rows], pa.list_(span)),
                ],
                names=[*b.schema.names, *names],
            )

    fields = "score double, predicted int, n_sentences int, offending array<struct<start_byte:int,end_byte:int,score:double>>"
    return kept.mapInArrow(work, extended(kept, fields))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(id_remainder("doc_id", 5) != 0))
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score_documents(docs.select("doc_id", "text"), model).select("doc_id", held, "score", "predicted", "n_sentences", "offending")
