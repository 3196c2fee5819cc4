"""Each registered query on the smallest tables, against its contract by plain means."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from tallyframe.llm import bpe, packing
from tallyframe.llm.catalogue import ORACLES, QUERIES
from tests.llm.test_llm import classes_by_force, nearest_by_force

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}


def run(spark, name):
    return QUERIES[name](spark, TABLES).collect()


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_classes(spark, docs):
    rows = run(spark, "op1_near_dedup")
    want = classes_by_force({i: r.text for i, r in docs.items()})
    assert {r.doc_id: r.class_id for r in rows} == want and len(rows) == len(docs) > len(set(want.values()))
    texts = Counter(r.text for r in docs.values())
    assert all(r.copies == texts[docs[r.doc_id].text] for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{TABLES}/documents.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(tuple(r[c] for c in names) for r in run(spark, name)) == sorted(found.fetchall())


def test_toxicity(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op3_toxicity")}
    assert set(rows) == set(docs)
    assert all(r.held_out == (remainder(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").collect()
    assert np.mean([rows[r.doc_id].predicted == r.toxic for r in labels if r.doc_id in rows]) > 0.9


def test_packing(spark, docs):
    lib = Tokenizer.from_file(packing.WORDS)
    lib.encode_special_tokens = True
    rows = run(spark, "op4_packing")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        ids = np.array([*lib.encode(docs[i].text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sum(r.length for r in rows) / (4096 * len(by_sequence)) > 0.9


def test_sharding(spark, docs):
    rows = run(spark, "op5_sharding")
    raw = {i: (r.text or "").encode() for i, r in docs.items()}
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {i: (len(t) + 8, zlib.crc32(t), "rows", None) for i, t in raw.items()}
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(24)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and len(rows) == len(docs)


def test_byte_bpe(spark, docs):
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.Vocabulary().ranks, special_tokens={})
    rows = {r.doc_id: r for r in run(spark, "op6_byte_bpe")}
    for i, d in docs.items():
        ids = np.array(lib.encode_ordinary(d.text or ""), "<u4")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_language_id(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op7_language_id")}
    learned = {d.lang for i, d in docs.items() if remainder(i, 3) != 1}
    assert set(rows) == set(docs) and all(r.held_out == (remainder(i, 3) == 1) and 0 <= r.score <= 1 and r.lang_pred in learned | {"und"} for i, r in rows.items())
    assert np.mean([r.lang_pred == docs[i].lang for i, r in rows.items() if r.held_out]) > 0.95


def test_nearest(spark):
    table = spark.read.parquet(f"{TABLES}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    found = defaultdict(list)
    for r in sorted(run(spark, "op9_nearest"), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    want = nearest_by_force(ids, x, np.flatnonzero(ids % 50 == 0))
    assert set(found) == set(want) and np.mean([len({v for v, _ in found[q]} & {v for v, _ in want[q]}) / 5 for q in want]) >= 0.9
    at = {int(i): k for k, i in enumerate(ids)}
    for q, own in found.items():
        assert len(own) == 5 and own == sorted(own, key=lambda p: (-p[1], p[0]))
        for v, s in own:
            a, b = x[at[q]], x[at[v]]
            assert abs(s - float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))) < 1e-12


def test_media(spark, docs):
    rows = {r.doc_id: r for r in run(spark, "op10_media_columns")}
    by_text = defaultdict(set)
    for i, d in docs.items():
        raw, r = (d.text or "").encode(), rows[i]
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        by_text[d.text].add((r.media_bytes, r.media_sha256, r.feature))
    assert set(rows) == set(docs) and all(len(v) == 1 for v in by_text.values())
