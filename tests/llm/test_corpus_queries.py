"""The registered corpus queries against DuckDB or a plain version of the same rule, on the smallest data."""

import zlib
from collections import Counter, defaultdict
from math import log10

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from workload.check import rows_of

import corpus_pipeline
import public_tokenizers
from rowassay.llm.oracle import SQL
from rowassay.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "conversations"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def docs(duck):
    return {r[0]: r[1:] for r in duck.sql("SELECT doc_id, text, source FROM documents").fetchall()}


def words(text):
    return (text or "").encode().lower().split()


def roots(items, linked):
    """Smallest reachable item of each, by repeated relabelling."""
    label = {i: i for i in items}
    while True:
        moved = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
        if not moved:
            return label


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    expected = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


def test_toxicity_folds_and_scores(spark, docs):
    rows = QUERIES["op1_toxicity"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_toxicity_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    marks = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    rows = [r for r in QUERIES["op1_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in marks]
    hits = Counter((marks[r.doc_id], r.predicted) for r in rows)
    assert hits[1, 1] / (hits[1, 1] + hits[0, 1]) > 0.85  # precision
    assert hits[1, 1] / (hits[1, 1] + hits[1, 0]) > 0.75  # recall


def test_language_model_base(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op3_context_mixing"](spark, FOLDER).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, (text, _) in docs.items() if not out[i] for w in (*words(text), b""))
    total, known = sum(counts.values()), len(counts)
    for i, (text, _) in docs.items():
        tokens = [*words(text), b""]
        assert (rows[i].held_out, rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (out[i], len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert rows[i].base_score == pytest.approx(sum(log10((counts[t] + 1) / (total + known + 1)) for t in tokens), rel=1e-9)
        assert rows[i].score < 0


def test_mix_meets_targets(spark, docs):
    rows = QUERIES["op5_budget_mix"](spark, FOLDER).collect()
    sizes = defaultdict(int)
    for text, source in docs.values():
        sizes[source] += len(words(text))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    rest, target, budget = set(sizes), {}, 1.5 * sum(sizes.values())
    while True:  # share, cap, share the excess again
        level = (budget - sum(target.values())) / sum(weights[s] for s in rest)
        above = {s for s in rest if level * weights[s] > 2 * sizes[s]}
        if not above:
            break
        target |= {s: 2 * sizes[s] for s in above}
        rest -= above
    target |= {s: level * weights[s] for s in rest}
    taken = defaultdict(int)
    for r in rows:
        text, source = docs[r.doc_id]
        assert r.size == len(words(text)) and r.source_size == sizes[source] and r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(target[source])
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(3, 0.01 * target[s]), s
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op5_budget_mix"](spark, FOLDER).collect()))


def test_simhash_groups(spark, docs):
    prints = {}
    for i, (text, _) in docs.items():
        own = words(text)
        shingles = [own[k : k + 3] for k in range(len(own) - 2)] or ([own] if own else [])
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    want = roots(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    rows = QUERIES["op6_golay_simhash"](spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_reshard_law(spark, docs):
    rows = QUERIES["op8_flow_reshard"](spark, FOLDER).collect()
    by_shard = defaultdict(list)
    for r in rows:
        data = docs[r.doc_id][0].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        by_shard[r.shard].append(r)
    assert set(by_shard) == set(range(16)) and len(rows) == len(docs)
    even, largest = sum(r.size for r in rows) / 16, max(r.size for r in rows)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - even) <= largest


def check_bins(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for own in bins.values():
        assert len({r.cluster for r in own}) == len({r.source for r in own}) == len(own)
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.size
        assert at == own[0].bin_used <= capacity
    return bins


def test_packing(spark, docs):
    rows = QUERIES["op9_conflict_packing"](spark, FOLDER).collect()
    check_bins(rows, 2048)
    sizes = Counter()
    for r in rows:
        sizes[r.doc_id] += r.size
    assert sizes == Counter({i: len(words(t)) for i, (t, _) in docs.items()})


def test_token_counts(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in QUERIES["op10_token_counts"](spark, FOLDER).collect():
        text = docs[r.doc_id][0]
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(model.encode(text)))
        assert r.over_limit == (r.n_tokens > 4096)


def test_pipeline(spark, docs):
    first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, at = first.columns, first
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        at = spark.createDataFrame(stage(spark, at, FOLDER).collect(), None if name == "packing" else first.schema) if name != "packing" else stage(spark, at, FOLDER)
        if name != "packing":
            assert at.columns == columns
        kept.append(at.collect())
    toxic_free, unique, mixed, packed = kept
    ids = [r.doc_id for r in unique]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in toxic_free}
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    check_bins(packed, 2048)
    assert sum(r.size for r in packed) == sum(len(words(r.text)) for r in mixed)
