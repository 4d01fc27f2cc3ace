"""Importance resampling, boosted quality and the iceberg audit: brute force, held-out accuracy and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from rowassay.llm import boosted, common, iceberg, importance
from rowassay.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, digest string, row long, n long, term string, back string, x map<string,int>"
LONG = "Very" * 30_000 + " " + "word " * 30_000


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty, blank and very long texts, repeated rows and ids, and extra columns with the operators' own names."""
    texts = [None, "", " \t\n", "one", "One two", "a b c d e " * 6, "a b c d e " * 6, LONG, "é ü ÉÜ <|turn|> \\ \0 x1y", "q" * 300]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", "x", 1, 2, "t", "b", {"k": 1}) for i, t in enumerate(texts)]
    rows += [(None, "no id " * 15, "en", "s0", None, None, None, None, None, None)] * 3 + [rows[5]] * 40 + [rows[9]] * 3 + [(5, "other text " * 12, "de", "s1", "", 0, 0, "", "", None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- importance resampling


def plain_resampling(docs, target, percent=5):
    """[(doc_id, n_features, weight, score, rank)] by the formula; ``docs`` holds (doc_id, text)."""

    def runs(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]

    read = [(i, *runs(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in read for b in f), Counter(b for text in target for b in runs(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    rows, able = [], []
    for i, words, found in read:
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        able += [len(rows)] if len(words) >= 20 else []
        rows.append([i, len(found), weight, score, None])
    able.sort(key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0, rows[k][1]))
    for rank, k in enumerate(able[: percent * len(able) // 100], 1):
        rows[k][4] = rank
    return rows


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x or 0) for x in r])


def test_resampling_against_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    found = QUERIES["op11_importance_resampling"](spark, FOLDER).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert ordered(found) == ordered(plain_resampling(docs, target))


@pytest.mark.parametrize("percent", [0, 30, 60, 100])
def test_resampling_of_odd_rows(spark, odd, percent):
    target = spark.createDataFrame([("a b c",), (None,), ("",)], "text string")
    ranked = importance.resample(odd, target, percent=percent, lot=7, few=3)
    shown = ranked.drop("digest").collect()
    expected = plain_resampling([(r.doc_id, r.text) for r in odd.collect()], ["a b c", None, ""], percent)
    assert ordered(shown) == ordered(expected)
    drawn = importance.drawn_documents(odd, ranked)
    assert drawn.columns == odd.columns and drawn.count() == sum(r.rank is not None for r in shown)


def test_resampling_of_nothing(spark, odd, none):
    empty = spark.createDataFrame([], "text string")
    assert importance.resample(none, empty).collect() == []
    assert importance.resample(odd, empty).count() == odd.count()


def test_cutoff_is_the_exact_rank(spark):
    draw = random.Random(4)
    keys = [tuple(draw.choice((-(1 << 40), -3, 0, 5, 1 << 50)) if c else draw.randint(-30, 30) for c in range(5)) for _ in range(2000)] + [(7, 0, 0, 0, 0)] * 900
    rows = spark.createDataFrame(keys, ", ".join(f"{c} long" for c in importance.KEY)).repartition(7)
    for places in (1, 2, 700, 1450, 1451, 2400, 2900):
        assert importance.cutoff(rows, places, lot=64, few=2) == sorted(keys)[places - 1]
    assert importance.cutoff(rows, 2901) is None and importance.cutoff(rows, 0) is None


def test_weighted_median_leaves_a_quarter_on_each_side():
    draw = np.random.default_rng(2)
    for _ in range(50):
        lots = [np.stack([draw.integers(0, 40, n), draw.integers(0, 3, n)], axis=1) for n in draw.integers(1, 60, 9)]
        pivot = importance.weighted_median([tuple(importance.middle_key(x).tolist()) for x in lots], [len(x) for x in lots])
        keys = [tuple(k) for x in lots for k in x.tolist()]
        assert sum(k <= pivot for k in keys) * 4 >= len(keys) and sum(k >= pivot for k in keys) * 4 >= len(keys)


# --- boosted quality


def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    marks = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    rows = QUERIES["op12_boosted_quality"](spark, folder).collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    known = [(marks[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in marks]
    hits = Counter(known)
    assert hits[0, 0] / (hits[0, 0] + hits[0, 1]) > 0.9 and hits[1, 1] / (hits[1, 1] + hits[1, 0]) > 0.97


def test_trees_walk_like_plain_ones():
    draw = np.random.default_rng(1)
    x = np.round(draw.standard_normal((600, 5)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = boosted.boost(x, y, trees=25)
    fresh = draw.standard_normal((200, 5))

    def plain(row):
        total = trees.bias
        for split, cut, leaf in zip(trees.split, trees.cut, trees.leaf):
            node = 0
            while node < boosted.INNER:
                node = 2 * node + (2 if row[split[node]] > cut[node] else 1)
            total += leaf[node - boosted.INNER]
        return total

    assert trees.raw(fresh) == pytest.approx([plain(r) for r in fresh])
    assert ((trees.raw(x) > 0) == (y > 0)).mean() > 0.97


def test_first_split_is_the_best_of_all():
    """One tree's root against every statistic and every edge tried one by one."""
    draw = np.random.default_rng(3)
    x, y = draw.integers(0, 20, (300, 4)).astype(float), draw.integers(0, 2, 300).astype(float)
    y[x[:, 2] > 13] = 1
    tree = boosted.boost(x, y, trees=1)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))

    def gain(left):
        parts = [(g[m].sum(), h[m].sum()) for m in (left, ~left)]
        if min(b for _, b in parts) < boosted.LEAST_WEIGHT:
            return 0
        return sum(a * a / (b + boosted.SMOOTH) for a, b in parts)

    best = max(((gain(x[:, c] <= e), c, e) for c in range(4) for e in range(20)), key=lambda t: t[0])
    assert gain(x[:, tree.split[0, 0]] <= tree.cut[0, 0]) == pytest.approx(best[0])


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 1), (4, 0, 1), (5, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (7, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    model = boosted.fit(odd, labels)
    rows = boosted.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by_text = defaultdict(set)
    for r, text in zip(rows, [r.text for r in odd.collect()]):
        by_text[text].add(r.score)
    assert all(len(s) == 1 for s in by_text.values())  # copies score alike
    assert boosted.score(none, model).collect() == []
    unknown = boosted.score(odd, boosted.fit(odd, labels.limit(0)), 0.3).collect()
    assert {round(r.score, 9) for r in unknown} == {0.3}
    only_good = boosted.score(odd, boosted.fit(odd, labels.filter("quality = 1")), 0.3).collect()
    assert min(r.score for r in only_good) > 0.3
    assert boosted.fit(none, labels).constant == 0.0


# --- iceberg audit


def plain_divergence(docs, least, limit):
    held, groups = defaultdict(set), defaultdict(Counter)
    for k, (lang, source, text) in enumerate(docs):
        lang, source, text = lang or "", source or "", text or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        groups[lang, source].update(found)
        for t in found:
            held[lang, t].add(k)
    rows = []
    for (lang, source), own in groups.items():
        kept = sorted(t for (l, t), d in held.items() if l == lang and len(d) >= least)

        def p_of(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        mine, whole = p_of(own), p_of(sum((c for (l, _), c in groups.items() if l == lang), Counter()))
        pairs = [(s, sum((mine[t] - q) ** 2 // q for t, q in p_of(c).items())) for (l, s), c in groups.items() if l == lang and s != source]
        terms = [(t, (mine[t] - whole[t]) ** 2 // whole[t]) for t in kept if own[t] and mine[t] > whole[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            rows += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(items if part == "pair" else items[:limit], 1)]
    return sorted(rows)


@pytest.mark.parametrize(("least", "first", "cells"), [(3, 4, 1 << 19), (1, 1, 8), (2, 3, 64)])
def test_divergence_of_odd_rows(spark, odd, monkeypatch, least, first, cells):
    monkeypatch.setattr(iceberg, "CELLS", cells)
    kept = iceberg.kept_terms
    monkeypatch.setattr(iceberg, "kept_terms", lambda docs, n: kept(docs, n, first))
    found = iceberg.divergence(odd, least, 5).collect()
    assert sorted(map(tuple, found)) == plain_divergence([(r.lang, r.source, r.text) for r in odd.collect()], least, 5)


def test_divergence_of_nothing(none):
    assert iceberg.divergence(none).collect() == []


def test_beginnings_below_the_threshold_are_discarded(spark):
    """Two documents share a beginning of four letters, so no longer term under it is ever counted."""
    docs = spark.createDataFrame([("en", "a", "abcdefgh abcdxxxx common"), ("en", "b", "abcdefgh common"), ("en", "b", "common commonly")], "lang string, source string, text string")
    level = iceberg.level_counts(docs, 0, 4, None)
    assert {bytes(r.term): r.docs for r in level.collect()} == {b"abcd\0": 2, b"comm\0": 3}
    bits = spark.sparkContext.broadcast(iceberg.surviving_bits(spark.createDataFrame([("en", bytearray(b"comm"))], "lang string, prefix binary")))
    assert {bytes(r.term) for r in iceberg.level_counts(docs, 4, 8, bits).collect()} == {b"common", b"commonly"}
    assert {(r.source, bytes(r.term)) for r in iceberg.kept_terms(docs).collect()} == {("a", b"common"), ("b", b"common")}


def test_iceberg_terms_and_places_of_the_bitmap_are_those_of_bytes():
    texts = ["", "Ab ab-ab \x0bé\u2003ü 1x9y", "z" * 300 + " " + "y" * 64 + " " + "y" * 65, "!?", "q"]
    terms, place = iceberg.terms_in(pa.array(["left out", *texts]).slice(1))
    plain = [(i, t) for i, text in enumerate(texts) for t in text.encode().translate(iceberg.LETTERS).split()]
    assert list(zip(place.tolist(), terms.to_pylist())) == plain
    longer, place = iceberg.terms_in(pa.array(texts), 2)
    assert list(zip(place.tolist(), longer.to_pylist())) == [(i, t) for i, t in plain if len(t) > 2]
    seeds = np.arange(len(terms), dtype=np.uint32) * np.uint32(2654435761)
    for length in (None, 1, 3, 70):
        assert iceberg.crc_of(terms, length, seeds).tolist() == [zlib.crc32(t[:length], int(x)) for t, x in zip(terms.to_pylist(), seeds)]


def test_iceberg_looks_at_a_term_once_for_all_sources(spark, monkeypatch):
    """One row for each group and kept term leaves a task, however many slices of text it had, and others are dropped there."""
    docs = spark.createDataFrame([("en", f"s{i % 3}", f"common rare{chr(97 + i)}") for i in range(20)], "lang string, source string, text string").coalesce(1)
    bits = spark.sparkContext.broadcast(iceberg.surviving_bits(spark.createDataFrame([("en", bytearray(b"common"))], "lang string, prefix binary")))
    numbers = spark.sparkContext.broadcast({(b"en", f"s{i}".encode()): i for i in range(3)})
    assert sorted((r.group, bytes(r.term), r.n) for r in iceberg.group_counts(docs, bits, numbers).collect()) == [(0, b"common", 7), (1, b"common", 7), (2, b"common", 6)]
    parts = [pa.table({"term": pa.array([b"a", b"b"]), "n": pa.array([1, 2])}) for _ in range(3)]
    assert sorted(zip(*iceberg.added_up(parts, "n").to_pydict().values())) == [(b"a", 3), (b"b", 6)] and not parts


class Caught:
    """Stands for the rows of a scan and keeps the function that tasks run."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def select(self, *columns):
        return self

    groupBy = agg = select


@pytest.mark.parametrize("scan", ["level", "groups"])
def test_iceberg_scans_hold_little_beside_a_large_batch(spark, scan):
    """A batch of 16 MB of different words is split, numbered and counted in a few MB at a time."""
    words = [f"{a}{b}{c}{d}{e}" for a in "abcdefgh" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst" for d in "abcdefghijklmnopqrst" for e in "abcdefghijklmnopqrst"]
    texts = [" ".join(words[i::2000]) for i in range(2000)] * 2
    batch = pa.record_batch([pa.array(["en"] * len(texts)), pa.array(["s"] * len(texts)), pa.array(texts)], names=["lang", "source", "text"])
    docs, shared = Caught(), lambda value: type("Shared", (), {"value": value})
    if scan == "level":
        iceberg.level_counts(docs, 0, 6, None)
    else:
        iceberg.group_counts(docs, shared(b"\xff" * (1 << iceberg.FILTER_BITS - 3)), shared({(b"en", b"s"): 0}))
    usual = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(pool)
    try:
        found = Counter()
        for out in docs.run(iter([batch])):
            for term, n in zip(out.column("term").to_pylist(), out.column(2).to_pylist()):
                found[term] += n
    finally:
        pa.set_memory_pool(usual)
    assert found == dict.fromkeys((w.encode() for w in words), 2)
    assert pool.max_memory() < 32 << 20


def test_a_worker_gives_memory_back_when_its_task_ends(monkeypatch):
    seen = []

    def run(batches):
        yield from batches
        seen.append("over")

    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
    assert seen == ["over", "back"]
