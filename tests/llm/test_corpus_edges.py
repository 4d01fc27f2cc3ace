"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns; and the methods' own promises."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from rowassay.llm import bit_sliced, budget, cap_filters, chat, context_mixing, golay, packing, reshard, token_counts, toxicity
from rowassay.llm.common import words_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, size string"
LONG = "very " * 30_000 + "long"


@pytest.fixture(scope="module")
def odd(spark):
    """Two of everything odd, with extra columns whose names the operators use themselves."""
    texts = [None, "", " \t\n", "one", "one two", "a b c d e", "a b c d e", LONG, "é ü <|turn|> \\ \0 x"]
    rows = [(i, t, None, None if i % 3 == 0 else f"s{i % 2}", None, 0.5, 1, "x") for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "s0", 5, None, None, None)] * 2 + [rows[5]] * 2
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (5, None, None), (None, 0, 1), (3, 1, 0)], LABELS)
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, toxicity.fit(none, labels)).collect() == []
    unknown = toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect()
    assert max(r.score for r in unknown) < 1e-9


def test_non_negative_risk_prefers_true_positives():
    draw = np.random.default_rng(0)
    bad, plain = toxicity.hashed_words([b"vile filth"])[0], toxicity.hashed_words([b"the of and to in it is was for on"])[0]
    def doc(toxic):
        return np.concatenate([plain[draw.integers(0, 10, 20)].ravel(), bad.ravel() if toxic else np.empty(0, np.int32)])
    weights, bias = toxicity.train([doc(True) for _ in range(60)], [doc(i % 10 == 0) for i in range(600)], 0.1, 1)
    def score(f):
        return bias + weights[f].sum() / np.sqrt(len(f) / toxicity.PER_WORD)
    assert min(score(doc(True)) for _ in range(50)) > max(score(doc(False)) for _ in range(50))


VECTORS = "vec_id long, embedding array<float>, label int, vector string, n long, rep long"


@pytest.fixture(scope="module")
def vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [[1.0, 0.0], [1.0, 0.0], [0.999, 0.01], [0.0, 1.0], [0.0, 0.0], None, [], [nan, 1.0], [1.0, inf], [1.0, None], [2.0, 0.0, 0.0], [5e37, 1e36]]
    rows = [(i * 50, v, 1, "x", 1, 2) for i, v in enumerate(data)]
    return spark.createDataFrame(rows + [(7, [1.0, 0.0], None, "x", 1, 2), (8, [1.0, 0.0], 2, "x", 1, 2), (None, [1.0, 0.0], 1, "x", 1, 2), rows[0]], VECTORS)


def test_cap_filters(spark, vectors):
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in cap_filters.near_duplicates(vectors).collect())
    near = (0, 4, 0), (50, 4, 0), (100, 4, 0), (550, 4, 0)
    assert all(got[n] for n in near) and got[near[0]] == 2
    assert all(got[i * 50, 0, i * 50] for i in (3, 4, 5, 6, 7, 8, 9, 10)) and got[7, 0, 7] and got[8, 0, 8] and got[None, 0, None]
    assert sum(got.values()) == vectors.count()
    assert cap_filters.near_duplicates(vectors.limit(0)).collect() == []


def test_cap_filters_lose_no_link(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((40, 64))
    points = np.concatenate([c + draw.standard_normal((20, 64)) * s for c, s in zip(centres, np.linspace(0.01, 0.2, 40))])
    df = spark.createDataFrame([(i, p.tolist(), int(i % 2)) for i, p in enumerate(points)], "vec_id long, embedding array<double>, label int")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.98) & (np.arange(800)[:, None] % 2 == np.arange(800)[None] % 2)
    want = {i: int(close[i].sum()) - 1 for i in range(800)}
    assert {r.vec_id: r.n_links for r in cap_filters.near_duplicates(df).collect()} == want


def test_bit_sliced(spark, vectors):
    rows = bit_sliced.search(vectors, F.col("vec_id") % 100 == 0, 3).collect()
    parts = {}
    for r in vectors.collect():
        if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding):
            parts[r.vec_id] = [int(np.floor(x * 1024)) for x in r.embedding]
    want = set()
    for q in (i for i in parts if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(parts[q], parts[c])), c) for c in parts if c != q)
        want |= {(q, n, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, c) in enumerate(scores[:3], 1)}
    assert {tuple(r) for r in rows} == want
    assert bit_sliced.search(vectors.limit(0), F.lit(True)).collect() == []


def test_bit_sliced_large_numbers(spark):
    """Components of any size are whole numbers to the last digit, and ranked by scores no long can show."""
    draw = np.random.default_rng(11)
    points = draw.standard_normal((150, 6)) * 10.0 ** draw.choice([0, 3, 9, 14, 17, 40], (150, 1))
    points[:20] = (2.0**43 + np.arange(20)[:, None]) / 1024  # neighbours around 2^43
    points[20:23] = points[23]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    whole = [[int(np.floor(x * 1024)) for x in p] for p in points.tolist()]
    want = set()
    for q in range(0, 150, 10):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in range(150) if c != q)
        want |= {(q, n, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, c) in enumerate(scores[:5], 1)}
    assert {tuple(r) for r in bit_sliced.search(df, F.col("vec_id") % 10 == 0, 5).collect()} == want


def test_bit_sliced_vectors_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0]), (3, [1.8e306, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in bit_sliced.search(df, F.col("vec_id") == 0, 10).collect())
    one = 1024 * 1024
    assert got == [(0, 1, 1, 3 * one), (0, 1, 2, 2 * one), (0, 2, 1, one), (0, 2, 2, one)]


def test_language_model(spark, odd, none):
    rows = context_mixing.score(odd, F.coalesce(F.col("doc_id") != 4, F.lit(False))).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r.score) and r.bits > 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert context_mixing.score(none, F.lit(True)).collect() == []
    untrained = context_mixing.score(odd, F.lit(False)).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(r.n_known == 0 for r in untrained)


def test_language_model_is_a_code():
    """The probabilities of all one-letter texts and the empty one sum to less than one: paths form a prefix code."""
    book = context_mixing.Codebook.build([(b"", 3), (b"a", 2)], 1, np.ones(context_mixing.LETTERS, dtype=np.int64))
    empty = {(t, c): np.zeros(2 * context_mixing.CHUNK) for t, n in ((0, 1), (1, 256), (2, 256)) for c in range(n)}
    model = context_mixing.Model.build(empty, book.n_nodes)
    letters = [bytes([b]) for b in range(256) if bytes([b]).split()]
    bits = context_mixing.code_lengths(context_mixing.stream(*context_mixing.encode([[], *[[w] for w in letters]], book.words), book), book, model)
    assert 0 < (2.0**-bits).sum() < 1


def test_budget(spark, odd, none):
    rows = budget.mix_sources(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in rows)
    assert budget.mix_sources(none).collect() == []


def test_subset_sums_are_nearest():
    draw = random.Random(4)
    for _ in range(200):
        lengths = np.array(sorted(draw.sample(range(1, 40), draw.randint(1, 5))))
        counts = np.array([draw.randint(1, 3) for _ in lengths])
        goal = draw.randint(0, int((lengths * counts).sum()))
        taken = budget.fit_lengths(lengths, counts, goal)
        sums = {0}
        for length, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        assert (taken <= counts).all() and abs(int((lengths * taken).sum()) - goal) == min(abs(s - goal) for s in sums)


def test_golay(spark, odd, none):
    rows = {(r.doc_id, r.component_id) for r in golay.near_duplicates(odd).collect()}
    assert {(0, 0), (1, 0), (2, 0), (5, 5), (6, 5), (None, None)} <= rows
    assert golay.near_duplicates(none).collect() == []


def test_golay_words_within_two_errors_share_a_codeword():
    table = golay.error_patterns()
    assert ((table >= 0).sum(axis=1).min(), (table >= 0).sum()) == (1, 10_903)
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << 23, 2000)
    own = golay.codeword_indices(words, table)
    flips = [0] + [1 << a for a in range(23)] + [1 << a | 1 << b for a in range(23) for b in range(a)]
    for flip in flips:
        other = golay.codeword_indices(words ^ flip, table)
        assert ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_golay_crowded_keys(spark):
    """More fingerprints under one key than are paired directly."""
    base = 0x0123456789ABCDE
    prints = {base ^ 1 << a ^ 1 << b for a in range(43, 64) for b in range(22, 43)} | {base}
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    got = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in golay.linked(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    ordered = sorted(prints)
    assert got == {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 2}


def test_chat_parts(spark):
    turns = spark.createDataFrame(
        [
            (1, 1, "assistant", [("text", "see \\ <|end|>\n", None, None), ("image", None, "i.png", 3), ("unknown", "?", None, 1)], "x"),
            (1, 0, "user", [("audio", None, "a.wav", 2), ("text", "<|image|>", None, None), ("document", None, "d.pdf", None)], "x"),
            (2, None, None, None, "x"),
            (None, 0, "a\nb", [(None, "x", None, None)], "x"),
        ],
        f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string",
    )
    rows = {r.conv_id: r for r in chat.format_conversations(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("segments"))).collect()}
    assert [(a.kind, a.ref, a.tokens) for a in rows[1].attachments] == [("audio", "a.wav", 50), ("document", "d.pdf", 0), ("image", "i.png", 768)]
    assert rows[1].attachment_tokens == 818
    assert [(t.role, t.text) for t in rows[1].turns] == [("user", "<|audio|><|image|><|document|>"), ("assistant", "see \\ <|end|>\n<|image|>")]
    assert rows[1].loss == "see \\ <|end|>\n<|image|>"
    assert [(t.role, t.text) for t in rows[2].turns] == [("", "")] and [(t.role, t.text) for t in rows[None].turns] == [("a\nb", "")]
    assert chat.format_conversations(turns.limit(0)).collect() == []


def test_reshard(spark, odd, none):
    rows = reshard.reshard(reshard.place(odd, 3), 4, 3).collect()
    assert len(rows) == odd.count() and {r.shard for r in rows} <= set(range(4))
    assert reshard.reshard(reshard.place(none, 3), 4, 3).collect() == []


def test_transfers_move_the_fewest_bytes():
    draw = random.Random(2)
    for _ in range(50):
        old = [draw.randint(0, 100) for _ in range(5)]
        new = reshard.even_capacities(sum(old), 7)
        flow = reshard.cheapest_transfers(old, new)
        assert [sum(a for (i, _), a in flow.items() if i == k) for k in range(5)] == old
        assert [sum(a for (_, j), a in flow.items() if j == k) for k in range(7)] == new
        assert sum(a for (i, j), a in flow.items() if i != j) == sum(old) - sum(map(min, zip(old, new)))


def test_rewrite_touches_only_what_changes(spark, tmp_path):
    rows = [(i, "x" * 99, s) for s, n in enumerate((4, 10, 2, 4)) for i in range(s * 100, s * 100 + n)]
    spark.createDataFrame(rows, "doc_id long, text string, old_shard int").write.partitionBy("old_shard").parquet(f"{tmp_path}/old")
    parts = {r.shard: r for r in reshard.rewrite(spark, f"{tmp_path}/old", f"{tmp_path}/new", 4, 4).collect()}
    counts = {s: spark.read.parquet(r.path).count() for s, r in parts.items()}
    assert sum(counts.values()) == 20 and max(counts.values()) - min(counts.values()) <= 1
    assert {s for s, r in parts.items() if r.rewritten} == {0, 1, 2, 3}


def test_packing(spark, odd, none):
    rows = packing.pack(packing.documents_to_pack(odd), 64).collect()
    assert sum(r.size for r in rows) == sum(len((r.text or "").encode().split()) for r in odd.collect())
    assert {r.doc_id for r in rows if r.bin_id is None} == {0, 1, 2}
    assert packing.pack(packing.documents_to_pack(none)).collect() == []


def test_tightest_bin_skips_conflicts():
    bins = packing.Bins(10)
    assert bins.put(7, 1, 1) == (0, 0) and bins.put(6, 2, 2) == (1, 0)
    assert bins.tightest(3, 4, 4) == 0  # the tightest
    assert bins.tightest(3, 1, 4) == 1  # its source is taken there: the successor
    assert bins.tightest(3, 1, 2) is None and bins.tightest(5, 4, 4) is None


def test_tokens(spark, odd, none):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in token_counts.count_tokens(odd, MODEL).collect():
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(model.encode(texts[r.doc_id])))
    assert token_counts.count_tokens(none, MODEL).collect() == []


def test_tokens_of_random_texts():
    model, counts = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.ChunkCounts(token_counts.load_ranks(MODEL), 50)
    draw = random.Random(5)
    for _ in range(2000):
        text = "".join(draw.choice("abet  \n\t▁éß漢<s>/😀\0.0") for _ in range(draw.randint(0, 40)))
        assert counts.of(text) == len(model.encode(text)), text


def plain_groups(texts):
    """Group number of each text by SimHash of three-word shingles, two differing bits at most, against all pairs."""
    prints = []
    for text in texts:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        prints.append(sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)))
    group = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_pipeline_stages(spark, odd, none, tmp_path):
    """Each stage against its rule on its own input, with extra columns of clashing names and of a type without a hash."""
    folder = str(tmp_path)
    spark.createDataFrame([(3, 1, 1), (4, 1, 0)], LABELS).write.parquet(f"{folder}/labels.parquet")
    extra = {"k0": F.lit(1), "w0": F.lit("x"), "copies": F.lit(2), "row": F.col("doc_id"), "toxic_score": F.lit(0.1), "m": F.create_map(F.lit("a"), F.col("doc_id"))}
    for docs in (odd.withColumns(extra), none.withColumns(extra)):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            before, rows = at.collect(), stage(spark, at, folder).collect()
            if name == "packing":
                sizes = Counter((r.doc_id, len((r.text or "").split())) for r in before)
                packed = Counter()
                for r in rows:
                    packed[r.doc_id] += r.size
                assert {i: sum(n * k for (j, n), k in sizes.items() if j == i) for i, _ in sizes} == dict(packed)
                break
            content = lambda r: str(sorted(r.asDict().items()))
            held, kept = Counter(map(content, before)), Counter(map(content, rows))
            assert set(kept) <= set(held)
            if name == "toxicity":
                assert kept == Counter({c: n for c, n in held.items() if c in kept})  # copies go together
            if name == "simhash_dedup":
                groups = {}
                for r, g in zip(before, plain_groups([r.text for r in before])):
                    groups.setdefault(g, []).append(r)
                first = {g: min((r.doc_id is None, r.doc_id or 0) for r in own) for g, own in groups.items()}
                assert len(rows) == len(groups) and sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted(first.values())
            if name == "mix":
                assert all(0 < n <= 2 * held[c] for c, n in kept.items())
            at = spark.createDataFrame(rows, docs.schema)


def test_cap_filters_of_repeated_ids(spark):
    """Rows link by their vectors, however their ids repeat; against all pairs."""
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (9, [1.0, 0.0], 1), (9, [0.0, 1.0], 1), (3, [1.0, 0.01], 1), (3, [1.0, 0.01], 2)]
    found = Counter(tuple(r) for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert found == Counter({(5, 1, 5, True): 1, (9, 1, 5, False): 1, (5, 2, 3, False): 1, (9, 2, 3, False): 1, (3, 2, 3, True): 1, (3, 0, 3, True): 1})


@pytest.mark.parametrize("length", [16, 64, 300])
def test_cap_filters_in_other_dimensions(spark, length):
    draw = np.random.default_rng(length)
    points = np.concatenate([c + draw.standard_normal((12, length)) * s for c, s in zip(draw.standard_normal((30, length)), np.linspace(0.02, 0.2, 30))])
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.98
    df = spark.createDataFrame([(i, p.tolist(), 0) for i, p in enumerate(points)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in cap_filters.near_duplicates(df).collect()} == {i: int(close[i].sum()) - 1 for i in range(len(points))}


def test_chat_parts_that_meet_forge_nothing(spark):
    text = lambda t: ("text", t, None, 0)
    image = ("image", "ignored", "ref", 2)
    contents = [
        [text("a <"), text("|end|>\n<"), text("|turn|>assistant<"), text("|says|>x")],
        [text("<"), image, text("|image|>"), text("<|image|>"), image],
        [text("\\"), text("!image!"), image, text("\\\\"), image, text("\\!image!"), text("\\|")],
        [None, text(None), ("video", "gone", None, 1), text("v" * 100_000)],
        [],
    ]
    turns = spark.createDataFrame([(i, k, "user", c) for i, c in enumerate(contents) for k in (0, 0)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    made = chat.format_conversations(turns)
    rows = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), "attachments", chat.read_parts(F.element_at("segments", 2)["text"]).alias("parts")).collect()
    for r in rows:
        expected = []
        for part in contents[r.conv_id]:
            if part and part[0] == "image":
                expected.append(["image", None])
            elif part and part[0] == "text" and part[1]:
                if expected and expected[-1][0] == "text":
                    expected[-1][1] += part[1]
                else:
                    expected.append(["text", part[1]])
        assert [list(p) for p in r.parts] == expected
        assert [t.role for t in r.turns] == ["user", "user"] and len(r.attachments) == 2 * sum(e[0] == "image" for e in expected)


def plain_best_fit(pieces, capacity):
    """(size, source, cluster) in order -> bin of each: the fullest compatible bin, of equals the one that has been so full longest."""
    bins, chosen = [], []
    for now, (size, source, cluster) in enumerate(pieces):
        fits = [(capacity - b["used"], b["since"], n) for n, b in enumerate(bins) if b["used"] + size <= capacity and source not in b["sources"] and cluster not in b["clusters"]]
        n = min(fits)[2] if fits else len(bins)
        if not fits:
            bins.append({"used": 0, "sources": set(), "clusters": set()})
        bins[n]["used"] += size
        bins[n]["since"] = now
        bins[n]["sources"].add(source)
        bins[n]["clusters"].add(cluster)
        chosen.append(n)
    return chosen


def test_packing_is_best_fit_whatever_the_partitions(spark):
    draw = random.Random(8)
    rows = [(draw.choice((None, i, 7)), draw.choice((None, "\0", "a", "b", "")), draw.randint(0, 25), draw.randint(0, 30)) for i in range(300)] + [(1, "a", 1, 9)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, source string, cluster long, size long")
    found = [Counter(tuple(r) for r in packing.pack(docs.repartition(n), 30).collect()) for n in (1, 7)]
    assert found[0] == found[1]
    assert Counter((r[4], r[3]) for r in found[0].elements()) == Counter((r[1], r[3]) for r in rows)
    pieces = sorted(found[0].elements(), key=lambda r: -r[3])
    lot = spark.createDataFrame([(i, s, c, n) for i, s, c, n in rows if n], "doc_id long, source string, cluster long, size long").toPandas()
    lot = lot.assign(spread=range(len(lot)), piece=0, source=lot["source"].map(lambda s: "" if s is None else "=" + s))
    packed = packing.pack_lot(lot, 30)
    assert packed["local"].tolist() == plain_best_fit(list(zip(packed["size"], packed["source"], packed["cluster"])), 30)
    assert len({r[6] for r in pieces if r[6] is not None}) <= 1.1 * packed["local"].nunique()


def test_context_mixing_walks_equal_symbols_once(monkeypatch):
    book = context_mixing.Codebook.build([(b"the", 9), (b"", 4), (b"cat", 2)], 5, np.arange(context_mixing.LETTERS))
    texts = [b"the cat the cat sat".split(), b"the the mat".split(), [], [b"sat"]] * 50
    s = context_mixing.stream(*context_mixing.encode(texts, book.words), book)
    walked, walk = [], context_mixing.steps
    monkeypatch.setattr(context_mixing, "steps", lambda b, symbols: walked.append(len(symbols)) or walk(b, symbols))
    for context in (s.c1, s.c2):
        found, plain = (np.zeros(2 << context_mixing.SLOTS, dtype=np.int32) for _ in range(2))
        keys = s.symbols.astype(np.uint64) << np.uint64(32) | context
        pairs = len(set(keys.tolist()))
        context_mixing.add_steps(found, keys, book)
        assert sum(walked) == pairs < len(s.symbols) / 10
        walked.clear()
        for symbol, c in zip(s.symbols, context):
            for x in book.path[book.offsets[symbol] : book.offsets[symbol + 1]]:
                plain[int(context_mixing.slots(np.array([c]), np.array([x >> 4]))[0]) << 1 | int(x & 1)] += 1
        assert np.array_equal(found, plain)
    # the counts of the nodes are those of the symbols that pass them
    met = np.bincount(s.symbols, minlength=book.escape + 1 + context_mixing.LETTERS)
    book.counts = met[: book.escape]
    nodes = np.concatenate([c for _, c in sorted(context_mixing.node_counts(book, met[book.escape], met[book.escape + 1 :]).items())])
    _, path = walk(book, s.symbols)
    assert np.array_equal(nodes, np.bincount((path >> 4 << 1 | path & 1).astype(np.int64), minlength=len(nodes)))


def test_context_mixing_words_are_those_of_bytes():
    texts = [None, "", "  ", " A\x0bb \x1c \u00c9 ", "z", "unmet zX", "\u2003\u00a0x"]
    words = pa.array([b"", b"a", b"zx"], pa.binary())
    ids, first, rare = context_mixing.numbered(*context_mixing.words_in(pa.array(texts)), words)
    own = [words_of(t.encode() if t else None) for t in texts]
    expected = [words.to_pylist().index(w) if w in words.to_pylist() else -1 for o in own for w in [*o, b""]]
    assert ids.tolist() == expected and np.diff(first).tolist() == [len(o) + 1 for o in own]
    assert rare.to_pylist() == [w for o in own for w in o if w not in words.to_pylist()]
