"""Quality by histogram gradient-boosted trees over document statistics.

A document becomes ``STATISTICS`` numbers: sizes, shares of kinds of bytes and words, entropies, repetition of words, runs
of three words and lines. No word itself, and neither language, source nor id, is among them. Trees of a fixed depth are
boosted on the logistic loss: statistics are cut into at most ``BINS`` bins by quantiles, a level's splits are chosen
from histograms of gradients and second derivatives by node, statistic and bin, and leaves are Newton steps. Trees are complete binary trees,
flattened into arrays of split statistics, split values and leaves; a batch of documents walks all trees at once in numpy, one step for each level.

The fit reads a bounded sample of labelled documents (``limit``), chosen by a hash of id and text: ids meet labels first, and only
drawn rows' texts are read. One model is trained without each fold of the sample, in tasks of their own; the fold left out
sets the model's threshold (best mean of both classes' F1), and scores are averaged. Scores are shifted so that the threshold lies at ``at_threshold``.
Scoring reads every whole text.

Defined cases: NULL, empty and blank texts have statistics 0 and the score of those; documents without a label, or with a NULL one,
teach nothing; of several labels of an id the largest counts; rows equal in id and text count once in the fit and are scored each; with labels of one class
only, every score is that class's side of ``at_threshold`` (without any: ``at_threshold``); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowassay.llm.common import as_bytes, sliced
from rowassay.session import settle

STATISTICS = (
    "bytes", "words", "word_bytes", "word_spread", "upper", "lower", "digits", "beyond_ascii", "blanks", "lines", "stops", "commas", "other_marks", "bars",
    "byte_entropy", "top_mark", "distinct_words", "top_word", "word_entropy", "once", "triples", "twins", "short_words", "long_words", "marked_words",
    "doubled_marks", "bare_words", "capital_words", "upper_words", "distinct_lines", "line_words", "stop_words",
)
BINS = 64
DEPTH = 4
INNER = (1 << DEPTH) - 1
TREES = 160
RATE = 0.1
SMOOTH = 1.0  # added to second derivatives
LEAST_WEIGHT = 2.0  # sum of second derivatives on either side of a split


def _kinds() -> np.ndarray:
    """[byte, kind] of the bytes that are counted: upper, lower, digits, beyond ASCII, blanks, line ends, stops, commas, other marks, bars."""
    out = np.zeros((256, 10))
    for b in range(256):
        c = chr(b)
        kind = 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if c.isdigit() and b < 128 else 3 if b >= 128 else 5 if c == "\n" else 4 if c.isspace() or b < 32 else 6 if c in ".!?" else 7 if c in ",;:" else 9 if c == "|" else 8
        out[b, kind] = 1
    return out


KINDS = _kinds()
MARKS = np.flatnonzero(KINDS[:, 6:].sum(axis=1))
LETTER = bytes(1 if KINDS[b, :4].any() else 0 for b in range(256))  # for translate: letters and digits against marks


def _entropy(counts: np.ndarray) -> float:
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def statistics(text: bytes) -> np.ndarray:
    """The ``STATISTICS`` of one text; all 0 without a word."""
    out = np.zeros(len(STATISTICS))
    words = text.split()
    if not words:
        return out
    n, size = len(words), len(text)
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    out[:4] = np.log1p(size), np.log1p(n), lengths.mean(), lengths.std()
    out[4:14] = seen @ KINDS / size
    out[14:16] = _entropy(seen[seen > 0]), seen[MARKS].max() / n
    counts = Counter(words)
    of_word = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    out[16:20] = len(counts) / n, of_word.max() / n, _entropy(of_word), (of_word == 1).sum() / n
    out[20] = len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2)
    out[21] = sum(map(bytes.__eq__, words, words[1:])) / n
    out[22:24] = (lengths <= 3).mean(), (lengths > 16).mean()
    marked = doubled = bare = capital = upper = 0
    for word, c in counts.items():
        shape = word.translate(LETTER)
        if 0 in shape:
            marked += c
            doubled += c * (b"\0\0" in shape)
            bare += c * (1 not in shape)
        if word[:1].isupper():
            capital += c
            upper += c * (len(word) > 1 and word.isupper())
    out[24:29] = marked / n, doubled / n, bare / n, capital / n, upper / n
    lines = text.split(b"\n")
    out[29:32] = len(set(lines)) / len(lines), np.log1p(n / len(lines)), np.log1p(n / (1 + seen[MARKS].sum()))
    return out


def statistics_of(texts: list[bytes]) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if texts else np.zeros((0, len(STATISTICS)))


@dataclass
class Trees:
    """Complete binary trees: the children of node i are 2i + 1 (value up to the cut) and 2i + 2."""

    split: np.ndarray  # [tree, inner node], statistic
    cut: np.ndarray  # [tree, inner node]
    leaf: np.ndarray  # [tree, leaf]
    bias: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of ``rows`` (documents, statistics): all documents and trees go down together."""
        tree = np.arange(len(self.split))
        document = np.arange(len(rows))[:, None]
        node = np.zeros((len(rows), len(tree)), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (rows[document, self.split[tree, node]] > self.cut[tree, node])
        return self.bias + self.leaf[tree, node - INNER].sum(axis=1)


def bin_edges(rows: np.ndarray) -> list[np.ndarray]:
    """Inner edges of each statistic's bins: a value is in the bin of as many edges as lie below it."""
    inner = np.linspace(0, 1, BINS + 1)[1:-1]
    return [np.unique(np.quantile(column, inner, method="lower")) for column in rows.T]


def boost(rows: np.ndarray, label: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Trees for ``rows`` (documents, statistics) and ``label`` (0 or 1, both present)."""
    n, width = rows.shape
    edges = bin_edges(rows)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T)], axis=1)
    cell = binned + np.arange(width) * BINS
    share = np.clip(label.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    odds = np.full(n, bias)
    split, cut, leaf = np.zeros((trees, INNER), dtype=np.int64), np.full((trees, INNER), np.inf), np.zeros((trees, INNER + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, curve = p - label, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for depth in range(DEPTH):
            first, many = (1 << depth) - 1, 1 << depth
            place = ((node - first)[:, None] * (width * BINS) + cell).ravel()
            g, h = (np.bincount(place, np.repeat(x, width), many * width * BINS).reshape(many, width, BINS) for x in (gradient, curve))
            g, h = g.cumsum(axis=2), h.cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + SMOOTH) + (g_all - g) ** 2 / (h_all - h + SMOOTH) - g_all**2 / (h_all + SMOOTH)
            gain[(h < LEAST_WEIGHT) | (h_all - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(many, -1)[np.arange(many), best] > 1e-9):
                column, at = divmod(int(best[k]), BINS)
                if at < len(edges[column]):
                    split[t, first + k], cut[t, first + k] = column, edges[column][at]
            node = 2 * node + 1 + (rows[np.arange(n), split[t, node]] > cut[t, node])
        end = node - INNER
        g, h = np.bincount(end, gradient, INNER + 1), np.bincount(end, curve, INNER + 1)
        leaf[t] = -rate * g / (h + SMOOTH)
        odds += leaf[t, end]
    return Trees(split, cut, leaf, bias)


def best_threshold(odds: np.ndarray, label: np.ndarray) -> float:
    """The log odds from which on documents are called 1, for the largest mean of both classes' F1; midway to the next lower one."""
    order = np.argsort(-odds, kind="stable")
    ranked = odds[order]
    hits, called = np.cumsum(label[order]), np.arange(1, len(label) + 1)
    ones, all_ = label.sum(), len(label)
    f1 = 2 * hits / (called + ones)
    misses = all_ - called - (ones - hits)  # zeros called 0
    f0 = 2 * misses / np.maximum(1, (all_ - called) + (all_ - ones))
    score = f1 + f0
    score[:-1][ranked[:-1] == ranked[1:]] = -1  # equal odds are called alike
    at = int(score.argmax())
    return float((ranked[at] + ranked[min(at + 1, all_ - 1)]) / 2)


@dataclass
class Model:
    """Flattened trees of several fits; scores are the mean of their log odds over each one's threshold."""

    trees: list[Trees]
    thresholds: list[float]
    constant: float | None = None

    def score(self, rows: np.ndarray, at_threshold: float) -> np.ndarray:
        shift = np.log(at_threshold / (1 - at_threshold))
        if self.constant is not None:
            odds = np.full(len(rows), self.constant)
        else:
            odds = np.mean([t.raw(rows) - level for t, level in zip(self.trees, self.thresholds)], axis=0)
        return 1 / (1 + np.exp(-(odds + shift)))


def drawn_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, folds: int, seed: int) -> DataFrame:
    """(drawn, fold, label, text) of about ``limit`` labelled rows of ``docs`` at most.

    Only ids and hashes are shuffled; the drawn hashes, bounded by ``limit``, are broadcast to a scan that reads the texts.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("k")).agg((F.max(label) > 0).cast("int").alias("label"))
    drawn = F.xxhash64(F.lit(seed), "doc_id", "text")
    known = settle(docs.select("doc_id", drawn.alias("drawn")).join(marks, F.col("doc_id") == F.col("k")).select("drawn", "label").dropDuplicates(["drawn"]), "quality-labelled")
    rate = min(1.0, limit / max(1, known.count()))
    wanted = known.filter(F.pmod(F.col("drawn"), F.lit(1 << 30)) < rate * (1 << 30)).withColumnRenamed("drawn", "wanted")
    rows = docs.select("text", drawn.alias("drawn")).join(F.broadcast(wanted), F.col("drawn") == F.col("wanted")).dropDuplicates(["drawn"])
    return rows.select("drawn", F.pmod(F.shiftright("drawn", 32), F.lit(folds)).cast("int").alias("fold"), "label", "text")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = 16_000, folds: int = 4, seed: int = 5) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, ``label``), read from about ``limit`` labelled rows at most."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = statistics_of([t or b"" for t in as_bytes(batch.column("text"))])
            offsets = np.arange(len(found) + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.record_batch([*map(batch.column, ("drawn", "fold", "label")), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))], names=["drawn", "fold", "label", "x"])

    def train_fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("drawn")  # the same order however the rows arrive
        number = rows.column("without")[0].as_py()
        x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
        y, inside = rows.column("label").to_numpy().astype(float), rows.column("fold").to_numpy() != number
        if not (0 < y[inside].sum() < inside.sum()) or not (0 < y[~inside].sum() < (~inside).sum()):
            inside = np.ones(len(y), dtype=bool)  # too few labels to leave some out
        trees = boost(x[inside], y[inside])
        held = ~inside if not inside.all() else inside
        level = best_threshold(trees.raw(x[held]), y[held])
        return pa.table({"number": pa.array([number], pa.int32()), "split": [trees.split.astype("<i8").tobytes()], "cut": [trees.cut.astype("<f8").tobytes()], "leaf": [trees.leaf.astype("<f8").tobytes()], "bias": [trees.bias], "level": [level]})

    sample = drawn_sample(docs, labels, label, limit, folds, seed).mapInArrow(features, "drawn long, fold int, label int, x array<double>")
    sample = settle(sample, "quality-sample")
    classes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(classes) < 2:
        return Model([], [], {(): 0.0, (0,): -3.0, (1,): 3.0}[tuple(classes)])
    dealt = sample.withColumn("without", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))  # a short row for each document
    found = dealt.groupBy("without").applyInArrow(train_fold, "number int, split binary, cut binary, leaf binary, bias double, level double").collect()  # ``folds`` rows of a fixed size
    found.sort(key=lambda r: r.number)
    trees = [Trees(np.frombuffer(r.split, "<i8").reshape(-1, INNER), np.frombuffer(r.cut, "<f8").reshape(-1, INNER), np.frombuffer(r.leaf, "<f8").reshape(-1, INNER + 1), r.bias) for r in found]
    return Model(trees, [r.level for r in found])


def score(docs: DataFrame, model: Model, at_threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` (text, ...) and its score; higher is likelier of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            scores = shared.value.score(statistics_of([t or b"" for t in as_bytes(batch.column("text"))]), at_threshold)
            yield pa.record_batch([*map(batch.column, keep), pa.array(scores)], names=[*keep, name])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, docs.select(*keep).schema.add(name, "double"))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls into the fold kept from training; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
