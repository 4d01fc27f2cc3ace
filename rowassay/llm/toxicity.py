"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives P; a sample of all training documents, whatever their label, is
the unlabelled set U. With the class prior p, the risk of a classifier f with loss l is

    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]),

the second term being the risk on negatives, estimated without any; where a step's estimate falls below
zero, the step goes the other way, which keeps the classifier from fitting U as if it were negative. The prior
is the share of toxic documents among the labelled training documents unless it is given.

Features are hashed words and hashed word beginnings of five bytes; a document's score is linear in their
counts over the square root of its number of words, so a few words decide in short texts only. Several numpy
classifiers are trained, each without one fold of the sample, and their weights are averaged. The fold left out
sets the classifier's threshold, again from positives, unlabelled documents and the prior alone: with the share r of positives and c of
unlabelled documents above it, the F1 of the toxic class is 2 p r / (c + p).

The fit reads at most about ``positives`` and ``unlabelled`` documents, chosen by a hash of id and text: ids meet labels first, and
only drawn documents' texts are read. The sample is one sparse matrix; as many folds train at once as ``memory`` bytes hold
copies of it. Scoring reads every whole text. The weights have a fixed size (2^18 numbers), which bounds what is broadcast.

Defined cases: NULL, empty and word-less texts get the score of the intercept; documents with a NULL or
no label are unlabelled; NULL ids and repeated rows are scored each; of several labels of an id the largest counts; without any
positive in training all scores are nearly 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowassay.llm.common import as_bytes, sliced
from rowassay.session import settle

DIMS = 1 << 18
HEADS = (4, 5, 6, 7)  # bytes of a word's beginnings
PER_WORD = 1 + len(HEADS)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
# letters and digits of ASCII, lower-cased, and all other UTF-8 bytes make words; the rest parts them
LETTERS = np.zeros(256, dtype=np.uint8)
LETTERS[48:58] = np.arange(48, 58)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, PER_WORD) features, the whole word's first, and each text's first word (and the end of the last)."""
    data = LETTERS[np.frombuffer(b" ".join([*texts, b" "]), dtype=np.uint8)]
    part = data > 0
    edge = np.diff(part.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # sums of scrambled (byte, place in word) pairs; each word is one slice of a running sum
    length = ends - starts
    owner = np.repeat(np.arange(len(starts)), length)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
    value = (data[part].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(8)) + np.uint64(1)) * FACTOR
    value = (value ^ value >> np.uint64(29)) * FACTOR
    value ^= value >> np.uint64(32)
    running = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    first = np.cumsum(length) - length
    shift = np.uint64(64 - 18)
    features = np.empty((len(starts), PER_WORD), dtype=np.int32)
    for k, head in enumerate((1 << 30, *HEADS)):
        features[:, k] = ((running[first + np.minimum(length, head)] - running[first]) ^ np.uint64(k * 0x5BD1E995)) * FACTOR >> shift
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return features, np.searchsorted(starts, borders)


def linear_scores(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    features, first = hashed_words(texts)
    running = np.concatenate([[0.0], np.cumsum(weights[features].sum(axis=1), dtype=np.float64)])
    n = np.diff(first)
    return bias + (running[first[1:]] - running[first[:-1]]) / np.sqrt(np.maximum(n, 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Bags:
    """Documents as bags of features: one sparse matrix by rows, with each document's scale."""

    first: np.ndarray  # of each document, and the end
    feature: np.ndarray
    count: np.ndarray
    norm: np.ndarray  # 1 / square root of the number of words

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Bags:
        """From features with repeats, ``PER_WORD`` for each word."""
        parts = [np.unique(d, return_counts=True) for d in docs]
        first = np.cumsum([0, *(len(f) for f, _ in parts)])
        empty = np.empty(0, np.int64)
        n_words = np.array([len(d) for d in docs]) / PER_WORD
        return cls(first, np.concatenate([empty, *(f for f, _ in parts)]), np.concatenate([empty, *(c for _, c in parts)]), 1 / np.sqrt(np.maximum(n_words, 1)))

    def __len__(self) -> int:
        return len(self.norm)

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries of ``rows`` lie, and the number of the row (in ``rows``) of each."""
        n = self.first[rows + 1] - self.first[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        return np.arange(len(owner)) + np.repeat(self.first[rows] - (np.cumsum(n) - n), n), owner

    def scores(self, rows: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
        at, owner = self.places(rows)
        return bias + np.bincount(owner, weights[self.feature[at]] * self.count[at], len(rows)) * self.norm[rows]


def train(positive: Bags | list[np.ndarray], unlabelled: Bags | list[np.ndarray], prior: float, seed: int, epochs: int = 20, batches: int = 16, rate: float = 0.5, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of one classifier. Documents are bags, or lists of features with repeats."""
    positive, unlabelled = (docs if isinstance(docs, Bags) else Bags.of(docs) for docs in (positive, unlabelled))
    return train_rows(positive, np.arange(len(positive)), unlabelled, np.arange(len(unlabelled)), prior, seed, epochs, batches, rate, penalty)


def train_rows(p_bags: Bags, p_all: np.ndarray, u_bags: Bags, u_all: np.ndarray, prior: float, seed: int, epochs: int = 20, batches: int = 16, rate: float = 0.5, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """``train`` on the rows ``p_all`` and ``u_all`` of two matrices, which may be one."""
    draw = np.random.default_rng(seed)
    weights, bias, seen, seen_bias = np.zeros(DIMS), float(np.log(prior / (1 - prior))), np.full(DIMS, 1e-8), 1e-8
    # features of most unlabelled documents say little: they are scaled down by their document frequency
    frequency = np.zeros(DIMS)
    for rows in np.array_split(u_all, batches):
        frequency += np.bincount(u_bags.feature[u_bags.places(rows)[0]], minlength=DIMS)
    scale = np.log((len(u_all) + 1) / (frequency + 1)) / np.log(len(u_all) + 2)

    for _ in range(epochs):
        for p_rows, u_rows in zip(np.array_split(draw.permutation(p_all), batches), np.array_split(draw.permutation(u_all), batches)):
            if not len(p_rows) or not len(u_rows):
                continue
            scaled = scale * weights
            fp, fu = p_bags.scores(p_rows, scaled, bias), u_bags.scores(u_rows, scaled, bias)
            # logistic loss: l(f) = log(1 + exp(-f)), with derivative sigmoid(f) - 1; l(-f) has sigmoid(f)
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            gu, gp_negative = sigmoid(fu) / len(fu), -prior * sigmoid(fp) / len(fp)
            if negative >= 0:
                gp = prior * (sigmoid(fp) - 1) / len(fp) + gp_negative
            else:
                gu, gp = -gu, -gp_negative
            gradient = penalty * weights
            for bags, rows, g in ((p_bags, p_rows, gp), (u_bags, u_rows, gu)):
                at, owner = bags.places(rows)
                gradient += scale * np.bincount(bags.feature[at], (g * bags.norm[rows])[owner] * bags.count[at], DIMS)
            slope = gp.sum() + gu.sum()
            seen += gradient**2
            seen_bias += slope**2
            weights -= rate * gradient / np.sqrt(seen)
            bias -= rate * 0.1 * slope / np.sqrt(seen_bias)
    return scale * weights, bias


def best_threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The score from which on calling documents toxic gives the largest F1, midway to the next lower one; no negatives are needed."""
    levels = np.unique(np.concatenate([positive, unlabelled]))
    caught, called = (1 - np.searchsorted(np.sort(own), levels, side="left") / len(own) for own in (positive, unlabelled))
    at = int((prior * caught / (called + prior)).argmax())
    return float((levels[at] + levels[max(at - 1, 0)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = 4_000, unlabelled: int = 8_000, folds: int = 4, at_threshold: float = 0.7, seed: int = 3, memory: int = 192 << 20) -> tuple[np.ndarray, float]:
    """Weights and intercept from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Each of ``folds`` classifiers leaves out one fold of the sample, which sets its threshold. The means of weights and
    thresholds make the model, shifted to score ``at_threshold`` there. A task trains one or more folds, one after the other.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("k")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # a row may serve as a positive, as an unlabelled document, or as both; rows of equal id and text share one draw and
    # count once in the sample, so neither the order of rows nor their partitions decide what is drawn
    drawn = F.xxhash64(F.lit(seed), "doc_id", "text")
    known = docs.select("doc_id", drawn.alias("drawn")).join(marks, F.col("doc_id") == F.col("k"), "left").select("drawn", "toxic")
    known = settle(known, "toxicity-draws")
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # three rows
    toxic, labelled, total = counts.get(1, 0), counts.get(1, 0) + counts.get(0, 0), sum(counts.values())
    if not toxic:
        return np.zeros(DIMS), -np.inf
    prior = min(0.9, toxic / labelled) if prior is None else prior
    chance = F.pmod(F.col("drawn"), F.lit(1 << 30)) / float(1 << 30)
    p_rate, u_rate = min(1.0, positives / toxic), min(1.0, unlabelled / total)
    is_positive, is_unlabelled = (F.coalesce(F.col("toxic") == 1, F.lit(False)) & (chance < p_rate)), 1 - chance <= u_rate
    fold = F.pmod(F.shiftright("drawn", 32), F.lit(folds)).cast("int")
    chosen = known.filter(is_positive | is_unlabelled).select("drawn", fold.alias("fold"), is_positive.alias("positive"), is_unlabelled.alias("unlabelled")).dropDuplicates(["drawn"])
    # the chosen hashes are as many as the sample has documents; the texts come from a scan that drops the others
    wanted = F.broadcast(chosen.withColumnRenamed("drawn", "wanted"))
    sample = docs.select("text", drawn.alias("drawn")).join(wanted, F.col("drawn") == F.col("wanted")).dropDuplicates(["drawn"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found, first = hashed_words([t or b"" for t in as_bytes(batch.column("text"))])
            bags = Bags.of([found[a:b].ravel() for a, b in zip(first[:-1], first[1:])])
            offsets = pa.array(bags.first, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (bags.feature, bags.count)]
            yield pa.record_batch([*map(batch.column, ("drawn", "fold", "positive", "unlabelled")), *lists, pa.array(bags.norm)], names=["drawn", "fold", "positive", "unlabelled", "feature", "count", "norm"])

    def train_folds(rows: pa.Table) -> pa.Table:
        def whole(name: str) -> np.ndarray:
            return np.concatenate([c.flatten().to_numpy() for c in rows.column(name).chunks])

        first = np.cumsum([0, *(n for c in rows.column("feature").chunks for n in c.value_lengths().to_pylist())])
        bags = Bags(first, whole("feature"), whole("count"), rows.column("norm").to_numpy())
        order = np.argsort(rows.column("drawn").to_numpy())  # the same however the rows arrive
        fold, positive, unlabelled = (rows.column(c).to_numpy()[order] for c in ("fold", "positive", "unlabelled"))
        made = []
        for number in range(rows.column("task")[0].as_py(), folds, tasks):
            inside = fold != number
            weights, bias = train_rows(bags, order[inside & positive], bags, order[inside & unlabelled], prior, seed + number)
            p_out, u_out = order[~inside & positive], order[~inside & unlabelled]
            level = best_threshold(bags.scores(p_out, weights, bias), bags.scores(u_out, weights, bias), prior) if len(p_out) and len(u_out) else None
            made.append((number, weights.astype(np.float32).tobytes(), bias, level))
        columns = list(zip(*made))
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("number", "weights", "bias", "threshold"), columns, (pa.int32(), pa.binary(), pa.float64(), pa.float64()))})

    held = settle(sample.mapInArrow(features, "drawn long, fold int, positive boolean, unlabelled boolean, feature array<int>, count array<int>, norm double"), "toxicity-sample")
    size = held.agg(F.coalesce(F.sum(F.size("feature")), F.lit(0))).first()[0] * 8
    tasks = int(max(1, min(folds, memory // max(1, size))))
    dealt = held.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    models = dealt.groupBy("task").applyInArrow(train_folds, "number int, weights binary, bias double, threshold double").collect()  # ``folds`` rows of a fixed size
    models.sort(key=lambda m: m.number)
    weights = np.mean([np.frombuffer(m.weights, dtype=np.float32) for m in models], axis=0)
    bias, thresholds = float(np.mean([m.bias for m in models])), [m.threshold for m in models if m.threshold is not None]
    level = float(np.mean(thresholds)) if thresholds else 0.0
    return weights, bias - level + float(np.log(at_threshold / (1 - at_threshold)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` (text, ...) and its score; higher is likelier toxic."""
    weights = docs.sparkSession.sparkContext.broadcast(model[0].astype(np.float32))
    bias = model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            texts = [t or b"" for t in as_bytes(batch.column("text"))]
            scores = pa.array(sigmoid(linear_scores(texts, weights.value, bias)))
            yield pa.record_batch([*map(batch.column, keep), scores], names=[*keep, name])

    schema = docs.select(*keep).schema.add(name, "double")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls into the fold that is kept from training; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
