"""Language-model scores by online logistic context mixing.

A text is coded as its lower-cased words and one end. A word among the most frequent ones is a path in a
binary (Huffman) tree; any other word is an escape followed by its bytes and a word end, paths in a second tree. Each
step of a path is one bit, predicted by three hashed-context predictors: the tree node alone; the node with
the class of the word before; the node with the last very frequent word before (inside a spelled word: the
two letters before, and the four letters before). A class is the word itself for frequent words, else a hash of its last
two bytes.

The predictors are counts of ones and zeros in hashed slots, gathered from every training document. Their
logits are combined by weights that a gate selects (depth in the tree, which contexts were seen, word or letter),
and an adaptive map (also by gate) refines the mixed probability. Weights and map start the same for
every document and are updated along it, block by block, each block being coded with what the blocks before it
taught; so a score depends on the trained counts and the document alone. Total bits over the bytes of the text are the bits per
byte; the score is minus the bits times log10(2).

What is broadcast has a fixed size: the frequent words and ``2^22`` slots for each context. Counts of all other words
stay in a table and are joined.

Defined cases: NULL, empty and blank texts are one end token; repeated rows and NULL ids are documents of their own; without any training document all
counts are 0 and every bit costs about one bit; an empty table gives no rows; any bytes can be coded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowassay.llm.common import sliced
from rowassay.session import settle

FREQUENT = 1 << 18  # words with a path of their own, at most
LEAST = 2  # count of a word with a path of its own, at least: rarer ones teach the escape and the letters
SLOTS = 22  # bits of a slot number
CLASSES = 1024  # most frequent words that are a class of their own
ENDINGS = 256
TOPICS = 64  # most frequent words that are remembered until the next of them
START = CLASSES + ENDINGS  # class of what comes before the first word
LETTERS = 257  # bytes and the end of a word
CHUNK = 1 << 14  # slots in one row of counts
SALTS = 8
COUNTED = 1 << 20  # symbols that wait until they are counted together
EXPANDED = 1 << 15  # different symbols in context whose paths are walked together
BLOCK = 128  # symbols coded before weights change
LANES = 160  # documents coded side by side
LEVELS = 8  # depths told apart by the gate
GATES = 64
STEP = np.float32(1 / 15)  # of a stored logit
MAP = 33  # cells of the adaptive map, for logits from -8 to 8
RATE, MAP_RATE = 0.004, 0.02
# starting weights of the three predictors by what was seen: neither context, the first, the second, both
FIRST_WEIGHTS = np.array([[1.0, 0.0, 0.0], [0.25, 0.8, 0.0], [0.3, 0.0, 0.75], [0.1, 0.4, 0.55]], dtype=np.float32)
MIX1, MIX2, MIX3, MIX4 = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0x2C1B3C6D, 0xC2B2AE3D))


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pieces between ASCII white space of lower-cased ``texts``, whether each is a word (not empty), and the first piece of each text (and the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    return lists.values.cast(pa.binary()), pc.binary_length(lists.values).to_numpy() > 0, lists.offsets.to_numpy()


def word_counts(docs: DataFrame, limit: int = 300_000) -> DataFrame:
    """(word, c) over all ``docs`` (text); the empty word stands for the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> Iterator[pa.RecordBatch]:
            summed = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            held.clear()
            yield from summed.select(["word", "c_sum"]).rename_columns(["word", "c"]).to_batches()

        for batch in sliced(batches, "text"):
            pieces, is_word, _ = words_in(batch.column("text"))
            found = pieces.filter(pa.array(is_word)).value_counts()
            held.append(pa.table([found.field("values"), found.field("counts")], names=["word", "c"]))
            held.append(pa.table([pa.array([b""], pa.binary()), pa.array([batch.num_rows], pa.int64())], names=["word", "c"]))
            if sum(t.num_rows for t in held) > limit * 2:
                yield from out()
        if held:
            yield from out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, nodes and bits of the path of each symbol; nodes are numbered from the root."""
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    up, bit = [0] * (2 * n - 1), bytearray(2 * n - 1)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i] = up[j] = node
        bit[j] = 1
        heapq.heappush(heap, (a + b, node))
    root, paths = 2 * n - 2, []
    for i in range(n):
        path, node = [], i
        while node != root:
            path.append((root - up[node]) << 1 | bit[node])
            node = up[node]
        paths.append(path[::-1])
    flat = np.fromiter((x for path in paths for x in path), dtype=np.int64)
    return np.cumsum([0, *map(len, paths)]), flat >> 1, (flat & 1).astype(np.uint8)


@dataclass
class Codebook:
    """Paths of all symbols: frequent words by falling count, the escape, then the letters."""

    words: dict[bytes, int]
    counts: np.ndarray  # of the frequent words
    classes: np.ndarray
    escape: int
    offsets: np.ndarray
    path: np.ndarray  # node << 4 | level << 1 | bit of each step
    n_nodes: int

    @classmethod
    def build(cls, frequent: list[tuple[bytes, int]], rare: int, letters: np.ndarray) -> Codebook:
        words = [w for w, _ in frequent]
        n = len(words)
        offsets, nodes, bits = huffman([c for _, c in frequent] + [rare + 1])
        more, letter_nodes, letter_bits = huffman((letters + 1).tolist())
        endings = np.array([ending(w) for w in words], dtype=np.int64)
        classes = np.where(np.arange(n) < CLASSES, np.arange(n), endings)
        offsets = np.concatenate([offsets, offsets[-1] + more[1:]])
        depth = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
        path = np.concatenate([nodes, letter_nodes + n]) << 4 | np.minimum(depth, LEVELS - 1) << 1 | np.concatenate([bits, letter_bits])
        return cls(dict(zip(words, range(n))), np.array([c for _, c in frequent], dtype=np.int64), classes, n, offsets, path.astype(np.uint32), n + LETTERS - 1)


def ending_number(last_two):
    """Class of a word by its last two bytes, read as a number."""
    return CLASSES + (last_two * 40503 >> 6) % ENDINGS


def ending(word: bytes) -> int:
    return ending_number(int.from_bytes(word[-2:], "little"))


@dataclass
class Stream:
    """Symbols of some documents one after another, with the multiplied contexts of each symbol."""

    symbols: np.ndarray
    first: np.ndarray  # of each document, and the end
    c1: np.ndarray
    c2: np.ndarray


def numbered(pieces: pa.Array, is_word: np.ndarray, piece_first: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number in ``words`` of each token (-1: a rare word), first token of each text (and the end), and the rare words in order."""
    found = pc.fill_null(pc.index_in(pieces, value_set=words), -1).to_numpy()
    rare = pieces.filter(pa.array(is_word & (found < 0)))
    first = np.concatenate([[0], np.cumsum(is_word)])[piece_first] + np.arange(len(piece_first))  # each text has its end
    ids = np.empty(first[-1], dtype=np.int32)
    inner = np.ones(len(ids), dtype=bool)
    inner[first[1:] - 1] = False
    ids[inner] = found[is_word]
    ids[~inner] = pc.index(words, b"").as_py()
    return ids, first, rare


def encode(texts: list[list[bytes]], words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``numbered`` for texts that are words already."""
    lists = pa.array(texts, pa.list_(pa.binary()))
    return numbered(lists.values, np.ones(len(lists.values), dtype=bool), lists.offsets.to_numpy(), pa.array(list(words), pa.binary()))


def stream(ids: np.ndarray, token_first: np.ndarray, rare: pa.Array, book: Codebook) -> Stream:
    """From the output of ``encode``."""
    at_rare = np.flatnonzero(ids < 0)
    if len(rare):
        ends = np.frombuffer(rare.buffers()[1], dtype=np.int32)[rare.offset : rare.offset + len(rare) + 1]
        data = np.frombuffer(rare.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
    else:
        ends, data = np.zeros(1, dtype=np.int32), np.zeros(0, dtype=np.uint8)
    n_rare = np.diff(ends).astype(np.int64) + 1  # letters and the word end
    sizes = np.ones(len(ids), dtype=np.int64)
    sizes[at_rare] += n_rare
    start = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    # classes of the words before; document starts see START
    own = book.classes.take(np.maximum(ids, 0))
    last_letter = data[ends[1:] - 1].astype(np.int64)
    own[at_rare] = ending_number(np.where(n_rare > 2, data[ends[1:] - 2] | last_letter << 8, last_letter))
    before = np.concatenate([[START], own[:-1]])
    before[token_first[:-1]] = START
    # the place of the last very frequent word before each token, if it lies in the same document
    places = np.where((ids >= 0) & (ids < TOPICS) & (ids != book.words[b""]), np.arange(len(ids)), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(places)[:-1]])
    topic = np.where(last >= np.repeat(token_first[:-1], np.diff(token_first)), ids.take(np.maximum(last, 0)), TOPICS)
    symbols = np.zeros(total, dtype=np.int64)
    c1, c2 = np.zeros(total, dtype=np.uint32), np.zeros(total, dtype=np.uint32)
    symbols[start] = np.where(ids >= 0, ids, book.escape)
    c1[start] = before.astype(np.uint32) * MIX1
    c2[start] = topic.astype(np.uint32) * MIX4 + np.uint32(1)
    if len(rare):
        spelled = np.ones(total, dtype=bool)
        spelled[start] = False
        place = np.flatnonzero(spelled)
        word_at = np.cumsum(n_rare) - n_rare
        letters = np.full(len(place), 256, dtype=np.uint32)
        inner = np.ones(len(place), dtype=bool)
        inner[word_at + n_rare - 1] = False
        letters[inner] = data
        back = []
        for k in (1, 2, 3, 4):
            # what a word's first letters look back to is no letter
            back.append(np.roll(letters if k == 1 else back[-1], 1))
            back[-1][word_at] = 256
        symbols[place] = letters.astype(np.int64) + (book.escape + 1)
        c1[place] = ((back[0] << 9 | back[1]) + np.uint32(START + 1)) * MIX1
        c2[place] = (back[0] << 27 ^ back[1] << 18 ^ back[2] << 9 ^ back[3]) * MIX4 + np.uint32(2)
    return Stream(symbols, np.concatenate([start, [total]])[token_first], c1, c2)


def steps(book: Codebook, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of path steps of each of ``symbols``, and the ``path`` of all of them."""
    begin = book.offsets.take(symbols)
    n = book.offsets.take(symbols + 1) - begin
    at = np.repeat(begin - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return n, book.path.take(at)


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slot numbers of path steps, by their multiplied contexts and nodes."""
    h = node * MIX2
    h += context
    h ^= h >> np.uint32(15)
    h *= MIX3
    h >>= np.uint32(32 - SLOTS)
    return h.astype(np.int64)


def encoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """What ``encode`` gave for the documents of a batch (ids, rare)."""
    ids, rare = batch.column("ids"), batch.column("rare")
    offsets = ids.offsets.to_numpy()
    return ids.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0], rare.flatten().cast(pa.binary())


def add_steps(total: np.ndarray, keys: np.ndarray, book: Codebook) -> None:
    """Add the path steps of ``keys`` (symbol << 32 | multiplied context; sorted in place) to the counts (zeros, ones) by slot.

    Equal symbols in equal contexts walk the same path through the same slots, so each of them is walked once, with its count.
    """
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(first, append=len(keys)).astype(total.dtype)
    keys = keys[first]
    for lo in range(0, len(keys), EXPANDED):
        cut = slice(lo, lo + EXPANDED)
        n, path = steps(book, (keys[cut] >> np.uint64(32)).astype(np.int64))
        at = slots(np.repeat(keys[cut].astype(np.uint32), n), path >> 4)
        at <<= 1
        at |= path & 1
        np.add.at(total, at, np.repeat(times[cut], n))


def node_counts(book: Codebook, rare: int, letters: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Counts (zeros, ones) of the tree nodes by (table 0, chunk): they follow from the counts of the symbols."""
    n = np.concatenate([book.counts, [rare], letters])
    size = -(-book.n_nodes // CHUNK) * CHUNK
    counts = np.zeros(2 * size, dtype=np.int64)
    np.add.at(counts, (book.path >> 4).astype(np.int64) << 1 | book.path & 1, np.repeat(n, np.diff(book.offsets)))
    return {(0, chunk): own for chunk, own in enumerate(counts.reshape(-1, 2 * CHUNK))}


def bit_counts(docs: DataFrame, book) -> dict[tuple[int, int], np.ndarray]:
    """Counts (zeros, ones) of encoded ``docs`` (ids, rare) by (table, chunk): tables 1 and 2 are the slots of the contexts."""

    def packed(table: int, chunk: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([[table], [chunk], [pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)]], schema=SCHEMA)

    def unpacked(data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(data, 16 * CHUNK, codec="zstd", asbytes=True), dtype="<i8")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = book.value
        held = [np.zeros(2 << SLOTS, dtype=np.int32) for _ in range(2)]
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def count() -> None:
            for total, parts in zip(held, zip(*waiting)):
                add_steps(total, np.concatenate(parts), b)
            waiting.clear()

        for batch in sliced(batches, "ids", 1 << 19):
            s = stream(*encoded(batch), b)
            symbols = s.symbols.astype(np.uint64) << np.uint64(32)
            waiting.append((symbols | s.c1, symbols | s.c2))
            if sum(len(w[0]) for w in waiting) > COUNTED:
                count()
        if waiting:
            count()
        for table, total in enumerate(held, 1):
            for chunk, counts in enumerate(total.reshape(-1, 2 * CHUNK)):
                if counts.any():
                    yield packed(table, chunk, counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # streams: at most one sum for each chunk is held
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for table, chunk, data in zip(*(batch.column(i) for i in range(3))):
                key = table.as_py(), chunk.as_py()
                counts = unpacked(data.as_py())
                sums[key] = sums[key] + counts if key in sums else counts
        for key, counts in sums.items():
            yield packed(*key, counts)

    SCHEMA = pa.schema([("table", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())])
    ddl = "table int, chunk int, counts binary"
    made = docs.select("ids", "rare").mapInArrow(gather, ddl).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    half = made.repartition("table", "chunk", "salt").select("table", "chunk", "counts").mapInArrow(add, ddl)
    whole = half.repartition("table", "chunk").mapInArrow(add, ddl)
    return {(r.table, r.chunk): unpacked(bytes(r.counts)) for r in whole.collect()}  # as many rows as chunks


@dataclass
class Model:
    """Logits of the three predictors in small whole steps; 0 where a context slot was never met."""

    nodes: np.ndarray
    one: np.ndarray
    two: np.ndarray

    @classmethod
    def build(cls, counts: dict[tuple[int, int], np.ndarray], n_nodes: int) -> Model:
        def logits(table: int, n: int, trust: float) -> np.ndarray:
            out = np.zeros(n, dtype=np.int8)
            for (t, chunk), c in counts.items():
                if t == table:
                    zeros, ones = c.reshape(-1, 2).T.astype(np.float64)
                    value = np.log((ones + 0.4) / (zeros + 0.4)) * (zeros + ones) / (zeros + ones + trust)
                    step = np.rint(np.clip(value / STEP, -127, 127))
                    out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.where((zeros + ones > 0) & (step == 0), 1, step)
            return out

        return cls(logits(0, -(-n_nodes // CHUNK) * CHUNK, 0.1), logits(1, 1 << SLOTS, 1.0), logits(2, 1 << SLOTS, 2.0))


def code_lengths(s: Stream, book: Codebook, model: Model) -> np.ndarray:
    """Bits of each document of a stream."""
    n_docs = len(s.first) - 1
    sizes = np.diff(s.first)
    bits = np.zeros(n_docs)
    order = np.argsort(-sizes, kind="stable")
    cells = np.linspace(-8, 8, MAP, dtype=np.float32)
    moved = 1 - (1 - MAP_RATE) ** np.arange(1 << 12)  # how far a cell goes towards what was seen that many times
    for lo in range(0, n_docs, LANES):
        docs = order[lo : lo + LANES]
        weights = np.tile(np.repeat(FIRST_WEIGHTS[None], GATES // 4, axis=0).reshape(GATES, 3), (len(docs), 1)).T.copy()
        weights *= STEP
        refined = np.tile((1 / (1 + np.exp(-cells))).astype(np.float32), len(docs) * 2 * LEVELS)
        for block in range(-(-int(sizes[docs[0]]) // BLOCK)):
            alive = int(np.searchsorted(-sizes[docs], -block * BLOCK, side="left"))  # documents with symbols left come first
            begin = s.first[docs[:alive]] + block * BLOCK
            n = np.minimum(sizes[docs[:alive]] - block * BLOCK, BLOCK)
            symbol_first = np.cumsum(n) - n
            place = np.repeat(begin - symbol_first, n) + np.arange(n.sum())
            symbols = s.symbols.take(place)
            # lane and kind of symbol (word or letter) choose a row of 8 levels
            row = np.repeat(np.arange(0, alive * 2 * LEVELS, 2 * LEVELS), n) + (symbols > book.escape) * LEVELS
            n_steps, path = steps(book, symbols)
            node = path >> 4
            one, two = (slots(np.repeat(c.take(place), n_steps), node) for c in (s.c1, s.c2))
            logits = [table.take(at) for table, at in ((model.nodes, node.astype(np.int64)), (model.one, one), (model.two, two))]
            level = np.repeat(row, n_steps)
            level += path >> 1 & (LEVELS - 1)
            seen = (logits[2] != 0).view(np.int8) << 1
            seen |= logits[1] != 0
            gate = level << 2
            gate += seen
            logits = [x.astype(np.float32) for x in logits]
            mixed = weights[0].take(gate)
            mixed *= logits[0]
            for w, logit in zip(weights[1:], logits[1:]):
                part = w.take(gate)
                part *= logit
                mixed += part
            np.minimum(mixed, 8, out=mixed)
            np.maximum(mixed, -8, out=mixed)
            p = np.exp(-mixed)
            p += 1
            np.reciprocal(p, out=p)
            mixed *= 2
            mixed += np.float32(16.5)
            level *= MAP
            level += mixed.astype(np.int32)
            bit = path & 1
            ones = bit.astype(np.float32)
            error = (ones - p).astype(np.float64)
            right = refined.take(level)
            right += p
            right *= np.float32(0.5)
            right -= 1 - ones  # for a zero, the negated probability of it
            np.abs(right, out=right)
            np.maximum(right, np.float32(1 / 4096), out=right)
            np.minimum(right, np.float32(1 - 1 / 4096), out=right)
            step_first = (np.cumsum(n_steps) - n_steps)[symbol_first]
            bits[docs[:alive]] -= np.add.reduceat(np.log2(right), step_first, dtype=np.float64)
            for w, logit in zip(weights, logits):
                w[: alive * GATES] += RATE * STEP * STEP * np.bincount(gate, error * logit, alive * GATES)
            level <<= 1
            level |= bit
            met = np.bincount(level, minlength=2 * alive * 2 * LEVELS * MAP)
            seen_ones = met[1::2]
            seen = met[::2] + seen_ones
            at = np.flatnonzero(seen)
            seen = seen[at]
            old = refined[at]
            refined[at] = old + moved.take(np.minimum(seen, len(moved) - 1)) * (seen_ones[at] / seen - old)
    return bits


def score(docs: DataFrame, training: Column) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, trained, n_bytes, n_tokens, n_known, train_tokens, base_score, bits, bits_per_byte, score.

    ``training`` says which rows the model learns from. The base is the unigram model with one added to each count.
    """
    context = docs.sparkSession.sparkContext
    counts = settle(word_counts(docs.filter(training)), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, n_words = int(totals[0]), int(totals[1])
    # the lowest count from which on words have a path: few enough of them; one row for each different count
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("words"))
    running = by_count.withColumn("up_to", F.sum("words").over(W.orderBy(F.desc("c"))))
    least = running.filter(F.col("up_to") < FREQUENT).agg(F.min("c")).first()[0] or (1 << 62)
    least = max(least, LEAST)
    is_frequent = (F.col("c") >= least) | (F.col("word") == F.lit(b""))
    frequent = sorted(((bytes(r.word), r.c) for r in counts.filter(is_frequent).collect()), key=lambda x: (-x[1], x[0])) or [(b"", 0)]
    if b"" not in dict(frequent):
        frequent.append((b"", 0))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS, dtype=np.int64)
        for batch in batches:
            n = batch.column("c").to_numpy(zero_copy_only=False)
            words = batch.column("word").to_pylist()
            total[:256] += np.bincount(np.frombuffer(b"".join(words), dtype=np.uint8), np.repeat(n, list(map(len, words))), 256).astype(np.int64)
            total[256] += n.sum()
        yield pa.record_batch([np.arange(LETTERS, dtype=np.int32), total], names=["letter", "n"])

    letters = np.zeros(LETTERS, dtype=np.int64)
    for r in counts.filter(~is_frequent).mapInArrow(spelled, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect():
        letters[r.letter] = r.n
    rare_total = n_all - sum(c for _, c in frequent)
    codebook = Codebook.build(frequent, rare_total, letters)
    known = context.broadcast(pa.array(list(codebook.words), pa.binary()))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            ids, first, rare = numbered(*words_in(batch.column("text")), known.value)
            rare_first = np.searchsorted(np.flatnonzero(ids < 0), first)
            yield pa.record_batch(
                [
                    batch.column("row"), batch.column("doc_id").cast(pa.int64()), batch.column("trained"), pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64()),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids)), pa.ListArray.from_arrays(pa.array(rare_first, pa.int32()), rare),
                ],
                names=["row", "doc_id", "trained", "n_bytes", "ids", "rare"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(training, F.lit(False)).alias("trained"), "text")
    texts = settle(rows.mapInArrow(numbers, "row long, doc_id long, trained boolean, n_bytes long, ids array<int>, rare array<binary>"), "encoded")
    # what follows needs the paths only, not the words
    book = context.broadcast(replace(codebook, words={b"": codebook.words[b""]}))
    counted = node_counts(codebook, rare_total, letters) | bit_counts(texts.filter("trained"), book)
    model = context.broadcast(Model.build(counted, codebook.n_nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, m = book.value, model.value
        logs = np.concatenate([np.log10(b.counts + 1), [0.0]])  # the last for rare words, which are -1
        met = np.concatenate([b.counts > 0, [False]])
        for batch in sliced(batches, "ids", 1 << 20):
            ids, first, rare = encoded(batch)
            yield pa.record_batch(
                [
                    *(batch.column(c) for c in ("row", "doc_id", "trained", "n_bytes")), pa.array(np.diff(first).astype(np.int64)),
                    pa.array(np.add.reduceat(met[ids], first[:-1], dtype=np.int64)), pa.array(np.add.reduceat(logs[ids], first[:-1])), pa.array(code_lengths(stream(ids, first, rare, b), b, m)),
                ],
                names=["row", "doc_id", "trained", "n_bytes", "n_tokens", "known", "logged", "bits"],
            )

    coded = texts.mapInArrow(run, "row long, doc_id long, trained boolean, n_bytes long, n_tokens long, known long, logged double, bits double")
    # the counts of rare words are joined; only words with a count matter
    met = texts.select("row", F.explode("rare").alias("w"))
    found = met.join(counts.filter(~is_frequent), F.col("w") == F.col("word")).groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_logged"))
    all_ = coded.join(found.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    return all_.select(
        "doc_id",
        "trained",
        "n_bytes",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logged") + F.coalesce("more_logged", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n_all + n_words + 1))).alias("base_score"),
        "bits",
        (F.col("bits") / F.when(F.col("n_bytes") > 0, F.col("n_bytes"))).alias("bits_per_byte"),
        (-F.col("bits") * float(np.log10(2))).alias("score"),
    )
