"""Source divergence audit over iceberg terms found by prefix refinement.

A term is a run of letters (ASCII letters, lower-cased, and everything beyond ASCII). A language keeps the terms that
occur in at least ``least`` of its documents. Rare terms are most of a vocabulary, so they are never counted by group:
prefixes are refined level by level. At a level of ``n`` bytes every document says which terms of up to n bytes and which n-byte
beginnings of longer terms it holds; what is in fewer than ``least`` documents of the language is discarded, as no term below such a beginning can be
kept, and only terms under a surviving beginning reach the next level, of twice the length. Terms that survive are
complete and kept; levels end when no beginning survives. Then the kept terms alone are counted by language and source. Documents are counted
row by row, so a document counts a beginning once however many of its terms share it, and counts add up across tasks.

What the next level may look at is broadcast as a bitmap of ``2**FILTER_BITS`` bits, whatever the number of
beginnings: one whose bit is set by another is looked at in vain, and the exact counts drop it then. The kept terms are known to the
last pass in the same way, and joined exactly after it.

The audit compares groups of (language, source) by smoothed whole-number probabilities; see ``divergence``. Pairs of sources
are summed over dense blocks of terms in numpy, so a task emits sums by pair, never a row by term and pair. The numbers of the groups
are broadcast: as many as there are groups, and the result has a row for every pair of them.

Defined cases: NULL text, language and source read as empty; documents without terms still make their group
occur; a language without kept terms has pairs of value 0 and no terms; repeated rows are documents of their own;
one long run of letters is one term of any length; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowassay.llm.common import as_bytes, lean, sliced
from rowassay.session import settle

FILTER_BITS = 26
BITMAP = 32_768  # bits in one bitmap of Spark's bitmap functions
SCALE = 1_000_000_000
SLICE = 1 << 20  # bytes of text whose terms are split and counted at once
HELD = 200_000  # counts of slices a task holds before it adds them up and passes them on
CELLS = 1 << 19  # probabilities in one numpy block
LONG = 64  # bytes of a term up to which its crc32 is worked out together with that of others
CRC = np.arange(256, dtype=np.uint32)  # of one byte
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1)
# letters stay, A-Z are lowered, all else parts terms
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_in(texts: pa.Array, shorter: int = 0) -> tuple[pa.Array, np.ndarray]:
    """All terms of more than ``shorter`` bytes in ``texts``, and the place of the text of each."""
    texts = texts.cast(pa.string()) if pa.types.is_large_string(texts.type) else texts
    if not len(texts):
        return pa.array([], pa.binary()), np.zeros(0, dtype=np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]).translate(LETTERS)
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)))
    long = pc.binary_length(lists.values).to_numpy() > shorter  # pieces without bytes are no terms
    place = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    return lists.values.cast(pa.binary()).filter(pa.array(long)), place[long]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ``keys`` in order and how often each occurs; sorts in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.diff(first, append=len(keys))


def added_up(held: list[pa.Table], n: str) -> pa.Table:
    """One row for each key of the tables ``held``, with the sum of ``n``; empties the list."""
    whole = pa.concat_tables(held)
    held.clear()
    keys = [c for c in whole.column_names if c != n]
    return whole.group_by(keys, use_threads=False).aggregate([(n, "sum")]).select([*keys, f"{n}_sum"]).rename_columns([*keys, n])


def read_documents(docs: DataFrame) -> DataFrame:
    """(lang, source, text) with NULLs as empty strings."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def slot_of(lang: Column, prefix: Column) -> Column:
    """Place of a beginning in the bitmap; ``bits_set`` reads the same place in Python."""
    return F.crc32(F.concat(lang.cast("binary"), F.lit(b"\0"), prefix)).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def surviving_bits(prefixes: DataFrame) -> bytes:
    """The bitmap of (lang, prefix) rows; at most 2**FILTER_BITS bits reach the driver."""
    slots = prefixes.select((slot_of(F.col("lang"), F.col("prefix")) + 1).alias("slot"))
    rows = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    bits = bytearray(1 << FILTER_BITS - 3)
    for r in rows:
        at = (r.bucket - 1) * BITMAP // 8
        bits[at : at + BITMAP // 8] = r.bits
    return bytes(bits)


def crc_of(terms: pa.Array, length: int | None, seeds: np.ndarray) -> np.ndarray:
    """The crc32 of each term, or of its first ``length`` bytes, that goes on from the crc32 in ``seeds``; as zlib and Spark give it."""
    if not len(terms):
        return np.zeros(0, dtype=np.uint32)
    offsets = np.frombuffer(terms.buffers()[1], dtype=np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    size = np.diff(offsets) if length is None else np.minimum(np.diff(offsets), length)
    data = np.frombuffer(terms.buffers()[2], dtype=np.uint8)
    state = ~seeds.astype(np.uint32)
    # longest first, so that those with a byte left stay together; very long ones one by one
    order = np.argsort(255 - np.minimum(size, LONG + 1).astype(np.uint8), kind="stable")
    order = order[np.count_nonzero(size > LONG) :]
    at, own, left = offsets[order], state[order], np.cumsum(np.bincount(size[order], minlength=LONG + 1)[::-1])[::-1]
    for byte in range(LONG):
        n = left[byte + 1]  # terms with more bytes than this
        own[:n] = CRC[(own[:n] ^ data[at[:n] + byte]) & 255] ^ own[:n] >> 8
    state[order] = own
    state = ~state
    for i in np.flatnonzero(size > LONG):
        state[i] = zlib.crc32(data[offsets[i] : offsets[i] + size[i]].tobytes(), int(seeds[i]))
    return state


def kept_by(bits: bytes):
    """A test whether the bitmap has the bit of each term, or of its beginning, in its language (the number in ``langs``)."""
    cells = np.frombuffer(bits, dtype=np.uint8)

    def test(langs: list[bytes], numbers: np.ndarray, terms: pa.Array, length: int | None) -> np.ndarray:
        seeds = np.array([zlib.crc32(lang + b"\0") for lang in langs], dtype=np.uint32)
        at = crc_of(terms, length, seeds[numbers]) & np.uint32((1 << FILTER_BITS) - 1)
        return (cells[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return test


def level_counts(docs: DataFrame, shorter: int, longest: int, bits) -> DataFrame:
    """(lang, term, docs) of one level: the documents that hold a term, or a beginning of longer terms.

    Terms of ``shorter`` < length <= ``longest`` bytes are complete and stand for themselves; longer ones are cut after ``longest``
    bytes and marked by a zero byte, which no term holds. Beyond the first level only terms under a beginning in ``bits`` count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by(bits.value) if bits is not None else None
        held: list[pa.Table] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = added_up(held, "docs")
            if known:
                langs = rows.column("lang").combine_chunks().dictionary_encode()
                rows = rows.filter(pa.array(known(langs.dictionary.cast(pa.binary()).to_pylist(), langs.indices.to_numpy(), rows.column("term").combine_chunks(), shorter)))
            yield from rows.to_batches()

        for batch in sliced(batches, "text", SLICE):
            terms, place = terms_in(batch.column("text"), shorter)
            terms = terms.dictionary_encode()
            whole = terms.dictionary
            cut = pc.binary_join_element_wise(pc.binary_slice(whole, 0, longest), pa.scalar(b"\0", pa.binary()), pa.scalar(b"", pa.binary()))
            own = pc.if_else(pc.greater(pc.binary_length(whole), longest), cut, whole).dictionary_encode()
            n = max(1, len(own.dictionary))
            # a document counts a beginning once
            pairs, _ = distinct(place * n + own.indices.to_numpy()[terms.indices.to_numpy()])
            langs = batch.column("lang").dictionary_encode()
            keys, times = distinct(langs.indices.to_numpy()[pairs // n].astype(np.int64) * n + pairs % n)
            held.append(pa.table([langs.dictionary.take(pa.array(keys // n)).cast(pa.string()), own.dictionary.take(pa.array(keys % n)), pa.array(times, pa.int64())], names=["lang", "term", "docs"]))
            if sum(t.num_rows for t in held) > HELD:
                yield from out()
        if held:
            yield from out()

    made = docs.select("lang", "text").mapInArrow(lean(run), "lang string, term binary, docs long")
    return made.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def numbered(groups: DataFrame) -> tuple[DataFrame, dict[tuple[bytes, bytes], int]]:
    """(group, lang, source) and the number of each group; groups are few, as results hold a row for each pair of them."""
    rows = sorted((r.lang, r.source) for r in groups.collect())
    frame = groups.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "group int, lang string, source string")
    return frame, {(lang.encode(), source.encode()): i for i, (lang, source) in enumerate(rows)}


def group_counts(docs: DataFrame, bits, numbers) -> DataFrame:
    """(group, term, n): occurrences by group of the terms in ``bits``; numbers are shuffled, not names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by(bits.value)
        langs = list(dict.fromkeys(lang for lang, _ in numbers.value))
        lang_of = np.zeros(len(numbers.value), dtype=np.int64)  # by number of the group
        for (lang, _), group in numbers.value.items():
            lang_of[group] = langs.index(lang)
        held: list[pa.Table] = []
        for batch in sliced(batches, "text", SLICE):
            groups = np.fromiter(map(numbers.value.__getitem__, zip(as_bytes(batch.column("lang")), as_bytes(batch.column("source")))), dtype=np.int64, count=batch.num_rows)
            terms, place = terms_in(batch.column("text"))
            terms = terms.dictionary_encode()
            n = max(1, len(terms.dictionary))
            keys, times = distinct(groups[place] * n + terms.indices.to_numpy())
            own = lang_of[keys // n] * n + keys % n
            asked, _ = distinct(own.copy())
            kept = known(langs, asked // n, terms.dictionary.take(pa.array(asked % n)), None)[np.searchsorted(asked, own)]
            keys, times = keys[kept], times[kept]
            held.append(pa.table([pa.array(keys // n, pa.int32()), terms.dictionary.take(pa.array(keys % n)), pa.array(times, pa.int64())], names=["group", "term", "n"]))
            if sum(t.num_rows for t in held) > HELD:
                yield from added_up(held, "n").to_batches()
        if held:
            yield from added_up(held, "n").to_batches()

    made = docs.mapInArrow(lean(run), "group int, term binary, n long")
    return made.groupBy("group", "term").agg(F.sum("n").alias("n"))


def kept_terms(docs: DataFrame, least: int = 3, first: int = 6) -> DataFrame:
    """(lang, source, term, n): occurrences by group of every term in at least ``least`` documents of its language.

    ``docs`` as ``read_documents`` gives them; ``first`` is the length of the first level's beginnings in bytes.
    """
    context = docs.sparkSession.sparkContext
    shorter, longest, bits, complete = 0, first, None, []
    while True:
        beginning = F.substring("term", longest + 1, 1) == F.lit(b"\0")
        level = settle(level_counts(docs, shorter, longest, bits).filter(F.col("docs") >= least).select("lang", "term", beginning.alias("cut")), "iceberg-level")
        complete.append(level.filter("NOT cut").select("lang", "term"))
        found = surviving_bits(level.filter("cut").select("lang", F.substring("term", 1, longest).alias("prefix")))
        if not any(found):
            break
        bits = context.broadcast(found)
        shorter, longest = longest, 2 * longest
    rows = complete[0]
    for more in complete[1:]:
        rows = rows.unionByName(more)
    bits = context.broadcast(surviving_bits(rows.withColumnRenamed("term", "prefix")))
    rows = rows.select(F.col("lang").alias("l"), F.col("term").alias("t"))
    names, numbers = numbered(docs.select("lang", "source").distinct())
    counts = group_counts(docs, bits, context.broadcast(numbers)).join(F.broadcast(names), "group").select("lang", "source", "term", "n")
    # a term that shares its bit with a kept one is dropped here
    return settle(counts.join(rows, (F.col("lang") == F.col("l")) & (F.col("term") == F.col("t")), "left_semi"), "iceberg-terms")


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)) in whole numbers of any size; NULL without terms."""
    whole = [c.cast("decimal(20,0)") for c in (n + 1, total + terms)]
    scaled = F.lit(SCALE).cast("decimal(10,0)") * whole[0]
    return F.call_function("div", scaled, F.when(whole[1] > 0, whole[1])) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); probabilities are at most SCALE + 1, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(terms: DataFrame, floors) -> DataFrame:
    """(lang, a, b, value): summed distance of sources numbered a and b; ``terms`` (lang, held) lists (number, p) by term.

    ``floors`` holds by language the probabilities of a term that a source does not have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            names, numbers = zip(*sums)
            values = [sums[k] for k in sums]
            offsets = np.cumsum([0, *map(len, values)])
            made = pa.record_batch(
                [pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values)))],
                names=["lang", "a", "sums"],
            )
            sums.clear()
            return made

        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            for lang in dict.fromkeys(langs):
                held = batch.column("held").filter(pa.array(langs == lang))
                absent = floors.value[lang]
                step = max(1, CELLS // len(absent))
                for lo in range(0, len(held), step):
                    part = held.slice(lo, step)
                    cells = part.flatten()
                    p = np.tile(absent, (len(part), 1))
                    row = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
                    p[row, cells.field("number").to_numpy()] = cells.field("p").to_numpy()
                    for a in range(len(absent)):
                        gap = p[:, a : a + 1] - p
                        gap *= gap
                        gap //= p
                        value = gap.sum(axis=0)
                        sums[lang, a] = sums[lang, a] + value if (lang, a) in sums else value
                        if len(sums) * len(absent) > CELLS * 4:
                            yield out()
        if sums:
            yield out()

    made = terms.mapInArrow(lean(run), "lang string, a int, sums array<long>")
    return made.select("lang", "a", F.posexplode("sums").alias("b", "value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = 3, limit: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of ``docs`` (lang, source, text).

    A group gives a kept term of its language p = 1 + floor(SCALE * (n + 1) / (N + V)): n occurrences there, N of
    all kept terms, V kept terms. Part ``pair``: for every other source of the language, floor((p - q)^2 / q) summed over
    all kept terms, q being the other's p. Part ``term``: terms the group has and gives more than the whole
    language does (q), the first ``limit``. Ranks follow falling values, then items byte by byte.
    """
    read = read_documents(docs)
    groups = settle(read.select("lang", "source").distinct(), "iceberg-groups")
    terms = kept_terms(read, least)
    by_group = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_lang = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("terms"))

    def named(rows: DataFrame, i: int, *on: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"{c}{i}") if c in on else F.col(c) for c in rows.columns])

    def same(i: int, *on: str) -> list[Column]:
        return [F.col(c) == F.col(f"{c}{i}") for c in on]

    whole = groups.join(named(by_group, 1, "lang", "source"), same(1, "lang", "source"), "left").join(named(by_lang, 2, "lang"), same(2, "lang"), "left")
    whole = whole.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "terms")])
    whole = settle(whole.withColumn("number", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).withColumn("absent", probability(F.lit(0), F.col("total"), F.col("terms"))), "iceberg-totals")
    # one short row for each group; the result has one for each pair of them
    known = whole.select("lang", "number", F.coalesce("absent", F.lit(0)).alias("absent")).collect()
    floors: dict[str, np.ndarray] = {}
    for lang, n in Counter(r.lang for r in known).items():
        floors[lang] = np.zeros(n, dtype=np.int64)
    for r in known:
        floors[r.lang][r.number] = r.absent
    shared = docs.sparkSession.sparkContext.broadcast(floors)

    of_group = named(whole, 3, "lang", "source")
    cells = terms.join(of_group, same(3, "lang", "source")).select("lang", "source", "term", "n", "number", "lang_total", "terms", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    cells = settle(cells.withColumn("lang_n", F.sum("n").over(W.partitionBy("lang", "term"))), "iceberg-cells")

    lists = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p")).alias("held")).select("lang", "held")  # at most one entry for each source
    zeros = whole.groupBy("lang").agg(F.count(F.lit(1)).cast("int").alias("n")).select("lang", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"), F.array_repeat(F.lit(0).cast("long"), F.col("n")).alias("sums"))
    zeros = zeros.select("lang", "a", F.posexplode("sums").alias("b", "value"))
    sums = pair_sums(lists, shared).unionByName(zeros).filter("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one, two = (whole.select(F.col("lang").alias(f"l{i}"), F.col("number").alias(f"n{i}"), F.col("source").alias(f"s{i}")) for i in (1, 2))
    pairs = sums.join(one, (F.col("lang") == F.col("l1")) & (F.col("a") == F.col("n1"))).join(two, (F.col("lang") == F.col("l2")) & (F.col("b") == F.col("n2")))
    pairs = pairs.select("lang", F.col("s1").alias("source"), F.lit("pair").alias("part"), F.col("s2").alias("item"), "value")

    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = cells.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [rows.withColumn("rank", F.row_number().over(order)) for rows in (pairs, above)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= limit))
