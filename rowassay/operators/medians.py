"""Exact order statistics without bringing a column into one task.

Spark's ``median`` keeps every distinct value of a column in one reducer. Here every numeric type gets an image in whole numbers that
keeps its order, and the value at a rank is found digit by digit: the values are counted by the image's leading bits, the
bucket that holds the rank is kept, and only its values are counted by the next bits. After the last digit a bucket is a
single value, so no bucket is ever put in order, whatever the distribution. A round counts at most ``2**DIGIT`` buckets
for a rank; all ranks of all columns go down together.

Images: whole numbers are their own. A double is its IEEE pattern, made by arithmetic (exponent and fraction), negated for
negative values; NaN comes last and both zeros are equal. A decimal is three words in base 10^13, each with the
number's sign, so 38 digits keep their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

DIGIT = 22  # bits of the first digit of a word; the later ones have 21
DIGITS = (42, 21, 0)  # shifts within a word of 64 bits
BASE = 10_000_000_000_000
SMALLEST_NORMAL = "2.2250738585072014E-308D"
SMALLEST = "4.9E-324D"
FLOATING, INTEGRAL = -1, -2  # kinds of image; a decimal's kind is its scale


def _double_image(counts: DataFrame) -> DataFrame:
    a = "abs(CAST(value AS DOUBLE))"
    guess = counts.selectExpr("*", f"try_cast(floor(log2({a})) AS INT) AS guess")
    # the logarithm is rounded, so the exponent may be one off
    exact = guess.selectExpr("*", f"guess + CAST(pow(2D, guess + 1) <= {a} AS INT) - CAST(pow(2D, guess) > {a} AS INT) AS power")
    size = f"""CASE WHEN {a} = double('infinity') THEN 9218868437227405312L WHEN {a} < {SMALLEST_NORMAL} THEN CAST({a} / {SMALLEST} AS BIGINT)
        ELSE (power + 1022) * 4503599627370496L + CAST({a} / pow(2D, power) * 4503599627370496D AS BIGINT) END"""
    return exact.selectExpr("*", f"CASE WHEN isnan(value) THEN 9223372036854775807L WHEN value = 0 THEN 0L WHEN value > 0 THEN {size} ELSE -({size}) END AS w0").drop("guess", "power")


def images(family: str, counts: DataFrame) -> DataFrame:
    """(position, n, w0, w1, w2, kind, number) of the counted values (position, value, n) of one numeric family."""
    zero = F.lit(0).cast("long")
    if family == "floating":
        rows = _double_image(counts).withColumns({"w1": zero, "w2": zero})
    elif family.startswith("decimal"):
        scale = int(family.removeprefix("decimal"))
        # the digits without the point: shifting it could need more than 38 of them
        digits = counts.withColumn("digits", F.expr(f"CAST(replace(CAST(CAST(value AS DECIMAL(38, {scale})) AS STRING), '.', '') AS DECIMAL(38, 0))"))
        lower, upper = f"CAST({BASE}L AS DECIMAL(14, 0))", f"CAST('{BASE * BASE}' AS DECIMAL(27, 0))"
        rows = digits.selectExpr("*", f"CAST(digits div {upper} AS BIGINT) AS w0", f"CAST((digits % {upper}) div {lower} AS BIGINT) AS w1", f"CAST(digits % {lower} AS BIGINT) AS w2")
    else:
        rows = counts.withColumns({"w0": F.col("value").cast("long"), "w1": zero, "w2": zero})
    kind = FLOATING if family == "floating" else int(family.removeprefix("decimal")) if family.startswith("decimal") else INTEGRAL
    # no column can be NULL here, so no round adds a filter of its own below the shuffle that all rounds share
    known = [f"coalesce({c}, 0) AS {c}" for c in ("position", "n", "w0", "w1", "w2")]
    return rows.selectExpr(*known, f"{kind} AS kind", "CAST(value AS DOUBLE) AS number")


def values(found: DataFrame) -> DataFrame:
    """(number, text) of images, exactly: the inverse of ``images``."""
    size, rest = "abs(w0)", "(abs(w0) % 4503599627370496L)"
    normal = f"(1D + {rest} / 4503599627370496D) * pow(2D, {size} div 4503599627370496L - 1023)"
    plain = f"CASE WHEN {size} = 9218868437227405312L THEN double('infinity') WHEN {size} < 4503599627370496L THEN {rest} * {SMALLEST} ELSE {normal} END"
    double = f"CASE WHEN w0 = 9223372036854775807L THEN double('NaN') WHEN w0 < 0 THEN -({plain}) ELSE {plain} END"
    digits = "concat(abs(w0), lpad(abs(w1), 13, '0'), lpad(abs(w2), 13, '0'))"
    # digits in front of the point without leading zeros, but at least one
    parts = found.selectExpr("*", f"CASE WHEN kind >= 0 THEN {digits} END AS digits", f"CASE WHEN kind = {FLOATING} THEN {double} END AS double")
    whole = "regexp_replace(left(digits, length(digits) - kind), '^0+(?=.)', '')"
    full = parts.selectExpr("*", "lpad(digits, greatest(length(digits), kind + 1), '0') AS padded").drop("digits").withColumnRenamed("padded", "digits")
    decimal = f"concat(CASE WHEN w0 < 0 OR w1 < 0 OR w2 < 0 THEN '-' ELSE '' END, {whole}, CASE WHEN kind > 0 THEN concat('.', right(digits, kind)) ELSE '' END)"
    text = full.withColumn("text", F.expr(f"CASE kind WHEN {FLOATING} THEN CAST(double AS STRING) WHEN {INTEGRAL} THEN CAST(w0 AS STRING) ELSE {decimal} END"))
    number = f"CASE kind WHEN {FLOATING} THEN double WHEN {INTEGRAL} THEN CAST(w0 AS DOUBLE) ELSE CAST(text AS DOUBLE) END"
    return text.withColumn("number", F.expr(number)).drop("digits", "double")


def _descent(words: int, fractions: tuple[float, ...]) -> str:
    """SQL over ``{counts}`` (images): (position, kind, which, fraction, upper, w0, w1, w2), one row for each rank.

    A bucket that holds ranks carries them along, relative to its own first value, as an array of at most two for each fraction. So a
    round reads the counts and the few buckets of the round before, each once, and the plan grows by the same for every digit.
    """
    # a word of a decimal has 44 bits, so its first digit is the second one
    steps = [(w, shift) for w in range(words) for shift in (DIGITS if words == 1 else DIGITS[1:] if w else DIGITS)]
    first = {w: min(k for k, (word, _) in enumerate(steps) if word == w) for w in range(words)}
    digit = [f"shiftright(w{w}, {shift}){'' if k == first[w] else f' & {(1 << 21) - 1}'} AS q{k}" for k, (w, shift) in enumerate(steps)]
    # ranks around fraction * (N - 1), counted from 1; they coincide when it is whole
    rank = "CAST({}({}D * (total - 1)) AS BIGINT) + 1"
    sides = [(i, f, rank.format(side, f), up) for i, f in enumerate(fractions) for side, up in (("floor", "false"), ("ceil", "true"))]
    asked = "array(" + ", ".join(f"named_struct('which', {i}, 'fraction', {f}D, 'upper', {up}, 'rank', {r})" for i, f, r, up in sides) + ")"
    below = "named_struct('which', a.which, 'fraction', a.fraction, 'upper', a.upper, 'rank', a.rank - (upto - n))"
    parts = [f"base AS (SELECT position, kind, n, {', '.join(digit)} FROM {{counts}})"]
    for k in range(len(steps)):
        known = ["position", "kind", *(f"q{i}" for i in range(k))]
        names = ", ".join(known)
        if k == 0:
            parts.append(f"c0 AS (SELECT position, kind, q0, sum(n) AS n FROM base GROUP BY position, kind, q0)")
            ranks = asked
        else:
            own, same = ", ".join(f"b.{c}" for c in known), " AND ".join(f"b.{c} = p.{c}" for c in known)
            parts.append(f"c{k} AS (SELECT /*+ BROADCAST(p) */ {own}, b.q{k}, p.asked, sum(b.n) AS n FROM base b JOIN p{k} p ON {same} GROUP BY {own}, b.q{k}, p.asked)")
            ranks = "asked"
        total = ", sum(n) OVER (PARTITION BY position) AS total" if k == 0 else ""
        parts.append(f"u{k} AS (SELECT *, sum(n) OVER (PARTITION BY {names} ORDER BY q{k} ROWS UNBOUNDED PRECEDING) AS upto{total} FROM c{k})")
        parts.append(f"s{k} AS (SELECT {names}, q{k}, n, upto, filter({ranks}, a -> a.rank > upto - n AND a.rank <= upto) AS held FROM u{k})")
        parts.append(f"p{k + 1} AS (SELECT {names}, q{k}, transform(held, a -> {below}) AS asked FROM s{k} WHERE size(held) > 0)")
    # the digits of a word side by side are the word again
    whole = [" + ".join(f"shiftleft(CAST(q{k} AS BIGINT), {shift})" for k, (word, shift) in enumerate(steps) if word == w) or "0L" for w in range(3)]
    found = ", ".join(f"{e} AS w{w}" for w, e in enumerate(whole))
    return f"WITH {', '.join(parts)} SELECT position, kind, a.which, a.fraction, a.upper, {found} FROM p{len(steps)} LATERAL VIEW explode(asked) AS a"


def order_statistics(counts: dict[str, DataFrame], fractions: tuple[float, ...]) -> DataFrame:
    """(position, which, fraction, lower, upper, lower_number, upper_number) from counted values by family.

    ``lower`` and ``upper`` are the exact values around the fraction, as text of the column's own type; they are equal
    when the fraction meets a value. 0 is the minimum and 1 the maximum. NaN sorts last, as a value.
    """
    merged = reduce(DataFrame.unionByName, [images(name, rows) for name, rows in counts.items()])
    words = 3 if any(name.startswith("decimal") for name in counts) else 1
    # images are made once: every round starts from the files of this shuffle
    merged = merged.drop("number")
    shared = merged.repartition("position", "w0", "w1", "w2") if words == 3 else merged.repartition("position", "w0")
    found = values(merged.sparkSession.sql(_descent(words, fractions), counts=shared))
    sides = [F.max(F.when(F.col("upper") == up, F.col(c))).alias(n) for up, c, n in ((False, "text", "lower"), (True, "text", "upper"), (False, "number", "lower_number"), (True, "number", "upper_number"))]
    return found.groupBy("position", "which", "fraction").agg(*sides)


def medians(counts: dict[str, DataFrame]) -> DataFrame:
    """Median per position from counted values (position, value, n) by family."""
    return order_statistics(counts, (0.5,)).selectExpr("position", "(lower_number + upper_number) / 2.0D AS median")
