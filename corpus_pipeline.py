"""A corpus pipeline in four stages: toxicity, near-duplicates, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns rows with the
columns of ``documents``; the last one returns packed pieces. Decisions are tied to rows by a 128-bit digest of all
columns: rows equal in every column are interchangeable, so repeated and NULL ids need no special care. Whole rows travel
as one struct beside the digest, so extra columns may have any name and type. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowassay.llm import budget, golay, packing, toxicity
from rowassay.llm.common import table
from rowassay.session import scratch_path

TOXIC_FROM = 0.7
KEY = ("k0", "k1")
READ = ("doc_id", "text", "source")

# The mix and the packing have no SQL form.
ORACLE_SQL = None


def hashable(field: T.StructField) -> Column:
    """The column itself, or its JSON text where its type cannot be hashed."""
    column = F.col("`" + field.name.replace("`", "``") + "`")
    return column if not any(word in field.dataType.simpleString() for word in ("map<", "variant")) else F.to_json(F.struct(column.alias("c")))


def keyed(docs: DataFrame, *read: str) -> DataFrame:
    """(row, k0, k1, doc_id, text, source or those in ``read``): whole rows, their digests, and what the operators look at."""
    parts = [hashable(f) for f in docs.schema.fields]
    return docs.select(F.struct("*").alias("row"), *[F.xxhash64(F.lit(i), *parts).alias(k) for i, k in enumerate(KEY)], *(read or READ))


def taken(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """Each row of ``docs`` as often as ``copies`` (k0, k1, copies) says; keys it does not name go."""
    wanted = copies.filter("copies > 0").toDF("w0", "w1", "copies")
    rows = keyed(docs).select("row", *KEY).join(wanted, (F.col("k0") == F.col("w0")) & (F.col("k1") == F.col("w1"))).dropDuplicates(list(KEY))
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from all labelled documents.

    NULL and empty texts score as the intercept says; equal texts score alike, so copies stay or go together.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = "toxic_score"
    while score in (c.lower() for c in docs.columns):
        score += "_"
    scored = toxicity.score(docs, model, tuple(docs.columns), score)
    return scored.filter(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id, a NULL id last, ties to the smaller digest.

    NULL, empty and blank texts have fingerprint zero and are one group with each other.
    """
    found = golay.near_duplicates(keyed(docs).select("doc_id", "text", *KEY), 3, 2, ("doc_id", *KEY))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("first"))
    return taken(docs, first.select(*[f"first.{k}" for k in KEY], F.lit(1).alias("copies")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a NULL source is a source, texts without words are never taken."""
    mixed = budget.mix_sources(keyed(docs).select(*READ, *KEY), keep=KEY)
    return taken(docs, mixed.groupBy(*KEY).agg(F.sum("copies").alias("copies")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their bins; documents without words have a row without a bin."""
    return packing.pack(packing.documents_to_pack(docs))


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_near_duplicates), ("mix", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
