"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartograf.llm import exact_dedup, jaccard, packing, pii, quality
from kartograf.llm.base import ascii_lower, prepared, stored, table


def _apart(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the documents has them."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of the documents (doc_id, text_hash) in ``kept``; NULL ids match NULL ids."""
    own, digest = _apart(docs, "_id", "_hash")
    kept = kept.select(F.col("doc_id").alias(own), F.col("text_hash").alias(digest))
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(digest))
    return docs.join(kept, same, "left_semi")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is no higher than their language's threshold; those without text go."""
    prepared(spark)
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    judged = quality.judge_quality(docs, trusted)
    return _only(docs, judged.filter("kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; of wholly repeated ones, one."""
    prepared(spark)
    sha, own, found, rows = _apart(docs, "_sha", "_id", "_kept", "_rows")
    named = docs.withColumn(sha, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    kept = exact_dedup.exact_duplicates(docs).filter("kept").groupBy(F.col("doc_id").alias(own), F.col("text_sha256").alias(found)).agg(F.count("*").alias(rows))
    kept = stored(kept, "kept")
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(sha) == F.col(found))
    again = kept.filter(F.col(rows) > 1)
    left = named.join(kept.filter(F.col(rows) == 1), same, "left_semi")
    if not again.isEmpty():
        left = left.union(named.join(again, same, "left_semi").dropDuplicates(["doc_id", sha]))
    return left.drop(sha)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 on five-word n-grams, the one with the smallest id."""
    prepared(spark)
    found = jaccard.near_components(docs)
    return _only(docs, found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    prepared(spark)
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 512 to 8,192 words."""
    prepared(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact),
    ("best-fit packing", pack),
]

#: The perplexity, similarity and personal data stages are beyond SQL; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
