"""An index that is built once and searched often: postings by bucket of their term, vectors by shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import keyword
from siltstone.operators.vectors import packed
from siltstone.plans.tables import own_folder, stage

SHARD_VECTORS = 65_536


def shard_of(chunk_id: Column) -> Column:
    return F.floor(chunk_id / SHARD_VECTORS).cast("long")


@dataclass(frozen=True)
class Index:
    """``postings(term, key, positions, n_tokens, bucket)``, the texts' number and average length, and unique ``vectors(chunk_id, shard, embedding, code)`` if there are any."""

    postings: DataFrame
    total: tuple[int, float]
    vectors: DataFrame | None = None


def build(texts: DataFrame, vectors: DataFrame | None = None, key: str = "chunk_id") -> Index:
    """Index ``texts(key, text)`` and ``vectors(chunk_id, embedding)`` into the shared folder. Of rows with one id the vectors are taken to be equal; null ones are left out."""
    spark, at = texts.sparkSession, own_folder(texts.sparkSession, "index")
    words = stage(keyword.tokenized(texts, key), "words")
    keyword.write_postings(keyword.postings(words, key), f"{at}/postings")
    kept = None
    if vectors is not None:
        unique = vectors.where("embedding is not null").select("chunk_id", "embedding").dropDuplicates(["chunk_id"])
        packed(unique).withColumn("shard", shard_of(F.col("chunk_id"))).repartition("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.partitionBy("shard").parquet(f"{at}/vectors")
        kept = spark.read.parquet(f"{at}/vectors").withColumn("shard", F.col("shard").cast("long"))
    return Index(spark.read.parquet(f"{at}/postings"), keyword.totals(keyword.lengths(words, key)), kept)
