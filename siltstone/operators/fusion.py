"""Reciprocal rank fusion of a vector and a keyword ranking, and merging the rankings of stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.filters import Filter, allowed_chunks
from siltstone.operators import keyword, vectors

RRF_K = 60
#: Each half is searched this many times deeper than the result.
RANK_DEPTH = 4


def fuse(dense: DataFrame, words: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """``key, score, similarity, position`` of the ``k`` best by the sum of 1 / (60 + rank).

    ``dense(key, similarity, rank)``, ``words(key, rank)``, ranks from 1. Equal sums keep the
    vector ranking's order, then the keyword ranking's. A text that only the keyword half found
    has similarity 0. Both inputs are top-k lists, so this is small whatever the store's size.
    """
    share = lambda rank: F.coalesce(F.lit(1).cast("float") / (F.lit(float(RRF_K)).cast("float") + F.col(rank).cast("float")), F.lit(0.0).cast("float"))
    d = dense.select(key, "similarity", F.col("rank").alias("dense_rank"))
    w = words.select(F.col(key).alias("_key"), F.col("rank").alias("word_rank"))
    both = d.join(w, F.col(key) == F.col("_key"), "full").withColumn(key, F.coalesce(key, "_key"))
    both = both.withColumn("score", (share("dense_rank") + share("word_rank")).cast("float"))
    order = (F.desc("score"), F.coalesce("dense_rank", F.col("word_rank") + F.lit(1_000_000_000)))
    best = both.orderBy(*order).limit(k)
    position = F.row_number().over(Window.orderBy(*order))
    return best.select(key, "score", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), position.alias("position"))


def search(
    files: DataFrame,
    chunks: DataFrame,
    vecs: DataFrame,
    index: DataFrame,
    total: tuple[int, float],
    query: str,
    query_vector: Sequence[float],
    k: int = 8,
    narrowed: Filter | None = None,
) -> DataFrame:
    """``position, score, similarity, path, start_line, end_line, text, chunk_id`` of the ``k`` best excerpts.

    The filter narrows both halves before they rank; the keyword statistics stay those of the whole
    store (``total``). ``vecs`` has one row for each chunk. Only chunks with a vector can be found where a filter is given, as without one only they
    can be in the vector half. Texts are looked up for the final ``k`` alone.
    """
    depth = RANK_DEPTH * k
    if not k:
        return resolve(fuse(vecs.sparkSession.createDataFrame([], "chunk_id long, similarity double, rank int"), vecs.sparkSession.createDataFrame([], "chunk_id long, rank int"), 0), files, chunks)
    searched = vecs.where(F.col("embedding").isNotNull())
    allowed = None
    if narrowed:
        own = ["chunk_id"] + (["shard"] if "shard" in vecs.columns else [])
        allowed = searched.select(*own).join(allowed_chunks(files, chunks, narrowed), "chunk_id", "left_semi")
    dense = vectors.top_k(searched, query_vector, depth, allowed=allowed)
    words = keyword.keyword_top(keyword.bm25(index, total, query, allowed=allowed), depth)
    return resolve(fuse(dense, words, k), files, chunks)


def resolve(hits: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Excerpts of ranked hits (at most a page of them); a hit whose chunk is gone is dropped."""
    rows = chunks.join(F.broadcast(hits), "chunk_id").join(files.select("file_id", "path"), "file_id")
    return rows.select("position", "score", "similarity", "path", "start_line", "end_line", "text", "chunk_id")


def merge(hits: DataFrame, k: int) -> DataFrame:
    """One ranking from those of several stores: ``hits(store, store_ord, position, score, similarity, ...)``.

    Higher scores go first, then more similar ones, then earlier stores, but the order within a
    store never changes. As a hit can't overtake an equal-scored one of its own store, what counts
    is the smallest similarity so far among those.
    """
    within = Window.partitionBy("store_ord", "score").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hits.withColumn("held", F.min("similarity").over(within))
    order = (F.desc("score"), F.desc("held"), "store_ord", "position")
    best = ranked.orderBy(*order).limit(k)
    return best.withColumn("merged", F.row_number().over(Window.orderBy(*order))).drop("held")


def breakdown(hits: DataFrame, stores: DataFrame) -> DataFrame:
    """``store, hits`` of every store, also those without a hit."""
    return stores.select("store").join(hits.groupBy("store").agg(F.count("*").alias("hits")), "store", "left").na.fill(0, ["hits"])
