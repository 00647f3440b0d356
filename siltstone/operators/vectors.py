"""Exact vector search: a scan with a bounded heap per task, and the same for many queries at once."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A set of queries is sent to the tasks up to this many numbers (16 MB); larger sets go in turns.
QUERY_CELLS = 4_000_000


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, JVM-side."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, key: str = "chunk_id", allowed: DataFrame | None = None) -> DataFrame:
    """``key, similarity, rank`` of the ``k`` vectors with the largest inner product, ties by key.

    Keys are unique. ``allowed`` (a table of keys) narrows before the ranking; where both it and the
    vectors have a ``shard`` that the vectors are stored by, only the shards it names are read. A task keeps the best of each
    Arrow batch, then of all (TakeOrderedAndProject). Null vectors and those of another length are not searched.
    """
    rows = vectors.where(F.col("embedding").isNotNull())
    if allowed is not None:
        keys = [c for c in (key, "shard") if c in rows.columns and c in allowed.columns]
        rows = rows.join(allowed.select(*keys).distinct(), keys, "left_semi")
    q = np.array(query, np.float64)

    def scan(batches):
        for b in batches:
            column = b.column("embedding")
            fits = np.flatnonzero(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == len(q))
            if k < 1 or not len(fits):
                continue
            x = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q)).astype(np.float64)
            s = np.einsum("ij,j->i", x, q)  # the same for equal rows, unlike a matrix product
            keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))  # ties at the edge stay
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(fits[keep])), pa.array(s[keep])], [key, "similarity"])

    best = rows.select(key, "embedding").mapInArrow(scan, f"{key} long, similarity double").orderBy(F.desc("similarity"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))  # k rows


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """``query_id, key, similarity, rank`` for every row of ``queries(query_id, embedding)``.

    Queries are the bounded side and are multiplied with each Arrow batch as a matrix; a task keeps
    ``k`` candidates per query and batch, the rest is one grouped limit. More queries than
    ``QUERY_CELLS`` allow are answered in several scans.
    """
    q = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    schema = f"query_id long, {key} long, similarity double"
    first = q.head()
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    per_scan = max(1, QUERY_CELLS // max(1, len(first["embedding"])))
    spark, found, rows = vectors.sparkSession, None, q.toLocalIterator()
    while part := list(islice(rows, per_scan)):
        one = _scan(spark, vectors, pd.DataFrame(part, columns=q.columns), k, key, schema)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(spark, vectors: DataFrame, queries: pd.DataFrame, k: int, key: str, schema: str) -> DataFrame:
    sent = spark.sparkContext.broadcast((queries["query_id"].to_numpy(), np.stack(queries["embedding"]).astype(np.float64)))

    def scan(batches):
        ids, q = sent.value
        for b in batches:
            if not len(b):
                continue
            x, keys = np.stack(b["embedding"]).astype(np.float64), b[key].to_numpy()
            s = q @ x.T
            if len(keys) > k:
                floor = np.partition(s, len(keys) - k, axis=1)[:, len(keys) - k]
                i, j = np.nonzero(s >= floor[:, None])  # ties at the edge stay, the final order decides
            else:
                i, j = (a.ravel() for a in np.indices(s.shape))
            yield pd.DataFrame({"query_id": ids[i], key: keys[j], "similarity": s[i, j]})

    return vectors.where(F.col("embedding").isNotNull()).select(key, "embedding").mapInPandas(scan, schema)


def quantized(v: Column, bits: int = 4) -> Column:
    """Symmetric scalar codes of ``bits`` bits by the largest component, as floats again."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x))).cast("double")
    levels = float(2 ** (bits - 1) - 1)
    return F.when(top > 0, F.transform(v, lambda x: F.floor(x.cast("double") / top * levels + 0.5) / levels * top)).otherwise(v.cast("array<double>"))


LEVELS = 7


def packed(vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``vectors`` with ``code``: the scale of :func:`quantized` (a double) and a nibble for each number, an eighth of the bytes. Null for null."""
    rest = [c for c in vectors.columns if c != "code"]

    def pack(batches):
        for b in batches:
            codes = []
            for v in b.column("embedding").to_pylist():
                if v is None:
                    codes.append(None)
                    continue
                x = np.array(v, np.float32).astype(np.float64)
                top = np.abs(x).max(initial=0.0)
                level = (np.floor(x / top * LEVELS + 0.5) if top > 0 else x).astype(np.int8) + LEVELS
                level = np.append(level, np.zeros(len(level) % 2, np.int8)).astype(np.uint8)
                codes.append(np.float64(top).tobytes() + (level[::2] << 4 | level[1::2]).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(codes, pa.binary())], [*rest, "code"])

    return vectors.select(*rest).mapInArrow(pack, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*rest).schema.fields) + ", code binary")


def coded_top_k(vectors: DataFrame, query: Sequence[float], k: int, key: str = "chunk_id", depth: int | None = None) -> DataFrame:
    """``key, similarity, rank`` of the ``k`` best by the packed codes alone, or of the ``k`` best of the ``depth`` best by their exact similarity.

    A scan of the codes, an eighth of what the vectors take; a task keeps the best of each batch.
    """
    q, n = np.array(query, np.float64), depth or k

    def scan(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            top = raw[:, :8].copy().view(np.float64)[:, 0]
            x = np.stack([raw[:, 8:] >> 4, raw[:, 8:] & 15], axis=2).reshape(b.num_rows, -1)[:, : len(q)].astype(np.float64) - LEVELS
            s = np.einsum("ij,j->i", x / LEVELS * top[:, None], q)
            keep = np.flatnonzero(s >= np.partition(s, len(s) - n)[len(s) - n]) if len(s) > n else np.arange(len(s))  # ties at the edge stay
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(keep)), pa.array(s[keep])], [key, "similarity"])

    best = vectors.where("code is not null").select(key, "code").mapInArrow(scan, f"{key} long, similarity double").orderBy(F.desc("similarity"), key).limit(n)
    if depth is None:
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))  # k rows
    return top_k(vectors, query, k, key, best)
