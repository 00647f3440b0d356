"""BM25 keyword search over an inverted index.

Words are runs of letters and digits without case and diacritics; ``_`` separates. A query word
that holds several of them is a phrase. Statistics are over all chunks, also where a filter narrows
which of them may be found.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache, reduce
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.plans.tables import spread, stage

K1, B = 1.2, 0.75
#: An idf that is not positive counts as this.
IDF_FLOOR = 1e-6
#: Buckets that a stored index is laid out by; a query reads those of its terms.
BUCKETS = 32
#: Words of queries that one scan of the texts answers; more are answered by several scans.
SCAN_WORDS = 500_000
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else folded(text))


def phrases(query: str) -> list[tuple[str, ...]]:
    """The phrases of a query, one for each run of letters, digits and ``_``; anything else is only a separator."""
    found = (tuple(tokens(part)) for part in re.findall(r"\w+", query))
    return [p for p in found if p]


def tokenized(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, words``, from Arrow batch to Arrow batch."""

    def split(batches):
        for b in batches:
            words, ends = [], [0]
            for t in b.column("text").to_pylist():
                words += tokens(t)
                ends.append(len(words))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()))], [key, "words"])

    return spread(chunks.select(key, "text")).mapInArrow(split, f"{key} {chunks.schema[key].dataType.simpleString()}, words array<string>")


def postings(words: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``term, key, positions, n_tokens``: the inverted index. Every row has a key of its own, so its postings are made where it is."""

    def invert(batches):
        for b in batches:
            terms, keys, ends, places, sizes = [], [], [0], [], []
            for i, ws in zip(b.column(key).to_pylist(), b.column("words").to_pylist(), strict=True):
                at: dict[str, list[int]] = {}
                for n, w in enumerate(ws):
                    at.setdefault(w, []).append(n)
                for w, ns in at.items():
                    terms.append(w)
                    places += ns
                    ends.append(len(places))
                keys += [i] * len(at)
                sizes += [len(ws)] * len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array(keys, b.schema.field(key).type), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32())), pa.array(sizes, pa.int32())], ["term", key, "positions", "n_tokens"]
            )

    return words.mapInArrow(invert, f"term string, {key} {words.schema[key].dataType.simpleString()}, positions array<int>, n_tokens int")


@lru_cache(1 << 17)
def bucket(term: str) -> int:
    return crc32(term.encode()) % BUCKETS


def write_postings(index: DataFrame, path: str) -> None:
    """Store postings by bucket of their term and sorted by it, so that a query reads few files and row groups of them."""
    rows = index.withColumn("bucket", F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(BUCKETS)).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_words(texts: DataFrame, postings_at: str, lengths_at: str, ids: list[str]) -> None:
    """Write what :func:`write_postings` writes, and ``ids, n_tokens`` of ``texts(ids, text)``, into folders that all executors mount.

    Postings pass from task to task as one block for each bucket and batch of texts, sorted where they are made, and never as rows.
    ``ids`` are longs, the first of them the key.
    """

    def invert(batches):
        for b in batches:
            words = [tokens(t) for t in b.column("text").to_pylist()]
            sizes = np.fromiter(map(len, words), np.int32, len(words))
            flat = pa.array([w for ws in words for w in ws], pa.string()).dictionary_encode()
            terms = flat.dictionary.to_pylist()
            of_term = np.fromiter(map(bucket, terms), np.int64, len(terms))
            order = np.array(sorted(range(len(terms)), key=lambda i: (of_term[i], terms[i])), np.int64)
            rank = np.empty(len(terms), np.int64)
            rank[order] = np.arange(len(terms))
            code, row = rank[flat.indices.to_numpy()], np.repeat(np.arange(len(words)), sizes)
            place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            by = np.argsort(code, kind="stable")  # rows and places stay in order within a term
            code, row, place = code[by], row[by], place[by].astype(np.int32)
            starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])]) if len(code) else np.zeros(0, np.int64)
            own = [b.column(c).to_numpy() for c in ids]
            rows = pa.RecordBatch.from_arrays(
                [flat.dictionary.take(pa.array(order[code[starts]])), *(pa.array(x[row[starts]]) for x in own), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(code)], pa.int32()), pa.array(place)), pa.array(sizes[row[starts]])],
                ["term", *ids, "positions", "n_tokens"],
            )
            ends = np.searchsorted(of_term[order][code[starts]], np.arange(BUCKETS + 1))
            parts = {i: rows.slice(ends[i], ends[i + 1] - ends[i]) for i in range(BUCKETS) if ends[i] < ends[i + 1]}
            parts[BUCKETS] = pa.RecordBatch.from_arrays([*(pa.array(x) for x in own), pa.array(sizes)], [*ids, "n_tokens"])
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([_block(x) for x in parts.values()], pa.binary())], ["bucket", "block"])

    def write(batches):
        blocks = defaultdict(list)
        for b in batches:
            for i, x in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
                blocks[i].append(pa.ipc.open_stream(x).read_all())
        for i, parts in blocks.items():
            rows = pa.concat_tables(parts)
            folder = lengths_at if i == BUCKETS else f"{postings_at}/bucket={i}"
            os.makedirs(folder, exist_ok=True)
            tmp = f"{folder}/_{uuid4().hex}"
            pq.write_table(rows if i == BUCKETS else rows.sort_by([("term", "ascending"), (ids[0], "ascending")]), tmp, compression="zstd", row_group_size=1 << 17)
            os.replace(tmp, f"{folder}/part-{i:05d}.zstd.parquet")  # a task that is repeated replaces it
        yield pa.RecordBatch.from_arrays([pa.array([len(blocks)], pa.int64())], ["n"])

    made = spread(texts.select(*ids, "text")).mapInArrow(invert, "bucket int, block binary").repartition(BUCKETS + 1, "bucket")
    made.mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one number


def _block(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    return out.getvalue().to_pybytes()


def of_query(index: DataFrame, query: str) -> DataFrame:
    """The postings of a query's terms; of a stored index only their buckets are read."""
    terms = sorted({t for p in phrases(query) for t in p})
    if "bucket" in index.columns:
        index = index.where(F.col("bucket").isin(sorted({bucket(t) for t in terms})))
    return index.where(F.col("term").isin(terms))


def lengths(words: DataFrame, key: str = "chunk_id") -> DataFrame:
    return words.select(key, F.size("words").alias("n_tokens"))


def occurrences(index: DataFrame, wanted: list[tuple[str, ...]], key: str = "chunk_id") -> DataFrame:
    """``phrase, key, f, n_tokens``: how often each phrase of the query occurs in each text.

    ``index`` holds the postings of the query's terms. A single word occurs as often as it has places; a phrase needs its n-th term
    at n places after its first: an equality on term and starting position, counted once.
    """
    slots: dict[str, list] = {}
    for i, p in enumerate(wanted):
        for n, term in enumerate(p):
            slots.setdefault(term, []).append(F.struct(F.lit(i).alias("phrase"), F.lit(n).alias("slot"), F.lit(len(p)).alias("size")))
    told = F.create_map(*(x for term, at in slots.items() for x in (F.lit(term), F.array(*at))))  # the words of the query
    near = index.withColumn("_at", F.explode(told[F.col("term")])).select(key, "positions", "n_tokens", "_at.*")
    found = near.where("size = 1").select("phrase", key, F.size("positions").cast("long").alias("f"), "n_tokens")
    if all(len(p) == 1 for p in wanted):
        return found
    starts = near.where("size > 1").select("phrase", key, "size", "n_tokens", F.explode("positions").alias("at"), "slot").withColumn("start", F.col("at") - F.col("slot"))
    whole = starts.groupBy("phrase", key, "start").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("n_tokens").alias("n_tokens")).where("n = size")
    return found.unionByName(whole.groupBy("phrase", key).agg(F.count("*").alias("f"), F.first("n_tokens").alias("n_tokens")))


def totals(n_tokens: DataFrame) -> tuple[int, float]:
    """How many texts there are and how many words they have on the average, as a store keeps it."""
    r = n_tokens.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("average")).first()
    return r["n"], r["average"] or 0.0


def bm25(index: DataFrame, total: tuple[int, float], query: str, key: str = "chunk_id", allowed: DataFrame | None = None) -> DataFrame:
    """``key, score`` of the texts with a phrase of the query; the larger the better.

    ``total`` is that of :func:`totals`. A query without any word finds nothing. Repeated phrases count repeatedly.
    """
    wanted = phrases(query)
    if not wanted:
        return index.sparkSession.createDataFrame([], f"{key} long, score double")
    n_all, average = total
    found = occurrences(of_query(index, query), wanted, key)
    idf = F.log((n_all - F.col("n_in") + 0.5) / (F.col("n_in") + 0.5))
    weight = found.groupBy("phrase").agg(F.count("*").alias("n_in")).select("phrase", F.when(idf > 0, idf).otherwise(IDF_FLOOR).alias("idf"))  # a row for each phrase
    rows = found if allowed is None else found.join(allowed.select(key).distinct(), key, "left_semi")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.lit(float(average))))
    return rows.join(F.broadcast(weight), "phrase").groupBy(key).agg(F.sum(part).alias("score"))


def bm25_batch(index: DataFrame, total: tuple[int, float], queries: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """``query_id, key, score, rank`` for many queries of single words, ``queries(query_id, term)``, a row for each word.

    One join on the term answers them all; terms that many texts hold are split by AQE.
    """
    n_all, average = total
    asked = queries.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    near = index.join(asked.select("term").distinct(), "term", "left_semi").select("term", key, F.size("positions").alias("f"), "n_tokens")
    idf = F.log((n_all - F.col("n_in") + 0.5) / (F.col("n_in") + 0.5))
    weight = near.groupBy("term").agg(F.count("*").alias("n_in")).select("term", F.when(idf > 0, idf).otherwise(IDF_FLOOR).alias("idf"), F.lit(float(average)).alias("average"))
    rows = near.join(weight, "term")
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("average")))
    scored = rows.select("term", key, part.alias("part")).join(asked, "term").groupBy("query_id", key).agg(F.round(F.sum(F.col("part") * F.col("times")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def counted(texts: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, n_tokens, terms, times``: the words of each text once, with how often it holds them."""

    def count(batches):
        for b in batches:
            sizes, terms, times, ends = [], [], [], [0]
            for t in b.column("text").to_pylist():
                words = tokens(t)
                at = Counter(words)
                sizes.append(len(words))
                terms += at.keys()
                times += at.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))], [key, "n_tokens", "terms", "times"]
            )

    return spread(texts.select(key, "text")).mapInArrow(count, f"{key} {texts.schema[key].dataType.simpleString()}, n_tokens int, terms array<string>, times array<int>")


def known_item_ranks(texts: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """``query_id, rank`` of the text that has the query's own id, where it is among the ``k`` best; ``queries(query_id, term)`` as for :func:`bm25_batch`.

    Only texts that beat a query's own one matter, and its score is known before: a text is looked at if the words of the query that it
    may hold could reach that score, and nothing about a pair of query and text leaves the scan.
    """
    held = stage(counted(texts, key), "counted")
    total = totals(held)
    asked = stage(queries.groupBy("query_id", "term").agg(F.count("*").alias("times")), "asked")
    blocks = -(-asked.count() // SCAN_WORDS)
    parts = [_ranks_of(held, total, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k, key) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts) if parts else asked.select("query_id", F.lit(1).alias("rank")).limit(0)


def _ranks_of(held: DataFrame, total: tuple[int, float], asked: DataFrame, k: int, key: str) -> DataFrame:
    """The ranks of one scan's queries, whose words the driver and every task hold."""
    rows = asked.toArrow()  # SCAN_WORDS or so
    if not rows.num_rows:
        return asked.select("query_id", F.lit(1).alias("rank"))
    words = pc.unique(rows.column("term"))
    ids, own_row = np.unique(rows.column("query_id").to_numpy(), return_inverse=True)
    term_of = pc.index_in(rows.column("term"), value_set=words).to_numpy().astype(np.int64)
    codes, n_all, average = np.sort(own_row * len(words) + term_of), total[0], total[1] or 1.0

    def entries(b):
        """Of a batch the place, word, count and saturation of what queries ask for."""
        terms, times = b.column("terms"), b.column("times")
        term = pc.index_in(terms.flatten(), value_set=words)
        kept = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        at = np.repeat(np.arange(b.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))[kept]
        f, n = times.flatten().to_numpy(zero_copy_only=False)[kept].astype(np.float64), b.column("n_tokens").to_numpy(zero_copy_only=False)[at]
        return at, term.fill_null(-1).to_numpy(zero_copy_only=False)[kept], f * (K1 + 1) / (f + K1 * (1 - B + B * n / average))

    def about(batches):
        """How many texts hold each word, the most that it counts in one, and what it counts in the queries' own."""
        n_in, most, mine = np.zeros(len(words), np.int64), np.zeros(len(words)), []
        for b in batches:
            at, term, part = entries(b)
            n_in += np.bincount(term, minlength=len(words))
            np.maximum.at(most, term, part)
            keys = b.column(key).fill_null(-1).to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
            is_own = ((ids[place] == keys) & b.column(key).is_valid().to_numpy(zero_copy_only=False))[at]
            code = place[at][is_own] * len(words) + term[is_own]
            asked_for = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
            mine.append((code[asked_for], part[is_own][asked_for]))
        seen = np.flatnonzero(n_in)
        code, part = (np.concatenate(x) for x in zip(*mine, strict=True)) if mine else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([-1 - seen, code]), np.concatenate([n_in[seen], np.ones(len(code), np.int64)]), np.concatenate([most[seen], part]))], ["code", "n", "part"])

    told = held.mapInArrow(about, "code long, n long, part double").groupBy("code").agg(F.sum("n").alias("n"), F.max("part").alias("part")).toArrow()
    code, n, part = (told.column(c).to_numpy() for c in ("code", "n", "part"))
    n_in, most, of_term = np.zeros(len(words)), np.zeros(len(words)), code < 0
    n_in[-1 - code[of_term]], most[-1 - code[of_term]] = n[of_term], part[of_term]
    idf = np.log((n_all - n_in + 0.5) / (n_in + 0.5))
    idf = np.where(idf > 0, idf, IDF_FLOOR)
    in_own = dict(zip(code[~of_term].tolist(), part[~of_term].tolist(), strict=True))
    weight = rows.column("times").to_numpy() * idf[term_of]
    order = np.lexsort((term_of, own_row))
    starts = np.searchsorted(own_row[order], np.arange(len(ids) + 1))
    plans = []  # id, score of the own text, words and weights, the words without which no text reaches that score, and what the others could add to them
    for q in range(len(ids)):
        own = order[starts[q] : starts[q + 1]]
        parts = [in_own.get(q * len(words) + int(t)) for t in term_of[own]]
        if all(p is None for p in parts):
            continue
        score = 0.0
        for w, p in zip(weight[own].tolist(), parts, strict=True):
            score += w * (p or 0.0)
        bound = weight[own] * most[term_of[own]]
        by = np.argsort(bound, kind="stable")
        slack = np.cumsum(bound[by]) * (1 + 1e-9) + 1e-8  # rounding and the order of a sum
        spare = min(int(np.searchsorted(slack, score)), len(own) - 1)
        plans.append((int(ids[q]), score, list(zip(term_of[own].tolist(), weight[own].tolist(), strict=True)), [(int(term_of[own][i]), float(weight[own][i])) for i in by[spare:]], float(slack[spare - 1]) if spare else 1e-8))

    def better(batches):
        """How many texts come before the own one, for each query that has such; a task stops counting at ``k``."""
        found, open_plans = {}, plans
        for b in batches:
            at, term, part = entries(b)
            by = np.argsort(term, kind="stable")
            at, part = at[by], part[by]
            ends = np.searchsorted(term[by], np.arange(len(words) + 1)).tolist()
            keys, sums = b.column(key).to_numpy(), np.zeros(b.num_rows)
            for own, score, all_words, needed, more in open_plans:
                some = False
                for t, w in needed:
                    lo, hi = ends[t], ends[t + 1]
                    if lo < hi:
                        sums[at[lo:hi]] += w * part[lo:hi]
                        some = True
                if not some:
                    continue
                near = np.flatnonzero(sums >= max(score - more, 1e-300))
                for t, _ in needed:
                    sums[at[ends[t] : ends[t + 1]]] = 0.0
                if not len(near):
                    continue
                whole = np.zeros(len(near))
                for t, w in all_words:  # in the order in which the own one was summed up
                    lo, hi = ends[t], ends[t + 1]
                    if lo < hi:
                        place = np.minimum(lo + np.searchsorted(at[lo:hi], near), hi - 1)
                        whole += np.where(at[place] == near, w * part[place], 0.0)
                whole, least = np.round(whole, 9), np.round(score, 9)
                n = int(((whole > least) | ((whole == least) & (keys[near] < own))).sum())
                if n:
                    found[own] = found.get(own, 0) + n
            open_plans = [p for p in open_plans if found.get(p[0], 0) < k]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["query_id", "n"])

    before = held.where(F.col(key).isNotNull()).mapInArrow(better, "query_id long, n long").groupBy("query_id").agg(F.sum("n").alias("n"))
    known = held.sparkSession.createDataFrame(pa.table({"query_id": pa.array([p[0] for p in plans], pa.int64())}))
    return known.join(before, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("rank")).where(F.col("rank") <= k)


def keyword_top(scores: DataFrame, k: int, key: str = "chunk_id", digits: int = 9) -> DataFrame:
    """``key, score, rank`` of the ``k`` best. Scores are rounded first, so that the order of summation decides no tie."""
    best = scores.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows
