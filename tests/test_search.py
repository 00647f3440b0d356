import random
import sqlite3

import numpy as np
import pytest

from siltstone.functions.filters import Filter
from siltstone.operators import change, fusion, keyword, vectors

TEXTS = [
    "const EMBED_BATCH: usize = 32;", "a paragraph about retry backoff and jitter", "the embed batch of the café", "Café EMBED embed_batch batch embed", "", None, "nothing here at all, nothing",
    "über straße œuvre naïve", "retry retry retry", "backoff_and_jitter",
]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string")
    words = keyword.tokenized(rows).cache()
    return keyword.postings(words), keyword.totals(keyword.lengths(words))


@pytest.mark.parametrize("query", ["EMBED_BATCH", "retry backoff", "cafe", "retry retry jitter", "naive straße", "backoff_and_jitter nothing", "œuvre ÜBER"])
def test_bm25_agrees_with_fts5(index, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='unicode61')")
    db.executemany("insert into t(rowid, x) values (?, ?)", [(i, t or "") for i, t in enumerate(TEXTS)])
    import re

    match = " OR ".join(f'"{w}"' for w in re.findall(r"\w+", query))
    want = {r: -s for r, s in db.execute("select rowid, rank from t where t match ? order by rank", (match,))}
    got = {r["chunk_id"]: r["score"] for r in keyword.bm25(*index, query).collect()}
    assert set(got) == set(want)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


@pytest.mark.parametrize("query", ["!!! ???", "", '" ( *', "_"])
def test_queries_without_words_find_nothing(index, query):
    assert keyword.bm25(*index, query).count() == 0


def test_batch_agrees_with_single(spark, index):
    asked = spark.createDataFrame([(1, "retry"), (1, "jitter"), (2, "batch"), (2, "batch")], "query_id long, term string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in keyword.bm25_batch(*index, asked, 10).collect()}
    want = {(q, r["chunk_id"]): r["score"] for q, t in ((1, "retry jitter"), (2, "batch batch")) for r in keyword.bm25(*index, t).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in got)


@pytest.mark.parametrize("scan", [500_000, 150])
def test_known_items_rank_as_the_batch_has_them(spark, monkeypatch, scan):
    """Also over several scans, with copies (the smaller id comes first), more than k better texts and a text without an id."""
    monkeypatch.setattr(keyword, "SCAN_WORDS", scan)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(3, 60)) % 40)) for i in range(120)]
    rows += [(i + 200, t) for i, t in rows[:60]] + [(500, ""), (None, "w1 w2"), (501, "w1 " * 40 + "pad " * 400)]
    texts = spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, w) for i, t in rows if i is not None for w in t.split()[:4]], "query_id long, term string")
    words = keyword.tokenized(texts)
    best = keyword.bm25_batch(keyword.postings(words), keyword.totals(keyword.lengths(words)), asked, 10).where("chunk_id = query_id")
    want = {(r["query_id"], r["rank"]) for r in best.collect()}
    ranks = {(r["query_id"], r["rank"]) for r in keyword.known_item_ranks(texts, asked, 10).collect()}
    assert ranks == want and 10 < len(want) < len({i for i, _ in rows}) - 2


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 8)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    s = x.astype(float) @ x[3].astype(float)
    want = sorted(range(50), key=lambda i: (-s[i], i))[:5]
    assert [r["chunk_id"] for r in vectors.top_k(df, x[3].tolist(), 5).orderBy("rank").collect()] == want
    allowed = spark.createDataFrame([(9,), (9,), (1,)], "chunk_id long")
    assert {r["chunk_id"] for r in vectors.top_k(df, x[3].tolist(), 5, allowed=allowed).collect()} == {1, 9}
    q = df.where("chunk_id < 4").selectExpr("chunk_id as query_id", "embedding")
    got = vectors.top_k_batch(df, q, 5, "chunk_id").collect()
    assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 3] == want
    old, vectors.QUERY_CELLS = vectors.QUERY_CELLS, 16
    try:
        assert {tuple(r) for r in vectors.top_k_batch(df, q, 5, "chunk_id").collect()} == {tuple(r) for r in got}
    finally:
        vectors.QUERY_CELLS = old
    assert vectors.top_k_batch(df, q.limit(0), 5, "chunk_id").count() == 0
    zero = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [[round(y, 6) for y in r[0]] for r in zero.select(vectors.normalized(zero.v)).collect()] == [[0, 0], [0.6, 0.8]]


def test_fusion_keeps_first_seen_order_on_ties(spark):
    dense = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 2)], "chunk_id long, similarity double, rank int")
    words = spark.createDataFrame([(3, 5.0, 1), (2, 4.0, 2)], "chunk_id long, score double, rank int")
    rows = fusion.fuse(dense, words, 3).orderBy("position").collect()
    assert [(r["chunk_id"], r["similarity"]) for r in rows] == [(2, 0.8), (1, 0.9), (3, 0.0)]
    assert abs(rows[0]["score"] - 2 / 62) < 1e-7


def greedy(queues, k):
    queues, out = [list(q) for q in queues], []
    while len(out) < k and any(queues):
        best = max((i for i, q in enumerate(queues) if q), key=lambda i: (queues[i][0][0], queues[i][0][1], -i))
        out.append((best, queues[best].pop(0)[2]))
    return out


def test_merge_equals_the_greedy_choice(spark):
    rng = random.Random(1)
    for _ in range(6):
        queues = [sorted(((rng.choice([1.0, 0.5, 0.25]), rng.choice([-0.2, 0.0, 0.3, 0.6]), i) for i in range(rng.randint(0, 7))), key=lambda x: -x[0]) for _ in range(4)]
        rows = [(f"s{o}", o, p, s, sim, i) for o, q in enumerate(queues) for p, (s, sim, i) in enumerate(q)]
        if rows:
            df = spark.createDataFrame(rows, "store string, store_ord int, position int, score double, similarity double, id int")
            assert [(r["store_ord"], r["id"]) for r in fusion.merge(df, 9).orderBy("merged").collect()] == greedy(queues, 9)


def test_search_filters_before_it_ranks(spark):
    files = spark.createDataFrame([(i, f"/p/{'sub' if i < 4 else 'noise'}/f{i}.md") for i in range(40)], "file_id long, path string")
    chunks = spark.createDataFrame([(i, i, 0, 1, 1, f"retry backoff {'noise ' * (i % 3)}") for i in range(40)], "chunk_id long, file_id long, ord int, start_line int, end_line int, text string")
    vecs = spark.createDataFrame([(i, [1.0 if i > 5 else 0.1, 0.2]) for i in range(40)] + [(0, None)], "chunk_id long, embedding array<float>")
    words = keyword.tokenized(chunks)
    hits = fusion.search(files, chunks, vecs, keyword.postings(words), keyword.totals(keyword.lengths(words)), "retry", [1.0, 0.0], 4, Filter.of(paths=["sub/**"])).collect()
    assert len(hits) == 4 and all("/sub/" in h["path"] for h in hits)
    assert fusion.search(files, chunks, vecs, keyword.postings(words), keyword.totals(keyword.lengths(words)), "retry", [1.0, 0.0], 0).count() == 0


def test_change_detection(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    files = spark.createDataFrame([(1, "/a", "x", 5), (2, "/b", "", 5), (3, "/c", "z", None)], "file_id long, path string, hash string, bytes long")
    listing = spark.createDataFrame([(1, "/a", "X", t), (2, "/b", "y", t), (3, "/d", "w", t)], "arrival_no long, path string, hash string, seen_at timestamp_ntz")
    assert {tuple(r) for r in change.statuses(files, listing).collect()} == {("/a", "unchanged"), ("/b", "unfinished"), ("/c", "unlisted"), ("/d", "new")}
    assert [r["path"] for r in change.vanished(files, listing).collect()] == ["/c"]
    batch = spark.createDataFrame([("/c",), ("/d",), ("/e",)], "path string")
    assert {r[0] for r in change.admissible(batch, listing, files).collect()} == {"/c", "/d"}
    assert change.store_stats(files, spark.createDataFrame([(1, 1)], "chunk_id long, file_id long")).first()["bytes"] == 10


def test_packed_codes(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 5)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 5), (901, None)]
    df = vectors.packed(spark.createDataFrame(rows, "chunk_id long, embedding array<float>"))
    assert {len(r["code"]) for r in df.where("code is not null").collect()} == {8 + 3}
    q = x[7].tolist()
    top = np.abs(x.astype(np.float64)).max(1)[:, None]
    s = (np.floor(x / top * 7 + 0.5) / 7 * top) @ np.array(q)
    want = sorted(range(300), key=lambda i: (-s[i], i))[:10]
    assert [r["chunk_id"] for r in vectors.coded_top_k(df, q, 10).orderBy("rank").collect()] == want
    exact = x.astype(np.float64) @ np.array(q)
    assert [r["chunk_id"] for r in vectors.coded_top_k(df, q, 3, depth=60).orderBy("rank").collect()] == sorted(range(300), key=lambda i: (-exact[i], i))[:3]
    assert vectors.coded_top_k(df.limit(0), q, 3).count() == 0
