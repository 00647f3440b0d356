import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import vectorjoin

SCHEMA = "chunk_id long, shard long, embedding array<float>, ids string, sims string"


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    out = {}
    for i, own in enumerate(ids):
        others = [j for j in range(len(ids)) if j != i]
        out[int(own)] = [int(ids[j]) for j in sorted(others, key=lambda j: (-s[i, j], ids[j]))[:k]]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 64))
    x = np.concatenate([c + 0.2 * rng.standard_normal((30, 64)) for c in centres])
    x = np.concatenate([x, np.repeat(x[:1], 20, axis=0), x[1:4] * 2.5]).astype(np.float32)
    return np.arange(len(x)) * 3 + 1, x


def rows_of(ids, x):
    rows = [(int(i), 1, v.tolist(), "", "") for i, v in zip(ids, x)]
    return [(9000, 1, [2.0], "", "")] + rows + [(9001, None, None, "", ""), (9002, 1, [0.0] * 64, "", ""), (9003, 1, [1.0] * 3, "", ""), (9004, 1, [float("nan")] * 64, "", ""), *rows[5:6], *rows[5:6]]


def test_all_lists_searched_is_exact(spark, data):
    ids, x = data
    df = spark.createDataFrame(rows_of(ids, x), SCHEMA)
    got = {r["chunk_id"]: r["ids"] for r in vectorjoin.neighbours(df, lists=4, probes=None).collect()}
    assert got == brute(ids, x.astype(np.float64), 5)


def test_recall_and_pairs(spark, data):
    ids, x = data
    df = spark.createDataFrame(rows_of(ids, x), SCHEMA)
    want = {(min(a, b), max(a, b)) for a, others in brute(ids, x.astype(np.float64), 5).items() for b in others}
    got = [tuple(r) for r in vectorjoin.pairs(df).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert len(want & set(got)) >= 0.95 * len(want)


def test_small_and_empty(spark, data):
    _, x = data
    df = spark.createDataFrame(rows_of([1, 2], x[:2])[1:3], SCHEMA)
    assert [tuple(r) for r in vectorjoin.pairs(df).collect()] == [(1, 2)]
    assert vectorjoin.pairs(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, 1, [0.0] * 4, "", "")], SCHEMA)
    assert vectorjoin.pairs(none).count() == 0
    flat = spark.createDataFrame([(i, 1, [float(i + 1), 1.0], "", "") for i in range(9)], SCHEMA)
    assert vectorjoin.neighbours(flat, lists=1).count() == 9


def block_of(unit):
    ids = pa.array([[i] for i in range(len(unit))], pa.list_(pa.int64()))
    return vectorjoin.Block(unit, ids, unit.mean(0).astype(np.float32), vectorjoin.rotation(64))


def test_bounds_hold_and_prune(data):
    _, x = data
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    block = block_of(unit)
    r = (unit - block.centroid) @ block.turn.T
    bound = np.c_[r, np.sqrt((r * r).sum(1)), np.ones(len(r))] @ block.columns() + 1 - (r * r).sum(1)[:, None] / 2
    assert (bound >= unit @ unit.T - 1e-5).mean() > 0.998
    assert (bound - unit @ unit.T).mean() < 0.25
    exact = np.round(unit @ unit.T, 12)
    counts, ids, sims, kept, edge = block.search(unit[:50], 6)
    assert (counts == 6).all() and kept.mean() < 0.4 * len(unit)
    for i, (own, s) in enumerate(zip(ids.reshape(50, 6), sims.reshape(50, 6))):
        assert list(own) == sorted(range(len(unit)), key=lambda j: (-exact[i, j], j))[:6]
        assert np.allclose(s, exact[i, own]) and abs(edge[i] - s[-1]) < 1e-5


def test_a_threshold_leaves_out_what_is_below(data):
    _, x = data
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    counts, ids, sims, kept, _ = block_of(unit).search(unit[:20], 6, np.full(20, 0.9999, np.float32))
    assert (sims >= 0.9998).all() and counts.min() >= 1 and kept.mean() < 0.2 * len(unit)


def test_no_list_that_holds_a_better_vector_is_passed_over(data):
    _, x = data
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = vectorjoin.fit(unit, 9)
    near, best = vectorjoin._nearest(unit, c, 1)
    near, radii = near[:, 0], np.full(9, -1, np.float32)
    np.maximum.at(radii, near, np.sqrt(np.maximum(0, best[:, 0] + 1)))
    lists = vectorjoin.Lists(c, radii, None)
    sim = unit @ unit.T
    for i in range(0, len(unit), 7):
        tau = np.sort(sim[i][near == near[i]])[-6:][0]
        asked = set(lists.others(unit[i : i + 1], int(near[i]), np.array([tau]))[1].tolist())
        assert {int(n) for n, s in zip(near, sim[i]) if s > tau + 1e-6 and n != near[i]} <= asked


def test_kept_share(spark, data):
    ids, x = data
    df = spark.createDataFrame(rows_of(ids, x), SCHEMA)
    r = vectorjoin.kept_share(df, lists=2).first()
    assert 0 < r["share"] < 0.5 and r["compared"] < r["estimated"] and r["blocks"] >= 1
    assert vectorjoin.kept_share(df.limit(0)).first()["estimated"] == 0


def test_skewed_lists_are_cut_in_blocks(spark, data, monkeypatch):
    ids, x = data
    df = spark.createDataFrame(rows_of(ids, x), SCHEMA)
    want = {r["chunk_id"]: r["ids"] for r in vectorjoin.neighbours(df, lists=2, probes=2).collect()}
    monkeypatch.setattr(vectorjoin, "BLOCK", 40)
    assert {r["chunk_id"]: r["ids"] for r in vectorjoin.neighbours(df, lists=2, probes=2).collect()} == want
