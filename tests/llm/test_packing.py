import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import packing, tokens


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 60), max_size=80), st.sampled_from([60, 100]))
def test_plan_uses_each_item_once(sizes, capacity):
    counts = np.bincount(sizes, minlength=capacity + 1)
    used = np.zeros(capacity + 1, int)
    for r in packing.plan(counts, capacity):
        assert sum(x * k for x, k in r.lengths.items()) <= capacity and r.times > 0
        for x, k in r.lengths.items():
            used[x] += k * r.times
    assert (used == counts).all()


def test_exact_complements_leave_nothing():
    counts = np.bincount([50] * 5 + [30] * 5 + [20] * 5 + [70] * 3 + [15] * 6, minlength=101)
    assert sum(r.times for r in packing.plan(counts, 100)) == 8  # 800 tokens in all


def test_triples_respect_counts():
    have = packing.Availability(np.bincount([10, 20, 20], minlength=101))
    assert have.triple(50) == (20, 20, 10) and have.triple(60) is None and have.pair(40) == (20, 20) and have.pair(20) is None
    assert have.exact(31) is None and have.largest(15) == 10 and have.largest(5) == 0


def test_large_counts_need_few_recipes():
    rng = np.random.default_rng(0)
    counts = np.zeros(4097, np.int64)
    counts[rng.integers(50, 2000, 300)] += 10**9
    plan = packing.plan(counts)
    assert len(plan) < 1500
    total = int((counts * np.arange(4097)).sum())
    assert sum(r.times for r in plan) * 4096 < total * 1.001


def test_documents(spark):
    long = "word " * 9000
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (5, "hello world", "x"), (5, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    out = packing.pack(df).collect()
    n = tokens.count(long)
    own = sorted((r["part"], r["token_from"], r["n"]) for r in out if r["doc_id"] == 4)
    assert [o[1] for o in own] == [4096 * i for i in range(len(own))] and sum(o[2] for o in own) == n
    assert sorted(r["doc_id"] for r in out if r["doc_id"] != 4) == [1, 5, 5]
    fill = {}
    for r in out:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n"]
    assert max(fill.values()) <= 4096 and len(fill) == -(-sum(fill.values()) // 4096)
    assert [r[0] for r in packing.oversized(df).collect()] == [4]
    assert packing.oversized(df.limit(0)).count() == 0
    assert packing.fill_report(packing.pack(df.where("doc_id = 1"))).first()["containers"] == 1


def test_parts_keep_the_text():
    old, tokens.PART_CHARS = tokens.PART_CHARS, 10
    try:
        for text in ("", "abc def ghi jkl\nmno", "x" * 35, "\n" * 25):
            assert "".join(tokens.parts(text)) == text and all(len(p) <= 10 for p in tokens.parts(text))
    finally:
        tokens.PART_CHARS = old
