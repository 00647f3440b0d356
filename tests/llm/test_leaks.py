import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import leaks


def test_words():
    assert leaks.words("Don't Stop-it_now") == ["don", "t", "stop", "it", "now"]
    assert leaks.words("CAFÉ caf\u200be\u0301 ＡＢＣ") == ["cafe", "cafe", "abc"]
    assert leaks.words("soft\u00adhyphen zero\u200dwidth a\x07b") == ["softhyphen", "zerowidth", "ab"]
    assert leaks.words("a\x07b c\x1dd") == ["ab", "c", "d"] and leaks.words(None) == leaks.words("") == []


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 8))
def test_every_window_keeps_its_smallest(values, window):
    g = np.array(values, np.uint64)
    kept = leaks.winnow(g, window)
    for i in range(len(g) - window + 1):
        w = g[i : i + window]
        assert kept[i : i + window][w == w.min()].all()


def brute(docs, items, n):
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    own = {i: grams(leaks.words(t)) for i, t in items}
    return {(d, i) for d, t in docs for i, g in own.items() if g & grams(leaks.words(t))}


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, text(40)) for i in range(12)]
    docs = []
    for d in range(60):
        w = text(rng.randint(0, 80))
        if d % 2:
            _, t = rng.choice(items)
            k = rng.randint(9, 15)
            at = rng.randint(0, len(t) - k)
            w[len(w) // 2 : len(w) // 2] = t[at : at + k]
        docs.append((d, " ".join(w)))
    items = [(i, " ".join(t)) for i, t in items]
    items += [(100, None), (101, ""), (102, "too short"), (103, items[0][1])]
    docs += [(900, None), (901, ""), (902, items[1][1].upper().replace(" ", ",\n")), (902, items[1][1])]
    return docs, items


@pytest.mark.parametrize("probe_chars", [10**6, 0])
def test_both_ways_equal_brute_force(spark, case, probe_chars):
    docs, items = case
    d = spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id long, text string, item_id int, task string")
    i = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in leaks.leaks(d, i, probe_chars=probe_chars).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([(a, b) for a, b in docs if b], [(a, b) for a, b in items if b], 12)
    assert leaks.leaks(d.limit(0), i, probe_chars=probe_chars).count() == 0
    assert leaks.leaks(d, i.limit(0), probe_chars=probe_chars).count() == 0
